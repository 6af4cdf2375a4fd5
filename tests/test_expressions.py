import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.errors import ExpressionError, ForbiddenFunction
from quillon.functions.expr import Call, Literal, Name, compile_expression, has_aggregate, parse, split_inline


def test_precedence_and_names():
    assert parse("a + b * 2") == Call("+", (Name("a"), Call("*", (Name("b"), Literal(2)))))
    assert parse("(a - b) - c") == parse("a - b - c")
    assert parse("order.customer$caption") == Name("order.customer$caption")
    assert parse("NOT a = 1 AND b") == Call("AND", (Call("NOT", (Call("=", (Name("a"), Literal(1))),)), Name("b")))
    assert parse("'it''s'") == Literal("it's")


@given(st.integers(0, 99), st.integers(1, 99), st.integers(0, 99))
def test_arithmetic_reads_like_python(a, b, c):
    def value(n):
        if isinstance(n, Literal):
            return n.value
        x, y = map(value, n.args)
        return {"+": x + y, "-": x - y, "*": x * y, "%": x % y if y else 0}[n.function]

    for text in (f"{a}+{b}*{c}", f"({a}-{b})*{c}", f"{a}-{b}-{c}", f"{a}*{c}%{b}"):
        assert value(parse(text)) == eval(text)


@pytest.mark.parametrize("text", ["", "a +", "a b", "f(", "a ,", "1 ; 2", "`x`", "a..b"])
def test_unreadable(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_only_whitelisted_functions():
    for text in ("sleep(1)", "reflect('java.lang.System', 'exit')", "ABS(load_file('x'))"):
        with pytest.raises(ForbiddenFunction):
            compile_expression(parse(text), F.col)
    with pytest.raises(ExpressionError):
        compile_expression(parse("ABS(1, 2)"), F.col)
    with pytest.raises(ExpressionError):
        compile_expression(parse("SUM(SUM(a))"), F.col, lambda how, c: F.sum(c))


def test_aggregates_are_seen_through_names():
    assert has_aggregate(parse("1 + SUM(a)"))
    assert not has_aggregate(parse("1 + a"))
    assert has_aggregate(parse("1 + a"), lambda n: n == "a")


def test_inline():
    assert split_inline("sum(a) AS total") == ("sum(a)", "total")
    assert split_inline("plain$caption") is None


def test_division_by_zero_is_null(spark):
    row = spark.range(1).select(compile_expression(parse("1 / (id - id)"), F.col).alias("a"), compile_expression(parse("MOD(7, id)"), F.col).alias("b")).first()
    assert row.a is None and row.b is None


def test_registered_function(spark):
    from quillon.functions.expr import FUNCTIONS, register_function

    register_function("twice", lambda c: c * 2)
    try:
        assert spark.range(3).select(compile_expression(parse("TWICE(id) + 1"), F.col).alias("x")).agg(F.sum("x")).first()[0] == 9
    finally:
        del FUNCTIONS["TWICE"]
