"""Calculated fields: a small expression language with a whitelist of functions, compiled to Spark columns.

Values get in as literals and names as resolved fields; there is no way to pass text to the SQL parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import ExpressionError, ForbiddenFunction

TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+\.\d*|\.\d+|\d+)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\$[A-Za-z_][\w$]*)?)"
    r"|'(?P<single>(?:[^'\\]|\\.|'')*)'|\"(?P<double>(?:[^\"\\]|\\.)*)\"|(?P<op><=|>=|<>|!=|==|&&|\|\||[-+*/%(),=<>!]))"
)
AGGREGATES = ("SUM", "AVG", "COUNT", "MAX", "MIN", "GROUP_CONCAT")
LEFT = {"OR": 1, "||": 1, "AND": 2, "&&": 2, "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple


Node = Literal | Name | Call


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at:]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind in ("single", "double"):
            kind, value = "string", re.sub(r"\\(.)|''", lambda x: x[1] or "'", value)
        elif kind == "name" and value.upper() in ("AND", "OR", "NOT"):
            kind, value = "op", value.upper()
        out.append((kind, value))
        at = m.end()
    return out


def parse(text: str) -> Node:
    """Syntax tree of an expression; operators become calls named by their sign."""
    found = tokens(text)
    at = 0

    def peek() -> tuple[str, str]:
        return found[at] if at < len(found) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        token = peek()
        if token[0] == "end" or value is not None and token != ("op", value):
            raise ExpressionError(f"{value or 'more'} expected in {text!r}")
        at += 1
        return token

    def operand() -> Node:
        kind, value = take()
        if kind == "number":
            return Literal(float(value) if "." in value else int(value))
        if kind == "string":
            return Literal(value)
        if kind == "name":
            if peek() != ("op", "("):
                word = value.upper()
                return Literal({"NULL": None, "TRUE": True, "FALSE": False}[word]) if word in ("NULL", "TRUE", "FALSE") else Name(value)
            take("(")
            args = []
            while peek() != ("op", ")"):
                if args:
                    take(",")
                if peek() == ("op", "*") and not args:
                    take()
                    args.append(Literal("*"))
                else:
                    args.append(expression(0))
            take(")")
            return Call(value.upper(), tuple(args))
        if value == "(":
            inside = expression(0)
            take(")")
            return inside
        if value == "-":
            return Call("NEG", (expression(7),))
        if value == "+":
            return expression(7)
        if value in ("NOT", "!"):
            return Call("NOT", (expression(3),))
        raise ExpressionError(f"{value!r} out of place in {text!r}")

    def expression(least: int) -> Node:
        left = operand()
        while peek()[0] == "op" and LEFT.get(peek()[1], 0) > least:
            sign = take()[1]
            left = Call(sign, (left, expression(LEFT[sign])))
        return left

    tree = expression(0)
    if at < len(found):
        raise ExpressionError(f"{found[at][1]!r} out of place in {text!r}")
    return tree


def names_in(node: Node) -> list[str]:
    if isinstance(node, Name):
        return [node.text]
    return [n for a in node.args for n in names_in(a)] if isinstance(node, Call) else []


def has_aggregate(node: Node, is_aggregate: Callable[[str], bool] = lambda name: False) -> bool:
    if isinstance(node, Name):
        return is_aggregate(node.text)
    return isinstance(node, Call) and (node.function in AGGREGATES or any(has_aggregate(a, is_aggregate) for a in node.args))


def _fixed(n: int, make: Callable[..., Column]) -> Callable[..., Column]:
    def checked(*args: Column) -> Column:
        if len(args) != n:
            raise ExpressionError(f"{n} arguments expected, {len(args)} given")
        return make(*args)

    return checked


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substr(s, start, length) if length is not None else F.substr(s, start)


def _round(x: Column, n: Column | None = None) -> Column:
    return F.round(x, n if n is not None else F.lit(0))


def _text(c: Column) -> Column:
    return c.cast("string")


#: What an expression may call.  Spark's own signs differ: / and % of zero give null here.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "+": _fixed(2, lambda a, b: a + b),
    "-": _fixed(2, lambda a, b: a - b),
    "*": _fixed(2, lambda a, b: a * b),
    "/": _fixed(2, F.try_divide),
    "%": _fixed(2, F.try_mod),
    "NEG": _fixed(1, lambda a: -a),
    "=": _fixed(2, lambda a, b: a == b),
    "==": _fixed(2, lambda a, b: a == b),
    "!=": _fixed(2, lambda a, b: a != b),
    "<>": _fixed(2, lambda a, b: a != b),
    "<": _fixed(2, lambda a, b: a < b),
    ">": _fixed(2, lambda a, b: a > b),
    "<=": _fixed(2, lambda a, b: a <= b),
    ">=": _fixed(2, lambda a, b: a >= b),
    "AND": _fixed(2, lambda a, b: a & b),
    "&&": _fixed(2, lambda a, b: a & b),
    "OR": _fixed(2, lambda a, b: a | b),
    "||": _fixed(2, lambda a, b: a | b),
    "NOT": _fixed(1, lambda a: ~a),
    "MOD": _fixed(2, F.try_mod),
    "ABS": _fixed(1, F.abs),
    "ROUND": _round,
    "CEIL": _fixed(1, F.ceil),
    "FLOOR": _fixed(1, F.floor),
    "POWER": _fixed(2, F.pow),
    "SQRT": _fixed(1, F.sqrt),
    "YEAR": _fixed(1, F.year),
    "MONTH": _fixed(1, F.month),
    "DAY": _fixed(1, F.dayofmonth),
    "DATE": _fixed(1, F.to_date),
    "NOW": _fixed(0, F.current_timestamp),
    "DATE_ADD": _fixed(2, F.date_add),
    "DATE_SUB": _fixed(2, F.date_sub),
    "DATEDIFF": _fixed(2, F.datediff),
    "DATE_FORMAT": _fixed(1, lambda d: F.date_format(d, "yyyy-MM-dd")),
    "CONCAT": lambda *a: F.concat(*map(_text, a)),
    "SUBSTRING": _substring,
    "UPPER": _fixed(1, F.upper),
    "LOWER": _fixed(1, F.lower),
    "TRIM": _fixed(1, F.trim),
    "LENGTH": _fixed(1, F.length),
    "COALESCE": lambda *a: F.coalesce(*a),
    "NULLIF": _fixed(2, F.nullif),
    "IFNULL": _fixed(2, F.ifnull),
}


def register_function(name: str, make: Callable[..., Column]) -> None:
    """Permits a further function: make gets the arguments' columns (it may wrap a pandas UDF)."""
    FUNCTIONS[name.upper()] = make


def compile_expression(node: Node, resolve: Callable[[str], Column], aggregate: Callable[[str, Column | None], Column] | None = None) -> Column:
    """Column of a tree.  resolve: column of a name.  aggregate: column of an aggregate's name and argument (None: rows);
    without it aggregates are an error, and they are inside aggregates."""
    if isinstance(node, Literal):
        return F.lit(node.value)
    if isinstance(node, Name):
        return resolve(node.text)
    if node.function in AGGREGATES:
        if aggregate is None:
            raise ExpressionError(f"{node.function} isn't possible here")
        if len(node.args) != 1:
            raise ExpressionError(f"{node.function} takes one argument")
        whole = node.function == "COUNT" and node.args[0] == Literal("*")
        return aggregate(node.function, None if whole else compile_expression(node.args[0], resolve))
    if node.function not in FUNCTIONS:
        raise ForbiddenFunction(f"{node.function} isn't among the permitted functions")
    if Literal("*") in node.args:
        raise ExpressionError("* outside COUNT")
    args = [compile_expression(a, resolve, aggregate) for a in node.args]
    try:
        return FUNCTIONS[node.function](*args)
    except TypeError as wrong:
        raise ExpressionError(f"wrong number of arguments for {node.function}") from wrong


INLINE = re.compile(r"(?is)^\s*(?P<expression>.+?)\s+as\s+(?P<alias>[A-Za-z_][\w$]*)\s*$")


def split_inline(text: str) -> tuple[str, str] | None:
    """(expression, alias) of ``expr as alias``, None for a plain reference."""
    m = INLINE.match(text)
    return (m["expression"], m["alias"]) if m else None
