"""Filter operators and the linking of conditions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import InvalidSlice
from quillon.plans.request import Slice

Operator = Callable[[Column, object], Column]


def _list(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def member(c: Column, value: object) -> Column:
    """Membership; nothing is in an empty list."""
    values = _list(value)
    return c.isin(values) if values else F.lit(False)


def _bits(c: Column, value: object) -> Column:
    masks = _list(value)
    return reduce(lambda a, b: a | b, [c.cast("bigint").bitwiseAND(F.lit(int(m)).cast("bigint")) != 0 for m in masks]) if masks else F.lit(False)


def _range(low: str, high: str) -> Operator:
    def within(c: Column, value: object) -> Column:
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise InvalidSlice("a range has two ends")
        a, b = value
        tests = []
        if a is not None:
            tests.append(c >= F.lit(a) if low == "[" else c > F.lit(a))
        if b is not None:
            tests.append(c <= F.lit(b) if high == "]" else c < F.lit(b))
        if not tests:
            raise InvalidSlice("a range has at least one end")
        return reduce(lambda x, y: x & y, tests)

    return within


def _empty(c: Column, _: object = None) -> Column:
    return c.isNull() | (c.cast("string") == "")


#: Operators by their code; register() adds to them.
OPERATORS: dict[str, Operator] = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "<>": lambda c, v: c != F.lit(v),
    "===": lambda c, v: c.eqNullSafe(F.lit(v)),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "in": member,
    "not in": lambda c, v: ~member(c, v),
    "bit_in": _bits,
    "like": lambda c, v: c.contains(str(v)),
    "left_like": lambda c, v: c.endswith(str(v)),
    "right_like": lambda c, v: c.startswith(str(v)),
    "not like": lambda c, v: ~c.like(str(v)),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
    "is null and empty": _empty,
    "is not null and empty": lambda c, v: ~_empty(c),
    "[]": _range("[", "]"),
    "[)": _range("[", ")"),
    "(]": _range("(", "]"),
    "()": _range("(", ")"),
}
#: Distances of descendants that a hierarchy operator takes without maxDepth: least and most.
HIERARCHY = {"childrenOf": (1, 1), "descendantsOf": (1, None), "selfAndDescendantsOf": (0, None)}


def register(code: str, operator: Operator) -> None:
    """Makes a further operator known."""
    OPERATORS[code] = operator


def condition(c: Column, op: str, value: object) -> Column:
    if op not in OPERATORS:
        raise InvalidSlice(f"{op!r} is no operator")
    return OPERATORS[op](c, value)


def within_distance(distance: Column, op: str, max_depth: int | None) -> Column:
    least, most = HIERARCHY[op]
    most = max_depth if max_depth is not None else most
    test = distance >= least
    return test if most is None else test & (distance <= most)


#: A compiled condition, and whether it is about aggregates.
Leaf = Callable[[Slice], tuple[Column, bool]]


def _and(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def split_conditions(items: Sequence[Slice], leaf: Leaf) -> tuple[Column | None, Column | None]:
    """(where, having) of linked conditions.  And binds tighter than or; the first item's link means nothing; children are
    in brackets.  Conditions on rows and on aggregates can't be linked by or."""
    runs: list[list[Slice]] = []
    for i, s in enumerate(items):
        if i == 0 or s.link == 2:
            runs.append([])
        runs[-1].append(s)
    parts = []
    for run in runs:
        where = having = None
        for s in run:
            if s.children:
                w, h = split_conditions(s.children, leaf)
            else:
                c, aggregate = leaf(s)
                w, h = (None, c) if aggregate else (c, None)
            where, having = _and(where, w), _and(having, h)
        parts.append((where, having))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return None, None
    either = lambda side: reduce(lambda a, b: a | b, [p[side] for p in parts])
    if all(h is None for _, h in parts):
        return either(0), None
    if all(w is None for w, _ in parts):
        return None, either(1)
    raise InvalidSlice("conditions on rows and on aggregates can't be linked by or")
