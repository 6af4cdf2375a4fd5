"""Requests as clients send them, brought into one form and checked."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quillon.errors import InvalidSlice, QueryError

AGGREGATIONS = ("SUM", "AVG", "COUNT", "MAX", "MIN", "GROUP_CONCAT", "NONE", "PK")
NO_VALUE = ("is null", "is not null", "is null and empty", "is not null and empty")


@dataclass(frozen=True)
class Slice:
    field: str | None = None
    op: str = "="
    value: object = None
    link: int = 1  # 2: or; anything else: and
    max_depth: int | None = None
    dedupe: bool = False
    children: tuple[Slice, ...] = ()


@dataclass(frozen=True)
class OrderBy:
    field: str
    descending: bool = False
    null_first: bool = False
    null_last: bool = False


@dataclass(frozen=True)
class Calculated:
    name: str
    expression: str
    aggregation: str | None = None
    caption: str | None = None


@dataclass(frozen=True)
class Grouping:
    field: str
    aggregation: str | None = None


@dataclass(frozen=True)
class Request:
    columns: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    slices: tuple[Slice, ...] = ()
    groups: tuple[Grouping, ...] = ()
    orders: tuple[OrderBy, ...] = ()
    calculated: tuple[Calculated, ...] = ()
    start: int = 0
    limit: int | None = None  # None: no paging
    totals: bool = False
    distinct: bool = False
    join_types: dict[str, str] = field(default_factory=dict)

    def changed(self, **parts: object) -> Request:
        return replace(self, **parts)


def paging(body: dict, default: int) -> tuple[int, int]:
    """(start, limit) of start and limit, or of page and pageSize; a limit of 0 is the page size."""
    size = int(body.get("pageSize") or default)
    limit = int(body.get("limit") or 0) or size
    if "start" in body and body["start"] is not None:
        return max(0, int(body["start"])), limit
    return (max(1, int(body.get("page") or 1)) - 1) * limit, limit


def page_of(start: int, limit: int) -> int:
    return start // limit + 1


def read_slice(item: dict) -> Slice:
    if not isinstance(item, dict):
        raise InvalidSlice(f"a condition is an object, not {item!r}")
    link = 2 if item.get("link") == 2 else 1
    if "children" in item and item["children"] is not None:
        if not item["children"]:
            raise InvalidSlice("children is empty")
        return Slice(link=link, children=tuple(read_slice(c) for c in item["children"]))
    if not item.get("field"):
        raise InvalidSlice("a condition lacks its field")
    op = str(item.get("op") or item.get("type") or "=").strip()
    op = "=" if op == "eq" else op
    if op not in NO_VALUE and "value" not in item:
        raise InvalidSlice(f"{item['field']} {op} lacks its value")
    return Slice(item["field"], op, item.get("value"), link, item.get("maxDepth"), bool(item.get("dedupe")))


def read_order(item: dict | str) -> OrderBy:
    if isinstance(item, str):
        item = {"field": item}
    name = item.get("field") or item.get("column")
    way = str(item.get("order") or item.get("dir") or item.get("direction") or "asc").lower()
    if not name:
        raise QueryError("an order lacks its field")
    if way not in ("asc", "desc"):
        raise QueryError(f"{way!r} is no direction")
    return OrderBy(name, way == "desc", bool(item.get("nullFirst")), bool(item.get("nullLast")))


def read_aggregation(code: str | None) -> str | None:
    if code is None or code == "":
        return None
    if str(code).upper() not in AGGREGATIONS:
        raise QueryError(f"{code!r} is no aggregation")
    return str(code).upper()


def read_request(body: dict, default_limit: int | None = 10) -> Request:
    """A request of its JSON form.  Keys of either client form do; those under param count too."""
    body = {**body.get("param", {}), **{k: v for k, v in body.items() if k != "param"}}
    start, limit = paging(body, default_limit or 10)
    if default_limit is None and not any(k in body for k in ("start", "limit", "page", "pageSize")):
        start, limit = 0, None
    groups = [g if isinstance(g, dict) else {"field": g} for g in body.get("groupBy") or ()]
    if any(not g.get("field") for g in groups):
        raise QueryError("a group lacks its field")
    made = body.get("calculatedFields") or ()
    if any(not c.get("name") or not c.get("expression") for c in made):
        raise QueryError("a calculated field lacks its name or expression")
    return Request(
        columns=tuple(body.get("columns") or ()),
        excluded=tuple(body.get("exColumns") or ()),
        slices=tuple(read_slice(x) for x in body.get("slice") or ()),
        groups=tuple(Grouping(g["field"], read_aggregation(g.get("agg"))) for g in groups),
        orders=tuple(read_order(x) for x in body.get("orderBy") or ()),
        calculated=tuple(Calculated(c["name"], c["expression"], read_aggregation(c.get("agg")), c.get("caption")) for c in made),
        start=start,
        limit=limit,
        totals=bool(body.get("returnTotal")),
        distinct=bool(body.get("distinct")),
        join_types=dict(body.get("joinTypes") or {}),
    )
