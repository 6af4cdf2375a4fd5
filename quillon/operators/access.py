"""Row and column access, roles, and the window that an open link has to have."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import AccessDenied, QueryError, ScopeError
from quillon.functions.types import to_datetime
from quillon.operators.slices import condition, member
from quillon.plans.request import Request, Slice


@dataclass(frozen=True)
class SecurityContext:
    user: str | None = None
    roles: tuple[str, ...] = ()
    attributes: dict = field(default_factory=dict)
    token: str | None = None

    @classmethod
    def of_header(cls, header: str | None, read: Callable[[str], dict] | None = None) -> SecurityContext:
        """The context of an Authorization header; the scheme is left out.  read: what the caller's identity service says of a
        token (user, roles, and further attributes)."""
        token = (header or "").split(" ")[-1] or None
        known = dict(read(token) or {}) if read and token else {}
        return cls(known.pop("user", None), tuple(known.pop("roles", None) or ()), known, token)


class Access:
    """What an access rule adds conditions through; all of them hold together, and with the request's own."""

    def __init__(self, resolve: Callable[[str], Column], trusted_sql: Callable[[str, dict[str, object]], Column] | None = None):
        self.resolve, self.trusted_sql, self.conditions = resolve, trusted_sql, []

    def add(self, c: Column) -> Access:
        self.conditions.append(c)
        return self

    def and_eq(self, ref: str, value: object) -> Access:
        return self.add(self.resolve(ref) == F.lit(value))

    def and_in(self, ref: str, values: Sequence) -> Access:
        """An empty list permits nothing."""
        return self.add(member(self.resolve(ref), list(values)))

    def and_ne(self, ref: str, value: object) -> Access:
        return self.add(self.resolve(ref) != F.lit(value))

    def and_not_null(self, ref: str) -> Access:
        return self.add(self.resolve(ref).isNotNull())

    def and_null(self, ref: str) -> Access:
        return self.add(self.resolve(ref).isNull())

    def and_op(self, ref: str, op: str, value: object) -> Access:
        """Any filter operator by its code."""
        return self.add(condition(self.resolve(ref), op, value))

    def and_sql(self, text: str, **values: object) -> Access:
        """A trusted fragment over the root's physical columns; :name outside quotes stands for a value, which is bound as one and
        never read as SQL.  Raises QueryError for a name without a value."""
        return self.add(self.trusted_sql(text, values))


SQL_PARTS = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(?<!:):[A-Za-z_]\w*)")


class BoundSql:
    """Fragments whose values stand in columns of their own, which the owner adds to the rows as literals."""

    def __init__(self) -> None:
        self.literals: dict[str, object] = {}

    def bind(self, text: str, values: dict[str, object], plain: Callable[[str], str] = str) -> Column:
        """The fragment as a column; plain: changes what is neither quoted nor a value."""
        parts = SQL_PARTS.split(text)
        parts[::2] = [plain(p) for p in parts[::2]]
        for i, part in enumerate(parts):
            if i % 2 and part[0] == ":":
                if part[1:] not in values:
                    raise QueryError(f"{part} has no value")
                name = f"#bound{len(self.literals)}"
                self.literals[name] = values[part[1:]]
                parts[i] = f"`{name}`"
        return F.expr("".join(parts))

    def columns(self) -> dict[str, Column]:
        return {name: F.lit(v) for name, v in self.literals.items()}


def without_columns(request: Request, hidden: Sequence[str]) -> Request:
    """Column security: hidden fields are taken out of what is selected, and may not be filtered, grouped or ordered by; a
    request for nothing else is refused.  Expressions are the planner's to refuse, which gets the same names."""
    used = {s.field for s in _leaves(request.slices)} | {g.field for g in request.groups} | {o.field for o in request.orders}
    if bad := used & set(hidden):
        raise AccessDenied(f"no access to {sorted(bad)}")
    left = tuple(c for c in request.columns if c not in hidden)
    if request.columns and not left:
        raise AccessDenied(f"no access to {sorted(request.columns)}")
    return request.changed(columns=left, excluded=(*request.excluded, *hidden))


def _leaves(slices: Sequence[Slice]) -> list[Slice]:
    return [x for s in slices for x in (_leaves(s.children) if s.children else [s])]


def bounded_scope(request: Request, name: str, days: int, now: datetime | None = None) -> Request:
    """Requires a bound on a date field, of no more than so many days; a bound that is open at its end is closed."""
    bounds = [s for s in _leaves(request.slices) if s.field == name]
    if not request.slices or not bounds:
        raise ScopeError(f"{name} has to be bounded")
    low = high = None
    for s in bounds:
        if s.op in ("[]", "[)", "(]", "()"):
            low, high = (to_datetime(v) for v in s.value)
        elif s.op in (">", ">="):
            low = to_datetime(s.value)
        elif s.op in ("<", "<="):
            high = to_datetime(s.value)
        elif s.op == "=":
            low = high = to_datetime(s.value)
    if low is None:
        raise ScopeError(f"{name} has no lower bound")
    if high is None:
        end = min(low + timedelta(days=days), now or datetime.max)
        return request.changed(slices=(*request.slices, Slice(name, "<", end.strftime("%Y-%m-%d %H:%M:%S"))))
    if high - low > timedelta(days=days):
        raise ScopeError(f"{name} spans more than {days} days")
    return request


#: Tools by category, and categories by role.
TOOLS = {
    "dataset.get_metadata": "metadata",
    "dataset.describe_model_internal": "metadata",
    "dataset.inspect_table": "metadata",
    "dataset.query_model_v2": "query",
    "chart.generate": "visualisation",
    "dataset.export_with_chart": "export",
    "dataset.open_in_viewer": "export",
    "dataset_nl.query": "natural_language",
    "system.ping": "system",
}
ROLES = {
    "ADMIN": {"metadata", "query", "visualisation", "export", "natural_language", "system"},
    "ANALYST": {"metadata", "query", "visualisation", "export", "system"},
    "BUSINESS": {"natural_language"},
}


def tools_of(role: str) -> list[str]:
    return [t for t, category in TOOLS.items() if category in ROLES.get(role.upper(), ())]


def check_tool(role: str, tool: str) -> None:
    if tool not in tools_of(role):
        raise AccessDenied(f"{role} has no tool {tool}")
