"""The engine: registries of models, queries of them, and what clients learn about them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import AccessDenied, QueryError, UnknownField
from quillon.operators.access import Access, BoundSql, SecurityContext, bounded_scope, without_columns
from quillon.plans.model import Dictionary, QueryModel, TableModel
from quillon.plans.planner import Planner, Schema, quoted
from quillon.plans.request import Request, page_of, read_request

CONTINUE, ABORT = 0, 1


@dataclass
class Step:
    """Work before or after a query.  before: changes the request, or returns ABORT; after: changes the result's rows."""

    order: int
    before: Callable[[Request, SecurityContext], Request | int] | None = None
    after: Callable[[DataFrame, SecurityContext], DataFrame] | None = None
    hides: Callable[[SecurityContext], list[str]] | None = None  # fields that nothing may read for this caller


@dataclass
class QueryResult:
    """A lazy page of rows, with the whole result and the totals, lazy too."""

    items: DataFrame
    whole: DataFrame
    totals: DataFrame | None
    start: int
    limit: int | None
    joined: list[str] = field(default_factory=list)

    @property
    def page(self) -> int:
        return page_of(self.start, self.limit) if self.limit else 1

    def total(self) -> int:
        return self.whole.count()

    def collect(self) -> dict:
        """The page as a client gets it: items, total, totalData, start, limit, hasNext.  One row more than the page's is
        never fetched; without totals the total isn't counted."""
        items = [r.asDict(recursive=True) for r in self.items.collect()]
        totals = self.totals.first().asDict() if self.totals is not None else None
        total = totals["total"] if totals else None
        more = self.limit is not None and (self.start + len(items) < total if total is not None else len(items) == self.limit)
        return {"items": items, "total": total, "totalData": totals, "start": self.start, "limit": self.limit, "hasNext": more}


class Engine:
    """Models over sources.

    sources: a function from a table's name to its DataFrame; by default the session's catalog.  exact: take floating sums
    as decimals, so that they don't hang on the order of rows.
    """

    def __init__(self, spark: SparkSession, sources: Callable[[str], DataFrame] | None = None, exact: bool = True):
        self.spark, self.exact = spark, exact
        self._sources = {None: sources or spark.table}
        self._models: dict[str, QueryModel] = {}
        self._schemas: dict[str, Schema] = {}
        self._dictionaries: dict[str, Dictionary] = {}
        self._steps: list[Step] = []
        self._processors: list[Callable[[TableModel], TableModel]] = []
        self._saved: dict[str, tuple[str, dict, float]] = {}

    # -- registries

    def add_source(self, name: str, sources: Callable[[str], DataFrame]) -> Engine:
        """A further data source that models can name."""
        self._sources[name] = sources
        return self

    def register(self, model: QueryModel | TableModel) -> Engine:
        if isinstance(model, TableModel):
            model = QueryModel(model.name, model)
        if self._processors:
            model = QueryModel(**{**model.__dict__, "model": model.model.processed(*self._processors)})
        self._models[model.name] = model
        self._schemas.pop(model.name, None)
        return self

    def add_dictionary(self, d: Dictionary) -> Engine:
        self._dictionaries[d.id] = d
        return self

    def dictionary(self, id: str) -> Dictionary | None:
        return self._dictionaries.get(id)

    def clear_dictionaries(self) -> None:
        self._dictionaries.clear()

    def add_step(self, step: Step) -> Engine:
        self._steps.append(step)
        self._steps.sort(key=lambda s: s.order)
        return self

    def add_processor(self, processor: Callable[[TableModel], TableModel]) -> Engine:
        """Changes table models that are registered after it."""
        self._processors.append(processor)
        return self

    def schema(self, name: str) -> Schema:
        if name not in self._models:
            raise UnknownField(f"no model {name!r}")
        if name not in self._schemas:
            self._schemas[name] = Schema(self._models[name])
        return self._schemas[name]

    def frame_of(self, source: object, data_source: str | None = None) -> DataFrame:
        """A relation's rows: of a table's name, a view's SQL text over the sources' tables, or a function."""
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source(self)
        if source.lstrip()[:6].upper() == "SELECT" or source.lstrip()[:4].upper() == "WITH":
            return self.view(source, data_source)
        return self._sources[data_source](source)

    def view(self, sql: str, data_source: str | None = None, **values: object) -> DataFrame:
        """A model author's SELECT; {name} stands for a table of the data source, :name for a value."""
        import string

        names = {n for _, n, _, _ in string.Formatter().parse(sql) if n}
        return self.spark.sql(sql, args=values or None, **{n: self._sources[data_source](n) for n in names})

    # -- queries

    def query(self, name: str, body: dict | Request, context: SecurityContext | None = None, default_limit: int | None = 10, mode: str = "execute") -> QueryResult:
        """Answers a request.  mode: execute; validate: plans alone; explain: prints the plan as well."""
        if mode not in ("execute", "validate", "explain"):
            raise QueryError(f"{mode!r} is no mode")
        context = context or SecurityContext()
        request = body if isinstance(body, Request) else read_request(body, default_limit)
        for step in self._steps:
            if step.before:
                changed = step.before(request, context)
                if changed == ABORT:
                    raise QueryError("a step refused the query")
                request = changed if isinstance(changed, Request) else request
        schema = self.schema(name)
        planned = Planner(schema, self.frame_of, request, context, self._dictionaries, self.exact, self.hidden_of(schema, context)).plan()
        items, whole = planned.items, planned.whole
        for step in self._steps:
            if step.after:
                items, whole = step.after(items, context), step.after(whole, context)
        if mode == "explain":
            items.explain("formatted")
        return QueryResult(items, whole, planned.totals, request.start, request.limit, planned.joined)

    def hidden_of(self, schema: Schema, context: SecurityContext | None) -> list[str]:
        """Fields and dimensions of a model that the steps hide from a caller."""
        found = {n for step in self._steps if step.hides for n in step.hides(context or SecurityContext())}
        return sorted(n for n in found if n in schema.fields or n in schema.dimensions)

    def rows(self, name: str, body: dict, context: SecurityContext | None = None) -> DataFrame:
        """All rows of a request that asks for no page, its page otherwise."""
        return self.query(name, body, context, default_limit=None).items

    def kpi(self, name: str, body: dict, context: SecurityContext | None = None) -> DataFrame:
        """Measures over all rows: one row, no paging."""
        schema = self.schema(name)
        hidden = schema.hidden_fields(self.hidden_of(schema, context))
        columns = body.get("columns") or [n for n in schema.visible if schema.fields[n].kind == "measure" and n not in hidden]
        made = [c if " as " in c.lower() else {"field": c} for c in columns]
        named = [m for m in made if isinstance(m, str)]
        fields = [m["field"] for m in made if isinstance(m, dict)]
        if bad := [f for f in fields if schema.find(f).kind != "measure"]:
            raise QueryError(f"{bad} aren't measures")
        request = read_request({**body, "columns": [*fields, *named], "groupBy": [{"field": f, "agg": schema.find(f).aggregation} for f in fields]}, None)
        return self.query(name, request.changed(start=0, limit=None, orders=()), context).whole

    def members(self, name: str, dimension: str, context: SecurityContext | None = None, limit: int | None = None) -> DataFrame:
        """(id, caption) of a dimension's members, as far as the caller's rules for members let them be seen."""
        schema = self.schema(name)
        d = schema.find(f"{dimension}$id").dimension
        if d is None:
            raise UnknownField(f"{dimension} is no dimension")
        if schema.hidden_fields(self.hidden_of(schema, context)) & {f"{dimension}$id", f"{dimension}$caption"}:
            raise AccessDenied(f"no access to {dimension!r}")
        if d.source is None:
            source, key, where = schema.model.model.source, d.foreign_key, schema.model.model.data_source
        else:
            source, key = d.source, d.primary_key
            where = next(r.data_source for r in schema.relations.values() if r.source is source)
        rows = self.frame_of(source, where)
        caption = d.caption_or_key if d.source is not None else key
        for rule in schema.model.accesses:
            if rule.members and rule.field == dimension:
                bound = BoundSql()
                access = Access(lambda ref: quoted(ref), bound.bind)
                rule.members(access, context or SecurityContext())
                rows = rows.withColumns(bound.columns()) if bound.literals else rows
                for c in access.conditions:
                    rows = rows.filter(c)
        rows = rows.select(quoted(key).alias("id"), quoted(caption).alias("caption")).distinct()
        return rows if limit is None else rows.orderBy("id").limit(limit)

    def labelled(self, name: str, result: DataFrame) -> DataFrame:
        """A result with labels in place of the values of fields that have a dictionary; unknown values stay."""
        fields = self.schema(name).fields
        out = []
        for c in result.columns:
            d = self._dictionaries.get(fields[c].dictionary) if c in fields and fields[c].dictionary else None
            if d is None:
                out.append(quoted(c))
            else:
                pairs = [F.lit(str(x)) for item in d.items for x in item]
                out.append(F.coalesce(F.create_map(*pairs)[quoted(c).cast("string")], quoted(c).cast("string")).alias(c))
        return result.select(*out)

    # -- metadata

    def describe(self, name: str, context: SecurityContext | None = None) -> dict:
        schema = self.schema(name)
        fields, hidden = [], schema.hidden_fields(self.hidden_of(schema, context))
        for n in schema.visible:
            if n in hidden:
                continue
            f = schema.fields[n]
            fields.append({"name": n, "kind": f.kind, "type": f.type, "caption": f.caption, "aggregation": f.aggregation, "dictionary": f.dictionary, "prompt": getattr(f.note, "prompt", None)})
        return {"model": name, "caption": schema.model.caption, "fields": fields, "hierarchies": sorted(schema.closures)}

    def metadata(self, names: list[str] | None = None, context: SecurityContext | None = None) -> dict:
        """Models, an index from field names to the models that have them, and dictionaries."""
        models = [self.describe(n, context) for n in names or sorted(self._models)]
        index: dict[str, list[str]] = {}
        for m in models:
            for f in m["fields"]:
                index.setdefault(f["name"], []).append(m["model"])
        return {"models": models, "fields": index, "dictionaries": {k: dict((str(a), b) for a, b in d.items) for k, d in self._dictionaries.items()}}

    def markdown(self, names: list[str] | None = None, context: SecurityContext | None = None) -> str:
        out = []
        for m in self.metadata(names, context)["models"]:
            out += [f"## {m['model']}", "", "| field | kind | type | aggregation |", "|---|---|---|---|"]
            out += [f"| {f['name']} | {f['kind']} | {f['type']} | {f['aggregation'] or ''} |" for f in m["fields"]] + [""]
        return "\n".join(out)

    # -- saved queries

    def save_query(self, name: str, body: dict, seconds: float = 3600, now: float | None = None) -> dict:
        """Keeps a request that bounds the model's scope field, for a time; returns its id and when it ends."""
        model, request = self._models[name], read_request(body)
        if model.scope_field:
            bounded_scope(request, model.scope_field, model.scope_days)
        elif not request.slices:
            raise QueryError("a saved query needs a filter")
        id, ends = uuid.uuid4().hex, (now or time.time()) + seconds
        self._saved[id] = (name, body, ends)
        return {"id": id, "expires": ends}

    def open_query(self, id: str, context: SecurityContext | None = None, now: float | None = None) -> QueryResult:
        name, body, ends = self._saved.get(id, (None, None, 0))
        if name is None or (now or time.time()) > ends:
            self._saved.pop(id, None)
            raise QueryError("no such saved query, or its time is over")
        model, request = self._models[name], read_request(body)
        if model.scope_field:
            request = bounded_scope(request, model.scope_field, model.scope_days)
        return self.query(name, request, context)


def column_security(hidden_for: Callable[[SecurityContext], list[str]], order: int = 1000) -> Step:
    """A step that hides fields, or whole dimensions, by who asks: from columns, conditions, expressions, members, metadata."""
    return Step(order, before=lambda request, context: without_columns(request, hidden_for(context)), hides=hidden_for)
