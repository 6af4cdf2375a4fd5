"""From a request and a query model to lazy DataFrames.

Only relations that some field needs are joined, each under a name of its own, and only the columns in use are taken from
them, so scans stay narrow and no two columns have one name.  Everything physical is left to Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import AccessDenied, AliasClash, QueryError, UnknownField
from quillon.functions import expr
from quillon.functions.naming import FieldPath
from quillon.functions.types import parameter
from quillon.operators.access import Access, BoundSql, SecurityContext
from quillon.operators.slices import HIERARCHY, condition, member, split_conditions, within_distance
from quillon.plans.joins import Edge, JoinGraph
from quillon.plans.model import Closure, Dimension, Measure, ModelJoin, On, Property, QueryModel, TableModel
from quillon.plans.request import Request, Slice

#: Floating sums are taken as decimals of this type, so their result doesn't hang on the order of rows.
EXACT = T.DecimalType(18, 4)
KEY_AGGREGATIONS = ("NONE", "PK")

Use = Callable[[str, str], Column]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Relation:
    alias: str
    source: object
    broadcast_rows: int | None = None
    data_source: str | None = None


@dataclass
class FieldDef:
    name: str
    kind: str  # property, measure or dimension
    build: Callable[[Use], Column]
    type: str = "STRING"
    caption: str | None = None
    aggregation: str | None = None
    dictionary: str | None = None
    format: str | None = None
    dimension: Dimension | None = None
    fan: bool = False  # reached through a closure
    rows: bool = False  # a measure that counts rows
    note: object = None


@dataclass
class Output:
    name: str
    node: expr.Node | None = None  # of a calculated field
    field: FieldDef | None = None
    aggregation: str | None = None


class Schema:
    """Relations, edges and fields of a query model."""

    def __init__(self, model: QueryModel):
        self.model = model
        self.relations: dict[str, Relation] = {}
        self.fields: dict[str, FieldDef] = {}
        self.dimensions: dict[str, list[str]] = {}
        self.closures: dict[str, tuple[Closure, Dimension, str, Callable[[Use], Column]]] = {}
        self.graph = JoinGraph("root")
        self._add_model(model.model, "root", "")
        models = dict(model.models)
        for j in model.joins:
            right = models[j.right]
            self._add_model(right, j.right, j.right + ".")
            self.graph.add(Edge(j.left if j.left in models else "root", j.right, self._on(j, models), j.how, (), (j.left,) if j.left in models else ()))
        self.graph.check_acyclic()
        self.visible = self._visible()

    def _add_model(self, t: TableModel, alias: str, prefix: str) -> None:
        self.relations[alias] = Relation(alias, t.source, data_source=t.data_source)
        for p in t.properties:
            self._add_field(prefix + p.key, self._property(p, alias), kind="property")
        for m in t.measures:
            self._add_field(prefix + m.key, self._measure(m, alias, prefix), kind="measure")
        for d in t.dimensions:
            self._add_dimension(d, alias, FieldPath((*prefix.split(".")[:-1], d.name)), ())

    def _add_field(self, name: str, made: FieldDef, kind: str) -> None:
        made.name, made.kind = name, kind
        self.fields.setdefault(name, made)

    def _property(self, p: Property, alias: str) -> FieldDef:
        build = (lambda use: p.formula(lambda c: use(alias, c))) if p.formula else (lambda use: use(alias, p.column))
        return FieldDef(p.key, "property", build, p.type, p.caption, dictionary=p.dictionary, format=p.format, note=p.ai)

    def _measure(self, m: Measure, alias: str, prefix: str) -> FieldDef:
        if m.formula:
            build = lambda use: m.formula(lambda c: use(alias, c))
        elif m.value:
            tree = expr.parse(m.value)
            build = lambda use: expr.compile_expression(tree, lambda name: self.fields[prefix + name].build(use))
        elif m.column:
            build = lambda use: use(alias, m.column)
        else:
            build = lambda use: F.lit(1)
        rows = not (m.formula or m.value or m.column)
        return FieldDef(m.key, "measure", build, m.type, m.caption, aggregation=m.default_aggregation, rows=rows, note=m.ai)

    def _add_dimension(self, d: Dimension, parent: str, path: FieldPath, outer: tuple[str, ...]) -> None:
        names = [path.dotted] + ([d.alias] if d.alias and d.alias != path.dotted else [])
        keyed = lambda use: use(parent, d.foreign_key)
        owned = [("id", FieldDef("", "dimension", keyed, d.type, d.caption, dimension=d, note=d.ai))]
        if d.source is None:
            owned.append(("caption", FieldDef("", "dimension", keyed, d.type, d.caption, dimension=d)))
        else:
            alias = path.dotted
            self.relations[alias] = Relation(alias, d.source, d.broadcast_rows, self._source_of(d, parent))
            self.graph.add(Edge(parent, alias, lambda use: use(parent, d.foreign_key) == use(alias, d.primary_key)))
            owned.append(("caption", FieldDef("", "dimension", lambda use: use(alias, d.caption_or_key), "STRING", d.caption, dimension=d)))
            for p in d.properties:
                owned.append((p.key, self._property(p, alias)))
            for sub in d.dimensions:
                self._add_dimension(sub, alias, path.child(sub.name), (*outer, alias))
        if d.closure is not None:
            owned += self._hierarchy(d, parent, path)
        for name in names:
            self.dimensions[name] = [f"{name}$id", f"{name}$caption"]
            for column, f in owned:
                self._add_field(f"{name}${column}", FieldDef(**{**f.__dict__}), "dimension")
            if d.closure is not None:
                self.closures[name] = (d.closure, d, parent, keyed)

    def _source_of(self, d: Dimension, parent: str) -> str | None:
        """A dimension's data source: its own, else that of what it hangs on."""
        return d.data_source if d.data_source is not None else self.relations[parent].data_source

    def _hierarchy(self, d: Dimension, parent: str, path: FieldPath) -> list[tuple[str, FieldDef]]:
        """Fields of a node's ancestors, itself among them: a row for each."""
        closure, above = path.dotted + "#closure", path.dotted + "#above"
        c = d.closure
        self.relations[closure] = Relation(closure, c.source, data_source=self._source_of(d, parent))
        self.relations[above] = Relation(above, d.source, data_source=self._source_of(d, parent))
        self.graph.add(Edge(parent, closure, lambda use: use(parent, d.foreign_key) == use(closure, c.child_key), "inner"))
        self.graph.add(Edge(closure, above, lambda use: use(closure, c.parent_key) == use(above, d.primary_key)))
        caption = lambda use: use(above, d.caption_or_key)
        return [
            ("hierarchy$id", FieldDef("", "dimension", lambda use: use(closure, c.parent_key), d.type, d.caption, dimension=d, fan=True)),
            ("hierarchy$caption", FieldDef("", "dimension", caption, "STRING", d.caption, dimension=d, fan=True)),
        ]

    def _on(self, j: ModelJoin, models: dict[str, TableModel]) -> Callable[[Use], Column]:
        left = j.left if j.left in models else "root"

        def side(alias: str, ref: str, use: Use) -> Column:
            """A reference of a join condition: a field of that model, else a physical column."""
            known = self.fields.get(ref if alias == "root" else f"{alias}.{ref}")
            return known.build(use) if known else use(alias, ref)

        def one(on: On, use: Use) -> Column:
            other = side(j.right, on.right, use) if on.right is not None else F.lit(on.constant)
            return condition_of(side(left if on.right is not None or left_has(on.left) else j.right, on.left, use), on.op, other)

        def left_has(ref: str) -> bool:
            return f"{j.right}.{ref}" not in self.fields

        def build(use: Use) -> Column:
            found = [one(on, use) for on in j.conditions]
            if j.on_builder:
                found.append(j.on_builder(lambda c: use(left, c), lambda c: use(j.right, c)))
            if not found:
                raise QueryError(f"the join with {j.right} has no condition")
            out = found[0]
            for f in found[1:]:
                out = out & f
            return out

        return build

    def _visible(self) -> dict[str, None]:
        if self.model.fields is None:
            return dict.fromkeys(n for n, f in self.fields.items() if not f.fan)
        out: dict[str, None] = {}
        for name in self.model.fields:
            for n in self.dimensions.get(name, [name]):
                self.find(n)
                out[n] = None
        return out

    def hidden_fields(self, names: Sequence[str]) -> set[str]:
        """These fields and all of these dimensions, under any of their names."""
        whole = {n for name in names for n in self.fields if n == name or n.startswith(f"{name}$")}
        if unknown := [n for n in names if n not in whole and n not in self.dimensions]:
            raise UnknownField(f"{self.model.name} has no field {unknown}")
        builds = {id(self.fields[n].build) for n in whole}
        return {n for n, f in self.fields.items() if id(f.build) in builds}

    def find(self, name: str) -> FieldDef:
        if name not in self.fields:
            raise UnknownField(f"{self.model.name} has no field {name!r}")
        return self.fields[name]


def condition_of(a: Column, op: str, b: Column) -> Column:
    return {"=": lambda: a == b, "<>": lambda: a != b, "!=": lambda: a != b, ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b}[op]()


@dataclass
class Planned:
    items: DataFrame  # ordered and paged
    whole: DataFrame  # neither
    totals: DataFrame | None
    outputs: list[Output]
    request: Request
    joined: list[str] = field(default_factory=list)


class Planner:
    """Plans one request."""

    def __init__(self, schema: Schema, frame_of: Callable[[object, str | None], DataFrame], request: Request, context: SecurityContext | None = None, dictionaries: dict | None = None, exact: bool = True, hidden: Sequence[str] = ()):
        self.schema, self.frame_of, self.request, self.context = schema, frame_of, request, context or SecurityContext()
        self.hidden, self.bound = schema.hidden_fields(hidden), BoundSql()
        self.dictionaries, self.exact = dictionaries or {}, exact
        self.used: dict[str, dict[str, str]] = {"root": {}}
        self.calculated: dict[str, tuple[expr.Node, str | None]] = {}
        self.frame: DataFrame | None = None
        self.semi: list[tuple[Column, Callable[[], DataFrame], str]] = []

    # -- fields

    def use(self, alias: str, column: str) -> Column:
        """A physical column of a relation, which is joined for it."""
        numbers = self.used.setdefault(alias, {})
        name = numbers.setdefault(column, f"r{list(self.schema.relations).index(alias)}__{column}")
        return quoted(name)

    def permitted(self, name: str) -> FieldDef:
        f = self.schema.find(name)
        if name not in self.schema.visible and not f.fan:
            raise AccessDenied(f"{self.schema.model.name} doesn't show {name!r}")
        if name in self.hidden:
            raise AccessDenied(f"no access to {name!r}")
        return f

    def row_value(self, name: str) -> Column:
        """A field's or calculated field's value in a row."""
        if name in self.calculated:
            node, _ = self.calculated[name]
            return expr.compile_expression(node, self.row_value)
        return self.permitted(name).build(self.use)

    def is_aggregate(self, name: str) -> bool:
        """Whether a calculated field of this name aggregates."""
        if name not in self.calculated:
            return False
        node, how = self.calculated[name]
        return how not in (None, *KEY_AGGREGATIONS) or expr.has_aggregate(node, self.is_aggregate)

    def aggregate(self, how: str, value: Column | None) -> Column:
        how = how.upper()
        if how == "CUSTOM" and value is not None:
            return value  # a formula that aggregates by itself
        if how == "COUNT":
            return F.count("*") if value is None else F.count(value)
        if value is None:
            raise QueryError(f"{how} needs a value")
        if how in ("MAX", "MIN"):
            return F.max(value) if how == "MAX" else F.min(value)
        if how == "GROUP_CONCAT":
            return F.array_join(F.array_sort(F.collect_list(value.cast("string"))), ",")
        if how not in ("SUM", "AVG"):
            raise QueryError(f"{how!r} is no aggregation")
        kind = self.frame.select(value.alias("v")).schema[0].dataType
        if self.exact and isinstance(kind, (T.DoubleType, T.FloatType)):
            total = F.sum(value.cast(EXACT)).cast("double")
            return total if how == "SUM" else F.try_divide(total, F.count(value).cast("double"))
        return F.sum(value) if how == "SUM" else F.avg(value)

    def aggregate_value(self, name: str) -> Column:
        """A name inside an expression over aggregates: an aggregating calculated field, or a group's own value."""
        if self.is_aggregate(name):
            return self.aggregated_column(name)
        return self.row_value(name)

    def aggregated_column(self, name: str) -> Column:
        node, how = self.calculated[name]
        if how not in (None, *KEY_AGGREGATIONS):
            return self.aggregate(how, expr.compile_expression(node, self.row_value))
        return expr.compile_expression(node, self.aggregate_value, self.aggregate)

    # -- outputs

    def outputs(self) -> list[Output]:
        r, out = self.request, []
        for c in r.calculated:
            self._define(c.name, expr.parse(c.expression), c.aggregation)
        names: list[str] = []
        for c in r.columns or [n for n in self.schema.visible]:
            inline = expr.split_inline(c)
            if inline:
                self._define(inline[1], expr.parse(inline[0]), None)
                names.append(inline[1])
            else:
                names += self.schema.dimensions.get(c, [c]) if c not in self.calculated else [c]
        for g in r.groups:
            if g.field not in names and r.columns == ():
                names.append(g.field)
        hidden = {n for e in r.excluded for n in self.schema.dimensions.get(e, [e])} | self.hidden
        taken: dict[str, str] = {}
        for n in names:
            if n in hidden:
                continue
            if n in self.calculated:
                made = Output(n, node=self.calculated[n][0], aggregation=self.calculated[n][1])
            else:
                self.permitted(n)
                made = Output(FieldPath.parse(n).alias, field=self.schema.fields[n])
            if made.name in taken:
                if taken[made.name] == n:
                    continue
                raise AliasClash(f"{made.name} is the name of two columns")
            taken[made.name] = n
            out.append(made)
        if not out:
            raise QueryError("no column is selected")
        return out

    def _define(self, name: str, node: expr.Node, how: str | None) -> None:
        if name in self.schema.fields:
            raise AliasClash(f"{name} is the name of a field")
        if name in self.calculated:
            raise AliasClash(f"{name} is defined twice")
        for n in expr.names_in(node):
            if n not in self.calculated:
                self.permitted(n)
        self.calculated[name] = (node, how)

    # -- the plan

    def plan(self) -> Planned:
        r = self.request
        outputs = self.outputs()
        by_group = {g.field: g.aggregation for g in r.groups}
        grouped = bool(r.groups) or any(self.is_aggregate(o.name) if o.node is not None else o.field.aggregation == "CUSTOM" for o in outputs)
        rows = self._conditions(grouped)
        # every column that is needed has to be known before relations are read
        keys, sums = [], []
        for o in outputs:
            name = o.name if o.node is not None else o.field.name
            how = by_group.get(name) or (None if o.node is not None else o.aggregation)
            if not grouped:
                keys.append(o)
            elif o.node is not None:
                (sums if self.is_aggregate(o.name) or how not in (None, *KEY_AGGREGATIONS) else keys).append(o)
                o.aggregation = how or o.aggregation
            elif how in KEY_AGGREGATIONS or how is None and (name in by_group or o.field.kind != "measure"):
                keys.append(o)
            else:
                o.aggregation = how or o.field.aggregation
                sums.append(o)
        for o in outputs:
            if o.node is None:
                o.field.build(self.use)
            else:
                self._touch(o.node)
        for g in r.groups:
            if g.field not in {o.name if o.node is not None else o.field.name for o in outputs}:
                keys.append(Output(FieldPath.parse(g.field).alias, field=self.permitted(g.field)) if g.field not in self.calculated else Output(g.field, node=self.calculated[g.field][0]))
                self.row_value(g.field)
        orders, extra = self._orders(outputs, grouped)
        for s in r.slices:
            self._touch_slice(s)
        access = self._access()
        self.frame, joined = self._frame()
        where, having = rows()
        for c in access.conditions:
            where = c if where is None else where & c
        frame = self.frame if where is None else self.frame.filter(where)
        for key, rows_of, name in self.semi:
            wanted = rows_of()
            frame = frame.join(wanted, key == quoted(name), "left_semi")
        self.frame = frame
        frame = self._project(frame, outputs, keys, sums, grouped, having, extra)
        shown = [quoted(o.name) for o in outputs]
        whole = frame.select(*shown)
        if r.distinct:
            whole = frame = whole.distinct()
        totals = self._totals(whole, outputs, grouped) if r.totals else None
        items = frame.orderBy(*orders) if orders else frame
        if r.start:
            items = items.offset(r.start)
        if r.limit is not None:
            items = items.limit(r.limit)
        return Planned(items.select(*shown), whole, totals, outputs, r, joined)

    def _touch(self, node: expr.Node) -> None:
        for n in expr.names_in(node):
            if n in self.calculated:
                self._touch(self.calculated[n][0])
            else:
                self.permitted(n).build(self.use)

    def _touch_slice(self, s: Slice) -> None:
        for c in s.children:
            self._touch_slice(c)
        if s.children:
            return
        if s.op in HIERARCHY:
            name = s.field.partition("$")[0]
            if name not in self.schema.closures:
                raise QueryError(f"{name} is no hierarchy")
            c, d, parent, key = self.schema.closures[name]
            if f"{name}$id" in self.hidden:
                raise AccessDenied(f"no access to {name!r}")
            key(self.use)
            if not s.dedupe:
                for column in (c.child_key, c.parent_key, c.distance):
                    self.use(self._closure_alias(name), column)
        elif s.field in self.calculated:
            self._touch(self.calculated[s.field][0])
        else:
            self.permitted(s.field).build(self.use)

    def _closure_alias(self, name: str) -> str:
        if f"{name}#closure" in self.schema.relations:
            return f"{name}#closure"
        d = self.schema.closures[name][1]
        return next(a for a in self.schema.relations if a.endswith("#closure") and a.partition("#")[0].split(".")[-1] == d.name)

    def _conditions(self, grouped: bool) -> Callable[[], tuple[Column | None, Column | None]]:
        def leaf(s: Slice) -> tuple[Column, bool]:
            if s.op in HIERARCHY:
                return self._descendants(s), False
            if self.is_aggregate(s.field):
                return condition(quoted(s.field), s.op, s.value), True
            kind = "STRING" if s.field in self.calculated else self.permitted(s.field).type
            value = s.value
            if s.field not in self.calculated and (d := self.permitted(s.field).dictionary):
                value = self._values(d, value)
            return condition(self.row_value(s.field), s.op, parameter(value, kind)), False

        return lambda: split_conditions(self.request.slices, leaf)

    def _values(self, dictionary: str, value: object) -> object:
        """Values for labels; what is no label is a value already."""
        d = self.dictionaries[dictionary]
        one = lambda v: d.value(v) if isinstance(v, str) and d.value(v) is not None else v
        return [one(v) for v in value] if isinstance(value, (list, tuple)) else one(value)

    def _descendants(self, s: Slice) -> Column:
        c, d, parent, key = self.schema.closures[s.field.partition("$")[0]]
        values = list(s.value) if isinstance(s.value, (list, tuple)) else [s.value]
        if s.dedupe:
            name = f"#{len(self.semi)}"
            source = d.data_source if d.data_source is not None else self.schema.relations[parent].data_source

            def rows() -> DataFrame:
                found = self.frame_of(c.source, source).filter(member(quoted(c.parent_key), values) & within_distance(quoted(c.distance), s.op, s.max_depth))
                return found.select(quoted(c.child_key).alias(name)).distinct()

            self.semi.append((key(self.use), rows, name))
            return F.lit(True)
        alias = self._closure_alias(s.field.partition("$")[0])
        return member(self.use(alias, c.parent_key), values) & within_distance(self.use(alias, c.distance), s.op, s.max_depth)

    def _access(self) -> Access:
        access = Access(lambda ref: self.schema.find(ref).build(self.use), self._trusted)
        for rule in self.schema.model.accesses:
            if rule.builder:
                rule.builder(access, self.context)
        return access

    def _trusted(self, text: str, values: dict[str, object]) -> Column:
        """A model author's fragment, whose names are physical columns of the root."""
        root = self.schema.relations["root"]
        columns = set(self.frame_of(root.source, root.data_source).columns)

        def named(m: re.Match) -> str:
            name = m[1] or m[0]
            if name not in columns:
                return m[0]
            self.use("root", name)
            return f"`{self.used['root'][name]}`"

        return self.bound.bind(text, values, lambda part: re.sub(r"`([^`]*)`|\b[A-Za-z_]\w*\b", named, part))

    def _frame(self) -> tuple[DataFrame, list[str]]:
        needed = [a for a in self.schema.relations if a in self.used and a != "root"]
        edges = self.schema.graph.ordered(needed, self.request.join_types)
        conditions = [(e, e.condition(self.use)) for e in edges]
        frame = self._columns("root")
        if self.bound.literals:
            frame = frame.withColumns(self.bound.columns())
        for e, on in conditions:
            right = self._columns(e.end)
            most = self.schema.relations[e.end].broadcast_rows
            if most is not None and right.limit(most + 1).count() <= most:
                right = F.broadcast(right)
            frame = frame.join(right, on, e.how)
        return frame, [e.end for e in edges]

    def _columns(self, alias: str) -> DataFrame:
        taken = self.used.get(alias, {})
        frame = self.frame_of(self.schema.relations[alias].source, self.schema.relations[alias].data_source)
        if missing := [c for c in taken if c not in frame.columns]:
            raise UnknownField(f"{alias} has no column {missing}")
        return frame.select(*[quoted(c).alias(n) for c, n in taken.items()])

    def _value_of(self, o: Output) -> Column:
        c = expr.compile_expression(o.node, self.row_value) if o.node is not None else o.field.build(self.use)
        if o.field is not None and o.field.format:
            c = F.date_format(c, o.field.format)
        return c

    def _project(self, frame: DataFrame, outputs: list[Output], keys: list[Output], sums: list[Output], grouped: bool, having: Column | None, extra: list[tuple[str, Column | None]]) -> DataFrame:
        if not grouped:
            more = [c.alias(n) for n, c in extra]
            return frame.select(*[self._value_of(o).alias(o.name) for o in outputs], *more)
        made = []
        for o in sums:
            if o.node is not None and self.is_aggregate(o.name):
                c = self.aggregated_column(o.name)
            elif o.field is not None and o.field.rows and o.aggregation == "COUNT":
                c = F.count("*")
            else:
                c = self.aggregate(o.aggregation, self._value_of(o))
            made.append(c.alias(o.name))
        shown = {o.name for o in outputs}
        for s in self._leaves(self.request.slices):
            if self.is_aggregate(s.field or "") and s.field not in shown:
                made.append(self.aggregated_column(s.field).alias(s.field))
                shown.add(s.field)
        if keys:
            grouped_frame = frame.groupBy(*[self._value_of(o).alias(o.name) for o in keys])
            frame = grouped_frame.agg(*made) if made else frame.select(*[self._value_of(o).alias(o.name) for o in keys]).distinct()
        else:
            frame = frame.agg(*made)
        return frame if having is None else frame.filter(having)

    def _leaves(self, slices: tuple[Slice, ...]) -> list[Slice]:
        return [x for s in slices for x in (self._leaves(s.children) if s.children else [s])]

    def _orders(self, outputs: list[Output], grouped: bool) -> tuple[list[Column], list[tuple[str, Column]]]:
        """Sort columns, and the values to keep for those that aren't selected."""
        names = {o.name for o in outputs}
        wanted = self.request.orders
        default = not wanted
        if default:
            wanted = self.schema.model.orders
        out, extra = [], []
        for o in wanted:
            name = o.field if o.field in self.calculated else FieldPath.parse(o.field).alias
            descending = o.descending if hasattr(o, "descending") else o.direction == "desc"
            if name not in names:
                if grouped:
                    if default:
                        continue
                    raise QueryError(f"{o.field} has to be selected to order by it")
                if default and name in self.hidden | {FieldPath.parse(h).alias for h in self.hidden}:
                    continue
                hidden = f"#order{len(extra)}"
                extra.append((hidden, self.row_value(o.field)))
                name = hidden
            c = quoted(name)
            if o.null_first:
                out.append(c.desc_nulls_first() if descending else c.asc_nulls_first())
            elif o.null_last:
                out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
            else:
                out.append(c.desc() if descending else c.asc())
        return out, extra

    def _totals(self, whole: DataFrame, outputs: list[Output], grouped: bool) -> DataFrame:
        """One row: of each column the aggregate of its kind over the unpaged result, null for plain ones, and the count.

        An average is that of the groups' averages.
        """
        self.frame, made = whole, []
        for o in outputs:
            how = o.aggregation or (o.field.aggregation if o.field is not None and o.field.kind == "measure" else None)
            if o.node is not None and how is None and self.is_aggregate(o.name):
                how = o.node.function if isinstance(o.node, expr.Call) and o.node.function in expr.AGGREGATES else "SUM"
            c = quoted(o.name)
            if how in (None, "CUSTOM", *KEY_AGGREGATIONS) or not grouped and how == "GROUP_CONCAT":
                made.append(F.lit(None).cast(whole.schema[o.name].dataType).alias(o.name))
            elif how == "COUNT":
                made.append((F.sum(c) if grouped else F.count("*")).alias(o.name))
            else:
                made.append(self.aggregate(how, c).alias(o.name))
        return whole.agg(*made, F.count("*").alias("total"))
