"""Table models, query models and what they are made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from quillon.functions.naming import camel

#: A relation's rows: the name of a table, or a function of the engine that gives a DataFrame.
Source = str | Callable[..., DataFrame]
#: A formula over physical columns: it gets a function from a column's name to its Column.
Formula = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class AiNote:
    """Hints for clients that read the metadata; without effect on queries."""

    enabled: bool = True
    prompt: str | None = None
    levels: tuple[int, ...] = ()


@dataclass(frozen=True)
class Property:
    column: str
    name: str | None = None
    type: str = "STRING"
    caption: str | None = None
    dictionary: str | None = None
    formula: Formula | None = None
    format: str | None = None
    bits: bool = False
    ai: AiNote = AiNote()

    @property
    def key(self) -> str:
        return self.name or camel(self.column)


@dataclass(frozen=True)
class Measure:
    """formula: over physical columns; value: an expression over other fields' names; neither and no column: row count."""

    column: str | None = None
    name: str | None = None
    aggregation: str | None = None
    type: str = "NUMBER"
    caption: str | None = None
    formula: Formula | None = None
    value: str | None = None
    ai: AiNote = AiNote()

    @property
    def key(self) -> str:
        return self.name or camel(self.column or "count")

    @property
    def default_aggregation(self) -> str:
        """In a grouped query: its own, COUNT where there is no column, else SUM."""
        return (self.aggregation or ("COUNT" if self.column is None and self.formula is None and self.value is None else "SUM")).upper()


@dataclass(frozen=True)
class Closure:
    """Ancestor and descendant pairs of a hierarchy, each node with itself at distance 0."""

    source: Source
    parent_key: str = "parent_id"
    child_key: str = "child_id"
    distance: str = "distance"


@dataclass(frozen=True)
class Dimension:
    name: str
    source: Source | None = None  # None: the key is all there is
    foreign_key: str = ""
    primary_key: str = ""
    caption_column: str | None = None
    properties: tuple[Property, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    alias: str | None = None
    closure: Closure | None = None
    type: str = "STRING"
    caption: str | None = None
    broadcast_rows: int | None = None  # send it to all executors if it has no more rows than this; None: leave it to Spark
    force_index: str | None = None  # accepted and ignored: Spark has none
    data_source: str | None = None  # None: that of the model or dimension it hangs on
    ai: AiNote = AiNote()

    @property
    def caption_or_key(self) -> str:
        return self.caption_column or self.primary_key or self.foreign_key


@dataclass(frozen=True)
class TableModel:
    name: str
    source: Source
    id_column: str | None = None
    dimensions: tuple[Dimension, ...] = ()
    properties: tuple[Property, ...] = ()
    measures: tuple[Measure, ...] = ()
    caption: str | None = None
    type: str = "table"  # or document: properties and measures only
    data_source: str | None = None
    ai: AiNote = AiNote()

    def __post_init__(self) -> None:
        if self.type == "document" and self.dimensions:
            raise ValueError(f"{self.name}: a document model has no dimensions")
        keys = [x.key for x in (*self.properties, *self.measures)] + [d.name for d in self.dimensions]
        if len(keys) != len(set(keys)):
            raise ValueError(f"{self.name}: two fields with one name")

    def processed(self, *processors: Callable[[TableModel], TableModel]) -> TableModel:
        """The model as load-time processors leave it."""
        model = self
        for p in processors:
            model = p(model)
        return model

    def with_dimensions(self, *more: Dimension) -> TableModel:
        return replace(self, dimensions=(*self.dimensions, *more))


@dataclass(frozen=True)
class On:
    """One condition of a model join: a column of the left model with a column of the right one, or with a constant."""

    left: str
    op: str
    right: str | None = None
    constant: object = None


@dataclass
class ModelJoin:
    """left.join(right) under conditions that are all to hold; on_builder: a function of both sides' column functions."""

    left: str
    right: str
    how: str = "left"
    conditions: list[On] = field(default_factory=list)
    on_builder: Callable[[Callable, Callable], Column] | None = None

    def on(self, left: str, right: str) -> ModelJoin:
        return self._add(left, "=", right, None)

    and_ = on

    def _add(self, left: str, op: str, right: str | None, constant: object) -> ModelJoin:
        self.conditions.append(On(left, op, right, constant))
        return self

    def eq(self, left: str, value: object) -> ModelJoin:
        return self._add(left, "=", None, value)

    def neq(self, left: str, value: object) -> ModelJoin:
        return self._add(left, "<>", None, value)

    def gt(self, left: str, value: object) -> ModelJoin:
        return self._add(left, ">", None, value)

    def gte(self, left: str, value: object) -> ModelJoin:
        return self._add(left, ">=", None, value)

    def lt(self, left: str, value: object) -> ModelJoin:
        return self._add(left, "<", None, value)

    def lte(self, left: str, value: object) -> ModelJoin:
        return self._add(left, "<=", None, value)

    def compare(self, left: str, op: str, right: str) -> ModelJoin:
        """A condition between two columns with any comparison."""
        return self._add(left, op, right, None)


@dataclass(frozen=True)
class Order:
    field: str
    direction: str = "asc"
    null_first: bool = False
    null_last: bool = False


@dataclass(frozen=True)
class AccessRule:
    """Adds conditions to each query.  builder: gets an Access and the caller's context.  members: the like for the list
    of a dimension's members."""

    builder: Callable | None = None
    field: str | None = None
    members: Callable | None = None


@dataclass(frozen=True)
class QueryModel:
    """What clients may ask of a table model and of the models joined to it.

    fields: references that may be used, None for all; a bare dimension stands for its id and caption.
    """

    name: str
    model: TableModel
    fields: tuple[str, ...] | None = None
    joins: tuple[ModelJoin, ...] = ()
    models: tuple[tuple[str, TableModel], ...] = ()  # alias and model of each joined one
    orders: tuple[Order, ...] = ()
    accesses: tuple[AccessRule, ...] = ()
    caption: str | None = None
    scope_field: str | None = None  # the field that an open viewer link must bound
    scope_days: int = 31
    ai: AiNote = AiNote()


@dataclass(frozen=True)
class Dictionary:
    """Values and their labels, looked up either way."""

    id: str
    items: tuple[tuple[object, str], ...]
    caption: str | None = None

    def label(self, value: object) -> str | None:
        return next((b for a, b in self.items if a == value), None)

    def value(self, label: str) -> object:
        return next((a for a, b in self.items if b == label), None)
