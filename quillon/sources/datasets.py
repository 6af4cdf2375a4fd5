"""Datasets by SQL text: optional parts with bound values, several texts with conditions, and plain helpers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from quillon.engine import Engine
from quillon.operators.frames import is_empty


#: A place for a value, or a quoted part, in which there is none.
MARK = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\?")


class Script:
    """SELECT text put together from parts.  {name} is a table; each ? of an optional part is bound to a value."""

    def __init__(self, text: str):
        self.text, self.values, self.start, self.limit = text, [], 0, None

    def optional(self, part: str, value: object, force: bool = False) -> Script:
        """Adds the part if the value isn't empty; the value counts once for each ? in it."""
        if not is_empty(value) or force:
            self.text += " " + part
            self.values += [value] * MARK.findall(part).count("?")
        return self

    def in_list(self, part: str, values: list, force: bool = False) -> Script:
        """Adds ``part (?, ?, ...)``; an empty list adds nothing, or what nothing meets if forced."""
        if is_empty(values):
            self.text += f" {part} (NULL) AND 1 = 2" if force else ""
        else:
            self.text += f" {part} ({', '.join('?' * len(values))})"
            self.values += list(values)
        return self

    def then(self, part: str) -> Script:
        self.text += " " + part
        return self

    def page(self, start: int, limit: int) -> Script:
        self.start, self.limit = start, limit
        return self

    def whole(self, engine: Engine) -> DataFrame:
        """All rows, without the page."""
        import string

        names = {n for _, n, _, _ in string.Formatter().parse(self.text) if n}
        left, values = iter(self.values), {}

        def bound(m: re.Match) -> str:
            if m[0] != "?":
                return m[0]
            name = f"p{len(values)}"
            values[name] = next(left)
            return f":{name}"

        text = MARK.sub(bound, self.text)
        return engine.spark.sql(text, args=values or None, **{n: engine.frame_of(n) for n in names})

    def run(self, engine: Engine) -> DataFrame:
        rows = self.whole(engine)
        if self.start:
            rows = rows.offset(self.start)
        return rows if self.limit is None else rows.limit(self.limit)

    def count(self, engine: Engine) -> int:
        return self.whole(engine).count()


class Conditional:
    """Several texts; the first whose condition holds for the arguments is the dataset."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, Callable[[dict], bool], str | None]] = []

    def add(self, sql: str, match: Callable[[dict], bool] = lambda args: True, data_source: str | None = None) -> Conditional:
        self.entries.append((sql, match, data_source))
        return self

    def run(self, engine: Engine, args: dict) -> DataFrame:
        for sql, match, data_source in self.entries:
            if match(args):
                return engine.view(sql, data_source)
        raise LookupError("no text's condition holds")


def query_maps(df: DataFrame, limit: int | None = None) -> list[dict]:
    """Rows as dictionaries; the caller answers for their number."""
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def query_object(df: DataFrame) -> dict | None:
    row = df.first()
    return row.asDict(recursive=True) if row else None


def tables(engine: Engine) -> list[str]:
    """Tables and views of the session's catalog."""
    return [t.name for t in engine.spark.catalog.listTables()]


def jdbc_source(spark, url: str, properties: dict | None = None) -> Callable[[str], DataFrame]:
    """A data source whose tables are read over JDBC, filters and columns pushed down by Spark."""
    return lambda name: spark.read.jdbc(url, name, properties=properties or {})


def files_source(spark, root: str, kind: str = "parquet", options: dict | None = None) -> Callable[[str], DataFrame]:
    """A data source of files, one folder or file per table."""
    return lambda name: spark.read.format(kind).options(**(options or {})).load(f"{root.rstrip('/')}/{name}.{kind}")
