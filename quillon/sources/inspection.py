"""A model suggested from a table's schema: logical types, roles, aggregations and dimensions by names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.functions.naming import camel
from quillon.functions.types import logical_of
from quillon.plans.model import Dimension, Measure, Property, TableModel

#: Parts of names that tell what a numeric column is.
MONEY_WORDS = ("amount", "price", "cost", "fee", "total", "tax", "balance", "revenue", "profit", "money")
MEAN_WORDS = ("price", "rate", "ratio", "percent", "avg", "average", "discount", "score")
KEY_ENDS = ("_id", "_key", "key", "_no", "_code")


def role_of(name: str, kind: str) -> str:
    """key, measure, time, flag or property."""
    low = name.lower()
    if kind in ("DAY", "DATETIME"):
        return "time"
    if kind == "BOOL" or low.startswith(("is_", "has_")):
        return "flag"
    if kind in ("INTEGER", "BIGINT", "NUMBER", "STRING") and (low == "id" or low.endswith(KEY_ENDS)):
        return "key"
    return "measure" if kind in ("INTEGER", "BIGINT", "NUMBER", "MONEY") else "property"


def aggregation_of(name: str) -> str:
    return "avg" if any(w in name.lower() for w in MEAN_WORDS) else "sum"


def dimension_name(column: str) -> str:
    low = column.lower()
    for end in ("_id", "_key", "_code", "key"):
        if low.endswith(end) and len(low) > len(end):
            return camel(column[: -len(end)].rstrip("_"))
    return camel(column)


def describe_columns(df: DataFrame) -> list[dict]:
    out = []
    for f in df.schema.fields:
        kind = logical_of(f.dataType)
        if kind == "NUMBER" and any(w in f.name.lower() for w in MONEY_WORDS):
            kind = "MONEY"
        role = role_of(f.name, kind)
        out.append({"column": f.name, "name": camel(f.name), "spark": f.dataType.simpleString(), "type": kind, "role": role, "nullable": f.nullable, "aggregation": aggregation_of(f.name) if role == "measure" else None})
    return out


def table_kind(columns: list[dict]) -> str:
    """fact: two keys or more and a measure; dimension otherwise."""
    keys = sum(c["role"] == "key" for c in columns)
    return "fact" if keys >= 2 and any(c["role"] == "measure" for c in columns) else "dimension"


def suggest_model(name: str, source: str, df: DataFrame, id_column: str | None = None) -> TableModel:
    """A table model of df; its first key is the id, the others dimensions without a table yet."""
    columns = describe_columns(df)
    keys = [c for c in columns if c["role"] == "key"]
    id_column = id_column or (keys[0]["column"] if keys else None)
    taken: set[str] = set()

    def free(n: str) -> str:
        while n in taken:
            n += "_"
        taken.add(n)
        return n

    dimensions = tuple(Dimension(free(dimension_name(c["column"])), None, c["column"], type=c["type"]) for c in keys if c["column"] != id_column)
    measures = tuple(Measure(c["column"], free(c["name"]), c["aggregation"], c["type"]) for c in columns if c["role"] == "measure")
    properties = tuple(Property(c["column"], free(c["name"]), c["type"]) for c in columns if c["role"] not in ("key", "measure") or c["column"] == id_column)
    return TableModel(name, source, id_column, dimensions, properties, measures)


def ddl_of(schema: T.StructType, table: str, comment: str | None = None) -> str:
    """CREATE TABLE of a schema, in Spark SQL."""
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING parquet" + (f" COMMENT '{comment}'" if comment else "")


def missing_columns(schema: T.StructType, existing: T.StructType) -> list[T.StructField]:
    """Columns that a table lacks of a schema, for ALTER TABLE ... ADD COLUMNS."""
    there = {f.name.lower() for f in existing.fields}
    return [f for f in schema.fields if f.name.lower() not in there]


def drop_ddl(table: str) -> str:
    return f"DROP TABLE IF EXISTS {table}"


def alter_ddl(schema: T.StructType, existing: T.StructType, table: str) -> str | None:
    """ALTER TABLE for the columns that the table lacks; None where it lacks none."""
    lacking = [f"`{f.name}` {f.dataType.simpleString().upper()}" for f in missing_columns(schema, existing)]
    return f"ALTER TABLE {table} ADD COLUMNS ({', '.join(lacking)})" if lacking else None


def synchronise(spark: SparkSession, schema: T.StructType, table: str) -> list[str]:
    """Creates the table, or adds the columns that it lacks; returns the statements that it ran.  Nothing is ever dropped."""
    made = alter_ddl(schema, spark.table(table).schema, table) if spark.catalog.tableExists(table) else ddl_of(schema, table)
    if made:
        spark.sql(made)
    return [made] if made else []
