"""Writing: insert, upsert, version-guarded upsert, delete; as new states of a table that a caller then writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows after it, by column names; columns that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], version: str | None = None, updates: dict[str, Callable[[Column, Column], Column]] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """table with rows in place of those that have their keys, and the others added.

    Of several rows with one key the last counts: by the columns of order, else by version, else as rows come.  version: a
    stored row with a larger one stays.  updates: for a column, a function of its old and new value.  Null keys equal
    nothing, as in a database's unique index.
    """
    rows = last_of_key(rows, keys, order or ([version] if version else ()))
    new = rows.select(*[F.col(c).alias(f"#{c}") for c in table.columns if c in rows.columns], F.lit(True).alias("#there"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"#{k}") for k in keys])
    joined = table.withColumn("#old", F.lit(True)).join(new, same, "full_outer")
    old, there = F.col("#old").isNotNull(), F.col("#there").isNotNull()
    stays = ~there if version is None else ~there | (old & (F.col(version) > F.col(f"#{version}")))
    out = []
    for c in table.columns:
        if c not in rows.columns:
            out.append(F.col(c))
            continue
        value = F.col(f"#{c}")
        if updates and c in updates and c not in keys:
            value = F.when(old, updates[c](F.col(c), value)).otherwise(value)
        out.append(F.when(stays, F.col(c)).otherwise(value).alias(c))
    return joined.select(*out)


def last_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """rows with the last one of each key; all of those with a null key.  One aggregation, with a partial one before it."""
    place = F.struct(*[F.col(c) for c in order], F.monotonically_increasing_id().alias("#at"))
    bare = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("#row"), place.alias("#place"), *keys)
    one = held.filter(~bare).groupBy(*keys).agg(F.max_by("#row", "#place").alias("#row")).select("#row")
    return one.union(held.filter(bare).select("#row")).select("`#row`.*")


def without(table: DataFrame, values: dict[str, object]) -> DataFrame:
    """table without the rows that have all these values; one with a null there stays."""
    gone = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
    return table.filter(~gone)


def without_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table without the rows whose keys are among rows."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def append(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").format(kind).partitionBy(*partition_by).save(path) if partition_by else df.write.mode("append").format(kind).save(path)


def replace_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a new state beside the old one and then takes its place, so df may have been read from path."""
    spark, fresh, old = df.sparkSession, path.rstrip("/") + "__new", path.rstrip("/") + "__old"
    df.write.mode("overwrite").format(kind).save(fresh)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(fresh), make(path))
    fs.delete(make(old), True)
