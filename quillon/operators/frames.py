"""Helpers over DataFrames: optional predicates, lookups, group breaks, semi joins, masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(value: object) -> bool:
    return value is None or value == "" or (isinstance(value, (list, tuple, set, dict)) and not value)


def when_given(value: object, predicate: Callable[[object], Column], force: bool = False) -> Column | None:
    """The predicate of a value, None (no condition) for an empty one unless forced."""
    return None if is_empty(value) and not force else predicate(value)


def in_list(c: Column, values: Sequence, force: bool = False) -> Column | None:
    """Membership; an empty list is no condition, or one that nothing meets if forced."""
    if is_empty(values):
        return F.lit(False) if force else None
    return c.isin(list(values))


def like_text(value: str | None, left: bool = True, right: bool = True) -> str | None:
    """A LIKE pattern: %v%, %v or v%."""
    return None if value is None else "%" * left + str(value) + "%" * right


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Filters by those predicates that there are."""
    there = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, there)) if there else df


def first_by(df: DataFrame, column: str, value: object, order: Sequence[str] = ()) -> DataFrame:
    """The first row with a value, by an order; without one, any."""
    found = df.filter(F.col(column) == F.lit(value))
    return (found.orderBy(*order) if order else found).limit(1)


def unique_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df as a unique index of columns: a row per key, `row`.  A key with several rows raises an error when rows are read."""
    held = df.groupBy(*columns).agg(F.first(F.struct(*df.columns)).alias("row"), F.count("*").alias("#n"))
    one = F.when(F.col("#n") > 1, F.raise_error(F.concat(F.lit("several rows with one key: "), F.to_json(F.struct(*columns))))).otherwise(F.lit(None).cast("string"))
    return held.withColumn("#checked", one).filter(F.col("#checked").isNull()).select(*columns, "row")


def multi_by(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df as a multiple index of columns: all rows of a key, `rows`, in an order.  A key's rows are held together."""
    fields = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))
    return df.groupBy(*columns).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["row"]).alias("rows"))


def to_list(df: DataFrame, column: str, limit: int) -> list:
    """A column's first values; one more than the limit, as far as there are."""
    return [r[0] for r in df.select(column).limit(limit + 1).collect()]


def left_join(df: DataFrame, other: DataFrame, left_key: str, right_key: str, columns: Sequence[str]) -> DataFrame:
    """Every match of one pair of keys; the other's columns come last."""
    right = other.select(F.col(right_key).alias("#key"), *columns)
    return df.join(right, F.col(left_key) == F.col("#key"), "left").drop("#key")


def semi_join(df: DataFrame, other: DataFrame, left_key: str, right_key: str, anti: bool = False) -> DataFrame:
    """Rows whose key the other has, or lacks."""
    keys = other.select(F.col(right_key).alias("#key"))
    return df.join(keys, F.col(left_key) == F.col("#key"), "left_anti" if anti else "left_semi")


def group_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], over: Sequence[str] = ()) -> DataFrame:
    """Adds new_group (the keys differ from those of the row before) and group_no, in the given order.

    over: columns that part the rows first; without them the groups are numbered over all rows by two passes, so that no
    single task gets them all.
    """
    change = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lag(k).over(Window.partitionBy(*over).orderBy(*order))) for k in keys])
    if over:
        by = Window.partitionBy(*over).orderBy(*order)
        marked = df.withColumn("new_group", change | (F.row_number().over(by) == 1))
        return marked.withColumn("group_no", F.sum(F.col("new_group").cast("bigint")).over(by))
    return _numbered(df, keys, order)


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).withColumn("#part", F.spark_partition_id())
    ranged = ranged.persist()
    by = Window.partitionBy("#part").orderBy(*order)
    lasts = ranged.groupBy("#part").agg(F.max_by(F.struct(*keys), F.struct(*order)).alias("last"), F.min_by(F.struct(*keys), F.struct(*order)).alias("first"))
    inner = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lag(k).over(by)) for k in keys]) & (F.row_number().over(by) > 1)
    counted = ranged.withColumn("#inner", inner)
    counts = {r["#part"]: r["n"] for r in counted.groupBy("#part").agg(F.sum(F.col("#inner").cast("bigint")).alias("n")).collect()}  # a row per partition
    base, opens, before = {}, {}, None
    running = 0
    for r in sorted(lasts.collect(), key=lambda r: r["#part"]):
        fresh = before is None or r["first"] != before
        running += fresh
        base[r["#part"]], opens[r["#part"]] = running, fresh
        running += counts[r["#part"]]
        before = r["last"]
    if not base:
        return df.withColumn("new_group", F.lit(True)).withColumn("group_no", F.lit(0).cast("bigint"))
    start = F.create_map(*[F.lit(x) for item in base.items() for x in item])[F.col("#part")]
    fresh = F.create_map(*[F.lit(x) for item in opens.items() for x in item])[F.col("#part")]
    out = counted.withColumn("group_no", (start + F.sum(F.col("#inner").cast("bigint")).over(by)).cast("bigint"))
    return out.withColumn("new_group", F.when(F.row_number().over(by) == 1, fresh).otherwise(F.col("#inner"))).select(*df.columns, "new_group", "group_no")


def mask_middle(c: Column, head: int, tail: int, sign: str = "*", count: int = 4) -> Column:
    """138****1234: what is longer than head and tail keeps those."""
    text = c.cast("string")
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(sign * count), F.expr("''") if tail == 0 else F.right(text, F.lit(tail)))).otherwise(text)


def cents_to_units(c: Column) -> Column:
    return (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
