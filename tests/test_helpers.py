import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.errors import AccessDenied, QueryError
from quillon.functions import scripting as S
from quillon.operators import frames
from quillon.sources import inspection, sinks
from quillon.star import star_engine
from quillon.tools import Tools, chart, infer_chart


def test_operators():
    assert S.plus(1, 2) == 3 and S.plus(1, 2.5) == 3.5 and S.plus("a", 1) == "a1" and S.plus(None, 4) == 4
    assert S.minus("x", 2) == -2 and S.minus(5) == -5 and S.times(2, None) is None
    assert S.divide(None, 3) == 0.0 and math.isnan(S.divide(1, None)) and S.divide(1, 0) == math.inf
    assert S.modulo(-7, 3) == -1 and S.bit_and(None, 3) == 0
    assert S.equal(None, None) and S.equal(1, Decimal("1.0")) and not S.equal(None, 0)
    assert S.compare(None, 1) == -1 and S.compare("b", "a") == 1 and S.compare(2, 10) == -1
    assert S.iif("", 1, 2) == 2 and S.first_true(0, "", "x") == "x" and S.case(0, 1, "y", 2, 3) == 2 and S.case(0, 1, 9) == 9
    assert S.to_ints([None, "3.7", 2]) == [0, 3, 2] and list(S.each(["a"])) == [("a", 0)]


def test_lists_and_json():
    values = [1, 2]
    assert S.push(values, 3) == 3 and S.includes(values, 3)
    assert S.keep(values, lambda v: v > 1 or "yes") == [2, 3]
    assert S.join([1, None, True]) == "1,,true"
    assert S.without_empty({"a": 0, "b": "", "c": None, "d": []}) == {"a": 0}
    assert S.parse_json(S.stringify({"a": [1, "é"]})) == {"a": [1, "é"]} and S.is_array([]) and not S.is_array("")


def test_dates_and_numbers():
    assert S.start_of("2024-05-17 13:45:10", "quarter") == datetime(2024, 4, 1) and S.end_of("2024-02-10", "month") == datetime(2024, 2, 29, 23, 59, 59)
    assert S.add("2024-01-31", months=1) == datetime(2024, 2, 29) and S.add("2024-01-31", days=1) == datetime(2024, 2, 1)
    assert S.check_days_range("2024-01-01", "2024-01-11", 10) == 10 and S.same("2024-01-01 05:00", "2024-01-01")
    with pytest.raises(ValueError):
        S.check_days_range("2024-01-01", "2024-01-12", 10)
    assert S.date_text(0) == "1970-01-01" and S.date_text(None) is None and S.to_date("17.05.24", "%d.%m.%y") == datetime(2024, 5, 17)
    assert S.has_flag(6, 2) and S.without_flag(6, 2) == 4 and S.with_flag(None, 1) == 1
    assert S.fixed(2.675, 2) == Decimal("2.68") and S.cents_to_units(1234) == Decimal("12.34") and S.total(1, None, 2) == 3 and S.digits(12345, 1, 3) == 234


def test_rules_as_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, '0', timestamp'2024-05-17 13:45:00'), (NULL, '', NULL), (6, 'x', timestamp'2024-05-17 00:00:00') AS t(n, s, at)")
    C = S.COLUMNS
    rows = df.select(C["truthy"](F.col("s")).alias("a"), C["has_flag"](F.col("n"), 2).alias("b"), C["iif"](F.col("n"), F.lit("y"), F.lit("n")).alias("c"), C["end_of_day"](F.col("at")).alias("d")).collect()
    assert [r.a for r in rows] == [False, False, True] and [r.b for r in rows] == [False, False, True] and [r.c for r in rows] == ["y", "n", "y"]
    assert rows[0].d == datetime(2024, 5, 17, 23, 59, 59)


def test_frame_helpers(spark):
    df = spark.range(5)
    assert frames.where_all(df, frames.when_given("", lambda v: F.col("id") == v), frames.in_list(F.col("id"), [1, 2])).count() == 2
    assert frames.where_all(df, frames.in_list(F.col("id"), [], force=True)).count() == 0
    assert frames.to_list(df, "id", 2) == [0, 1, 2]
    assert frames.like_text("a", right=False) == "%a" and frames.like_text(None) is None
    assert [r[0] for r in spark.createDataFrame([("13812345678",), ("12",), (None,)], "p string").select(frames.mask_middle(F.col("p"), 3, 4)).collect()] == ["138****5678", "12", None]
    empty = frames.group_breaks(spark.range(0), ["id"], ["id"])
    assert empty.columns == ["id", "new_group", "group_no"] and empty.count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (None, "n", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (3, "C", 1)], "k int, v string, version int")
    got = {r.k: r.v for r in sinks.upserted(old, new, ["k"], "version").collect()}
    assert got == {1: "a", 2: "B", None: "n", 3: "C"}
    both = sinks.upserted(old, new, ["k"], updates={"v": lambda a, b: F.concat(a, b)})
    assert {r.k: r.v for r in both.collect()} == {1: "aA", 2: "bB", None: "n", 3: "C"}
    assert sinks.without(old, {"k": None}).count() == 2 and sinks.without_rows(old, new, ["k"]).count() == 1
    path = f"file://{tmp_path}/t"
    sinks.append(old, path)
    sinks.replace_table(sinks.upserted(spark.read.parquet(path), new, ["k"]), path)
    sinks.append(new.limit(1), path)
    assert spark.read.parquet(path).count() == 5


def test_inspection(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    model = inspection.suggest_model("Orders2", "orders", e.frame_of("orders"))
    assert model.id_column == "o_orderkey" and [d.foreign_key for d in model.dimensions] == ["o_custkey"] and [m.column for m in model.measures] == ["o_totalprice"]
    e.register(model)
    assert e.rows("Orders2", {"columns": ["oOrderstatus", "oTotalprice"], "groupBy": ["oOrderstatus"]}).count() > 0
    assert inspection.ddl_of(e.frame_of("region").schema, "r").startswith("CREATE TABLE IF NOT EXISTS r (`r_regionkey` INT, `r_name` STRING)")
    assert [f.name for f in inspection.missing_columns(e.frame_of("nation").schema, e.frame_of("region").schema)] == ["n_nationkey", "n_name", "n_regionkey"]


def test_tools(spark, sf_dir):
    tools = Tools(star_engine(spark, sf_dir))
    body = {"model": "Orders", "payload": {"columns": ["status", "orderCount"], "groupBy": ["status"], "orderBy": ["status"]}}
    made = tools.call("dataset.export_with_chart", body)
    assert made["chart"]["type"] == "PIE" and made["chart"]["xField"] == "status" and made["limit"] == 20
    assert tools.call("dataset.query_model_v2", {**body, "mode": "validate"})["columns"] == ["status", "orderCount"]
    assert tools.call("dataset.inspect_table", {"table": "lineitem"})["kind"] == "fact"
    with pytest.raises(AccessDenied):
        tools.call("dataset.query_model_v2", body, role="BUSINESS")
    with pytest.raises(QueryError):
        tools.call("dataset.query_model_v2", {"model": "Orders"})
    assert [r.success for r in tools.audit_rows().orderBy("at").collect()] == [True, True, True, False, False]
    assert infer_chart([{"month": "2024-01", "n": 1}], {}, True)["type"] == "LINE"
    with pytest.raises(QueryError):
        chart("RADAR", [], "a", "b")
