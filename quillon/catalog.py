"""The registered queries of the semantic layer over the test tables, each with the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.engine import Engine, column_security
from quillon.errors import QueryError
from quillon.functions import scripting
from quillon.operators import frames
from quillon.operators.access import SecurityContext
from quillon.plans.model import AccessRule, Measure, QueryModel
from quillon.plans.request import read_request
from quillon.sources import datasets, inspection, sinks
from quillon.star import ORDERS, star_engine
from quillon.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def total(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x})"


def ask(key: str, model: str, body: dict, sql: str | None, context: SecurityContext | None = None, label: bool = False) -> None:
    """Registers a request."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = star_engine(spark, sf_dir)
        rows = engine.rows(model, body, context)
        return engine.labelled(model, rows) if label else rows

    QUERIES[key] = run
    if sql:
        ORACLES[key] = sql


def use(key: str, sql: str | None = None) -> Callable:
    """Registers a function of an engine."""

    def register(f: Callable[[Engine], DataFrame]) -> Callable:
        QUERIES[key] = lambda spark, sf_dir: f(star_engine(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return register


def cond(field: str, op: str, value: object = None, **more: object) -> dict:
    return {"field": field, "op": op, **({} if op.startswith("is ") else {"value": value}), **more}


OC = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"
OCNR = OC + " LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
LO = "lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
LOCNR = LO + " LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"

# -- scans and projections
ask("scan_select", "Orders", {"columns": ["orderKey", "status", "totalPrice"]}, 'SELECT o_orderkey AS "orderKey", o_orderstatus AS status, o_totalprice AS "totalPrice" FROM orders')
ask("select_all", "Labels", {}, 'SELECT doc_id AS "labelDoc", quality, toxic, 1 AS "labelCount" FROM labels')
ask("exclude_columns", "Documents", {"exColumns": ["source", "count", "nChars", "docCount", "chars"]}, 'SELECT doc_id AS "docId", lang FROM documents')
ask("view_model", "BigOrders", {"columns": ["custKey", "totalPrice"], "groupBy": ["custKey"]}, f'SELECT o_custkey AS "custKey", {total("o_totalprice")} AS "totalPrice" FROM orders WHERE o_totalprice > 200000 GROUP BY 1')
ask("distinct_rows", "Orders", {"columns": ["status", "priority"], "distinct": True}, "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
ask("dimension_expands", "Orders", {"columns": ["orderKey", "customer"]}, f'SELECT o_orderkey AS "orderKey", o_custkey AS "customer$id", c_name AS "customer$caption" FROM {OC}')
ask("key_only_dimension", "Events", {"columns": ["user$id", "eventCount"], "groupBy": ["user$id"]}, 'SELECT user_id AS "user$id", count(*) AS "eventCount" FROM events GROUP BY 1')

# -- joins
ask("join_dimension", "Orders", {"columns": ["orderKey", "customer$caption", "customer$segment"]}, f'SELECT o_orderkey AS "orderKey", c_name AS "customer$caption", c_mktsegment AS "customer$segment" FROM {OC}')
FLAGSHIP = {
    "columns": ["order.customer.nation$caption", "sum(extendedPrice * (1 - discount)) as revenue", "count(*) as n"],
    "slice": [cond("order$orderDate", "[)", ["1995-01-01", "1996-01-01"]), cond("revenue", ">", 0)],
    "orderBy": [{"field": "revenue", "order": "desc"}, {"field": "order.customer.nation$caption"}],
    "limit": 25,
}
NET = "l_extendedprice * (1 - l_discount)"
ask("join_snowflake_4hop", "LineItem", FLAGSHIP, f"""SELECT n_name AS "order_customer_nation$caption", {total(NET)} AS revenue, count(*) AS n FROM {LOCNR}
  WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1 HAVING sum({NET}) > 0 ORDER BY revenue DESC, 1 LIMIT 25""")
ask("join_region_5_tables", "LineItem", {"columns": ["order.customer.nation.region$caption", "quantity", "lineCount"], "groupBy": ["order.customer.nation.region$caption"]},
    f'SELECT r_name AS "order_customer_nation_region$caption", {total("l_quantity")} AS quantity, count(*) AS "lineCount" FROM {LOCNR} GROUP BY 1')
ask("join_by_alias", "Orders", {"columns": ["customerNation$caption", "orderCount"], "groupBy": ["customerNation$caption"]}, f'SELECT n_name AS "customerNation$caption", count(*) AS "orderCount" FROM {OCNR} GROUP BY 1')
ask("join_role_playing_nation", "LineItem", {"columns": ["customerNation$caption", "supplierNation$caption", "lineCount"], "groupBy": ["customerNation$caption", "supplierNation$caption"]},
    f'''SELECT n.n_name AS "customerNation$caption", n2.n_name AS "supplierNation$caption", count(*) AS "lineCount" FROM {LOCNR}
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n2 ON s.s_nationkey = n2.n_nationkey GROUP BY 1, 2''')  # fmt: skip
ask("join_pruned", "LineItem", {"columns": ["returnFlag", "lineStatus", "quantity", "lineCount"], "groupBy": ["returnFlag", "lineStatus"]}, f'SELECT l_returnflag AS "returnFlag", l_linestatus AS "lineStatus", {total("l_quantity")} AS quantity, count(*) AS "lineCount" FROM lineitem GROUP BY 1, 2')
ask("join_for_filter_only", "Orders", {"columns": ["orderCount"], "groupBy": ["status"], "slice": [cond("customerNation$caption", "=", "NATION_3")]}, f"SELECT count(*) AS \"orderCount\" FROM {OCNR} WHERE n_name = 'NATION_3' GROUP BY o_orderstatus")
ask("join_type_override", "LineItem", {"columns": ["order$status", "lineCount"], "groupBy": ["order$status"], "joinTypes": {"order": "inner"}}, f'SELECT o_orderstatus AS "order$status", count(*) AS "lineCount" FROM {LO.replace("LEFT", "INNER")} GROUP BY 1')
ask("model_left_join", "DocumentsLeftLabels", {"columns": ["docId", "lang", "COALESCE(label.quality, 9) as quality9", "COALESCE(label.toxic, 9) as toxic9"]}, 'SELECT d.doc_id AS "docId", lang, coalesce(quality, 9) AS quality9, coalesce(toxic, 9) AS toxic9 FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id')
ask("model_inner_join", "DocumentsInnerLabels", {"columns": ["lang", "label.quality", "docCount"], "groupBy": ["lang", "label.quality"]}, 'SELECT lang, quality AS label_quality, count(*) AS "docCount" FROM documents d JOIN labels b ON d.doc_id = b.doc_id GROUP BY 1, 2')
ask("model_right_join", "DocumentsRightLabels", {"columns": ["label.labelDoc", "lang"]}, 'SELECT b.doc_id AS "label_labelDoc", lang FROM documents d RIGHT JOIN labels b ON d.doc_id = b.doc_id')
ask("model_theta_join", "DocumentsThetaLabels", {"columns": ["docId", "COALESCE(label.quality, 9) as quality9"]}, 'SELECT d.doc_id AS "docId", coalesce(quality, 9) AS quality9 FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id AND b.quality = 1 AND d.doc_id >= 100')
ask("model_custom_on", "DocumentsCustomLabels", {"columns": ["docId", "COALESCE(label.toxic, 9) as toxic9"]}, 'SELECT d.doc_id AS "docId", coalesce(toxic, 9) AS toxic9 FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id AND b.toxic = 0')

# -- filters
FILTERS = {
    "filter_eq": (cond("status", "=", "O"), "o_orderstatus = 'O'"),
    "filter_eq_code": (cond("status", "eq", "F"), "o_orderstatus = 'F'"),
    "filter_ne": (cond("status", "!=", "O"), "o_orderstatus <> 'O'"),
    "filter_ne_sign": (cond("status", "<>", "P"), "o_orderstatus <> 'P'"),
    "filter_eq_null_safe": (cond("status", "===", "P"), "o_orderstatus IS NOT DISTINCT FROM 'P'"),
    "filter_cmp": ([cond("totalPrice", ">", 50000), cond("totalPrice", "<=", 90000)], "o_totalprice > 50000 AND o_totalprice <= 90000"),
    "filter_in": (cond("priority", "in", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": (cond("priority", "not in", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "filter_bit_in": (cond("orderKey", "bit_in", [1, 8]), "((o_orderkey & 1) <> 0 OR (o_orderkey & 8) <> 0)"),
    "filter_like": (cond("priority", "like", "HIG"), "o_orderpriority LIKE '%HIG%'"),
    "filter_left_like": (cond("priority", "left_like", "URGENT"), "o_orderpriority LIKE '%URGENT'"),
    "filter_right_like": (cond("priority", "right_like", "3-"), "o_orderpriority LIKE '3-%'"),
    "filter_not_like": (cond("priority", "not like", "%LOW%"), "o_orderpriority NOT LIKE '%LOW%'"),
    "filter_not_null": (cond("status", "is not null"), "o_orderstatus IS NOT NULL"),
    "filter_not_null_or_empty": (cond("status", "is not null and empty"), "NOT (o_orderstatus IS NULL OR o_orderstatus = '')"),
    "range_cc": (cond("orderDate", "[]", ["1995-03-01", "1995-06-30"]), "o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1995-06-30'"),
    "range_co": (cond("orderDate", "[)", ["1995-03-01", "1995-06-30"]), "o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-30'"),
    "range_oc": (cond("orderDate", "(]", ["1995-03-01 00:00", "1995-06-30"]), "o_orderdate > TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1995-06-30'"),
    "range_oo": (cond("orderDate", "()", ["1995-03", "1995-06-30 00:00:00"]), "o_orderdate > TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-30'"),
    "range_open_end": (cond("totalPrice", "[]", [300000, None]), "o_totalprice >= 300000"),
    "filter_or": ([cond("status", "=", "P"), cond("priority", "=", "1-URGENT", link=2)], "o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'"),
    "filter_and_binds_tighter": ([cond("status", "=", "P"), cond("priority", "=", "1-URGENT", link=2), cond("totalPrice", ">", 100000)], "o_orderstatus = 'P' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 100000)"),
    "filter_nested": ([cond("status", "=", "O"), {"link": 1, "children": [cond("totalPrice", ">=", 200000), cond("customer$segment", "=", "BUILDING", link=2)]}], "o_orderstatus = 'O' AND (o_totalprice >= 200000 OR c_mktsegment = 'BUILDING')"),
    "filter_dictionary_label": (cond("status", "=", "Open"), "o_orderstatus = 'O'"),
    "filter_dictionary_labels": (cond("status", "in", ["Open", "F"]), "o_orderstatus IN ('O', 'F')"),
}
for name, (what, where) in FILTERS.items():
    ask(name, "Orders", {"columns": ["orderKey", "totalPrice"], "slice": what if isinstance(what, list) else [what]}, f'SELECT o_orderkey AS "orderKey", o_totalprice AS "totalPrice" FROM {OC} WHERE {where}')
ask("filter_null", "DocumentsLeftLabels", {"columns": ["docId"], "slice": [cond("label.quality", "is null")]}, 'SELECT d.doc_id AS "docId" FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE quality IS NULL')
ask("filter_null_or_empty", "DocumentsLeftLabels", {"columns": ["docId"], "slice": [cond("label.toxic", "is null and empty")]}, 'SELECT d.doc_id AS "docId" FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE toxic IS NULL')
ask("filter_null_safe_null", "DocumentsLeftLabels", {"columns": ["docId"], "slice": [cond("label.quality", "===", None)]}, 'SELECT d.doc_id AS "docId" FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE quality IS NULL')

# -- aggregation
ask("agg_sum", "Orders", {"columns": ["status", "totalPrice"], "groupBy": ["status"]}, f'SELECT o_orderstatus AS status, {total("o_totalprice")} AS "totalPrice" FROM orders GROUP BY 1')
ask("agg_avg", "Orders", {"columns": ["status", "avg(totalPrice) as mean"]}, f"SELECT o_orderstatus AS status, {mean('o_totalprice')} AS mean FROM orders GROUP BY 1")
ask("agg_count", "Orders", {"columns": ["priority", "orderCount", "count(orderKey) as keys", "count(*) as n"]}, 'SELECT o_orderpriority AS priority, count(*) AS "orderCount", count(o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY 1')
ask("agg_minmax", "Orders", {"columns": ["status", "min(totalPrice) as least", "max(totalPrice) as most"]}, "SELECT o_orderstatus AS status, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
ask("agg_group_concat", "Orders", {"columns": ["customer$id", "group_concat(orderKey) as keys"]}, """SELECT o_custkey AS "customer$id", string_agg(k, ',' ORDER BY k COLLATE "C") AS keys FROM (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY 1""".replace(' COLLATE "C"', ""))
ask("agg_override", "Orders", {"columns": ["status", "totalPrice"], "groupBy": [{"field": "status"}, {"field": "totalPrice", "agg": "AVG"}]}, f'SELECT o_orderstatus AS status, {mean("o_totalprice")} AS "totalPrice" FROM orders GROUP BY 1')
ask("agg_none_is_key", "Orders", {"columns": ["totalPrice", "orderCount"], "groupBy": [{"field": "totalPrice", "agg": "NONE"}]}, 'SELECT o_totalprice AS "totalPrice", count(*) AS "orderCount" FROM orders GROUP BY 1')
ask("agg_pk_is_key", "Orders", {"columns": ["orderKey", "orderCount"], "groupBy": [{"field": "orderKey", "agg": "PK"}]}, 'SELECT o_orderkey AS "orderKey", count(*) AS "orderCount" FROM orders GROUP BY 1')
ask("agg_auto_group", "LineItem", {"columns": ["returnFlag", "sum(quantity) as total"]}, f'SELECT l_returnflag AS "returnFlag", {total("l_quantity")} AS total FROM lineitem GROUP BY 1')
ask("agg_default_measure", "LineItem", {"columns": ["returnFlag", "quantity", "extendedPrice", "discount", "netAmount", "lineCount"], "groupBy": ["returnFlag"]},
    f'''SELECT l_returnflag AS "returnFlag", {total("l_quantity")} AS quantity, {total("l_extendedprice")} AS "extendedPrice", {mean("l_discount")} AS discount, {total(NET)} AS "netAmount", count(*) AS "lineCount" FROM lineitem GROUP BY 1''')
ask("agg_formula_value", "LineItem", {"columns": ["lineStatus", "charge"], "groupBy": ["lineStatus"]}, f'SELECT l_linestatus AS "lineStatus", {total("l_extendedprice * (1 + l_tax)")} AS charge FROM lineitem GROUP BY 1')
ask("agg_expr_ratio", "LineItem", {"columns": ["returnFlag", "sum(netAmount) * 100.0 / sum(extendedPrice) as share"]}, f'SELECT l_returnflag AS "returnFlag", {total(NET)} * 100.0 / {total("l_extendedprice")} AS share FROM lineitem GROUP BY 1')
ask("agg_calc_field", "LineItem", {"columns": ["returnFlag", "gross"], "calculatedFields": [{"name": "gross", "expression": "extendedPrice * (1 + tax)", "agg": "SUM"}]}, f'SELECT l_returnflag AS "returnFlag", {total("l_extendedprice * (1 + l_tax)")} AS gross FROM lineitem GROUP BY 1')
ask("having_simple", "Orders", {"columns": ["customer$id", "sum(totalPrice) as spent"], "slice": [cond("spent", ">=", 1500000)]}, f'SELECT o_custkey AS "customer$id", {total("o_totalprice")} AS spent FROM orders GROUP BY 1 HAVING {total("o_totalprice")} >= 1500000')
ask("having_with_where", "Orders", {"columns": ["customer$segment", "sum(totalPrice) as spent", "count(*) as n"], "slice": [cond("status", "=", "O"), cond("n", ">", 10)]}, f'SELECT c_mktsegment AS "customer$segment", {total("o_totalprice")} AS spent, count(*) AS n FROM {OC} WHERE o_orderstatus = \'O\' GROUP BY 1 HAVING count(*) > 10')
ask("having_or", "Orders", {"columns": ["customer$id", "count(*) as n", "max(totalPrice) as most"], "slice": [cond("n", ">", 15), cond("most", ">", 400000, link=2)]}, 'SELECT o_custkey AS "customer$id", count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING count(*) > 15 OR max(o_totalprice) > 400000')

# -- order, pages, totals
ask("page_offset", "Orders", {"columns": ["orderKey", "totalPrice"], "orderBy": ["orderKey"], "page": 3, "pageSize": 20}, 'SELECT o_orderkey AS "orderKey", o_totalprice AS "totalPrice" FROM orders ORDER BY 1 LIMIT 20 OFFSET 40')
ask("page_start_limit", "Events", {"columns": ["eventId", "eventType"], "orderBy": [{"field": "eventId", "order": "desc"}], "start": 15, "limit": 25}, 'SELECT event_id AS "eventId", event_type AS "eventType" FROM events ORDER BY 1 DESC LIMIT 25 OFFSET 15')
ask("top_k", "Orders", {"columns": ["customer$id", "totalPrice"], "groupBy": ["customer$id"], "orderBy": [{"field": "totalPrice", "order": "desc"}, {"field": "customer$id"}], "limit": 10}, f'SELECT o_custkey AS "customer$id", {total("o_totalprice")} AS "totalPrice" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')


def numbered(rows: DataFrame) -> DataFrame:
    """rows with their place in the order that they come in; sorted partitions are counted, none gets all rows."""
    schema = T.StructType([*rows.schema, T.StructField("place", T.LongType(), False)])
    return rows.sparkSession.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), schema, verifySchema=False)


def ask_order(key: str, model: str, body: dict, columns: str, source: str, order: str) -> None:
    """Registers the whole of an ordered request, each row with its place."""
    use(key, f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM {source}")(lambda e: numbered(e.rows(model, body)))


DL = "documents d LEFT JOIN labels b ON d.doc_id = b.doc_id"
ask_order("order_by", "Orders", {"columns": ["orderKey", "totalPrice"], "orderBy": [{"field": "totalPrice", "dir": "desc"}, {"column": "orderKey", "direction": "asc"}]}, 'o_orderkey AS "orderKey", o_totalprice AS "totalPrice"', "orders", "o_totalprice DESC, o_orderkey")
ask_order("order_default", "OrdersNewest", {"columns": ["orderKey", "orderDate"]}, 'o_orderkey AS "orderKey", o_orderdate AS "orderDate"', "orders", "o_orderdate DESC, o_orderkey")
ask_order("order_by_unselected", "Orders", {"columns": ["orderKey"], "orderBy": [{"field": "totalPrice", "order": "desc"}, "orderKey"]}, 'o_orderkey AS "orderKey"', "orders", "o_totalprice DESC, o_orderkey")
ask_order("order_nulls", "DocumentsLeftLabels", {"columns": ["docId"], "orderBy": [{"field": "label.quality", "order": "desc", "nullFirst": True}, {"field": "docId"}]}, 'd.doc_id AS "docId"', DL, "quality DESC NULLS FIRST, d.doc_id")
ask_order("order_nulls_last", "DocumentsLeftLabels", {"columns": ["docId"], "orderBy": [{"field": "label.quality", "order": "asc", "nullLast": True}, {"field": "docId"}]}, 'd.doc_id AS "docId"', DL, "quality ASC NULLS LAST, d.doc_id")


def totals_of(model: str, body: dict) -> Callable[[Engine], DataFrame]:
    return lambda engine: engine.query(model, {**body, "returnTotal": True}).totals


use("totals_detail", f'SELECT {total("o_totalprice")} AS "totalPrice", count(*) AS "orderCount", count(*) AS total FROM orders WHERE o_orderstatus = \'O\'')(
    totals_of("Orders", {"columns": ["totalPrice", "orderCount"], "slice": [cond("status", "=", "O")]})
)
use("totals_grouped", f"""SELECT CAST(NULL AS VARCHAR) AS status, {total("s")} AS "totalPrice", CAST(sum(n) AS BIGINT) AS "orderCount", {mean("m")} AS mean, max(h) AS most, count(*) AS total FROM (
  SELECT o_orderstatus, {total("o_totalprice")} AS s, count(*) AS n, {mean("o_totalprice")} AS m, max(o_totalprice) AS h FROM orders GROUP BY 1)""")(
    totals_of("Orders", {"columns": ["status", "totalPrice", "orderCount", "avg(totalPrice) as mean", "max(totalPrice) as most"], "groupBy": ["status"]})
)
use("kpi", f'SELECT {total("o_totalprice")} AS "totalPrice", count(*) AS "orderCount" FROM orders WHERE o_orderdate >= TIMESTAMP \'1996-01-01\'')(lambda e: e.kpi("Orders", {"slice": [cond("orderDate", ">=", "1996-01-01")]}))
use("total_count", "SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")(lambda e: e.rows("Orders", {"columns": ["count(*) as total"], "slice": [cond("totalPrice", ">", 100000)]}))

# -- expressions
CALC = {
    "expr_arith": ({"r": "totalPrice * 2 - orderKey / 4", "m": "orderKey % 7", "z": "orderKey / (orderKey - orderKey)"}, "o_totalprice * 2 - CAST(o_orderkey AS DOUBLE) / 4 AS r, o_orderkey % 7 AS m, CAST(NULL AS DOUBLE) AS z"),
    "expr_math": ({"a": "ABS(0 - totalPrice)", "c": "CEIL(totalPrice)", "f": "FLOOR(totalPrice)", "q": "SQRT(orderKey)", "p": "POWER(orderKey, 2)", "m": "MOD(orderKey, 5)"}, "abs(0 - o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, sqrt(o_orderkey) AS q, CAST(power(o_orderkey, 2) AS DOUBLE) AS p, o_orderkey % 5 AS m"),
    "expr_round": ({"r": "ROUND(orderKey / 8, 1)"}, "round(CAST(o_orderkey AS DOUBLE) / 8, 1) AS r"),
    "expr_date": ({"y": "YEAR(orderDate)", "m": "MONTH(orderDate)", "d": "DAY(orderDate)", "day": "DATE(orderDate)", "plus": "DATE_ADD(orderDate, 10)", "minus": "DATE_SUB(orderDate, 3)", "days": "DATEDIFF(orderDate, DATE('1995-01-01'))"},
                  "CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 10 AS plus, CAST(o_orderdate AS DATE) - 3 AS minus, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days"),
    "expr_string": ({"u": "UPPER(priority)", "l": "LOWER(priority)", "s": "SUBSTRING(priority, 3, 4)", "t": "TRIM(CONCAT(' ', status, ' '))", "n": "LENGTH(priority)", "c": "CONCAT(status, '-', priority)"}, "upper(o_orderpriority) AS u, lower(o_orderpriority) AS l, substring(o_orderpriority, 3, 4) AS s, trim(' ' || o_orderstatus || ' ') AS t, CAST(length(o_orderpriority) AS INTEGER) AS n, o_orderstatus || '-' || o_orderpriority AS c"),
    "expr_null": ({"x": "NULLIF(status, 'O')", "y": "COALESCE(NULLIF(status, 'O'), 'none')", "w": "IFNULL(NULLIF(status, 'F'), 'filled')"}, "nullif(o_orderstatus, 'O') AS x, coalesce(nullif(o_orderstatus, 'O'), 'none') AS y, ifnull(nullif(o_orderstatus, 'F'), 'filled') AS w"),
    "expr_chained": ({"net": "totalPrice - 100", "gross": "net * 1.25", "twice": "gross + net"}, "o_totalprice - 100 AS net, (o_totalprice - 100) * 1.25::DOUBLE AS gross, (o_totalprice - 100) * 1.25::DOUBLE + (o_totalprice - 100) AS twice"),
    "expr_date_format": ({"d": "DATE_FORMAT(orderDate)"}, "strftime(o_orderdate, '%Y-%m-%d') AS d"),
    "expr_comparison": ({"big": "totalPrice > 100000 AND NOT status = 'O'"}, "o_totalprice > 100000 AND NOT o_orderstatus = 'O' AS big"),
}
for name, (made, shown) in CALC.items():
    ask(name, "Orders", {"columns": ["orderKey", *made], "calculatedFields": [{"name": k, "expression": v} for k, v in made.items()]}, f'SELECT o_orderkey AS "orderKey", {shown} FROM orders')
ask("expr_as_filter", "Orders", {"columns": ["orderKey", "share"], "calculatedFields": [{"name": "share", "expression": "totalPrice / 1000"}], "slice": [cond("share", ">", 300)]}, 'SELECT o_orderkey AS "orderKey", o_totalprice / 1000 AS share FROM orders WHERE o_totalprice / 1000 > 300')
ask("expr_inline", "Orders", {"columns": ["orderKey", "totalPrice * 1.5 as more"]}, 'SELECT o_orderkey AS "orderKey", o_totalprice * 1.5::DOUBLE AS more FROM orders')
ask("expr_json", "Events", {"columns": ["propK", "eventCount"], "groupBy": ["propK"]}, """SELECT json_extract_string(props, '$.k') AS "propK", count(*) AS "eventCount" FROM events GROUP BY 1""")
ask("expr_year_group", "Orders", {"columns": ["YEAR(orderDate) as y", "sum(totalPrice) as spent"]}, f"SELECT CAST(year(o_orderdate) AS INTEGER) AS y, {total('o_totalprice')} AS spent FROM orders GROUP BY 1")
ask("expr_now", "Orders", {"columns": ["orderKey", "known"], "calculatedFields": [{"name": "known", "expression": "NOW() > orderDate AND NOW() < DATE('2400-01-01')"}]}, """SELECT o_orderkey AS "orderKey", CAST(now() AS TIMESTAMP) > o_orderdate AND CAST(now() AS TIMESTAMP) < TIMESTAMP '2400-01-01' AS known FROM orders""")

# -- hierarchies
TREE = """places AS (SELECT 'W' AS id, 'WORLD' AS name, NULL AS up UNION ALL SELECT 'R' || r_regionkey, r_name, 'W' FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation),
closure AS (SELECT id AS anc, id AS node, 0 AS dist FROM places UNION ALL SELECT up, id, 1 FROM places WHERE up IS NOT NULL
  UNION ALL SELECT p.up, c.id, 2 FROM places c JOIN places p ON c.up = p.id WHERE p.up IS NOT NULL),
fact AS (SELECT *, 'N' || c_nationkey AS place_id FROM customer)"""


def hierarchy(key: str, columns: list[str], slices: list[dict], sql: str, groups: list[str] | None = None) -> None:
    ask(key, "PlacedCustomers", {"columns": columns, "slice": slices, "groupBy": groups or []}, f"WITH {TREE} {sql}")


BALANCE = total("c_acctbal")
hierarchy("hier_rollup", ["place$hierarchy$caption", "balance", "customerCount"], [cond("place$hierarchy$id", "in", ["W", "R1", "R2"])], f'SELECT a.name AS "place$hierarchy$caption", {BALANCE} AS balance, count(*) AS "customerCount" FROM fact JOIN closure ON place_id = node LEFT JOIN places a ON anc = a.id WHERE anc IN (\'W\', \'R1\', \'R2\') GROUP BY 1', ["place$hierarchy$caption"])
hierarchy("hier_detail", ["place$caption", "balance"], [cond("place$hierarchy$id", "=", "R0")], f'SELECT p.name AS "place$caption", {BALANCE} AS balance FROM fact JOIN closure ON place_id = node LEFT JOIN places p ON place_id = p.id WHERE anc = \'R0\' GROUP BY 1', ["place$caption"])
hierarchy("hier_children", ["place$id", "customerCount"], [cond("place$id", "childrenOf", "R1")], 'SELECT place_id AS "place$id", count(*) AS "customerCount" FROM fact JOIN closure ON place_id = node WHERE anc = \'R1\' AND dist = 1 GROUP BY 1', ["place$id"])
hierarchy("hier_descendants", ["place$id", "customerCount"], [cond("place$id", "descendantsOf", "W")], 'SELECT place_id AS "place$id", count(*) AS "customerCount" FROM fact JOIN closure ON place_id = node WHERE anc = \'W\' AND dist > 0 GROUP BY 1', ["place$id"])
hierarchy("hier_self_desc", ["place$id", "customerCount"], [cond("place$id", "selfAndDescendantsOf", "N3")], 'SELECT place_id AS "place$id", count(*) AS "customerCount" FROM fact JOIN closure ON place_id = node WHERE anc = \'N3\' GROUP BY 1', ["place$id"])
hierarchy("hier_max_depth", ["place$id", "customerCount"], [cond("place$id", "childrenOf", "W", maxDepth=2)], 'SELECT place_id AS "place$id", count(*) AS "customerCount" FROM fact JOIN closure ON place_id = node WHERE anc = \'W\' AND dist BETWEEN 1 AND 2 GROUP BY 1', ["place$id"])
hierarchy("hier_multi", ["custKey"], [cond("place$id", "descendantsOf", ["W", "R1"])], 'SELECT c_custkey AS "custKey" FROM fact JOIN closure ON place_id = node WHERE anc IN (\'W\', \'R1\') AND dist > 0')
hierarchy("hier_multi_deduped", ["custKey"], [cond("place$id", "descendantsOf", ["W", "R1"], dedupe=True)], 'SELECT c_custkey AS "custKey" FROM fact WHERE place_id IN (SELECT node FROM closure WHERE anc IN (\'W\', \'R1\') AND dist > 0)')

# -- access, dictionaries, steps
ask("access_eq", "OrdersByStatus", {"columns": ["orderKey"]}, "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_orderstatus = 'F'", SecurityContext(attributes={"status": "F"}))
ask("access_in", "OrdersBySegment", {"columns": ["status", "orderCount"], "groupBy": ["status"]}, f"SELECT o_orderstatus AS status, count(*) AS \"orderCount\" FROM {OC} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1", SecurityContext(attributes={"segments": ["BUILDING", "MACHINERY"]}))
ask("access_in_empty", "OrdersBySegment", {"columns": ["orderKey"]}, 'SELECT o_orderkey AS "orderKey" FROM orders WHERE 1 = 2', SecurityContext(attributes={"segments": []}))
ask("access_or_stays_inside", "OrdersByStatus", {"columns": ["orderKey"], "slice": [cond("priority", "=", "1-URGENT"), cond("priority", "=", "2-HIGH", link=2)]}, "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_orderstatus = 'O' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')", SecurityContext(attributes={"status": "O"}))
ask("access_sql", "OrdersBySql", {"columns": ["orderKey"]}, "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'O'", SecurityContext(attributes={"least": 150000}))
ask("dict_label", "Orders", {"columns": ["status", "orderCount"], "groupBy": ["status"]}, "SELECT CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Pending' ELSE o_orderstatus END AS status, count(*) AS \"orderCount\" FROM orders GROUP BY 1", label=True)


@use("access_dimension", "SELECT DISTINCT c_custkey AS id, c_name AS caption FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(e: Engine) -> DataFrame:
    return e.members("OrdersByMember", "customer", SecurityContext(attributes={"segment": "BUILDING"}))


@use("dimension_members", "SELECT n_nationkey AS id, n_name AS caption FROM nation")
def _(e: Engine) -> DataFrame:
    return e.members("Orders", "customer.nation")


@use("column_security", 'SELECT o_orderkey AS "orderKey", o_orderstatus AS status FROM orders')
def _(e: Engine) -> DataFrame:
    e.add_step(column_security(lambda context: ["totalPrice"]))
    return e.rows("Orders", {"columns": ["orderKey", "status", "totalPrice"]})


@use("mask_phone", "SELECT c_custkey, CASE WHEN length(c_name) > 7 THEN substr(c_name, 1, 3) || '****' || right(c_name, 4) ELSE c_name END AS masked, c_custkey / 100 AS units FROM customer")
def _(e: Engine) -> DataFrame:
    return e.frame_of("customer").select("c_custkey", frames.mask_middle(F.col("c_name"), 3, 4).alias("masked"), frames.cents_to_units(F.col("c_custkey")).cast("double").alias("units"))


@use("scope_window", "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-06-01'")
def _(e: Engine) -> DataFrame:
    saved = e.save_query("OrdersNewest", {"columns": ["orderKey"], "slice": [cond("orderDate", ">=", "1996-05-01")], "start": 0, "limit": 1_000_000})
    return e.open_query(saved["id"]).whole


# -- script datasets, helpers, sinks
@use("template_optional_pred", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(e: Engine) -> DataFrame:
    script = datasets.Script("SELECT o_orderkey, o_totalprice FROM {orders} WHERE 1 = 1")
    script.optional("AND o_orderstatus = ?", "O").optional("AND o_orderpriority = ?", "").in_list("AND o_orderpriority IN", ["1-URGENT", "5-LOW"])
    return script.run(e)


@use("template_forced_empty_list", "SELECT o_orderkey FROM orders WHERE 1 = 2")
def _(e: Engine) -> DataFrame:
    return datasets.Script("SELECT o_orderkey FROM {orders} WHERE 1 = 1").in_list("AND o_orderkey IN", [], force=True).run(e)


@use("script_like_paged", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%HIGH%' ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def _(e: Engine) -> DataFrame:
    script = datasets.Script("SELECT o_orderkey FROM {orders} WHERE 1 = 1").optional("AND o_orderpriority LIKE ?", frames.like_text("HIGH"))
    return script.then(" ORDER BY o_orderkey").page(30, 15).run(e)


@use("conditional_sql", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)")
def _(e: Engine) -> DataFrame:
    chosen = datasets.Conditional().add("SELECT o_orderkey FROM {orders}", lambda args: args["detail"]).add("SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY 1")
    return chosen.run(e, {"detail": False})


@use("semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(e: Engine) -> DataFrame:
    return frames.semi_join(e.frame_of("documents").select("doc_id", "lang"), e.frame_of("labels").filter("toxic = 1"), "doc_id", "doc_id")


@use("anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(e: Engine) -> DataFrame:
    return frames.semi_join(e.frame_of("documents").select("doc_id", "lang"), e.frame_of("labels"), "doc_id", "doc_id", anti=True)


@use("memory_left_join", "SELECT d.doc_id, lang, coalesce(quality, 9) AS quality FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
def _(e: Engine) -> DataFrame:
    return frames.left_join(e.frame_of("documents").select("doc_id", "lang"), e.frame_of("labels"), "doc_id", "doc_id", ["quality"]).fillna(9, ["quality"])


@use("first_by_column", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def _(e: Engine) -> DataFrame:
    return frames.first_by(e.frame_of("customer").select("c_custkey", "c_name"), "c_custkey", 7)


@use("group_breaks", """SELECT event_id, user_id, event_type, new_group, CAST(sum(CAST(new_group AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS group_no FROM (
  SELECT event_id, user_id, event_type, ts, event_type IS DISTINCT FROM lag(event_type) OVER w AS new_group FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")  # fmt: skip
def _(e: Engine) -> DataFrame:
    events = e.frame_of("events").select("event_id", "user_id", "event_type", "ts")
    return frames.group_breaks(events, ["event_type"], ["ts", "event_id"], ["user_id"]).drop("ts")


@use("group_breaks_whole", """SELECT o_orderkey, o_orderstatus, new_group, CAST(sum(CAST(new_group AS INTEGER)) OVER (ORDER BY o_orderkey) AS BIGINT) AS group_no FROM (
  SELECT o_orderkey, o_orderstatus, row_number() OVER w = 1 OR o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS new_group FROM orders WINDOW w AS (ORDER BY o_orderkey))""")  # fmt: skip
def _(e: Engine) -> DataFrame:
    return frames.group_breaks(e.frame_of("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"])


CHANGES = "(SELECT c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal, c_custkey % 3 AS version FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 10000000, 'new', 0.0::DOUBLE, 1 FROM customer WHERE c_custkey <= 5)"


def _changes(e: Engine) -> tuple[DataFrame, DataFrame]:
    c = e.frame_of("customer")
    old = c.select("c_custkey", "c_name", "c_acctbal", F.lit(1).cast("bigint").alias("version"))
    new = c.filter("c_custkey % 4 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_custkey") % 3).alias("version"))
    more = c.filter("c_custkey <= 5").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"), F.lit(1).cast("bigint").alias("version"))
    return old, new.union(more)


@use("upsert", f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.version, 1) AS version FROM customer o FULL JOIN {CHANGES} n ON o.c_custkey = n.c_custkey")
def _(e: Engine) -> DataFrame:
    return sinks.upserted(*_changes(e), ["c_custkey"])


@use("upsert_versioned", f"""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL AND (n.version IS NULL OR 1 > n.version) THEN o.c_name ELSE n.c_name END AS c_name,
  CASE WHEN o.c_custkey IS NOT NULL AND (n.version IS NULL OR 1 > n.version) THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal,
  CASE WHEN o.c_custkey IS NOT NULL AND (n.version IS NULL OR 1 > n.version) THEN 1 ELSE n.version END AS version FROM customer o FULL JOIN {CHANGES} n ON o.c_custkey = n.c_custkey""")  # fmt: skip
def _(e: Engine) -> DataFrame:
    return sinks.upserted(*_changes(e), ["c_custkey"], version="version")


@use("delete_by_columns", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')")
def _(e: Engine) -> DataFrame:
    return sinks.without(e.frame_of("orders"), {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}).select("o_orderkey", "o_orderstatus")


@use("insert_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def _(e: Engine) -> DataFrame:
    n = e.frame_of("nation")
    return sinks.inserted(n, n.withColumn("n_nationkey", F.col("n_nationkey") + 100))


@use("upsert_repeated_keys", f"""WITH changes AS (SELECT *, 1 AS turn FROM {CHANGES} UNION ALL SELECT c_custkey, c_name || '?', c_acctbal * 2, version, 2 FROM {CHANGES} WHERE c_custkey % 8 = 0),
last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY turn DESC) = 1)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.version, 1) AS version FROM customer o FULL JOIN last n ON o.c_custkey = n.c_custkey""")
def _(e: Engine) -> DataFrame:
    old, new = _changes(e)
    again = new.filter("c_custkey % 8 = 0").select("c_custkey", F.concat("c_name", F.lit("?")).alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"), "version")
    return sinks.upserted(old, new.withColumn("turn", F.lit(1)).union(again.withColumn("turn", F.lit(2))), ["c_custkey"], order=["turn"])


@use("lookup_multi", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def _(e: Engine) -> DataFrame:
    held = frames.multi_by(e.frame_of("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return held.select("o_custkey", F.size("rows").cast("bigint").alias("n"), F.col("rows")[0]["o_orderkey"].alias("first"), F.element_at("rows", -1)["o_orderkey"].alias("last"))


@use("lookup_unique", "SELECT n_nationkey, n_name FROM nation")
def _(e: Engine) -> DataFrame:
    return frames.unique_by(e.frame_of("nation"), ["n_nationkey"]).select("n_nationkey", "row.n_name")


@use("alter_add_columns", "SELECT column_name, n FROM (VALUES ('o_comment', 1), ('o_weight', 2)) AS t(column_name, n)")
def _(e: Engine) -> DataFrame:
    have = e.frame_of("orders").schema
    lacking = inspection.missing_columns(T.StructType([*have.fields, T.StructField("o_comment", T.StringType()), T.StructField("O_ORDERKEY", T.LongType()), T.StructField("o_weight", T.DoubleType())]), have)
    return e.spark.createDataFrame([(f.name, i) for i, f in enumerate(lacking, 1)], "column_name string, n int")


@use("access_sql_bound", "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> ':status' AND o_orderkey > 7 AND o_custkey > 70")
def _(e: Engine) -> DataFrame:
    rule = AccessRule(lambda a, context: a.and_sql("o_orderstatus = :status AND o_orderpriority <> ':status' AND o_orderkey > :id AND o_custkey > :id2", **context.attributes))
    e.register(QueryModel("OrdersBound", ORDERS, accesses=(rule,)))
    return e.rows("OrdersBound", {"columns": ["orderKey"]}, SecurityContext(attributes={"status": "F", "id": 7, "id2": 70}))


@use("access_sql_no_injection", "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE 1 = 2")
def _(e: Engine) -> DataFrame:
    e.register(QueryModel("OrdersBound", ORDERS, accesses=(AccessRule(lambda a, context: a.and_sql("o_orderstatus = :a AND o_orderpriority = :b", a=":b", b=" or 1=1 or o_orderstatus = ")),)))
    return e.rows("OrdersBound", {"columns": ["orderKey"]})


def refused(key: str, steps: Callable[[Engine], object], bodies: list[tuple[str, dict]], model: str = "Orders") -> None:
    """Registers requests that must be refused: a row for each with the kind of error."""

    @use(key, " UNION ALL ".join(f"SELECT {i} AS request, '{kind}' AS refused" for i, (kind, _) in enumerate(bodies)))
    def _(e: Engine) -> DataFrame:
        steps(e)
        found = []
        for i, (_, body) in enumerate(bodies):
            try:
                e.rows(model, body)
                found.append((i, "none"))
            except QueryError as error:
                found.append((i, type(error).__name__))
        return e.spark.createDataFrame(found, "request int, refused string")


def hide_price(e: Engine) -> None:
    e.add_step(column_security(lambda context: ["totalPrice", "customer.nation"]))


refused("column_security_expr", hide_price, [("AccessDenied", b) for b in (
    {"columns": ["totalPrice"]}, {"columns": ["orderKey", "totalPrice + 0 as x"]}, {"columns": ["sum(totalPrice) as s"]}, {"columns": ["orderKey"], "slice": [cond("totalPrice", ">", 1)]},
    {"columns": ["x"], "calculatedFields": [{"name": "x", "expression": "totalPrice"}]}, {"columns": ["orderKey"], "orderBy": ["totalPrice"]}, {"columns": ["status"], "groupBy": ["status", "customer.nation$id"]},
    {"columns": ["orderKey", "UPPER(customer.nation$caption) as x"]},
)])
refused("having_mixed_or_refused", lambda e: None, [("InvalidSlice", {"columns": ["status", "sum(totalPrice) as s"], "slice": [cond("s", ">", 1), cond("status", "=", "O", link=2)]})])


@use("access_ne_null", "SELECT o_orderkey AS \"orderKey\" FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority IS NOT NULL")
def _(e: Engine) -> DataFrame:
    e.register(QueryModel("OrdersNe", ORDERS, accesses=(AccessRule(lambda a, context: a.and_ne("status", "O").and_not_null("priority")), AccessRule(lambda a, context: a.and_null("status") if context.user else a))))
    return e.rows("OrdersNe", {"columns": ["orderKey"]})


@use("agg_custom", f"SELECT o_orderstatus AS status, {total('o_totalprice')} / count(DISTINCT o_custkey) AS \"perCustomer\" FROM orders GROUP BY 1")
def _(e: Engine) -> DataFrame:
    ratio = Measure(None, "perCustomer", "CUSTOM", "MONEY", formula=lambda c: F.sum(c("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count_distinct(c("o_custkey")))
    e.register(QueryModel("OrdersRatio", replace(ORDERS, measures=(*ORDERS.measures, ratio))))
    return e.rows("OrdersRatio", {"columns": ["status", "perCustomer"], "groupBy": ["status"]})


def _renamed(e: Engine) -> None:
    e.add_source("loud", lambda name: e.frame_of(name).withColumn("c_name", F.upper(F.concat(F.col("c_name"), F.lit(" x")))) if name == "customer" else e.frame_of(name))


@use("dimension_data_source", f"SELECT o_orderkey AS \"orderKey\", upper(c_name || ' x') AS \"customer$caption\" FROM {OC}")
def _(e: Engine) -> DataFrame:
    _renamed(e)
    loud = tuple(replace(d, data_source="loud") for d in ORDERS.dimensions)
    e.register(QueryModel("OrdersLoud", replace(ORDERS, dimensions=loud)))
    return e.rows("OrdersLoud", {"columns": ["orderKey", "customer$caption"]})


@use("conditional_data_source", "SELECT c_custkey, upper(c_name || ' x') AS c_name FROM customer")
def _(e: Engine) -> DataFrame:
    _renamed(e)
    chosen = datasets.Conditional().add("SELECT c_custkey, c_name FROM {customer}", lambda args: args["loud"], "loud").add("SELECT c_custkey, c_name FROM {customer}")
    return chosen.run(e, {"loud": True})


@use("script_literal_mark", "SELECT o_orderkey, '?' AS sign FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey IN (1, 2, 4, 7)")
def _(e: Engine) -> DataFrame:
    return datasets.Script("SELECT o_orderkey, '?' AS sign FROM {orders} WHERE o_orderstatus <> 'a?b'").optional("AND o_orderpriority = ? AND '?' = '?'", "2-HIGH").in_list("AND o_custkey IN", [1, 2, 4, 7]).run(e)


@use("helper_columns", """SELECT o_orderkey, o_orderkey % 2 <> 0 AS odd, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END ELSE CAST(o_orderkey % 2 AS DOUBLE) / (o_custkey % 3) END AS ratio,
  o_orderkey & 5 AS bits, CASE WHEN o_orderkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS word, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def _(e: Engine) -> DataFrame:
    c, key, odd, third = scripting.COLUMNS, F.col("o_orderkey"), F.col("o_orderkey") % 2, F.col("o_custkey") % 3
    # the SQL's rule for null and negative keys, where the functions give false, 0, NaN or -infinity
    by_zero, known = c["divide"](F.coalesce(F.abs(odd), F.lit(1)), third), odd.isNotNull() & third.isNotNull()
    ratio = F.when(third == 0, by_zero).when(known, c["divide"](odd, third))
    made = {"odd": F.when(key.isNotNull(), c["truthy"](odd)), "ratio": ratio, "bits": F.when(key.isNotNull(), c["bit_and"](key, F.lit(5))), "word": c["iif"](odd, F.lit("odd"), F.lit("even")), "day": c["date_text"](F.col("o_orderdate"))}
    return e.frame_of("orders").select("o_orderkey", *[v.alias(k) for k, v in made.items()], c["quarter"](F.col("o_orderdate")).alias("quarter"), c["last_day"](F.col("o_orderdate")).alias("month_end"))


@use("metadata_fields", " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS kind" for n, k in (("orderKey", "property"), ("status", "property"), ("totalPrice", "measure"))))
def _(e: Engine) -> DataFrame:
    fields = e.describe("Orders")["fields"]
    return e.spark.createDataFrame([(f["name"], f["kind"]) for f in fields if f["name"] in ("orderKey", "status", "totalPrice")], "name string, kind string")


@use("inspect_roles", "SELECT * FROM (VALUES ('c_custkey', 'key'), ('c_acctbal', 'measure')) AS t(name, role)")
def _(e: Engine) -> DataFrame:
    found = inspection.describe_columns(e.frame_of("customer"))
    return e.spark.createDataFrame([(c["column"], c["role"]) for c in found if c["column"] in ("c_custkey", "c_acctbal")], "name string, role string")


# -- beyond the reference: windows, set operations, cubes, event time
@use("extra_window_rank", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def _(e: Engine) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return e.frame_of("orders").withColumn("place", F.row_number().over(by)).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


@use("extra_rollup", f"SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(e: Engine) -> DataFrame:
    q = F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("quantity")
    return e.frame_of("lineitem").rollup("l_returnflag", "l_linestatus").agg(q, F.count("*").alias("n"))


@use("extra_set_operations", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(e: Engine) -> DataFrame:
    return e.frame_of("documents").select("doc_id").exceptAll(e.frame_of("labels").select("doc_id")).distinct()


@use("extra_event_windows", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, {total('value')} AS value FROM events GROUP BY 1, 2")
def _(e: Engine) -> DataFrame:
    return windows.tumbling(e.frame_of("events"), "ts", "1 hour", ["event_type"], {"value": "value"})


@use("stream_event_windows", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, {total('value')} AS value FROM events GROUP BY 1, 2")
def _(e: Engine) -> DataFrame:
    return windows.streamed(e.spark, e.frame_of("events"), "ts", "1 hour", ["event_type"], {"value": "value"})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_engine(spark, sf_dir).query("LineItem", read_request(FLAGSHIP)).items
