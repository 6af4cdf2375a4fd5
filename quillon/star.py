"""Models over the star schema of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.operators.hierarchy import closure_of
from quillon.plans.model import AccessRule, Closure, Dictionary, Dimension, Measure, ModelJoin, Order, Property, QueryModel, TableModel

REGION = Dimension("region", "region", "n_regionkey", "r_regionkey", "r_name", type="INTEGER")


def nation(key: str, alias: str | None = None) -> Dimension:
    return Dimension("nation", "nation", key, "n_nationkey", "n_name", dimensions=(REGION,), alias=alias, type="INTEGER")


CUSTOMER = Dimension("customer", "customer", "o_custkey", "c_custkey", "c_name", (Property("c_mktsegment", "segment"), Property("c_acctbal", "balance", "MONEY")), (nation("c_nationkey", "customerNation"),), type="BIGINT")
SUPPLIER = Dimension("supplier", "supplier", "l_suppkey", "s_suppkey", "s_name", (Property("s_acctbal", "balance", "MONEY"),), (nation("s_nationkey", "supplierNation"),), type="BIGINT")
PART = Dimension("part", "part", "l_partkey", "p_partkey", "p_name", (Property("p_brand", "brand"), Property("p_type", "type"), Property("p_size", "size", "INTEGER"), Property("p_retailprice", "price", "MONEY")), type="BIGINT")
ORDER_PROPERTIES = (Property("o_orderstatus", "status", dictionary="order_status"), Property("o_orderdate", "orderDate", "DATETIME"), Property("o_orderpriority", "priority"))
ORDER = Dimension("order", "orders", "l_orderkey", "o_orderkey", "o_orderkey", (*ORDER_PROPERTIES, Property("o_totalprice", "totalPrice", "MONEY")), (CUSTOMER,), type="BIGINT")

LINE_ITEM = TableModel(
    "LineItem", "lineitem", None, (ORDER, PART, SUPPLIER),
    (Property("l_linenumber", "lineNumber", "INTEGER"), Property("l_returnflag", "returnFlag"), Property("l_linestatus", "lineStatus"), Property("l_shipdate", "shipDate", "DATETIME"), Property("l_orderkey", "orderKey", "BIGINT")),
    (
        Measure("l_quantity", "quantity", "sum", "MONEY"),
        Measure("l_extendedprice", "extendedPrice", None, "MONEY"),
        Measure("l_discount", "discount", "avg", "MONEY"),
        Measure("l_tax", "tax", "avg", "MONEY"),
        Measure(None, "lineCount", "count", "BIGINT"),
        Measure(None, "netAmount", "sum", "MONEY", formula=lambda c: c("l_extendedprice") * (1 - c("l_discount"))),
        Measure(None, "charge", "sum", "MONEY", value="extendedPrice * (1 + tax)"),
    ),
)
ORDERS = TableModel("Orders", "orders", "o_orderkey", (CUSTOMER,), (Property("o_orderkey", "orderKey", "BIGINT"), *ORDER_PROPERTIES), (Measure("o_totalprice", "totalPrice", "sum", "MONEY"), Measure(None, "orderCount", "count", "BIGINT")))
EVENTS = TableModel(
    "Events", "events", "event_id", (Dimension("user", None, "user_id", type="BIGINT"),),
    (Property("event_id", "eventId", "BIGINT"), Property("ts", "ts", "DATETIME"), Property("event_type", "eventType"), Property("props", "props"), Property("props", "propK", formula=lambda c: F.get_json_object(c("props"), "$.k"))),
    (Measure("value", "value", "sum", "MONEY"), Measure(None, "eventCount", "count", "BIGINT")),
)
DOCUMENTS = TableModel("Documents", "documents", "doc_id", (), (Property("doc_id", "docId", "BIGINT"), Property("lang", "lang"), Property("source", "source")), (Measure("n_chars", "chars", "sum", "BIGINT"), Measure(None, "docCount", "count", "BIGINT")))
LABELS = TableModel("Labels", "labels", "doc_id", (), (Property("doc_id", "labelDoc", "BIGINT"), Property("quality", "quality", "INTEGER"), Property("toxic", "toxic", "INTEGER")), (Measure(None, "labelCount", "count", "BIGINT"),))


def places(engine: Engine) -> DataFrame:
    """The world, its regions and nations: (place_id, place_name, parent_id)."""
    region, nations = engine.frame_of("region"), engine.frame_of("nation")
    world = engine.spark.range(1).select(F.lit("W").alias("place_id"), F.lit("WORLD").alias("place_name"), F.lit(None).cast("string").alias("parent_id"))
    return world.union(region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), "r_name", F.lit("W"))).union(
        nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    )


def place_closure(engine: Engine) -> DataFrame:
    return closure_of(places(engine), "place_id", "parent_id")


def placed_customers(engine: Engine) -> DataFrame:
    return engine.frame_of("customer").withColumn("place_id", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))


PLACE = Dimension("place", places, "place_id", "place_id", "place_name", closure=Closure(place_closure))
PLACED_CUSTOMERS = TableModel("PlacedCustomers", placed_customers, "c_custkey", (PLACE,), (Property("c_custkey", "custKey", "BIGINT"), Property("c_mktsegment", "segment")), (Measure("c_acctbal", "balance", "sum", "MONEY"), Measure(None, "customerCount", "count", "BIGINT")))

DOC_LABELS = {
    how: QueryModel(f"Documents{how.title()}Labels", DOCUMENTS, joins=(ModelJoin("root", "label", how).on("docId", "labelDoc"),), models=(("label", LABELS),))
    for how in ("left", "inner", "right")
}
THETA = QueryModel("DocumentsThetaLabels", DOCUMENTS, joins=(ModelJoin("root", "label", "left").on("docId", "labelDoc").eq("quality", 1).gte("docId", 100),), models=(("label", LABELS),))
CUSTOM_ON = QueryModel("DocumentsCustomLabels", DOCUMENTS, joins=(ModelJoin("root", "label", "left", on_builder=lambda a, b: (a("doc_id") == b("doc_id")) & (b("toxic") == 0)),), models=(("label", LABELS),))

BY_SEGMENT = QueryModel("OrdersBySegment", ORDERS, accesses=(AccessRule(lambda a, ctx: a.and_in("customer$segment", ctx.attributes.get("segments", [])), "customer"),))
BY_STATUS = QueryModel("OrdersByStatus", ORDERS, accesses=(AccessRule(lambda a, ctx: a.and_eq("status", ctx.attributes["status"])),))
BY_SQL = QueryModel("OrdersBySql", ORDERS, accesses=(AccessRule(lambda a, ctx: a.and_sql("o_totalprice > :least AND o_orderstatus <> :status", least=ctx.attributes["least"], status="O")),))
BY_MEMBER = QueryModel("OrdersByMember", ORDERS, accesses=(AccessRule(members=lambda a, ctx: a.and_op("c_mktsegment", "=", ctx.attributes["segment"]), field="customer"),))
DEFAULT_ORDER = QueryModel("OrdersNewest", ORDERS, ("orderKey", "orderDate", "totalPrice", "customer"), orders=(Order("orderDate", "desc"), Order("orderKey")), scope_field="orderDate")
STATUS = Dictionary("order_status", (("O", "Open"), ("F", "Filled"), ("P", "Pending")))


def sources(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, sources(spark, sf_dir)).add_dictionary(STATUS)
    for m in (LINE_ITEM, ORDERS, EVENTS, DOCUMENTS, LABELS, PLACED_CUSTOMERS, *DOC_LABELS.values(), THETA, CUSTOM_ON, BY_SEGMENT, BY_STATUS, BY_SQL, BY_MEMBER, DEFAULT_ORDER):
        engine.register(m)
    engine.register(TableModel("BigOrders", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000", "o_orderkey", (), (Property("o_orderkey", "orderKey", "BIGINT"), Property("o_custkey", "custKey", "BIGINT")), (Measure("o_totalprice", "totalPrice", "sum", "MONEY"),)))
    return engine
