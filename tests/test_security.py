"""What access rules bind, what column security covers, and where rows come from."""

import pytest

from quillon.engine import Engine, column_security
from quillon.errors import AccessDenied, QueryError
from quillon.operators import frames
from quillon.operators.access import SecurityContext
from quillon.plans.model import AccessRule, Dimension, Measure, Property, QueryModel, TableModel
from quillon.plans.planner import F
from quillon.sources import datasets, inspection, sinks


@pytest.fixture()
def engine(spark):
    sales = spark.createDataFrame([(1, "n", 10.0, 7), (2, "s", 20.0, 8), (3, "it's :b", 40.0, 7)], "id int, area string, amount double, shop int")
    shops = spark.createDataFrame([(7, "seven"), (8, "eight")], "shop_id int, shop_name string")
    other = spark.createDataFrame([(7, "SEVEN"), (8, "EIGHT")], "shop_id int, shop_name string")
    e = Engine(spark, {"sales": sales, "shops": shops}.__getitem__)
    return e.add_source("far", {"shops": other, "sales": sales.filter("id < 3")}.__getitem__)


def model(name="Sales", rule=None, members=None, far=None, measures=()):
    shop = Dimension("shop", "shops", "shop", "shop_id", "shop_name", data_source=far)
    table = TableModel(name, "sales", "id", (shop,), (Property("id", "id", "INTEGER"), Property("area", "area")), (Measure("amount", "amount", "SUM", "NUMBER"), *measures))
    rules = tuple(r for r in (AccessRule(builder=rule) if rule else None, AccessRule(field="shop", members=members) if members else None) if r)
    return QueryModel(name, table, accesses=rules)


def ids(e, **body):
    return sorted(r.id for r in e.rows("Sales", {"columns": ["id"], **body}).collect())


def test_fragments_bind_their_values(engine):
    def rule(a, context):
        a.and_sql(context.attributes["text"], **context.attributes["values"])

    def asked(text, **values):
        engine.register(model(rule=rule))
        return sorted(r.id for r in engine.rows("Sales", {"columns": ["id"]}, SecurityContext(attributes={"text": text, "values": values})).collect())

    assert asked("area = :a AND shop = :b", a=":b", b=7) == []
    assert asked("area = :a AND area = :b", a=":b", b=" or 1=1 or area = ") == []
    assert asked("area = :a", a="it's :b") == [3]
    assert asked("area = :a", a="\\' OR 1=1 --") == []
    assert asked("id = :id OR id = :id2", id=1, id2=3) == [1, 3]
    assert asked("`area` = 'n' OR area = ':a' OR amount::int = :a", a=20) == [1, 2]
    with pytest.raises(QueryError):
        asked("id = :nobody")


def test_member_fragments_bind_too(engine):
    engine.register(model(members=lambda a, context: a.and_sql("shop_name = :name", name="x' OR '1'='1")))
    assert engine.members("Sales", "shop").count() == 0


def test_hidden_fields_are_hidden_everywhere(engine):
    engine.register(model()).add_step(column_security(lambda context: [] if context.user == "boss" else ["amount", "shop"]))
    ask = lambda **body: engine.rows("Sales", body).collect()
    assert engine.rows("Sales", {"columns": ["id", "amount"]}).columns == ["id"]
    assert engine.rows("Sales", {}).columns == ["id", "area"]
    for body in (
        {"columns": ["amount"]},
        {"columns": ["id", "amount + 0 as x"]},
        {"columns": ["sum(amount) as s"]},
        {"columns": ["id", "x"], "calculatedFields": [{"name": "x", "expression": "amount * 2"}]},
        {"columns": ["id"], "calculatedFields": [{"name": "x", "expression": "amount"}], "orderBy": ["x"]},
        {"columns": ["id"], "slice": [{"field": "amount", "op": ">", "value": 1}]},
        {"columns": ["id"], "slice": [{"children": [{"field": "shop$caption", "op": "=", "value": "seven"}]}]},
        {"columns": ["id"], "orderBy": ["amount"]},
        {"columns": ["area"], "groupBy": ["area", "shop$id"]},
        {"columns": ["id", "concat(shop$caption, '') as x"]},
    ):
        with pytest.raises(AccessDenied):
            ask(**body)
    with pytest.raises(AccessDenied):
        engine.members("Sales", "shop")
    assert [f["name"] for f in engine.describe("Sales")["fields"]] == ["id", "area"]
    assert "amount" not in engine.metadata()["fields"] and "amount" not in engine.markdown()
    boss = SecurityContext("boss")
    assert engine.rows("Sales", {"columns": ["sum(amount) as s"]}, boss).first().s == 70.0
    assert engine.members("Sales", "shop", boss).count() == 2 and "amount" in engine.metadata(context=boss)["fields"]


def test_default_orders_and_kpis_leave_hidden_fields_out(engine):
    engine.register(model(measures=(Measure(None, "n"),))).add_step(column_security(lambda context: ["amount"]))
    assert engine.kpi("Sales", {}).first().asDict() == {"n": 3}


def test_data_sources(engine):
    engine.register(model(far="far"))
    assert sorted(r["shop$caption"] for r in engine.rows("Sales", {"columns": ["shop$caption"], "distinct": True}).collect()) == ["EIGHT", "SEVEN"]
    assert sorted(r.caption for r in engine.members("Sales", "shop").collect()) == ["EIGHT", "SEVEN"]
    chosen = datasets.Conditional().add("SELECT * FROM {sales}", lambda args: args["far"], "far").add("SELECT * FROM {sales}")
    assert (chosen.run(engine, {"far": True}).count(), chosen.run(engine, {"far": False}).count()) == (2, 3)


def test_custom_aggregation(engine):
    ratio = Measure(None, "ratio", "CUSTOM", "NUMBER", formula=lambda c: F.sum(c("amount")) / F.count(c("id")))
    engine.register(model(measures=(ratio,)))
    assert {r["shop$id"]: r.ratio for r in engine.rows("Sales", {"columns": ["shop$id", "ratio"], "groupBy": ["shop$id"]}).collect()} == {7: 25.0, 8: 20.0}
    assert engine.query("Sales", {"columns": ["shop$id", "ratio"], "groupBy": ["shop$id"], "returnTotal": True}).collect()["totalData"] == {"shop$id": None, "ratio": None, "total": 2}


def test_marks_inside_literals(engine):
    s = datasets.Script("SELECT id FROM {sales} WHERE area <> 'a?b' AND \"?\" = '?'").optional("AND shop = ? AND '?' <> area", 7).in_list("AND id IN", [1, 2])
    assert [r.id for r in s.run(engine).collect()] == [1]


def test_last_of_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (3, "p"), (3, "q"), (None, "m"), (None, "o")], "k int, v string").coalesce(1)
    key = lambda r: str(r)
    assert sorted(map(tuple, sinks.upserted(table, rows, ["k"]).collect()), key=key) == sorted([(1, "y"), (2, "b"), (3, "q"), (None, "n"), (None, "m"), (None, "o")], key=key)
    assert sorted(r.v for r in sinks.upserted(table, rows.filter("k = 1").orderBy(F.desc("v")), ["k"], order=["v"]).collect() if r.k == 1) == ["y"]


def test_column_helpers_follow_the_functions(spark):
    from quillon.functions.scripting import COLUMNS, divide, truthy

    cases = [("double", [0.0, -0.0, 0.5, None]), ("string", ["", "x", None]), ("int", [0, 3, None]), ("boolean", [True, False, None]), ("decimal(9,2)", [None])]
    for kind, values in cases:
        got = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(COLUMNS["truthy"](F.col("v"))).collect()
        assert [r[0] for r in got] == [truthy(v) for v in values], kind
    pairs = [(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (3.0, 2.0), (None, None)]
    got = spark.createDataFrame(pairs, "a double, b double").select(COLUMNS["divide"](F.col("a"), F.col("b"))).collect()
    assert [str(r[0]) for r in got] == [str(divide(a, b)) for a, b in pairs]


def test_context_of_a_header():
    known = SecurityContext.of_header("Bearer t", lambda token: {"user": "u", "roles": ["ADMIN"], "area": token})
    assert known == SecurityContext("u", ("ADMIN",), {"area": "t"}, "t")
    assert SecurityContext.of_header("Bearer t").roles == () and SecurityContext.of_header(None, lambda t: {}).token is None


def test_indexes(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, o int")
    assert {r.k: [x.v for x in r.rows] for r in frames.multi_by(df, ["k"], ["o"]).collect()} == {1: ["a", "b"], 2: ["c"]}
    assert {r.v: r.row.o for r in frames.unique_by(df, ["v"]).collect()} == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(Exception, match="several rows with one key"):
        frames.unique_by(df, ["k"]).collect()
    assert frames.first_by(df, "k", 1, ["o"]).first().v == "a"


def test_tables_are_synchronised(spark):
    table = "sync_" + "q" * 8
    spark.sql(inspection.drop_ddl(table))
    try:
        first, second = (spark.createDataFrame([], s).schema for s in ("a int", "a int, b string, C double"))
        assert [s.split()[0] for s in inspection.synchronise(spark, first, table)] == ["CREATE"]
        assert [s.split()[0] for s in inspection.synchronise(spark, second, table)] == ["ALTER"]
        assert inspection.synchronise(spark, second, table) == [] and spark.table(table).columns == ["a", "b", "C"]
    finally:
        spark.sql(inspection.drop_ddl(table))
