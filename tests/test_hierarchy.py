"""The team tree: nine teams, eighteen sales, with known answers."""

import pytest

from quillon.engine import Engine
from quillon.errors import QueryError
from quillon.operators.hierarchy import closure_of
from quillon.plans.model import Closure, Dimension, Measure, Property, TableModel

PARENTS = {"T001": None, "T002": "T001", "T003": "T002", "T004": "T002", "T005": "T001", "T006": "T003", "T007": "T003", "T008": "T005", "T009": "T005"}
FIRST = {"T001": 50000, "T002": 30000, "T003": 10000, "T004": 8000, "T005": 100000, "T006": 5000, "T007": 7000, "T008": 45000, "T009": 40000}
SECOND = {"T001": 60000, "T002": 35000, "T003": 12000, "T004": 9000, "T005": 120000, "T006": 6000, "T007": 8000, "T008": 55000, "T009": 48000}


@pytest.fixture(scope="module")
def engine(spark):
    teams = spark.createDataFrame([(t, "Team " + t, p) for t, p in PARENTS.items()], "team_id string, team_name string, parent_id string")
    sales = spark.createDataFrame([(t, d, float(v)) for d, day in ((20240101, FIRST), (20240102, SECOND)) for t, v in day.items()], "team_id string, date_key int, sales_amount double")
    closure = closure_of(teams, "team_id", "parent_id").withColumnRenamed("child_id", "team_id")
    e = Engine(spark, {"team": teams, "sales": sales, "closure": closure}.__getitem__)
    team = Dimension("team", "team", "team_id", "team_id", "team_name", closure=Closure("closure", "parent_id", "team_id"))
    e.register(TableModel("TeamSales", "sales", dimensions=(team,), properties=(Property("date_key"),), measures=(Measure("sales_amount"),)))
    return e


def ids(engine, op, value, **more):
    rows = engine.rows("TeamSales", {"columns": ["team$id", "salesAmount"], "groupBy": ["team$id"], "slice": [{"field": "team$id", "op": op, "value": value, **more}]})
    return sorted(r["team$id"] for r in rows.collect())


def test_closure(engine):
    assert engine.frame_of("closure").count() == 25


def test_plain_and_rollup(engine):
    own = engine.rows("TeamSales", {"columns": ["salesAmount"], "slice": [{"field": "team$id", "op": "=", "value": "T001"}]})
    assert sorted(r[0] for r in own.collect()) == [50000, 60000]
    whole = engine.rows("TeamSales", {"columns": ["team$hierarchy$caption", "salesAmount"], "groupBy": ["team$hierarchy$caption"], "slice": [{"field": "team$hierarchy$id", "op": "=", "value": "T001"}]})
    assert [tuple(r) for r in whole.collect()] == [("Team T001", 648000.0)]
    each = engine.rows("TeamSales", {"columns": ["team$caption", "salesAmount"], "groupBy": ["team$caption"], "slice": [{"field": "team$hierarchy$id", "op": "=", "value": "T001"}]})
    assert {r[0]: r[1] for r in each.collect()} == {"Team " + t: FIRST[t] + SECOND[t] for t in PARENTS}


def test_operators(engine):
    assert ids(engine, "childrenOf", "T001") == ["T002", "T005"]
    assert ids(engine, "descendantsOf", "T001") == [f"T00{i}" for i in range(2, 10)]
    assert ids(engine, "selfAndDescendantsOf", "T001") == sorted(PARENTS)
    assert ids(engine, "descendantsOf", "T001", maxDepth=2) == ["T002", "T003", "T004", "T005", "T008", "T009"]
    assert ids(engine, "childrenOf", "T002", maxDepth=2) == ["T003", "T004", "T006", "T007"]
    assert ids(engine, "childrenOf", ["T002", "T005"]) == ["T003", "T004", "T008", "T009"]


def test_overlapping_ancestors_repeat_rows_unless_deduped(engine):
    def count(**more):
        return engine.rows("TeamSales", {"columns": ["dateKey"], "slice": [{"field": "team$id", "op": "descendantsOf", "value": ["T001", "T002"], **more}]}).count()

    assert count() == 24 and count(dedupe=True) == 16


def test_cycle_is_an_error(spark):
    with pytest.raises(QueryError):
        closure_of(spark.createDataFrame([("a", "b"), ("b", "a")], "k string, p string"), "k", "p", 5)
