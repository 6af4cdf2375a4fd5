from datetime import datetime

import pytest

from quillon.errors import AccessDenied, AliasClash, InvalidSlice, JoinPathError, QueryError, ScopeError, UnknownField
from quillon.functions.naming import FieldPath, camel
from quillon.functions.types import condition_type, dimension_type, logical, parameter, to_datetime
from quillon.operators.access import SecurityContext, bounded_scope, check_tool, tools_of
from quillon.plans.joins import Edge, JoinGraph
from quillon.plans.request import page_of, paging, read_request
from quillon.star import star_engine


def edge(a, b, **more):
    return Edge(a, b, lambda use: None, **more)


def test_field_paths():
    assert FieldPath.parse("product.category$caption").alias == "product_category$caption"
    assert FieldPath.parse("team$hierarchy$id").column == "hierarchy$id"
    assert FieldPath.parse("team$hierarchy$id").hierarchical
    for bad in ("", "a b", "1a", "a.", None):
        with pytest.raises(UnknownField):
            FieldPath.parse(bad)
    assert camel("order_date") == "orderDate" and camel("x") == "x"


def test_types():
    assert logical("varchar") == "TEXT" and logical("Time") == "DATETIME" and logical(None) == "UNKNOWN" and logical("blob") == "UNKNOWN"
    assert dimension_type("MONEY") == "DOUBLE" and condition_type("DAY") == "DAY_RANGE" and condition_type("INTEGER", has_dictionary=True) == "DICT"
    assert to_datetime("2024-03") == datetime(2024, 3, 1) and to_datetime("2024-03-05 07") == datetime(2024, 3, 5, 7)
    assert to_datetime("nonsense") is None and to_datetime(0) == datetime(1970, 1, 1)
    assert parameter(["2024-01-01", None], "DAY")[0].isoformat() == "2024-01-01"


def test_join_graph_paths_and_cycles():
    g = JoinGraph("f").add(edge("f", "a")).add(edge("a", "b")).add(edge("f", "c")).add(edge("c", "b"))
    assert [e.end for e in g.path("b")] == ["a", "b"]
    assert [e.end for e in g.ordered(["b", "c", "b"])] == ["a", "b", "c"]
    assert g.add(edge("f", "a", how="inner")).path("a")[0].how == "left"
    assert g.ordered(["a"], {"a": "inner"})[0].how == "inner"
    with pytest.raises(JoinPathError):
        g.path("nowhere")
    with pytest.raises(JoinPathError):
        g.copy().add(edge("b", "f")).check_acyclic()
    assert [e.end for e in JoinGraph("f").add(edge("f", "a", first=("z",))).add(edge("f", "z")).ordered(["a"])] == ["z", "a"]


def test_requests():
    assert paging({"page": 3, "pageSize": 20}, 10) == (40, 20) and paging({}, 10) == (0, 10) and paging({"start": 5, "limit": 0}, 20) == (5, 20)
    assert page_of(40, 20) == 3
    r = read_request({"param": {"orderBy": [{"column": "a", "dir": "DESC"}], "slice": [{"field": "x", "op": "eq", "value": 1}]}})
    assert r.orders[0].descending and r.slices[0].op == "="
    for bad in ({"slice": [{"op": "=", "value": 1}]}, {"slice": [{"field": "a"}]}, {"slice": [{"children": []}]}, {"groupBy": [{"field": "a", "agg": "MEDIAN"}]}, {"orderBy": [{"field": "a", "order": "up"}]}, {"groupBy": [{}]}):
        with pytest.raises(QueryError):
            read_request(bad)


def test_errors_of_planning(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    for body, wrong in (
        ({"columns": ["nothing"]}, UnknownField),
        ({"columns": ["orderKey + 1 as status"]}, AliasClash),
        ({"columns": ["orderKey + 1 as a", "orderKey as a"]}, AliasClash),
        ({"columns": ["status", "count(*) as n"], "slice": [{"field": "n", "op": ">", "value": 1}, {"field": "status", "op": "=", "value": "O", "link": 2}]}, InvalidSlice),
        ({"columns": ["orderKey"], "slice": [{"field": "status", "op": "~", "value": 1}]}, InvalidSlice),
        ({"columns": ["status", "count(*) as n"], "orderBy": ["totalPrice"]}, QueryError),
        ({"columns": ["orderKey"], "slice": [{"field": "orderDate", "op": "[]", "value": [1]}]}, InvalidSlice),
    ):
        with pytest.raises(wrong):
            e.query("Orders", body)
    with pytest.raises(AccessDenied):
        e.query("OrdersNewest", {"columns": ["priority"]})
    with pytest.raises(UnknownField):
        e.query("Nothing", {})


def test_unreferenced_relations_are_not_joined(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    assert e.query("LineItem", {"columns": ["returnFlag", "quantity"], "groupBy": ["returnFlag"]}).joined == []
    assert e.query("LineItem", {"columns": ["order.customer$caption"]}).joined == ["order", "order.customer"]
    plan = e.query("LineItem", {"columns": ["returnFlag", "quantity"], "groupBy": ["returnFlag"]}).items._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "l_comment" not in plan and "l_quantity" in plan and "l_tax" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    rows = star_engine(spark, sf_dir).query("Orders", {"columns": ["orderKey"], "slice": [{"field": "totalPrice", "op": ">", "value": 1000}]}).items
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in rows._jdf.queryExecution().toString()


def test_pages_and_totals(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    got = e.query("Orders", {"columns": ["orderKey", "totalPrice"], "orderBy": ["orderKey"], "page": 2, "pageSize": 7, "returnTotal": True}).collect()
    assert got["start"] == 7 and got["limit"] == 7 and len(got["items"]) == 7 and got["hasNext"] and got["total"] == got["totalData"]["total"] == e.frame_of("orders").count()


def test_scope_and_saved_queries(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    with pytest.raises(ScopeError):
        e.save_query("OrdersNewest", {"columns": ["orderKey"]})
    with pytest.raises(ScopeError):
        e.save_query("OrdersNewest", {"slice": [{"field": "orderDate", "op": "[]", "value": ["1996-01-01", "1996-03-01"]}]})
    saved = e.save_query("OrdersNewest", {"columns": ["orderKey"], "slice": [{"field": "orderDate", "op": ">=", "value": "1996-01-01"}]}, seconds=10, now=100)
    assert e.open_query(saved["id"], now=105).limit == 10
    with pytest.raises(QueryError):
        e.open_query(saved["id"], now=200)
    closed = bounded_scope(read_request({"slice": [{"field": "d", "op": ">=", "value": "2024-01-01"}]}), "d", 31)
    assert closed.slices[-1].value == "2024-02-01 00:00:00"


def test_roles():
    assert tools_of("BUSINESS") == ["dataset_nl.query"] and "dataset.query_model_v2" in tools_of("analyst")
    with pytest.raises(AccessDenied):
        check_tool("BUSINESS", "chart.generate")
    assert SecurityContext.of_header("Bearer abc").token == "abc"


def test_metadata(spark, sf_dir):
    e = star_engine(spark, sf_dir)
    found = e.metadata(["Orders"])
    assert found["fields"]["status"] == ["Orders"] and found["dictionaries"]["order_status"]["O"] == "Open"
    assert "| totalPrice | measure | MONEY | SUM |" in e.markdown(["Orders"])
