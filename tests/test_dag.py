import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.dag import Arbiter, Composer, Cost, Enricher, GraphError, Router

WORDS = lambda k: lambda c: text.word_count(c[k])


def rows(spark, data):
    return spark.createDataFrame(data, "prompt string, response string, extra int")


def test_cost_and_verdict(spark):
    g = Composer("d", [Enricher("e", lambda c: F.lit(1), Cost(0.6, 0.4, 0.25, 0.25), WORDS("prompt"), WORDS("response"), next=["a"]), Arbiter("a", lambda c: F.lit("UNSAFE"), Cost(0, 0, 0.25, 0.25))], ["SAFE", "UNSAFE"])
    r = g.run(rows(spark, [("Hello, world", "This is a response.", 7)])).first()
    assert (r.d_output, r.d_error, r.extra) == ("UNSAFE", None, 7)
    assert [round(r.d_cost[k], 9) for k in ("input", "output", "fixed", "latency")] == [1.2, 1.6, 0.5, 0.5]


def test_context_goes_through_nodes_without_updates(spark):
    nodes = [Enricher("lower", lambda c: F.lit(1), updates=lambda c, v: {"response": F.lower(c["response"]), "metadata": F.create_map(F.lit("k"), F.lit("v"))}, next=["same"]), Enricher("same", lambda c: F.lit(1), next=["score"]), Arbiter("score", lambda c: F.concat(c["response"], F.lit("-"), F.try_element_at(c["metadata"], F.lit("k"))))]
    assert Composer("d", nodes, []).run(rows(spark, [("p", "ABC", 1)])).first().d_output == "abc-v"


def gate(default=None, **more):
    return [Router("r", lambda c: F.length("prompt") % 4, routes={1: ["SAFE"], 2: ["a"]}, default=default), Arbiter("a", lambda c: F.lit("UNSAFE"), Cost(fixed=1.0), **more)]


def test_routes_and_costs_only_where_reached(spark):
    got = Composer("d", gate(["SAFE"]), ["SAFE", "UNSAFE"]).run(rows(spark, [(p, "", 1) for p in ("a", "ab", "abc")]), trace=True).collect()
    assert [(r.d_output, r.d_cost.fixed, r.d_reached) for r in got] == [("SAFE", 0.0, ["r"]), ("UNSAFE", 1.0, ["r", "a"]), ("SAFE", 0.0, ["r"])]


def test_keys_without_a_route(spark):
    g = Composer("d", gate(), ["SAFE", "UNSAFE"])
    with pytest.raises(Exception, match="no route"):
        g.run(rows(spark, [("abc", "", 1)])).collect()
    r = g.run(rows(spark, [("abc", "", 1), ("a", "", 1)]), on_abort="column").collect()
    assert r[0].d_output is None and "no route for 3" in r[0].d_error and r[1].d_output == "SAFE"


def test_a_node_error_is_the_rows(spark):
    r = Composer("d", gate(["SAFE"], error=lambda c: F.lit("broke")), ["SAFE", "UNSAFE"]).run(rows(spark, [("ab", "", 1), ("a", "", 1)])).collect()
    assert [(x.d_output, x.d_error, x.d_cost.fixed) for x in r] == [(None, "a: broke", 0.0), ("SAFE", None, 0.0)]


def test_parents_that_differ(spark):
    up = lambda v: lambda c, x: {"metadata": F.create_map(F.lit("k"), F.lit(v))}
    for a, b, bad in (("1", "1", False), ("1", "2", True)):
        g = Composer("d", [Enricher("x", lambda c: F.lit(1), updates=up(a), next=["z"]), Enricher("y", lambda c: F.lit(1), updates=up(b), next=["z"]), Arbiter("z", lambda c: F.try_element_at(c["metadata"], F.lit("k")))], [])
        r = g.run(rows(spark, [("p", "r", 1)])).first()
        assert (r.d_error is not None) == bad and r.d_output == (None if bad else "1")


def test_only_a_default_names_it_so_it_is_a_root(spark):
    nodes = [Router("r", lambda c: F.lit("k"), routes={"k": ["SAFE"]}, default=["a"]), Arbiter("a", lambda c: F.lit("UNSAFE"))]
    assert Composer("d", nodes, ["SAFE", "UNSAFE"]).roots() == ["r", "a"]


def test_graphs_are_checked():
    one = lambda c: F.lit(1)
    with pytest.raises(GraphError, match="cycle"):
        Composer("d", [Enricher("a", one, next=["b"]), Enricher("b", one, next=["a"])], [])
    with pytest.raises(GraphError, match="isn't there"):
        Composer("d", [Enricher("a", one, next=["nowhere"])], [])
    with pytest.raises(GraphError, match="more than one verdict"):
        Composer("d", [Enricher("a", one, next=["S", "U"])], ["S", "U"])
    with pytest.raises(GraphError, match="one name"):
        Composer("d", [Arbiter("a", one), Arbiter("a", one)], [])


def test_potential_costs():
    g = Composer("d", gate(["SAFE"]), ["SAFE", "UNSAFE"])
    assert {k: v.fixed for k, v in g.potential_costs().items()} == {"r": 0.0, "r -> a": 1.0}
