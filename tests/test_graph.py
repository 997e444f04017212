"""Building and checking graphs."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import windows as W
from tidewell.operators.frames import Order
from tidewell.plans import graph as G


def example():
    """Two prices: their spread is smoothed and scaled, one of them is also taken by itself, and both meet again."""
    g = G.Graph()
    g.root("quotes", 2)
    g.add("spread", G.binary("sub"), "quotes.1", "quotes.0")
    g.add("log", G.unary("log"), "quotes.0")
    g.add("half", G.lerp(0.5), "quotes.0", "quotes.1")
    g.add("share", G.binary("div"), "spread", "half")
    g.add("level", G.unary("abs"), "share")
    return g.set_output("level", "log")


def test_structure():
    g = example()
    assert g.size == 6 and not g.empty and "half" in g and "whole" not in g
    assert g.pred_of("share") == ["spread", "half"] and g.succ_of("quotes") == ["spread", "log", "half"]
    assert g.args_of("spread") == [G.Edge("quotes", 1), G.Edge("quotes", 0)]
    assert g.roots() == ["quotes"] and set(g.leaves()) == {"log", "level"} and g.is_root("quotes") and not g.is_leaf("half")
    order = g.order()
    assert max(order.index("spread"), order.index("half")) < order.index("share") < order.index("level")
    g.validate()
    g.clear()
    assert g.empty


def test_edges():
    assert G.Edge.parse("n") == G.Edge("n", 0) and G.Edge.parse("n.2") == G.Edge("n", 2)
    for bad in ("a.b.c", "a.x", ".1", ""):
        with pytest.raises(ValueError):
            G.Edge.parse(bad)


@pytest.mark.parametrize("build", [
    lambda g: g.root("again"),
    lambda g: g.add("half", G.unary("neg"), "quotes.0"),
    lambda g: g.add("", G.unary("neg"), "quotes.0"),
    lambda g: g.add("x.y", G.unary("neg"), "quotes.0"),
    lambda g: (g.add("N", G.unary("neg"), "quotes.9"), g.validate()),
    lambda g: (g.add("N", G.unary("neg"), "Missing"), g.validate()),
    lambda g: (g.add("N", G.binary("add"), "half"), g.validate()),
    lambda g: (g.add_output("Missing"), g.validate()),
    lambda g: (g.add("P", G.unary("neg"), "Q"), g.add("Q", G.unary("neg"), "P"), g.validate()),
    lambda g: (g.supp_root("S", ["p"]), g.supp_link("half", alpha="p")),
    lambda g: (g.aux("T", W.counter(2)), g.aux("U", W.counter(2))),
    lambda g: (g.aux("T", W.counter(2)), g.add("N", G.unary("neg"), "T")),
    lambda g: g.aux("T", W.counter(2), "half"),
])
def test_errors(build):
    with pytest.raises(ValueError):
        build(example())


def test_aliases_and_forward_references(spark):
    g = G.Graph()
    g.root("r", 2).alias("a", "b")
    with pytest.raises(ValueError):
        g.root("s")
    g.add("late", G.binary("sub"), "early", "b")
    g.add("early", G.binary("add"), "a", "b")
    df = spark.createDataFrame([(1, 1, 2.0, 3.0)], "k int, t int, in0 double, in1 double")
    assert g.set_output("late", "a", "late").run(df, Order("k", "t")).drop("k", "t").first() == (2.0, 2.0, 2.0)


def test_unneeded_nodes_are_left_out(spark):
    g = G.Graph()
    g.root("r", ["x"])
    g.add("bad", G.functor(lambda x: F.raise_error(F.lit("ran")), 1), "x")
    g.add("good", G.unary("neg"), "x")
    df = spark.createDataFrame([(1, 1, 2.0)], "k int, t int, x double")
    assert g.set_output("good").run(df, Order("k", "t")).first().good == -2


def test_functor_shapes(spark):
    g = G.Graph()
    g.root("r", ["x"])
    g.add("four", G.functor(lambda x: (x, x + 1, x * 2, x / 2), 1, 4), "x")
    g.add("constant", G.functor(lambda: 42, 0))
    df = spark.createDataFrame([(1, 1, 10.0)], "k int, t int, x double")
    assert g.set_output("four.0", "four.1", "four.2", "four.3", "constant").run(df, Order("k", "t")).drop("k", "t").first() == (10, 11, 20, 5, 42)


def test_sequential_nodes_share_one_pass(spark):
    g = G.Graph()
    g.root("r", ["x"])
    g.add("f", G.kernel("ema", alpha=0.5), "x")
    g.add("s", G.kernel("ema", alpha=0.1), "x")
    g.add("m", G.kernel("macd"), "f", "s")
    df = spark.createDataFrame([(1, 1, 10.0)], "k int, t int, x double")
    plan = g.set_output("m.2").run(df, Order("k", "t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_parameters_reach_rolling_operators(spark):
    """A group's own span, and a span that changes with the rows."""
    g = G.Graph()
    g.root("in", ["x"])
    g.supp_root("p", ["n"])
    g.add("s", G.rolling("sum", rows=1), "x")
    g.supp_link("s", rows="n").set_output("s")
    df = spark.createDataFrame([(k, t, float(t)) for k in (1, 2) for t in range(1, 6)], "k int, t int, x double")
    own = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, n double")
    got = {k: [r.s for r in g.run(df, Order("k", "t"), parameters=own).orderBy("t").collect() if r.k == k] for k in (1, 2)}
    assert got == {1: [1, 3, 5, 7, 9], 2: [1, 3, 6, 9, 12]}
    changing = df.filter("k = 1").withColumn("n", F.when(F.col("t") < 4, 2.0).otherwise(1.0))
    assert [r.s for r in g.run(changing, Order("k", "t"), live=True).orderBy("t").collect()] == [1, 3, 5, 4, 5]


def test_users_operator_over_a_span(spark):
    class Range:
        def __init__(self):
            self.x = []

        def add(self, x):
            self.x.append(x)

        def evict(self, x):
            self.x.remove(x)

        def value(self):
            return max(self.x) - min(self.x)

    g = G.Graph()
    g.root("in", ["x"])
    g.add("r", G.windowed_operator(Range, 1, rows=3), "x")
    g.add("d", G.windowed_operator(Range, 1, time=2), "x")
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate([5, 1, 4, 4, 9])], "k int, t int, x double")
    got = g.set_output("r", "d").run(df, Order("k", "t")).orderBy("t").collect()
    assert [(r.r, r.d) for r in got] == [(0, 0), (4, 4), (4, 3), (3, 0), (5, 5)]


@pytest.mark.parametrize("ranges", [0, 2])
def test_sums_of_all_rows_lose_nothing_by_rounding(spark, ranges):
    inf, nan = float("inf"), float("nan")
    x = {0: [1e16, 1.0, None, 1.0, -1e16], 1: [2.0, inf, 5.0, 1.0, 1.0], 2: [1.0, inf, -inf, 3.0, 3.0], 3: [None, 1e-3, nan, 1.0, 1.0], 4: [0.1] * 3000}
    df = spark.createDataFrame([(g, float(k), k, v, 0.0) for g, xs in x.items() for k, v in enumerate(xs)], "grp int, ts double, n int, x double, y double")
    g = G.Graph()
    g.root("in", ["x", "y"])
    for name in ("sum", "avg", "order_flow"):
        g.add(name, G.running(name), *["x", "y"][: G.running(name).inputs])
    g.add("all", G.rolling("sum"), "x")
    out = {k: [(r.sum, r.avg, r.order_flow, r.all) for r in rows] for k, rows in itertools.groupby(g.set_output("sum", "avg", "order_flow", "all").run(df, Order("grp", "ts", "n"), ranges=ranges).orderBy("grp", "n").collect(), lambda r: r.grp)}
    assert out[0] == [(s, s / n, s, s) for s, n in ((1e16, 1), (1e16, 2), (1e16, 2), (1e16 + 2, 3), (2.0, 4))]
    assert [r[0] for r in out[1]] == [2.0, inf, inf, inf, inf] and all(r[0] == r[2] == r[3] for r in out[1])
    assert [r[2] for r in out[2]][:2] == [1.0, inf] and all(math.isnan(s) for r in out[2][2:] for s in r)
    assert out[3][:2] == [(None,) * 4, (1e-3,) * 4] and all(math.isnan(s) for r in out[3][2:] for s in r)
    assert [r[0] for r in out[4]] == [r[2] for r in out[4]] == [r[3] for r in out[4]] == [math.fsum([0.1] * n) for n in range(1, 3001)]
