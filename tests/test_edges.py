"""Values at the edges of arithmetic, and tables whose plans Spark changes while they run."""

import math

import pytest

from tidewell.operators import windows as W
from tidewell.operators.frames import Order
from tidewell.plans import graph as G

ORDER = Order("g", "t")
FROM_ZERO = {"up": (0.0, 5.0), "down": (5.0, 0.0), "none": (0.0, 0.0), "whole": (5.0, 10.0)}
SIMPLE = {"up": math.inf, "down": -1.0, "none": math.nan, "whole": 1.0}
LOG = {"up": math.inf, "down": -math.inf, "none": math.nan, "whole": math.log(2)}


def same(a, b):
    return a is not None and (a == pytest.approx(b) or math.isnan(a) and math.isnan(b))


def from_zero(spark):
    return spark.createDataFrame([(g, t, v) for g, x in FROM_ZERO.items() for t, v in enumerate(x)], "g string, t long, x double")


def test_returns_from_and_to_zero(spark):
    for ranges in (None, 2):
        rows = G.AggGraph().input("x").window(W.counter(2, ranges=ranges) if ranges else W.counter(2)).add("simple_return", ["x"]).add("log_return", ["x"]).run(from_zero(spark), ORDER).collect()
        assert len(rows) == 4 and all(same(r.simple_return, SIMPLE[r.g]) and same(r.log_return, LOG[r.g]) for r in rows)


@pytest.mark.parametrize("ranges", [0, 2])
def test_running_returns_from_and_to_zero(spark, ranges):
    g = G.Graph()
    g.root("in", ["x"])
    g.add("s", G.running("simple_return"), "x")
    g.add("l", G.running("log_return"), "x")
    rows = [r for r in g.set_output("s", "l").run(from_zero(spark), ORDER, ranges=ranges).collect() if r.t == 1]
    assert len(rows) == 4 and all(same(r.s, SIMPLE[r.g]) and same(r.l, LOG[r.g]) for r in rows)


@pytest.mark.parametrize("ranges", [None, 3])
def test_cusum_bars_end_where_a_log_return_is_nan(spark, ranges):
    values = {"zeros": (5.0, 5.5, 0.0, 0.0, 0.0, 5.0, 6.0, 0.0), "first": (0.0, 0.0, 3.0, 3.1), "below": (5.0, -1.0, 5.0, 5.1)}
    ends = {"zeros": [2, 3, 4, 5, 7], "first": [1, 2, 3], "below": [1, 2, 3]}  # the last one of "first" and "below" stays open
    df = spark.createDataFrame([(g, t, v) for g, x in values.items() for t, v in enumerate(x)], "g string, t long, x double")
    rows = G.AggGraph().input("x").window(W.cusum(2.0, "x", ranges=ranges)).add("count").run(df, ORDER).collect()
    assert {g: sorted(r.window_ts for r in rows if r.g == g) for g in values} == ends


def test_returns_by_parts_from_and_to_zero():
    from tidewell.operators import aggs

    for name, want in (("simple_return", SIMPLE), ("log_return", LOG)):
        agg = aggs.by_parts(name)
        assert all(same(agg.finish(x)[0], want[g]) for g, x in FROM_ZERO.items())


def test_parameters_joined_while_rows_stay_where_they_were_read(spark):
    """Spark sees only in mid-run that the parameters are few, and then leaves the rows of the join where they were read."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
        df = spark.range(0, 4000, 1, 4).selectExpr("id % 3 as g", "id as t", "1.0D as x")
        own = df.select("g").distinct().selectExpr("g", "1000.0D as rows")
        g = G.Graph()
        g.root("in", ["x"])
        g.add("s", G.rolling("sum", rows=1), "x")
        g.supp_root("p", ["rows"])
        g.supp_link("s", rows="rows")
        rows = g.set_output("s").run(df, ORDER, parameters=own).collect()
        assert len(rows) == 4000 and all(r.s == min(r.t // 3 + 1, 1000) for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranges_are_more_where_a_table_is_larger(spark, monkeypatch):
    from tidewell.operators import ranges

    for name, value in (("LARGE_BYTES", 0), ("LARGE_ROWS", 1000), ("RANGE_ROWS", 50)):
        monkeypatch.setattr(ranges, name, value)
    width = ranges.width_of(spark)
    for rows in (1000, 5000):
        df = spark.range(rows).selectExpr("1 as g", "id as t", "1.0D as x", "2.0D as y")
        number = ranges.wanted(df, ORDER)
        assert number == max(width, rows // 50)
        g = G.Graph()
        g.root("in", ["x", "y"])
        g.add("rows", G.rolling("avg_weighted", rows=3), "x", "y")
        got = g.set_output("rows").run(df, ORDER)
        assert got.count() == rows and got.filter("rows = 1").count() == rows
    assert ranges.wanted(spark.range(900).selectExpr("1 as g", "id as t"), ORDER) == 0
