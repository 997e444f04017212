"""Groups that are cut into ranges against groups that are one task's work: the same rows for any number of cuts."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.operators import aggs, overlap
from tidewell.operators import windows as W
from tidewell.operators.frames import Order
from tidewell.operators.ranges import can_carry, cut_into, numbered, scan_ranges, scan_rows, scan_times
from tidewell.operators.scan import KERNELS, Node, scan
from tidewell.operators.spans import SpanLag, SpanStatistic
from tidewell.plans import graph as G

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this file

ORDER = Order("g", "t", "k")
OPTIONS = {
    "ema": {"alpha": 0.2}, "ema_unbiased": {"alpha": 0.05}, "ewma": {"alpha": 0.2}, "ema_time": {"tau": 3.0}, "var_ew": {"alpha": 0.2}, "std_ew": {"alpha": 9.0}, "cov_ew": {"alpha": 0.2},
    "zscore_ew": {"alpha": 0.02}, "macd": {}, "rsi": {}, "atr": {}, "dm": {}, "adosc": {}, "kdj": {"rows": 40}, "cusum": {"threshold": 0.8},
}


@pytest.fixture(scope="module")
def table(spark):
    """One group of most rows, small ones, groups without a value, a null and a NaN group; ties of time, nulls."""
    rng = np.random.default_rng(3)
    rows = []
    for g, n in ((1.0, 900), (2.0, 3), (3.0, 1), (None, 40), (float("nan"), 30), (5.0, 120), (6.0, 20)):
        base = 50 + np.cumsum(rng.normal(size=n))
        for k in range(n):
            x = None if rng.random() < 0.1 or g == 6.0 or (g == 1.0 and 300 <= k < 520) else float(base[k])
            rows.append((g, k // 3, k, x, float(base[k] + rng.uniform(0, 2)), float(base[k] - rng.uniform(0, 2)), float(rng.uniform(1, 9))))
    return spark.createDataFrame(rows, "g double, t int, k int, a double, b double, c double, d double").repartition(5).cache()


def named(df):
    return df.withColumn("g", F.coalesce(F.col("g").cast("string"), F.lit("none")))


def compare(one, other, columns, tolerance=1e-12):
    read = lambda df: named(df).toPandas().sort_values(["g", "t", "k"]).reset_index(drop=True)
    a, b = read(one), read(other)
    assert len(a) == len(b) and a[["g", "t", "k"]].equals(b[["g", "t", "k"]])
    for c in columns:
        assert (a[c].isna() == b[c].isna()).all(), c
        np.testing.assert_allclose(a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), rtol=tolerance, atol=tolerance * 100, err_msg=c)


@pytest.mark.parametrize("number", [2, 23])
def test_kernels(table, number):
    nodes = [Node(KERNELS[name], ["b", "c", "a", "d"][: KERNELS[name].inputs] if KERNELS[name].inputs > 1 else ["a"], [f"{name}_{o}" for o in KERNELS[name].outputs], o) for name, o in OPTIONS.items()]
    nodes.append(Node(KERNELS["ema"], ["macd_hist"], ["smooth"], {"alpha": 0.1}))  # levels above those of what it reads
    nodes.append(Node(KERNELS["rsi"], ["smooth"], ["strength"], {}))
    assert all(map(can_carry, nodes))
    made = [n for node in nodes for n in node.names]
    compare(scan(table, ORDER, nodes), scan_ranges(table, ORDER, nodes, number), made)


def test_odd_values_spread_alike(spark):
    rows = [(1.0, k, 0, float(k % 7)) for k in range(200)] + [(2.0, k, 0, float("nan") if k == 60 else 1.0 + k % 3) for k in range(200)] + [(3.0, k, 0, float("inf") if k == 60 else 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "g double, t int, k int, a double")
    nodes = [Node(KERNELS["ema"], ["a"], ["m"], {"alpha": 0.3}), Node(KERNELS["ema"], ["a"], ["x"], {"alpha": 1.0}), Node(KERNELS["var_ew"], ["a"], ["y", "z"], {"alpha": 0.3}), Node(KERNELS["ewma"], ["a"], ["w"], {"alpha": 1e-3})]
    compare(scan(df, ORDER, nodes), scan_ranges(df, ORDER, nodes, 17), ["m", "x", "y", "z", "w"])


def test_guessed_starts_meet(spark):
    rng = np.random.default_rng(1)
    x = np.exp(np.cumsum(rng.normal(size=3000) * 0.1))
    df = spark.createDataFrame([(1.0, k, 0, float(v)) for k, v in enumerate(x)], "g double, t int, k int, a double")
    report = {}
    node = [Node(KERNELS["cusum"], ["a"], ["bar", "fired"], {"threshold": 0.5})]
    compare(scan(df, ORDER, node), scan_ranges(df, ORDER, node, 6, report), ["bar", "fired"], 0)
    assert report["ranges"] == 6 and report["passes"] == 3 and report["ranges_again"] <= 10
    slow = [Node(KERNELS["cusum"], ["a"], ["bar", "fired"], {"threshold": 1e9})]  # no bar ends: runs may never meet
    compare(scan(df, ORDER, slow), scan_ranges(df, ORDER, slow, 6), ["bar", "fired"], 0)


def test_rows_and_numbers(table):
    for _, part in named(numbered(table, ORDER, 19, "n")).toPandas().groupby("g"):
        assert part.sort_values(["t", "k"]).n.tolist() == list(range(len(part)))
    nodes = [Node(SpanStatistic, ["a", "t"], ["s"], {"name": "sum", "rows": 7}), Node(SpanStatistic, ["s", "t"], ["m"], {"name": "max", "rows": 30}), Node(SpanLag, ["a", "t"], ["l"], {"rows": 5, "fill": "oldest"}), Node(SpanStatistic, ["b", "c", "t"], ["x", "y", "z", "r"], {"name": "corr", "rows": 12})]
    compare(scan(table, ORDER, nodes), scan_rows(table, ORDER, nodes, 37, 20), ["s", "m", "l", "x", "y", "z", "r"], 1e-9)


def test_times(table):
    nodes = [Node(SpanStatistic, ["a", "t"], ["s"], {"name": "avg", "time": 4.0}), Node(SpanStatistic, ["s", "t"], ["m"], {"name": "min", "time": 9.0})]
    compare(scan(table, ORDER, nodes), scan_times(table, ORDER, nodes, "t", 13.0, 12), ["s", "m"], 1e-9)


def test_graph(table):
    g = G.Graph()
    g.root("in", ["a", "b"])
    fast = g.add("fast", G.kernel("ema", alpha=3.0), "a")
    g.add("low", G.rolling("min", rows=9), fast)
    g.add("sum", G.rolling("sum"), "b")
    g.add("near", G.rolling("avg", time=5), "low")
    g.add("both", G.binary("add"), "near", "sum")
    g.add("old", G.rolling("lag", rows=2, fill="zero"), "both")
    g.add("top", G.running("ohlc"), "b")
    g.add("own", G.stateful(lambda: lambda v: v * 2, 1), "old")
    g.set_output("low", "near", "both", "old", "own", *(f"top.{k}" for k in range(4)))
    compare(g.run(table, ORDER, ranges=0), g.run(table, ORDER, ranges=14), g.names(), 1e-9)


@pytest.mark.parametrize("make", [lambda r: W.counter(7, ranges=r), lambda r: W.session(2, ranges=r), lambda r: W.cusum(0.3, "b", ranges=r)])
@pytest.mark.parametrize("partial", [True, False])
def test_windows(table, make, partial):
    run = lambda r: sorted(map(str, G.AggGraph().input("b").window(make(r)).add("sum", ["b"]).add("count").run(table.filter("b > 0"), ORDER, emit_partial=partial).withColumn("sum_b", F.round("sum_b", 6)).collect()))
    assert run(0) == run(15)


def test_no_rows(table):
    assert scan_ranges(table.limit(0), ORDER, [Node(KERNELS["rsi"], ["a"], ["r"], {})], 4).collect() == []
    assert scan_times(table.limit(0), ORDER, [Node(SpanStatistic, ["a", "t"], ["s"], {"name": "avg", "time": 4.0})], "t", 4.0, 4).collect() == []


def spread():
    class Range(aggs.Mergeable):
        """Distance between the largest and the least value, and the last less the first one."""

        outputs = ("width", "move")
        ordered = True

        def lift(self, x):
            return x.min(), x.max(), x[0], x[-1]

        def merge(self, a, b):
            return min(a[0], b[0]), max(a[1], b[1]), a[2], b[3]

        def finish(self, s):
            return s[1] - s[0], s[3] - s[2]

    return Range()


@pytest.mark.parametrize("window", [W.tumbling(17), W.counter(11), W.tumbling(10**6)])
def test_mergeable_aggregates(spark, table, window):
    """By parts from rows in any partition: what the whole window gives; nulls, null groups, a window that holds all rows."""
    a = G.AggGraph().input("a", "b", "d").window(window).add(spread(), ["a"], into=["width", "move"]).add("count")
    for name, cols in (("sum", ["a"]), ("stddev", ["a"]), ("ohlc", ["a"]), ("vwap", ["a", "d"]), ("log_return", ["b"]), ("book_imba", ["a", "d"])):
        a.add(name, cols).add(aggs.by_parts(name), cols, into=[f"p_{n}" for n in aggs.outputs(name, cols)])
    got = a.run(table, ORDER).toPandas()
    assert len(got) == len(G.AggGraph().window(window).add("count").run(table, ORDER).toPandas()) and got["count"].sum() == table.count()
    for name in [c[2:] for c in got.columns if c.startswith("p_")]:
        np.testing.assert_allclose(got[f"p_{name}"], got[name], rtol=1e-9, atol=1e-9, err_msg=name)
    np.testing.assert_allclose(got.width, got.high - got.low)
    np.testing.assert_allclose(got.move, got.close - got.open)
    assert G.AggGraph().input("a").window(window).add(spread(), ["a"]).run(table.limit(0), ORDER).count() == 0


def by_hand(table, make, columns):
    """Windows of an emitter, group by group, as (group, time, sum and count of a, last less first b)."""
    out = []
    rows = sorted(named(table).collect(), key=lambda r: (r.g, r.t, r.k))
    for g in dict.fromkeys(r.g for r in rows):
        queue, e = [], make()
        for r in (r for r in rows if r.g == g):
            x = [r[c] for c in columns]
            if None in x:
                continue
            queue.append(r)
            if (got := e.on_row(float(r.t), *x)) is not None:
                offset, size, evict = got
                w = queue[offset : offset + size]
                a = [v.a for v in w if v.a is not None]
                out.append((g, r.t, sum(a) if a else None, float(len(w)) if w else None, w[-1].b - w[0].b if w else None))
                queue = queue[evict:]
    return sorted(out, key=str)


def alternating():
    class E:
        """Of four rows that wait three, by turns the first and the last ones; two leave, then all."""

        def __init__(self):
            self.n, self.odd = 0, False

        def on_row(self, t):
            self.n += 1
            if self.n < 4:
                return None
            self.odd = not self.odd
            self.n = 2 if self.odd else 0
            return (0, 3, 2) if self.odd else (1, 3, 4)

    return E()


def every_row():
    class E:
        """The last 24 rows at every row; nothing at times."""

        def __init__(self):
            self.n = 0

        def on_row(self, t, b):
            self.n += 1
            if self.n == 24:
                self.n = 23
                return 0, 24, 1
            return (0, 0, 0) if self.n == 10 else None

    return E()


@pytest.mark.parametrize("make, columns", [(alternating, []), (every_row, ["b"])])
def test_windows_of_an_emitter(table, make, columns, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 16)
    move = aggs.Parts(("first", "last"), lambda x: (x[0], x[-1]), lambda a, b: (b - a,))
    run = lambda df: G.AggGraph().input("a", "b").window(W.emitter(make, columns)).add("sum", ["a"]).add("count").add(move, ["b"], into=["move"]).run(named(df), ORDER)
    got = sorted(((r.g, r.window_ts, r.sum_a, r["count"], r.move) for r in run(table).collect()), key=str)
    want = by_hand(table, make, columns)
    assert len(got) == len(want) and [x[:2] for x in got] == [x[:2] for x in want]
    for x, y in zip(got, want, strict=True):
        assert x[2:] == pytest.approx(y[2:])
    assert run(table.limit(0)).count() == 0


@pytest.mark.parametrize("size, step", [(24, 1), (10, 2), (7, 1.5), (12, 3)])
def test_hopping_windows_from_panes(table, size, step):
    a = G.AggGraph().input("a", "d").window(W.hopping(size, step)).add("ohlc", ["a"]).add("stddev", ["a"]).add("vwap", ["a", "d"]).add("count")
    rows = G.AggGraph().input("a", "d").window(W.hopping(size, step)).add("ohlc", ["a"]).add("stddev", ["a"]).add("vwap", ["a", "d"]).add(lambda seq: [F.count("*").cast("double")], into=["count"])
    read = lambda g: named(g.run(table, ORDER)).toPandas().sort_values(["g", "window_ts"]).reset_index(drop=True)
    got, want = read(a), read(rows)
    assert len(got) == len(want) and (got.window_ts == want.window_ts).all()
    for c in ("open", "high", "low", "close", "stddev_a", "vwap", "count"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9)


def test_versions_of_parameters(table):
    """The latest version not later than the row; rows before the first one are as if they were not there."""
    versions = [(1.0, 20, 0.5, 3), (1.0, 100, 0.1, 9), (1.0, 101, 0.9, 2), (5.0, 0, 0.3, 4), (None, 5, 1.0, 1), (8.0, 0, 0.2, 2)]
    v = table.sparkSession.createDataFrame(versions, "g double, begin int, alpha double, size int")
    g = G.Graph()
    g.root("in", ["b"])
    g.add("m", G.kernel("ema", alpha=0.0), "b")
    g.add("s", G.rolling("sum", rows=2), "b")
    g.supp_root("given", ["alpha", "size"])
    g.supp_link("m", alpha="alpha").supp_link("s", rows="size")
    g.set_output("m", "s")
    for number in (0, 13):
        with cut_into(number):
            got = {(r.g, r.t, r.k): (r.m, r.s) for r in named(g.run(table, ORDER, parameters=v, since="begin")).collect()}
        assert len(got) == table.count()
        state = {}
        for r in sorted(named(table).collect(), key=lambda r: (r.g, r.t, r.k)):
            fit = [x for x in versions if ("none" if x[0] is None else str(x[0])) == r.g and x[1] <= r.t]
            if not fit:
                assert got[r.g, r.t, r.k] == (None, None)
                continue
            _, _, alpha, size = max(fit, key=lambda x: x[1])
            m, held = state.get(r.g, (None, []))
            m = r.b if m is None else m + alpha * (r.b - m)
            held = [*held, r.b][-size:]
            state[r.g] = m, held
            assert got[r.g, r.t, r.k] == pytest.approx((m, sum(held)))


def test_options_that_can_not_change(table):
    with pytest.raises(ValueError, match="on_param"):
        Node(SpanLag, ["b", "t"], ["l"], {"rows": "d"}, live=True)
