"""Rolling operators, windows and pipelines on small series with known results."""

import math
import random

import pytest

from tidewell.operators import windows as W
from tidewell.operators.frames import Order, Span
from tidewell.operators.scan import KERNELS, Node, scan
from tidewell.plans import graph as G
from tidewell.plans.pipeline import Pipeline

ORDER = Order("grp", "ts", "n")


def frame(spark, rows, schema="grp int, ts double, n int, x double"):
    return spark.createDataFrame(rows, schema)


def series(spark, groups, times=None):
    rows = [(g, float(times[i] if times else i + 1), i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    return frame(spark, rows)


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("grp", "ts", "n").collect()]


def fan_out():
    g = G.Graph()
    g.root("in", ["x"])
    g.add("a", G.rolling("sum", rows=2), "x")
    g.add("b", G.rolling("sum", rows=5), "x")
    g.add("c", G.binary("add"), "a", "b")
    return g.set_output("a", "b", "c")


def test_fan_out_slides_and_keeps_groups_apart(spark):
    out = values(fan_out().run(series(spark, {0: [1] * 12, 1: [1] * 3, 2: [10]}), ORDER), "grp", "a", "b", "c")
    assert out[0] == (0, 1, 1, 2) and out[11] == (0, 2, 5, 7)
    assert out[14] == (1, 2, 3, 5) and out[15] == (2, 10, 10, 20)


def test_time_span_is_half_open(spark):
    g = G.Graph()
    g.root("in", ["x"])
    g.add("s", G.rolling("sum", time=5.0), "x")
    df = series(spark, {0: [1, 1, 1]}, [1, 3, 7])
    assert [v[0] for v in values(g.set_output("s").run(df, ORDER), "s")] == [1, 2, 2]


def brute(op, rows, w):
    """Statistics over (t - w, t] in row order, from the definition."""
    out = []
    for i, (t, x, y) in enumerate(rows):
        seen = [(a, b) for s, a, b in rows[: i + 1] if s > t - w]
        xs, ys = [a for a, _ in seen], [b for _, b in seen]
        n, mx, my = len(seen), sum(xs) / len(xs), sum(ys) / len(ys)
        cov = sum((a - mx) * (b - my) for a, b in seen) / (n - 1) if n > 1 else 0.0
        vx = sum((a - mx) ** 2 for a in xs) / (n - 1) if n > 1 else 0.0
        vy = sum((b - my) ** 2 for b in ys) / (n - 1) if n > 1 else 0.0
        out.append({"sum": sum(xs), "avg": mx, "var": vx, "cov": cov, "corr": cov / math.sqrt(vx * vy) if vx * vy > 1e-12 else 0.0, "beta": cov / vx if vx > 1e-12 else 0.0}[op])
    return out


@pytest.mark.parametrize("op", ["sum", "avg", "var", "cov", "corr", "beta"])
@pytest.mark.parametrize("w", [5.0, 2.5, 5])
def test_time_spans_with_ties(spark, op, w):
    rng = random.Random(3)
    rows, data = [], {0: [], 1: []}
    for g in (0, 1):
        t = 0
        for i in range(60):
            t += rng.choice([0, 0, 1, 2])
            x, y = rng.uniform(-5, 5), rng.uniform(0, 9)
            rows.append((g, t if isinstance(w, int) else float(t), i, x, y))
            data[g].append((t, x, y))
    df = frame(spark, rows, f"grp int, ts {'long' if isinstance(w, int) else 'double'}, n int, x double, y double")
    g = G.Graph()
    g.root("in", ["x", "y"])
    node = g.add("op", G.rolling(op, time=w), *(["x", "y"] if op in ("cov", "corr", "beta") else ["x"]))
    last = len(G.rolling(op, time=w).outputs) - 1
    got = [v[0] for v in values(g.set_output(node[last]).run(df, ORDER), g.names()[0])]
    want = brute(op, data[0], w) + brute(op, data[1], w)
    assert got == pytest.approx(want, abs=1e-7)


def test_lag_by_time_with_ties(spark):
    times = [0, 1, 1, 3, 4, 4, 9]
    df = series(spark, {0: range(7)}, times)
    for fill, want in {"nan": None, "zero": 0.0, "oldest": 0.0}.items():
        g = G.Graph()
        g.root("in", ["x"])
        g.add("l", G.rolling("lag", time=3.0, fill=fill), "x")
        got = [v[0] for v in values(g.set_output("l").run(df, ORDER), "l")]
        assert got[3:] == [0, 2, 2, 5]
        assert all(math.isnan(x) if want is None else x == want for x in got[:3])


def test_time_extremes_follow_row_order(spark):
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(80):
        t += rng.choice([0, 1, 3])
        times.append(t)
    xs = [rng.randint(0, 50) for _ in times]
    df = series(spark, {0: xs}, times)
    g = G.Graph()
    g.root("in", ["x"])
    g.add("lo", G.rolling("min", time=4.0), "x")
    g.add("hi", G.rolling("max", time=4.0), "x")
    out = g.set_output("lo", "hi").run(df, ORDER)
    spans = [[x for s, x in zip(times[: i + 1], xs[: i + 1]) if s > t - 4] for i, t in enumerate(times)]
    assert values(out, "lo", "hi") == [(min(s), max(s)) for s in spans]


@pytest.mark.parametrize("extent", [{"rows": 3}, {"time": 3.0}, {}])
def test_nulls_do_not_count(spark, extent):
    """The same rule for all spans: a row with a null in any input is as if it were not there."""
    rows = [(1, 1.0, 10.0, 1.0), (1, 2.0, None, 1.0), (1, 3.0, 20.0, None), (1, 4.0, 40.0, 3.0), (1, 5.0, 80.0, 5.0), (2, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "grp int, ts double, x double, y double")
    g = G.Graph()
    g.root("in", ["x", "y"])
    for name in ("avg", "sum", "moment2", "max"):
        g.add(name, G.rolling(name, **(extent or {"rows": 9} if name == "max" else extent)), "x")
    g.add("cov", G.rolling("cov", **extent), "x", "y")
    out = g.set_output("avg", "sum", "moment2.1", "max", "cov.0", "cov.2").run(df, Order("grp", "ts")).orderBy("grp", "ts").collect()
    got = [tuple(r)[2:] for r in out]
    width = 3 if extent else 9
    for i, r in enumerate(got[:5]):
        span = rows[max(0, i - width + 1) : i + 1]
        x = [v for _, _, v, _ in span if v is not None]
        both = [(v, w) for _, _, v, w in span if v is not None and w is not None]
        mean = sum(x) / len(x)
        want = [mean, sum(x), sum((v - mean) ** 2 for v in x), max(x)]
        mx, my = (sum(c) / len(both) for c in zip(*both)) if both else (None, None)
        want += [mx, None if not both else sum((v - mx) * (w - my) for v, w in both) / (len(both) - 1) if len(both) > 1 else 0.0]
        assert [None if v is None else pytest.approx(v) for v in want] == list(r)
    assert got[5] == (None,) * 6


def bars(spark, times, size, partial=True):
    df = series(spark, {0: times}, times)
    return [(r.window_ts, r["count"]) for r in G.AggGraph().window(W.tumbling(size)).add("count").run(df, ORDER, emit_partial=partial).orderBy("window_ts").collect()]


def test_tumbling_boundaries(spark):
    assert bars(spark, [1, 2, 3, 11, 12, 13, 20, 23, 60, 62, 70], 10, False) == [(10, 3), (20, 3), (30, 2), (70, 2)]
    assert bars(spark, [0, 26, 27, 30], 5, False) == [(5, 1), (30, 2)]
    assert bars(spark, [10, 40, 60, 70], 10, False) == [(20, 1), (50, 1), (70, 1)]
    assert bars(spark, [0.1, 0.2, 0.49, 0.5, 0.51, 0.99, 1.0], 0.5, False) == [(0.5, 3), (1.0, 3)]
    assert bars(spark, [-3, -1, 2], 5) == [(0, 2), (5, 1)]


def test_bars_and_flush(spark):
    df = series(spark, {0: range(1, 9)})
    out = G.AggGraph().input("x").window(W.tumbling(3)).add("ohlc", ["x"]).add("count").run(df, ORDER).orderBy("window_ts").collect()
    assert [tuple(r)[1:] for r in out] == [(3, 1, 2, 1, 2, 2), (6, 3, 5, 3, 5, 3), (9, 6, 8, 6, 8, 3)]
    assert G.AggGraph().input("x").window(W.tumbling(3)).add("sum", ["x"]).run(df.limit(0), ORDER).count() == 0


def test_counter_and_session(spark):
    df = series(spark, {0: range(1, 8)})
    run = lambda w, p: [r["sum_x"] for r in G.AggGraph().input("x").window(w).add("sum", ["x"]).run(df, ORDER, emit_partial=p).orderBy("window_ts").collect()]
    assert run(W.counter(3), True) == [6, 15, 7] and run(W.counter(3), False) == [6, 15]
    gaps = series(spark, {0: [1, 2, 3, 4]}, [0, 5, 9, 20])
    got = G.AggGraph().input("x").window(W.session(5)).add("sum", ["x"]).add("count").run(gaps, ORDER).orderBy("window_ts").collect()
    assert [(r.window_ts, r["count"]) for r in got] == [(0, 1), (9, 2), (20, 1)]


def test_single_row_statistics_are_zero(spark):
    df = series(spark, {0: [5]})
    row = G.AggGraph().input("x").window(W.counter(3)).add("stddev", ["x"]).add("simple_return", ["x"]).add("log_return", ["x"]).run(df, ORDER).first()
    assert (row.stddev_x, row.simple_return, row.log_return) == (0, 0, 0)
    assert G.AggGraph().input("x").window(W.counter(3)).add("vwap", ["x", "x"]).run(series(spark, {0: [0, 0, 0]}), ORDER).first().vwap == 0


def test_unknown_column_is_an_error():
    with pytest.raises(ValueError, match="unknown column"):
        G.AggGraph().input("x").add("sum", ["y"])


def sums():
    g = G.Graph()
    g.root("in", ["x"])
    g.add("s", G.rolling("sum", rows=2), "x")
    return g.set_output("s")


def test_pipeline(spark):
    out = Pipeline().add_stage(sums()).add_stage(sums()).run(series(spark, {0: [10, 10, 10]}), ORDER)
    assert [v[0] for v in values(out, "s")] == [10, 30, 40]
    with pytest.raises(ValueError, match="inputs"):
        Pipeline().add_stage(fan_out()).add_stage(sums())
    with pytest.raises(ValueError, match="groups"):
        Pipeline(2).add_stage(sums(), groups=3)


def test_pipeline_with_time_windows_sees_arrivals(spark):
    t = G.Graph()
    t.root("in", ["x"])
    t.add("s", G.running("sum"), "x")
    t.aux("w", W.tumbling(10))
    out = Pipeline().add_stage(G.TumbleGraph(t.set_output("s"))).add_stage(sums()).run(series(spark, {0: [1, 2, 3, 4]}, [1, 5, 12, 31]), ORDER)
    assert [(r.ts, r.s) for r in out.orderBy("ts").collect()] == [(12, 3), (31, 6)]


def test_spans_are_checked():
    with pytest.raises(ValueError):
        Span(rows=1, time=2)
    with pytest.raises(ValueError):
        G.rolling("min")
    assert G.rolling("sum", rows=0).span.kind == "all"


def test_time_spans_are_cut_into_slices(spark):
    """One group gives many tasks' work; spans reach over the slices' edges; the same as one pass."""
    rng = random.Random(12)
    t, rows = -400, []
    for _ in range(900):
        t += rng.choice([0, 0, 1, 2, 9])
        rows.append((1, t, float(rng.randint(0, 99)), len(rows)))
    df = spark.createDataFrame(rows, "grp int, ts int, x double, k int")
    order = Order("grp", "ts", "k")
    g = G.Graph()
    g.root("in", ["x"])
    g.add("s", G.rolling("sum", time=5), "x")
    g.add("m", G.rolling("max", time=2), "x")
    out = g.set_output("s", "m").run(df, order, ranges=12)
    assert "__block" in out._jdf.queryExecution().optimizedPlan().toString() and "__block" not in out.columns
    got = [(r.s, r.m) for r in out.orderBy("k").collect()]
    assert got == [(sum(x for _, s, x, _ in rows[: k + 1] if s > t - 5), max(x for _, s, x, _ in rows[: k + 1] if s > t - 2)) for _, t, _, k in rows]
