"""Sequential kernels: any cut of the rows into batches gives what one row at a time gives, and known recurrences."""

import numpy as np
import pandas as pd
import pytest

from tidewell.operators.frames import Order
from tidewell.operators.scan import KERNELS, Functor, Node, advance, scan, start
from tidewell.operators.spans import STATISTICS, SpanStatistic, Windowed

OPTIONS = {
    "ema": {"alpha": 0.2}, "ema_unbiased": {"alpha": 0.2}, "ewma": {"alpha": 0.2}, "ema_time": {"tau": 3.0}, "var_ew": {"alpha": 0.2}, "std_ew": {"alpha": 9},
    "cov_ew": {"alpha": 0.2}, "zscore_ew": {"alpha": 0.2}, "zband": {"alpha": 0.2, "threshold": 1.5, "influence": 0.3}, "macd": {}, "rsi": {}, "atr": {}, "dm": {},
    "adosc": {}, "kdj": {}, "dynwin_avg": {"rows": 3, "threshold": 2.0}, "cusum": {"threshold": 0.8},
}


def columns(n, rng):
    base = 50 + np.cumsum(rng.normal(size=n))
    high, low = base + rng.uniform(0, 2, n), base - rng.uniform(0, 2, n)
    return {1: [base], 2: [high, np.cumsum(rng.uniform(0, 2, n))], 3: [high, low, base], 4: [high, low, base, rng.uniform(1, 9, n)]}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_cuts_do_not_matter(name):
    rng = np.random.default_rng(1)
    make = KERNELS[name]
    cols = columns(200, rng)[make.inputs]
    one = make(**OPTIONS[name])
    rows = [one.step(*(c[i : i + 1] for c in cols)) for i in range(200)]
    single = [np.concatenate([r[k] for r in rows]) for k in range(len(make.outputs))]
    many, parts, at = make(**OPTIONS[name]), [], 0
    for size in (1, 7, 8, 30, 154):
        parts.append(many.step(*(c[at : at + size] for c in cols)))
        at += size
    for k in range(len(make.outputs)):
        np.testing.assert_allclose(np.concatenate([p[k] for p in parts]), single[k], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(KERNELS))
@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_cuts_do_not_matter_with_odd_values(name, odd):
    """Nulls are skipped in the same way, and a NaN or an infinity spreads in the same way, for any cut of the rows."""
    rng = np.random.default_rng(5)
    make = KERNELS[name]
    cols = [c.copy() for c in columns(120, rng)[make.inputs]]
    cols[0][70] = odd
    ok = rng.random(120) > 0.15
    names = [f"c{k}" for k in range(len(cols))]
    outs = [f"y{k}" for k in range(len(make.outputs))]
    node = [Node(make, names, outs, OPTIONS[name])]

    def run(sizes):
        kernels, at, parts = None, 0, []
        for size in sizes:
            data = {n: (c[at : at + size], ok[at : at + size] if k == 0 else None) for k, (n, c) in enumerate(zip(names, cols))}
            kernels = kernels or start(node, data)
            advance(node, kernels, data, len(ok[at : at + size]))
            parts.append([np.where(np.ones(len(y), dtype=bool) if fine is None else fine, y, -12345.0) for y, fine in (data[o] for o in outs)])
            at += size
        return [np.concatenate([p[k] for p in parts]) for k in range(len(outs))]

    with np.errstate(all="ignore"):
        single = run([1] * 120)
        for sizes in ((1, 7, 8, 30, 74), (120,), (60, 11, 49)):
            for a, b in zip(run(sizes), single):
                np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert all((y[~ok] == -12345.0).all() and (y[ok] != -12345.0).all() for y in single)


STATS = {
    "sum": lambda x: (x.sum(),), "avg": lambda x: (x.mean(),), "moment2": lambda x: (x.mean(), ((x - x.mean()) ** 2).sum()), "var": lambda x: (x.mean(), x.var(ddof=1) if len(x) > 1 else 0.0),
    "stddev": lambda x: (x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0), "min": lambda x: (np.fmin.reduce(x),), "max": lambda x: (x.max(),),
    "cov": lambda x, y: (x.mean(), y.mean(), np.cov(x, y)[0, 1] if len(x) > 1 else 0.0), "avg_weighted": lambda x, w: ((x * w).sum() / w.sum(),),
    "var_vw": lambda x, w: ((m := (x * w).sum() / w.sum()), (w * (x - m) ** 2).sum() / (w.sum() - (w**2).sum() / w.sum()) if len(x) > 1 else 0.0),
}


@pytest.mark.parametrize("name", sorted(STATS))
@pytest.mark.parametrize("extent", [{"time": 5.0}, {"rows": 7}, {}])
def test_spans_by_definition(name, extent):
    """Ties of time, nulls, infinities, NaN and values of other magnitudes; any cut of the rows."""
    rng = np.random.default_rng(8)
    n = 90
    t = np.cumsum(rng.integers(0, 3, n)).astype(float)
    x = [rng.normal(size=n), rng.uniform(1, 3, n)][: STATISTICS[name][0]]
    x[0][[20, 40, 41]] = [1e17, np.nan if extent else 5.0, np.inf if extent else 7.0]
    ok = rng.random(n) > 0.2
    ok[:3] = [False, True, True]
    ok[20] = ok[40] = ok[41] = True
    parts, at, k = [], 0, SpanStatistic(name, **extent)
    for size in (1, 2, 30, 8, 49):
        parts.append(k.step(*(c[at : at + size] for c in x), t[at : at + size], valid=ok[at : at + size]))
        at += size
    with np.errstate(all="ignore"):
        for i in range(n):
            first = 0 if not extent else max(0, i - 6) if "rows" in extent else int(np.searchsorted(t, t[i] - 5.0, side="right"))
            rows = np.arange(first, i + 1)[ok[first : i + 1]]
            got = [np.ma.concatenate([p[j] for p in parts])[i] for j in range(len(k.outputs))]
            if not len(rows):
                assert all(g is np.ma.masked for g in got)
                continue
            if not np.isfinite(x[0][rows]).all() and name not in ("sum", "avg", "min", "max"):
                continue  # NaN in some order of the sums, an infinity in another
            np.testing.assert_allclose(np.array(got, dtype=float), np.array(STATS[name](*(c[rows] for c in x)), dtype=float), rtol=1e-9, atol=1e-9 if np.abs(x[0][rows]).max() < 1e9 else 50)


def test_what_has_left_a_time_span_leaves_no_trace():
    step = lambda name, x, t: [y.tolist() for y in SpanStatistic(name, time=5.0).step(np.array(x), np.array(t), valid=np.ones(len(x), dtype=bool))]
    assert step("sum", [1.0, np.inf, 2.0, 3.0], [1.0, 2.0, 50.0, 51.0]) == [[1, np.inf, 2, 5]]
    assert step("avg", [1e17, 2.0, 3.0], [1.0, 50.0, 51.0]) == [[1e17, 2, 2.5]]
    k = SpanStatistic("avg", time=100.0)
    assert k.step(np.array([10.0, np.nan, 20.0]), np.arange(3.0), valid=np.array([True, False, True]))[0].tolist() == [10, 10, 15]


def test_users_operator_with_eviction_and_a_span_that_grows():
    class Distinct:
        """Different values in the span, which doubles when they are few."""

        def __init__(self):
            self.n, self.rows = {}, 2

        def add(self, x):
            self.n[x] = self.n.get(x, 0) + 1

        def evict(self, x):
            self.n[x] -= 1
            if not self.n[x]:
                del self.n[x]

        def value(self):
            return len(self.n)

        def size(self):
            if len(self.n) == 1:
                self.rows = 4
            return self.rows

    t = np.arange(8.0)
    x = np.array([3.0, 4, 5, 6, 6, 7, 8, 9])
    fixed = type("Fixed", (Distinct,), {"size": None})
    assert Windowed(fixed, 1, rows=3).step(x, t)[0].tolist() == [1, 2, 3, 3, 2, 2, 3, 3]
    assert Windowed(fixed, 1, time=2.0).step(x, t)[0].tolist() == [1, 2, 2, 2, 1, 2, 2, 2]
    assert Windowed(Distinct, 1, rows=2).step(x, t)[0].tolist() == [1, 2, 3, 4, 3, 3, 3, 4]


def test_options_that_change_in_mid_run():
    x, t = np.arange(1.0, 9.0), np.arange(8.0)
    data = {"x": (x, None), "t": (t, None), "n": (np.array([2.0] * 4 + [3.0] * 4), None), "a": (np.array([0.5] * 4 + [1.0] * 4), None)}
    nodes = [Node(SpanStatistic, ["x", "t"], ["s"], {"name": "sum", "rows": "n"}, live=True), Node(KERNELS["ema"], ["x"], ["m"], {"alpha": "a"}, live=True)]
    advance(nodes, start(nodes, data), data, 8)
    assert data["s"][0].tolist() == [1, 3, 5, 7, 12, 15, 18, 21]  # the fifth row still has the two rows of the smaller span before it
    assert data["m"][0].tolist() == [1, 1.5, 2.25, 3.125, 5, 6, 7, 8]


def test_against_pandas():
    x = np.random.default_rng(2).normal(size=300)
    s = pd.Series(x)
    np.testing.assert_allclose(KERNELS["ema"](0.1).step(x)[0], s.ewm(alpha=0.1, adjust=False).mean())
    np.testing.assert_allclose(KERNELS["ema_unbiased"](0.1).step(x)[0], s.ewm(alpha=0.1, adjust=True).mean())
    np.testing.assert_allclose(KERNELS["var_ew"](0.1).step(x)[1], s.ewm(alpha=0.1, adjust=False).var(bias=True), atol=1e-12)
    y = np.random.default_rng(3).normal(size=300)
    np.testing.assert_allclose(KERNELS["cov_ew"](0.1).step(x, y)[2], s.ewm(alpha=0.1, adjust=False).cov(pd.Series(y), bias=True), atol=1e-12)


def test_start_values():
    assert KERNELS["rsi"]().step(np.array([5.0, 5.0]))[0].tolist() == [100, 100]
    assert KERNELS["zband"](0.1, 2, 0.5).step(np.array([1.0]))[1][0] == np.finfo(float).max
    assert KERNELS["dm"]().step(np.array([2.0]), np.array([1.0]))[0][0] == 0
    assert KERNELS["atr"](14).step(np.array([3.0]), np.array([1.0]), np.array([2.0]))[0][0] == pytest.approx(2 * 2 / 15)
    assert KERNELS["kdj"]().step(np.ones(3), np.ones(3), np.ones(3))[0].tolist() == [50, 50, 50]


def test_rolling_mean_with_fixed_window():
    got = KERNELS["dynwin_avg"](3, 1e9).step(np.arange(1.0, 7.0))[0]
    np.testing.assert_allclose(got, [1, 1.5, 2, 3, 4, 5])


def test_scan_over_groups_and_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(4)
        rows = [(g, i, float(rng.normal())) for g in range(3) for i in range(40)] + [(None, 0, 1.0), (5, 0, None)]
        df = spark.createDataFrame(rows, "g int, t int, x double")
        out = scan(df, Order("g", "t"), [Node(KERNELS["ema"], ["x"], ["m"], {"alpha": 0.3}), Node(lambda: Functor(lambda: lambda v: v * 2, 1), ["m"], ["twice"])]).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(out) == 122
    for g, part in out[out.g.isin([0, 1, 2])].groupby("g"):
        part = part.sort_values("t")
        np.testing.assert_allclose(part.m, part.x.ewm(alpha=0.3, adjust=False).mean())
        np.testing.assert_allclose(part.twice, part.m * 2)
    assert scan(df.limit(0), Order("g", "t"), [Node(KERNELS["ema"], ["x"], ["m"], {"alpha": 0.3})]).count() == 0
