"""Streams give what a batch over the same rows gives."""

import pickle

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import aggs
from tidewell.operators import windows as W
from tidewell.operators.frames import Order
from tidewell.operators.scan import KERNELS, Node, scan
from tidewell.plans import graph as G
from tidewell.plans.pipeline import Pipeline
from tidewell.streaming.runner import stream_bars, stream_scan, stream_windows
from tidewell.streaming.stages import Aggregates, Trigger, Windows

ORDER = Order("g", "ts")
SCHEMA = "g int, ts timestamp, x double"


def rows(n):
    rng = np.random.default_rng(6)
    return pd.DataFrame({"g": np.arange(n) % 3, "ts": pd.date_range("2024-01-01", periods=n, freq="7min"), "x": 50 + rng.normal(size=n)}).astype({"g": "int32"})


def feed(spark, tmp_path, parts):
    for k, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_kernels_keep_their_state(spark, tmp_path):
    data = rows(60)
    nodes = [Node(KERNELS["ema"], ["x"], ["m"], {"alpha": 0.2}), Node(KERNELS["rsi"], ["x"], ["r"], {"period": 5})]
    drain(stream_scan(feed(spark, tmp_path, [data[:25], data[25:60]]), ORDER, nodes), "kernels")
    got = spark.table("kernels").toPandas().sort_values(["g", "ts"]).reset_index(drop=True)
    want = scan(spark.createDataFrame(data, SCHEMA), ORDER, nodes).toPandas().sort_values(["g", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got[["m", "r"]], want[["m", "r"]], rtol=1e-9)


def test_bars_close_with_the_watermark(spark, tmp_path):
    data = rows(60)
    drain(stream_bars(feed(spark, tmp_path, [data[:30], data[30:]]), ORDER, "1 hour", "0 seconds", {"bar": ("ohlc", ["x"]), "n": ("count", [])}), "bars")
    got = spark.table("bars").toPandas()
    hour = data.ts.dt.floor("h") + pd.Timedelta("1h")
    want = data.groupby(["g", hour]).x.agg(["first", "max", "min", "last", "count"])
    assert len(got) >= len(want) - 3
    for r in got.itertuples():
        assert (r.bar_open, r.bar_high, r.bar_low, r.bar_close, r.n) == tuple(want.loc[(r.g, r.window_ts)])


def test_graph_over_a_stream(spark, tmp_path):
    """Rolling over rows, time and all rows, columns, kernels and running functors: the same as the batch."""
    data = rows(60)
    data.loc[[7, 20, 41], "x"] = np.nan
    data["x"] = data["x"].astype(object).where(data["x"].notna(), None)
    g = G.Graph()
    g.root("in", ["x"])
    g.add("rows", G.rolling("stddev", rows=5), "x")
    g.add("hour", G.rolling("avg", time="1 hour"), "x")
    g.add("low", G.rolling("min", time="1 hour"), "x")
    g.add("all", G.rolling("var"), "x")
    g.add("lag", G.rolling("lag", rows=2), "hour")
    g.add("mean", G.lerp(0.3), "hour", "low")
    g.add("root", G.unary("sqrt"), "mean")
    g.add("smooth", G.kernel("ema", alpha=5), "root")
    g.add("twice", G.functor(lambda a, b: a * 2 + b, 2), "hour", "smooth")
    g.add("n", G.running("count"))
    g.set_output("rows.1", "hour", "low", "all.1", "lag", "smooth", "twice", "n")
    drain(g.run(feed(spark, tmp_path, [data[:25], data[25:44], data[44:]]), ORDER), "graph")
    sort = lambda df: df.toPandas().sort_values(["g", "ts"]).reset_index(drop=True)
    got, want = sort(spark.table("graph")), sort(g.run(spark.createDataFrame(data, SCHEMA), ORDER))
    assert len(got) == 60
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9)


def test_columns_between_kernels_of_a_stream_are_an_error(spark, tmp_path):
    g = G.Graph()
    g.root("in", ["x"])
    g.add("a", G.kernel("ema", alpha=5), "x")
    g.add("b", G.functor(lambda x: x * 2, 1), "a")
    g.add("c", G.kernel("ema", alpha=5), "b")
    with pytest.raises(ValueError, match="one pass"):
        g.set_output("c").run(feed(spark, tmp_path, [rows(3)]), ORDER)


@pytest.mark.parametrize("kind, size, assign", [("counter", 7, W.counter(7)), ("session", "30 minutes", W.session("30 minutes")), ("cusum", (0.03, "x"), W.cusum(0.03, "x")), ("tumbling", "1 hour", W.tumbling("1 hour"))])
def test_windows_close_on_a_stream(spark, tmp_path, kind, size, assign):
    """Every window that the batch closes, once, with the same aggregates."""
    data = rows(90)
    data["ts"] += pd.to_timedelta(np.arange(90) // 25 * 45, unit="min")
    spec = {"bar": ("ohlc", ["x"]), "n": ("count", []), "sd": ("stddev", ["x"]), "r": ("log_return", ["x"]), "w": ("vwap", ["x", "x"])}
    drain(stream_windows(feed(spark, tmp_path, [data[:31], data[31:33], data[33:]]), ORDER, (kind, size), spec), f"win_{kind}")
    a = G.AggGraph().input("x").window(assign)
    for name, cols in spec.values():
        a.add(name, cols)
    names = ["g", "window_ts", "bar_open", "bar_high", "bar_low", "bar_close", "n", "sd", "r", "w"]
    want = a.run(spark.createDataFrame(data, SCHEMA), ORDER, emit_partial=False).toPandas()
    got = spark.table(f"win_{kind}").toPandas()
    want.columns = got.columns = names
    sort = lambda df: df.sort_values(["g", "window_ts"]).reset_index(drop=True)
    got, want = sort(got), sort(want)
    assert len(got) == len(want) > 3 and (got["window_ts"] == want["window_ts"]).all()
    for c in names[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12)


def shuffled(data, size, rng):
    """The rows in parts, in another order within two parts' reach, and a last row far ahead that lets the watermark pass all."""
    order = np.argsort(np.arange(len(data)) + rng.uniform(0, size, len(data)))
    far = data.iloc[-1:].assign(g=99, ts=data.ts.max() + pd.Timedelta("30d"))
    later = far.assign(ts=far.ts + pd.Timedelta("1d"))
    return [data.iloc[order[k : k + size]] for k in range(0, len(data), size)] + [far, later]


def both(spark, name, want, keys):
    sort = lambda df: df[df.g != 99].sort_values(keys).reset_index(drop=True)
    got, want = sort(spark.table(name).toPandas()), sort(want.toPandas())
    assert len(got) == len(want) and list(got.columns) == list(want.columns)
    for c in want.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (got[c] == want[c]).all(), c


def holes(n):
    data = rows(n)
    data["x"] = data["x"].astype(object).where(np.random.default_rng(9).random(n) > 0.15, None)
    return data


def test_rows_in_any_order_within_the_watermark(spark, tmp_path):
    data = holes(80)
    g = G.Graph()
    g.root("in", ["x"])
    g.add("m", G.kernel("ema", alpha=4), "x")
    g.add("s", G.rolling("sum", time="2 hours"), "x")
    g.add("o", G.running("ohlc"), "x")
    g.set_output("m", "s", "o.0", "o.3")
    drain(g.run(feed(spark, tmp_path, shuffled(data, 15, np.random.default_rng(2))), ORDER, late="5 hours"), "late_graph")
    both(spark, "late_graph", g.run(spark.createDataFrame(data, SCHEMA), ORDER), ["g", "ts"])


@pytest.mark.parametrize("kind", ["tumbling", "session", "counter", "cusum"])
def test_windows_in_any_order_and_timers(spark, tmp_path, kind):
    """Nulls, rows out of order, and last windows that no row ends but the watermark."""
    data = holes(90)
    data["ts"] += pd.to_timedelta(np.arange(90) // 25 * 45, unit="min")
    window = {"tumbling": W.tumbling("1 hour"), "session": W.session("30 minutes"), "counter": W.counter(7), "cusum": W.cusum(0.03, "x")}[kind]
    a = G.AggGraph().input("x").window(window).add("count")
    for name in ("sum", "avg", "stddev", "ohlc", "simple_return", "log_return"):
        a.add(name, ["x"])
    a.add("vwap", ["x", "x"]).add("order_flow", ["x", "x"])
    want = a.run(spark.createDataFrame(data, SCHEMA), ORDER, emit_partial=kind in ("tumbling", "session"))
    drain(a.run(feed(spark, tmp_path, shuffled(data, 17, np.random.default_rng(4))), ORDER, late="6 hours"), f"late_{kind}")
    both(spark, f"late_{kind}", want, ["g", "window_ts"])


def test_tumbling_graphs_and_pipelines(spark, tmp_path):
    data = holes(120)
    bar = G.Graph()
    bar.root("in", ["x"])
    bar.aux("end", W.counter(4), "x")
    bar.add("last", G.running("ohlc"), "x")
    bar.add("up", G.unary("sqrt"), "last.1")
    bar.add("ema", G.kernel("ema", alpha=3), "x")
    bar.set_output("last.3", "up", "ema")
    tumble = G.TumbleGraph(bar)
    smooth = G.Graph()
    smooth.root("in", ["a", "b", "c"])
    smooth.add("m", G.rolling("avg", rows=3), "a")
    smooth.add("d", G.binary("sub"), "b", "c")
    smooth.set_output("m", "d")
    hours = G.Graph()
    hours.root("in", ["m", "d"])
    hours.aux("end", W.tumbling("3 hours"), "m")
    hours.add("sum", G.running("sum"), "d")
    hours.add("n", G.running("count"))
    hours.set_output("sum", "n")
    batch = spark.createDataFrame(data, SCHEMA)
    drain(tumble.run(feed(spark, tmp_path, [data[:50], data[50:]]), ORDER), "tumble")
    both(spark, "tumble", tumble.run(batch, ORDER), ["g", "window_ts"])
    three = Pipeline().add_stage(tumble).add_stage(smooth).add_stage(G.TumbleGraph(hours))
    drain(three.run(feed(spark, tmp_path / "b", shuffled(data, 20, np.random.default_rng(5))), ORDER, late="8 hours"), "three")
    got, want = (sorted((r.g, r.window_ts, round(r["sum"] or 0, 9), r.n) for r in df.collect() if r.g != 99) for df in (spark.table("three"), three.run(batch, ORDER)))
    assert set(want) <= set(got) and len(got) - len(want) <= 3  # the watermark ends each group's last window too


def test_whole_numbers_and_nan_are_exact(spark, tmp_path):
    big = [9007199254740993, None, 9007199254740995, 7]
    schema = "g int, ts timestamp, id long, flag boolean, x double, note string"
    rows_ = [(1, (pd.Timestamp("2024-01-01") + pd.Timedelta(k, "min")).to_pydatetime(), v, None if k == 2 else True, [1.0, float("nan"), None, 2.0][k], "n") for k, v in enumerate(big)]
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    node = [Node(KERNELS["macd"], ["x", "x"], ["m", "s", "h"], {})]
    drain(stream_scan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Order("g", "ts", "id"), node), "exact")
    got = sorted(spark.table("exact").collect(), key=lambda r: r.ts)
    assert [r.id for r in got] == big and [r.flag for r in got] == [True, True, None, True]
    assert got[0].m == 0 and np.isnan(got[1].m) and got[2].m is None and np.isnan(got[1].x) and got[2].x is None


def test_an_open_window_is_a_few_numbers():
    spec = [(["n"], aggs.by_parts("count"), []), (["sd"], aggs.by_parts("stddev"), ["x"])]
    w = Windows(Trigger("tumbling", 10**9), Aggregates(spec), ["n", "sd"])
    size = []
    for k in range(3):
        t = np.arange(100_000) + k * 100_000
        assert len(w.feed({"__tick": (t, None), "x": (t * 1.0, None)})["n"][0]) == 0
        size.append(len(pickle.dumps(w.body.states)))
    assert max(size) < 200 and w.close(10**9)["n"][0].tolist() == [300_000.0] and w.due() is None


def test_parameters_from_a_stream(spark, tmp_path):
    """Versions of an option come as a stream of their own and hold from their time on; the same as the batch."""
    data = holes(80)
    g = G.Graph()
    g.root("in", ["x"])
    g.add("m", G.kernel("ema", alpha=0.0), "x")
    g.add("r", G.rolling("sum", rows=4), "x")
    g.supp_root("given", ["alpha"])
    g.supp_link("m", alpha="alpha")
    g.set_output("m", "r")
    begin = data.ts.iloc[0]
    versions = pd.DataFrame({"g": [0, 1, 0, 2, 1], "begin": [begin, begin + pd.Timedelta("1h"), begin + pd.Timedelta("3h"), begin, begin + pd.Timedelta("4h")], "alpha": [0.5, 0.2, 0.9, 0.3, 1.0]}).astype({"g": "int32"})
    schema = "g int, begin timestamp, alpha double"
    spark.createDataFrame(versions, schema).coalesce(1).write.parquet(f"{tmp_path}/v")
    given = spark.readStream.schema(schema).parquet(f"{tmp_path}/v")
    drain(g.run(feed(spark, tmp_path, shuffled(data, 15, np.random.default_rng(7))), ORDER, parameters=given, since="begin", late="5 hours"), "versions")
    both(spark, "versions", g.run(spark.createDataFrame(data, SCHEMA), ORDER, parameters=spark.createDataFrame(versions, schema), since="begin"), ["g", "ts"])
