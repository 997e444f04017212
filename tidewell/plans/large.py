"""More registered queries: groups cut into ranges, streams, spans sized by a series, nulls in aggregators, overlapping windows,
aggregators by parts, versions of parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggs
from ..operators import windows as W
from ..operators.ranges import cut_into
from ..sources.tables import as_streams, drained, read
from . import catalog
from . import graph as G
from .catalog import _EVENT_SQL, BY_TYPE, BY_USER, Query, _sql_round, rounded

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Queries of the catalog that are also run with their groups cut into so many ranges.
RANGES = 16
CUT = (
    "scan_ema", "scan_ema_time", "scan_ema_unbiased", "scan_ewma", "scan_var_ew", "scan_cov_ew", "scan_zscore_ew", "scan_macd", "scan_rsi", "scan_atr", "scan_dm", "scan_adosc", "scan_kdj",
    "graph_macd", "graph_fan_out", "cum_stddev", "cum_corr", "run_ohlc", "run_log_return", "roll_min_100", "roll_sum_rows", "roll_corr_rows", "roll_zscore_rows", "roll_lag_oldest_rows", "roll_lag_nan_rows",
    "roll_sum_time", "roll_max_time", "roll_std_vw_time", "agg_ohlc_counter", "agg_sum_session", "win_cusum_filter", "tumble_counter_ohlc", "tumble_session_ohlc", "tumble_cusum_ohlc", "tumble_cusum_sum", "tumble_nested",
)
#: Queries of the catalog that are also run over streams of the tables' files.
STREAMS = ("scan_ema", "scan_rsi", "graph_macd", "graph_fan_out", "cum_var", "run_ohlc", "roll_avg_time", "tumble_session_ohlc", "tumble_counter_sum", "tumble_cusum_ohlc", "tumble_time_log_return", "pipeline_sums", "pipeline_log_bars")
KEYS = ["event_type", "event_id"]


def _add(name: str, query: Query, sql: str) -> None:
    _queries[name], _oracles[name] = query, sql


def _cuts() -> None:
    for name in CUT:

        def query(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            with cut_into(RANGES):
                return catalog._queries[name](spark, d)

        _add(f"{name}_ranges", query, catalog._oracles[name])


def _streams() -> None:
    for name in STREAMS:

        def query(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            with as_streams():
                return drained(catalog._queries[name](spark, d))

        _add(f"stream_{name}", query, catalog._oracles[name])


def _sized() -> None:
    def by_rows(spark: SparkSession, d: str) -> DataFrame:
        df = read(spark, d, "events").select(*BY_TYPE.columns, F.col("value").cast("double").alias("x"), (1 + F.col("event_id") % 23).cast("double").alias("size"))
        g = G.Graph()
        g.root("in", ["x", "size"])
        g.add("sum", G.sized("sum", "rows"), "x", "size")
        g.add("dev", G.sized("stddev", "rows"), "x", "size")
        out = g.set_output("sum", "dev.0", "dev.1").run(df, BY_TYPE).toDF(*BY_TYPE.columns, "sum", "mean", "std")
        return rounded(out.drop("ts"), KEYS)

    w = "PARTITION BY event_type ORDER BY ts, event_id"
    begin = f"max(rn - event_id % 23) OVER ({w}) AS begin"
    frame = f"OVER ({w} ROWS BETWEEN (rn - begin) PRECEDING AND CURRENT ROW)"
    rows = f"SELECT *, {begin} FROM (SELECT *, row_number() OVER ({w}) AS rn FROM ({_EVENT_SQL}))"
    _add("roll_sum_dyn_rows", by_rows, f"SELECT event_type, event_id, {_sql_round({'sum': f'sum(x) {frame}', 'mean': f'avg(x) {frame}', 'std': f'coalesce(stddev_samp(x) {frame}, 0)'})} FROM ({rows})")

    def by_time(spark: SparkSession, d: str) -> DataFrame:
        df = read(spark, d, "events").select(*BY_TYPE.columns, F.col("value").cast("double").alias("x"), ((1 + F.col("event_id") % 47) * F.lit(3.6e9)).alias("size"))
        g = G.Graph()
        g.root("in", ["x", "size"])
        g.add("low", G.sized("min", "time"), "x", "size")
        g.add("high", G.sized("max", "time"), "x", "size")
        return rounded(g.set_output("low", "high").run(df, BY_TYPE).drop("ts"), KEYS)

    gone = "count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND (to_hours(CAST(1 + event_id % 47 AS INTEGER))) PRECEDING) AS gone"
    times = f"SELECT *, max(gone) OVER ({w}) + 1 AS begin FROM (SELECT *, row_number() OVER ({w}) AS rn, {gone} FROM ({_EVENT_SQL}))"
    _add("roll_min_dyn_time", by_time, f"SELECT event_type, event_id, {_sql_round({'low': f'min(x) {frame}', 'high': f'max(x) {frame}'})} FROM ({times})")


def _nulls() -> None:
    def holes(spark: SparkSession, d: str) -> DataFrame:
        e = read(spark, d, "events")
        x, y = F.col("value").cast("double"), (F.col("event_id") % 7 + 1).cast("double")
        return e.select(*BY_TYPE.columns, F.when(F.col("event_id") % 4 != 1, x).alias("x"), F.when(F.col("event_id") % 5 != 2, y).alias("y"))

    sql = "SELECT event_type, ts, event_id, CASE WHEN event_id % 4 <> 1 THEN CAST(value AS DOUBLE) END AS x, CASE WHEN event_id % 5 <> 2 THEN CAST(event_id % 7 + 1 AS DOUBLE) END AS y FROM events"
    both = f"SELECT *, CASE WHEN y IS NOT NULL THEN x END AS px, CASE WHEN x IS NOT NULL THEN y END AS py FROM ({sql})"
    ends = {k: f"arg_{f}(x, (ts, event_id)) FILTER (WHERE x IS NOT NULL)" for k, f in (("first", "min"), ("last", "max"))}

    def aggregates(spark: SparkSession, d: str) -> DataFrame:
        a = G.AggGraph().input("x", "y").window(W.tumbling("6 hours"))
        for name in ("sum", "avg", "stddev", "ohlc", "simple_return", "log_return"):
            a.add(name, ["x"])
        for name in ("vwap", "avg_weighted", "order_flow", "book_imba"):
            a.add(name, ["x", "y"])
        return rounded(a.add("count").run(holes(spark, d), BY_TYPE), ["event_type", "window_ts"])

    pair = "sum(px * py) / sum(py)"
    outs = {
        "sum_x": "sum(x)", "avg_x": "avg(x)", "stddev_x": "CASE WHEN count(x) > 0 THEN coalesce(stddev_samp(x), 0) END", "open": ends["first"], "high": "max(x)", "low": "min(x)", "close": ends["last"],
        "simple_return": f"{ends['last']} / {ends['first']} - 1", "log_return": f"ln({ends['last']} / {ends['first']})", "vwap": pair, "avg_weighted": pair,
        "order_flow": "sum(px) - sum(py)", "book_imba": "(sum(px) - sum(py)) / (sum(px) + sum(py))", "count": "count(*)",
    }
    _add("agg_nulls", aggregates, f"SELECT event_type, window_ts, {_sql_round(outs)} FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_ts FROM ({both})) GROUP BY event_type, window_ts")

    def running(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["x", "y"])
        names = []
        for name in ("sum", "avg", "ohlc", "simple_return", "log_return", "avg_weighted", "order_flow", "book_imba"):
            op = G.running(name)
            g.add(name, op, *["x", "y"][: op.inputs])
            g.add_output(*(f"{name}.{k}" for k in range(len(op.outputs))))
            names += op.outputs
        g.add("mean", G.rolling("avg_weighted", rows=30), "x", "y")
        out = g.add_output("mean").run(holes(spark, d), BY_TYPE).toDF(*BY_TYPE.columns, *names, "mean30")
        return rounded(out.drop("ts"), KEYS)

    first, last = "first_value(x IGNORE NULLS) OVER w", "last_value(x IGNORE NULLS) OVER w"
    rows = {
        "sum": "sum(x) OVER w", "avg": "avg(x) OVER w", "open": first, "high": "max(x) OVER w", "low": "min(x) OVER w", "close": last, "simple_return": f"{last} / {first} - 1", "log_return": f"ln({last}) - ln({first})",
        "avg_weighted": "sum(px * py) OVER w / sum(py) OVER w", "order_flow": "sum(px) OVER w - sum(py) OVER w", "book_imba": "(sum(px) OVER w - sum(py) OVER w) / (sum(px) OVER w + sum(py) OVER w)",
        "mean30": "sum(px * py) OVER v / sum(py) OVER v",
    }
    win = "PARTITION BY event_type ORDER BY ts, event_id ROWS"
    _add("run_nulls", running, f"SELECT event_type, event_id, {_sql_round(rows)} FROM ({both}) WINDOW w AS ({win} UNBOUNDED PRECEDING), v AS ({win} 29 PRECEDING)")


class Alternating:
    """Of four rows that wait, by turns the first three, of which two leave, and the last three, and all leave."""

    def __init__(self) -> None:
        self.waiting, self.odd = 0, False

    def on_row(self, t: float) -> tuple[int, int, int] | None:
        self.waiting += 1
        if self.waiting < 4:
            return None
        self.odd = not self.odd
        self.waiting = 2 if self.odd else 0
        return (0, 3, 2) if self.odd else (1, 3, 4)


class Sliding:
    """The last `size` rows at every row."""

    def __init__(self, size: int):
        self.size, self.waiting = size, 0

    def on_row(self, t: float) -> tuple[int, int, int] | None:
        self.waiting += 1
        if self.waiting < self.size:
            return None
        self.waiting -= 1
        return 0, self.size, 1


class Skewness(aggs.Mergeable):
    """Skewness of a column from its number, mean and sums of squared and cubed deviations."""

    outputs = ("skewness",)

    def lift(self, x):
        d = x - x.mean()
        return len(x), x.mean(), (d**2).sum(), (d**3).sum()

    def merge(self, a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        cubed = a[3] + b[3] + d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, cubed

    def finish(self, s):
        return ((s[3] / s[0]) / (s[2] / s[0]) ** 1.5 if s[2] > 0 else 0.0,)


def _overlaps() -> None:
    w = "PARTITION BY event_type ORDER BY ts, event_id"
    numbered = f"SELECT *, row_number() OVER ({w}) - 1 AS rn FROM ({_EVENT_SQL})"

    def emitter(spark: SparkSession, d: str) -> DataFrame:
        a = G.AggGraph().input("value").window(W.emitter(Alternating)).add("ohlc", ["value"]).add("sum", ["value"]).add("count")
        return rounded(a.run(read(spark, d, "events"), BY_TYPE), ["event_type", "window_ts"])

    outs = {"open": "arg_min(x, rn)", "high": "max(x)", "low": "min(x)", "close": "arg_max(x, rn)", "sum_value": "sum(x)", "count": "count(*)"}
    ended = f"SELECT event_type, rn, ts FROM ({numbered})"
    _add("win_emitter", emitter, f"SELECT n.event_type, any_value(e.ts) AS window_ts, {_sql_round(outs).replace('rn)', 'n.rn)')} FROM ({numbered}) n JOIN ({ended}) e ON e.event_type = n.event_type AND e.rn = n.rn // 3 * 3 + CASE WHEN n.rn // 3 % 2 = 0 THEN 3 ELSE 2 END GROUP BY n.event_type, n.rn // 3")

    def sliding(spark: SparkSession, d: str) -> DataFrame:
        a = G.AggGraph().input("value").window(W.emitter(lambda: Sliding(24))).add("avg", ["value"]).add("stddev", ["value"]).add("log_return", ["value"])
        return rounded(a.run(read(spark, d, "events"), BY_TYPE), ["event_type", "window_ts"])

    f = f"OVER ({w} ROWS 23 PRECEDING)"
    rows = {"avg_value": f"avg(x) {f}", "stddev_value": f"stddev_samp(x) {f}", "log_return": f"ln(last_value(x) {f} / first_value(x) {f})"}
    _add("win_emitter_sliding", sliding, f"SELECT event_type, ts AS window_ts, {_sql_round(rows)} FROM ({numbered}) QUALIFY rn >= 23")

    def panes(spark: SparkSession, d: str) -> DataFrame:
        a = G.AggGraph().input("value").window(W.hopping("24 hours", "1 hour")).add("ohlc", ["value"]).add("stddev", ["value"]).add("count")
        return rounded(a.run(read(spark, d, "events"), BY_TYPE), ["event_type", "window_ts"])

    hours = f"SELECT *, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS window_ts FROM ({numbered})"
    outs = {"open": "arg_min(x, rn)", "high": "max(x)", "low": "min(x)", "close": "arg_max(x, rn)", "stddev_value": "coalesce(stddev_samp(x), 0)", "count": "count(*)"}
    _add("win_hopping_panes", panes, f"SELECT event_type, window_ts, {_sql_round(outs)} FROM ({hours}) GROUP BY event_type, window_ts")

    def by_parts(spark: SparkSession, d: str) -> DataFrame:
        a = G.AggGraph().input("value").window(W.tumbling("1 day")).add(Skewness(), ["value"]).add("count")
        return rounded(a.run(read(spark, d, "events"), BY_TYPE), ["event_type", "window_ts"])

    m = lambda k: f"avg(power(x - mean, {k}))"
    days = f"SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS window_ts, avg(x) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS mean FROM ({_EVENT_SQL})"
    _add("udf_mergeable", by_parts, f"SELECT event_type, window_ts, {_sql_round({'skewness': f'CASE WHEN {m(2)} > 0 THEN {m(3)} / power({m(2)}, 1.5) ELSE 0 END', 'count': 'count(*)'})} FROM ({days}) GROUP BY event_type, window_ts")


def _versions() -> None:
    def versions(spark: SparkSession, d: str) -> DataFrame:
        e = read(spark, d, "events").select(*BY_USER.columns, F.col("value").cast("double").alias("x"))
        week = F.date_trunc("week", "ts")
        v = e.groupBy("user_id", week.cast("timestamp_ntz").alias("begin")).agg((0.05 + F.min("event_id") % 7 * 0.1).cast("double").alias("alpha"), (2 + F.min("event_id") % 5).alias("rows"))
        v = v.filter("rows <> 4")  # some weeks have the version before them, and some rows none yet
        g = G.Graph()
        g.root("in", ["x"])
        g.add("m", G.kernel("ema", alpha=0.0), "x")
        g.supp_root("given", ["alpha"])
        g.supp_link("m", alpha="alpha")
        out = g.set_output("m").run(e, BY_USER, parameters=v.drop("rows"), since="begin").toDF(*BY_USER.columns, "ema")
        return rounded(out.drop("ts"), ["user_id", "event_id"])

    source = "SELECT user_id, ts, event_id, CAST(value AS DOUBLE) AS x FROM events"
    v = "SELECT user_id, date_trunc('week', ts) AS begin, CAST(0.05 AS DOUBLE) + min(event_id) % 7 * CAST(0.1 AS DOUBLE) AS alpha FROM events GROUP BY 1, 2 HAVING 2 + min(event_id) % 5 <> 4"
    held = f"SELECT s.*, v.alpha FROM ({source}) s ASOF LEFT JOIN ({v}) v ON s.user_id = v.user_id AND s.ts >= v.begin"
    sql = f"""WITH RECURSIVE h AS MATERIALIZED ({held}),
      s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM h WHERE alpha IS NOT NULL),
      e AS (SELECT user_id, rn, x AS m FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, e.m + s.alpha * (s.x - e.m) FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1)
      SELECT s.user_id, s.event_id, {_sql_round({"ema": "e.m"})} FROM s JOIN e USING (user_id, rn) UNION ALL SELECT user_id, event_id, NULL FROM h WHERE alpha IS NULL"""
    _add("graph_parameter_versions", versions, sql)


_cuts()
_streams()
_sized()
_nulls()
_overlaps()
_versions()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
