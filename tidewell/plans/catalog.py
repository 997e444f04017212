"""Registered queries of the library on the standard tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.timeunits import Duration, floor_time, from_epoch, posix, since_epoch
from ..operators import aggs
from ..operators import windows as W
from ..operators.frames import Order
from ..operators.scan import KERNELS, Node, scan
from ..sources.tables import hourly_bars, read
from . import graph as G
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

BY_TYPE = Order("event_type", "ts", "event_id")
BY_USER = Order("user_id", "ts", "event_id")
BY_FLAG = Order("l_returnflag", "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"))
LINE_KEYS = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"]
#: Added before rounding, so that sums and means of prices never lie on the edge between two rounded values.
SHIFT = 0.00000031415926
BARS = Order("event_type", "bar_ts")
DAY = Duration(1, "d")


def _add(name: str, query: Query, sql: str | None) -> None:
    _queries[name] = query
    if sql:
        _oracles[name] = sql


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; a negative zero becomes zero."""
    return df.select(*keys, *((F.round(F.col(c) + SHIFT, digits) + F.lit(0.0)).alias(c) for c, t in df.dtypes if c not in keys and t == "double"), *(c for c, t in df.dtypes if c not in keys and t != "double"))


def _sql_round(exprs: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE) + CAST({SHIFT!r} AS DOUBLE), {digits}) + 0.0 AS {n}" for n, e in exprs.items())


# scalar functions

_UNARY_SQL: dict[str, tuple[str, str]] = {
    # name: (column expression over the input x, input expression); inputs keep each function within its domain or test its edge
    "neg": ("-x", "c_acctbal"),
    "inv": ("CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1.0 / x END", "c_acctbal"),
    "abs": ("abs(x)", "c_acctbal"),
    "exp": ("exp(x)", "c_acctbal / 1000.0"),
    "expm1": ("exp(x) - 1", "c_acctbal / 1000.0"),
    "log": ("CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "c_acctbal"),
    "log10": ("CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "c_acctbal"),
    "log2": ("CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "c_acctbal"),
    "log1p": ("CASE WHEN x > -1 THEN ln(1 + x) WHEN x = -1 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "c_acctbal / 1000.0"),
    "sqrt": ("CASE WHEN x >= 0 THEN sqrt(x) ELSE 'nan'::DOUBLE END", "c_acctbal"),
    "cbrt": ("cbrt(x)", "c_acctbal"),
    "sin": ("sin(x)", "c_acctbal / 1000.0"),
    "cos": ("cos(x)", "c_acctbal / 1000.0"),
    "tan": ("tan(x)", "c_acctbal / 10000.0"),
    "asin": ("asin(x)", "c_acctbal / 10000.0"),
    "acos": ("acos(x)", "c_acctbal / 10000.0"),
    "atan": ("atan(x)", "c_acctbal"),
    "sinh": ("sinh(x)", "c_acctbal / 1000.0"),
    "cosh": ("cosh(x)", "c_acctbal / 1000.0"),
    "tanh": ("tanh(x)", "c_acctbal / 1000.0"),
    "asinh": ("asinh(x)", "c_acctbal / 1000.0"),
    "acosh": ("acosh(x)", "2.0 + abs(c_acctbal) / 1000.0"),
    "atanh": ("atanh(x)", "c_acctbal / 20000.0"),
    "erf": ("", "c_acctbal / 5000.0"),
    "erfc": ("", "c_acctbal / 5000.0"),
    "tgamma": ("gamma(x)", "1.0 + abs(c_acctbal) / 2000.0"),
    "lgamma": ("lgamma(x)", "1.0 + abs(c_acctbal) / 100.0"),
    "ceil": ("ceil(x)", "c_acctbal"),
    "floor": ("floor(x)", "c_acctbal"),
    "trunc": ("trunc(x)", "c_acctbal"),
    "round": ("CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END", "c_acctbal"),
}


def _erf_sql(sign: str) -> str:
    """erf by its series, whose terms are summed until they vanish; enough for |x| below 2.1."""
    return f"""WITH RECURSIVE t AS (
        SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 5000.0 AS x, CAST(c_acctbal AS DOUBLE) / 5000.0 AS term, CAST(c_acctbal AS DOUBLE) / 5000.0 AS s, 0 AS n FROM customer
        UNION ALL SELECT c_custkey, x, term * -(x * x) / (n + 1), s + term * -(x * x) / (n + 1) / (2 * n + 3), n + 1 FROM t WHERE n < 60)
        SELECT c_custkey, round({sign}(2 / sqrt(pi()) * s) + CAST({SHIFT!r} AS DOUBLE), 6) + 0.0 AS y FROM t WHERE n = 60"""


def _scalar() -> None:
    for name, (sql, source) in _UNARY_SQL.items():

        def unary(spark: SparkSession, d: str, name: str = name, source: str = source) -> DataFrame:
            df = read(spark, d, "customer").select("c_custkey", F.expr(source).cast("double").alias("x"))
            return rounded(df.select("c_custkey", S.UNARY[name](F.col("x")).alias("y")), ["c_custkey"])

        oracle = f"SELECT c_custkey, {_sql_round({'y': sql})} FROM (SELECT c_custkey, CAST({source} AS DOUBLE) AS x FROM customer)"
        _add(f"fn_{name}", unary, _erf_sql("") if name == "erf" else _erf_sql("1 - ") if name == "erfc" else oracle)
    binary = {"add": "a + b", "sub": "a - b", "mul": "a * b", "div": "CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'nan'::DOUBLE ELSE sign(a) * 'inf'::DOUBLE END ELSE a / b END", "fmod": "CASE WHEN b = 0 THEN 'nan'::DOUBLE ELSE a % b END"}
    pair = "SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer"
    for name, sql in binary.items():

        def two(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            df = read(spark, d, "customer")
            return rounded(df.select("c_custkey", S.BINARY[name](F.col("c_acctbal"), F.col("c_nationkey")).alias("y")), ["c_custkey"])

        _add(f"fn_{name}", two, f"SELECT c_custkey, {_sql_round({'y': sql})} FROM ({pair})")
    one = lambda f: lambda spark, d: rounded(read(spark, d, "customer").select("c_custkey", f().alias("y")), ["c_custkey"])
    _add("fn_clamp", one(lambda: S.clamp(F.col("c_acctbal"), 0.0, 5000.0)), f"SELECT c_custkey, {_sql_round({'y': 'least(greatest(c_acctbal, 0.0), 5000.0)'})} FROM customer")
    _add("fn_lerp", one(lambda: S.lerp(F.col("c_acctbal"), F.col("c_nationkey"), 0.25)), f"SELECT c_custkey, {_sql_round({'y': 'a + 0.25 * (b - a)'})} FROM ({pair})")


# rolling operators

def _line(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(*BY_FLAG.columns, F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000.0).cast("double").alias("y"))


_ROLL_SQL: dict[str, tuple[int, dict[str, str]]] = {
    "sum": (1, {"sum": "sum(x) OVER w"}),
    "avg": (1, {"mean": "avg(x) OVER w"}),
    "avg_weighted": (2, {"mean": "sum(x * y) OVER w / sum(y) OVER w"}),
    "moment2": (1, {"mean": "avg(x) OVER w", "m2": "var_pop(x) OVER w * count(x) OVER w"}),
    "var": (1, {"mean": "avg(x) OVER w", "var": "coalesce(var_samp(x) OVER w, 0)"}),
    "stddev": (1, {"mean": "avg(x) OVER w", "std": "coalesce(stddev_samp(x) OVER w, 0)"}),
    "var_vw": (2, {"mean": "sum(x * y) OVER w / sum(y) OVER w", "var": "CASE WHEN count(x) OVER w = 1 THEN 0 ELSE (sum(y * x * x) OVER w - (sum(x * y) OVER w) * (sum(x * y) OVER w) / sum(y) OVER w) / (sum(y) OVER w - sum(y * y) OVER w / sum(y) OVER w) END"}),
    "std_vw": (2, {"mean": "sum(x * y) OVER w / sum(y) OVER w", "std": "CASE WHEN count(x) OVER w = 1 THEN 0 ELSE sqrt(greatest(0, (sum(y * x * x) OVER w - (sum(x * y) OVER w) * (sum(x * y) OVER w) / sum(y) OVER w) / (sum(y) OVER w - sum(y * y) OVER w / sum(y) OVER w))) END"}),
    "cov": (2, {"mean_x": "avg(x) OVER w", "mean_y": "avg(y) OVER w", "cov": "coalesce(covar_samp(x, y) OVER w, 0)"}),
    "corr": (2, {"mean_x": "avg(x) OVER w", "mean_y": "avg(y) OVER w", "cov": "coalesce(covar_samp(x, y) OVER w, 0)", "corr": "CASE WHEN coalesce(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) > 1e-9 THEN covar_samp(x, y) OVER w / (stddev_samp(x) OVER w * stddev_samp(y) OVER w) ELSE 0 END"}),
    "beta": (2, {"mean_x": "avg(x) OVER w", "mean_y": "avg(y) OVER w", "cov": "coalesce(covar_samp(x, y) OVER w, 0)", "beta": "CASE WHEN coalesce(var_samp(x) OVER w, 0) > 1e-9 THEN covar_samp(x, y) OVER w / var_samp(x) OVER w ELSE 0 END"}),
    "zscore": (1, {"mean": "avg(x) OVER w", "z": "CASE WHEN coalesce(stddev_samp(x) OVER w, 0) > 1e-9 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END"}),
    "min": (1, {"min": "min(x) OVER w"}),
    "max": (1, {"max": "max(x) OVER w"}),
}
_LINE_SQL = "SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice / 1000.0 AS DOUBLE) AS y FROM lineitem"
_EVENT_SQL = "SELECT event_type, user_id, ts, event_id, CAST(value AS DOUBLE) AS x FROM events"


def _rolling() -> None:
    frames = {"rows": ({"rows": 20}, "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"), "time": ({"time": DAY}, "RANGE BETWEEN INTERVAL 1 DAY - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW"), "cum": ({}, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")}
    for op, (n, outs) in _ROLL_SQL.items():
        for kind, (span, frame) in frames.items():
            if op in ("min", "max") and kind == "cum":
                continue
            two = n == 2

            def roll(spark: SparkSession, d: str, op: str = op, two: bool = two, span: dict = span, outs: dict = outs, kind: str = kind) -> DataFrame:
                # two series over ties need the rows' own order; a time span runs on events, whose times are distinct
                order = BY_FLAG if two and kind != "time" else BY_TYPE
                if order is BY_FLAG:
                    df = _line(spark, d)
                else:
                    df = read(spark, d, "events").select(*BY_TYPE.columns, F.col("value").cast("double").alias("x"), (F.col("event_id") % 7 + 1).cast("double").alias("y"))
                g = G.Graph()
                g.root("in", ["x", "y"])
                g.add("op", G.rolling(op, **span), *(["x", "y"] if two else ["x"]))
                g.set_output(*(f"op.{k}" for k in range(len(outs))))
                out = g.run(df, order)
                out = out.toDF(*order.columns, *outs)
                keys = LINE_KEYS if order is BY_FLAG else ["event_type", "event_id"]
                return rounded(out.select(*keys, *outs), keys, 4)

            line = two and kind != "time"
            source = _LINE_SQL if line else "SELECT event_type, ts, event_id, CAST(value AS DOUBLE) AS x, CAST(event_id % 7 + 1 AS DOUBLE) AS y FROM events"
            by = "PARTITION BY l_returnflag ORDER BY " + ", ".join(BY_FLAG.keys) if line else f"PARTITION BY event_type ORDER BY ts{'' if kind == 'time' else ', event_id'}"
            keys = ", ".join(LINE_KEYS) if line else "event_type, event_id"
            _add(f"{'cum' if kind == 'cum' else 'roll'}_{op}{'' if kind == 'cum' else '_' + kind}", roll, f"SELECT {keys}, {_sql_round(outs, 4)} FROM ({source}) WINDOW w AS ({by} {frame})")
    for fill, sql in {"nan": "'nan'::DOUBLE", "zero": "0.0", "last": "x", "oldest": "first_value(x) OVER (PARTITION BY event_type ORDER BY ts, event_id)"}.items():
        for kind in ("rows", "time"):

            def lagged(spark: SparkSession, d: str, fill: str = fill, kind: str = kind) -> DataFrame:
                df = read(spark, d, "events").withColumn("x", F.col("value").cast("double"))
                g = G.Graph()
                g.root("in", ["x"])
                g.add("lag", G.rolling("lag", **({"rows": 5} if kind == "rows" else {"time": DAY}), fill=fill), "x")
                return rounded(g.set_output("lag").run(df, BY_TYPE).drop("ts"), ["event_type", "event_id"])

            w = "PARTITION BY event_type ORDER BY ts"
            if kind == "rows":
                body = f"SELECT event_type, event_id, CASE WHEN row_number() OVER ({w}) > 5 THEN lag(x, 5) OVER ({w}) ELSE {sql} END AS lag FROM ({_EVENT_SQL})"
            else:
                gone = f"count(*) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
                old = f"last_value(x) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
                inner = f"SELECT *, {gone} AS gone, {old} AS old, {sql} AS other FROM ({_EVENT_SQL})"
                test = "gone > 0 AND gone > before" if fill == "last" else "gone > 0"
                body = f"SELECT event_type, event_id, CASE WHEN {test} THEN old ELSE other END AS lag FROM (SELECT *, coalesce(lag(gone) OVER ({w}), 0) AS before FROM ({inner}))"
            _add(f"roll_lag_{fill}_{kind}", lagged, f"SELECT event_type, event_id, {_sql_round({'lag': 'lag'})} FROM ({body})")

    def rolling_min(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["value"])
        g.add("low", G.rolling("min", rows=100), "value")
        return rounded(g.set_output("low").run(read(spark, d, "events"), BY_TYPE).drop("ts"), ["event_type", "event_id"])

    _add("roll_min_100", rolling_min, f"SELECT event_type, event_id, {_sql_round({'low': 'min(x) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)'})} FROM ({_EVENT_SQL})")


# aggregates over windows

_AGG_COLS = {"count": [], "sum": ["value", "sell"], "avg": ["value", "sell"], "stddev": ["value", "sell"], "ohlc": ["value"], "vwap": ["value", "weight"], "simple_return": ["value"], "log_return": ["value"], "order_flow": ["buy", "sell"], "book_imba": ["buy", "sell"], "avg_weighted": ["value", "weight"]}
_O, _C = "arg_min(value, (ts, event_id))", "arg_max(value, (ts, event_id))"
_AGG_SQL: dict[str, dict[str, str]] = {
    "count": {"count": "count(*)"},
    "sum": {"sum_value": "sum(value)", "sum_sell": "sum(sell)"},
    "avg": {"avg_value": "avg(value)", "avg_sell": "avg(sell)"},
    "stddev": {"stddev_value": "coalesce(stddev_samp(value), 0)", "stddev_sell": "coalesce(stddev_samp(sell), 0)"},
    "ohlc": {"open": _O, "high": "max(value)", "low": "min(value)", "close": _C},
    "vwap": {"vwap": "sum(value * weight) / sum(weight)"},
    "simple_return": {"simple_return": f"({_C} - {_O}) / {_O}"},
    "log_return": {"log_return": f"ln({_C} / {_O})"},
    "order_flow": {"order_flow": "sum(buy) - sum(sell)"},
    "book_imba": {"book_imba": "(sum(buy) - sum(sell)) / (sum(buy) + sum(sell))"},
    "avg_weighted": {"avg_weighted": "sum(value * weight) / sum(weight)"},
}
_SIDES_SQL = "SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DOUBLE) ELSE 0.0 END AS buy, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS sell, CAST(event_id % 7 + 1 AS DOUBLE) AS weight FROM events"


def sides(spark: SparkSession, d: str) -> DataFrame:
    """Events with a buying and a selling side by the parity of event_id, and a weight."""
    even = F.col("event_id") % 2 == 0
    v = F.col("value").cast("double")
    return read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", v.alias("value"), F.when(even, v).otherwise(0.0).alias("buy"), F.when(even, 0.0).otherwise(v).alias("sell"), (F.col("event_id") % 7 + 1).cast("double").alias("weight"))


def _cusum_rows(theta: float) -> str:
    """Events with the number of their bar by accumulated log-returns, and whether they end it."""
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, ln(value) - lag(ln(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM ({_SIDES_SQL})),
      r AS (SELECT event_type, rn, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS n, 0 AS wid, FALSE AS fired FROM s WHERE rn = 1
            UNION ALL
            SELECT event_type, rn, CASE WHEN f THEN CAST(0 AS DOUBLE) ELSE p2 END, CASE WHEN f THEN CAST(0 AS DOUBLE) ELSE n2 END, wid2, f FROM (
              SELECT *, (p2 > {theta} OR n2 < -{theta}) AS f FROM (
                SELECT s.event_type, s.rn, greatest(CAST(0 AS DOUBLE), r.p + s.g) AS p2, least(CAST(0 AS DOUBLE), r.n + s.g) AS n2, r.wid + CASE WHEN r.fired THEN 1 ELSE 0 END AS wid2
                FROM r JOIN s ON s.event_type = r.event_type AND s.rn = r.rn + 1)))"""


_WINDOWS: dict[str, tuple[Callable, Order, str, str, str]] = {
    # name: (assigner, order, rows with wid in SQL, time of a window in SQL, whether it is shut in SQL)
    "tumbling": (lambda: W.tumbling("1 hour"), BY_TYPE, f"SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS wid FROM ({_SIDES_SQL})", "wid", "TRUE"),
    "counter": (lambda: W.counter(50), BY_TYPE, f"SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS wid FROM ({_SIDES_SQL})", "max(ts)", "count(*) = 50"),
    "session": (lambda: W.session("6 hours"), BY_USER, f"SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM ({_SIDES_SQL}))", "max(ts)", ""),
}


def _aggregates() -> None:
    for agg, cols in _AGG_COLS.items():
        for kind, (assign, order, rows, end, _) in _WINDOWS.items():

            def windows(spark: SparkSession, d: str, agg: str = agg, cols: list = cols, assign: Callable = assign, order: Order = order) -> DataFrame:
                out = G.AggGraph().input(*cols).window(assign()).add(agg, cols).run(sides(spark, d), order)
                return rounded(out, [*order.groups, "window_ts"])

            key = order.groups[0]
            _add(f"agg_{agg}_{kind}", windows, f"SELECT {key}, {end} AS window_ts, {_sql_round(_AGG_SQL[agg])} FROM ({rows}) GROUP BY {key}, wid")

    def ddof(spark: SparkSession, d: str) -> DataFrame:
        out = G.AggGraph().input("value").window(W.counter(50)).add("stddev", ["value"], ddof=0, into=["sd0"]).add("stddev", ["value"], ddof=2, into=["sd2"]).run(sides(spark, d), BY_TYPE)
        return rounded(out, ["event_type", "window_ts"])

    _add("agg_stddev_ddof", ddof, f"SELECT event_type, max(ts) AS window_ts, {_sql_round({'sd0': 'stddev_pop(value)', 'sd2': 'CASE WHEN count(*) > 2 THEN sqrt(var_pop(value) * count(*) / (count(*) - 2)) ELSE 0 END'})} FROM ({_WINDOWS['counter'][2]}) GROUP BY event_type, wid")

    def bars(spark: SparkSession, d: str) -> DataFrame:
        g = G.AggGraph().input("value").window(W.tumbling("1 hour")).add("ohlc", ["value"]).add("avg", ["value"], into=["mean"]).add("stddev", ["value"], into=["std"]).add("count")
        return rounded(g.run(sides(spark, d), BY_TYPE), ["event_type", "window_ts"])

    _add("bars_hourly", bars, f"SELECT event_type, wid AS window_ts, {_sql_round(_AGG_SQL['ohlc'] | {'mean': 'avg(value)', 'std': 'coalesce(stddev_samp(value), 0)', 'count': 'count(*)'})} FROM ({_WINDOWS['tumbling'][2]}) GROUP BY event_type, wid")

    def cusum(spark: SparkSession, d: str) -> DataFrame:
        g = G.AggGraph().input("value").window(W.cusum(2.0, "value")).add("ohlc", ["value"]).add("count")
        return rounded(g.run(sides(spark, d), BY_TYPE), ["event_type", "window_ts"])

    _add("win_cusum_filter", cusum, f"WITH RECURSIVE {_cusum_rows(2.0)} SELECT event_type, max(ts) AS window_ts, {_sql_round(_AGG_SQL['ohlc'] | _AGG_SQL['count'])} FROM s JOIN r USING (event_type, rn) GROUP BY event_type, wid")

    def custom(spark: SparkSession, d: str) -> DataFrame:
        spread = lambda seq, x: [F.max(x) - F.min(x)]
        moves = aggs.python_aggregate(lambda x: float(abs(x[1:] - x[:-1]).sum()), 1)
        g = G.AggGraph().input("value").window(W.tumbling("1 hour")).add(spread, ["value"], into=["spread"]).add(moves, ["value"], into=["moves"])
        return rounded(g.run(sides(spark, d), BY_TYPE), ["event_type", "window_ts"])

    moved = f"SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type, wid ORDER BY ts, event_id)) AS m FROM ({_WINDOWS['tumbling'][2]})"
    _add("udf_aggregates", custom, f"SELECT event_type, wid AS window_ts, {_sql_round({'spread': 'max(value) - min(value)', 'moves': 'coalesce(sum(m), 0)'})} FROM ({moved}) GROUP BY event_type, wid")

    def custom_window(spark: SparkSession, d: str) -> DataFrame:
        class Jump:
            """A window starts where the value has more than doubled."""

            outputs = ("window",)

            def __init__(self) -> None:
                self.last, self.n = None, 0

            def step(self, x):
                out = []
                for v in x.tolist():
                    self.n += self.last is not None and v > 2 * self.last
                    self.last = v
                    out.append(float(self.n))
                return (np.array(out),)

        g = G.AggGraph().input("value").window(W.custom(Jump, ["value"])).add("ohlc", ["value"]).add("count")
        return rounded(g.run(sides(spark, d), BY_TYPE), ["event_type", "window_ts"])

    jumps = f"SELECT *, sum(j) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS wid FROM (SELECT *, CASE WHEN value > 2 * lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 1 ELSE 0 END AS j FROM ({_SIDES_SQL}))"
    _add("win_custom", custom_window, f"SELECT event_type, max(ts) AS window_ts, {_sql_round(_AGG_SQL['ohlc'] | _AGG_SQL['count'])} FROM ({jumps}) GROUP BY event_type, wid")

    def hop(spark: SparkSession, d: str) -> DataFrame:
        g = G.AggGraph().input("value").window(W.hopping("2 hours", "1 hour")).add("sum", ["value"], into=["total"]).add("count")
        return rounded(g.run(sides(spark, d), BY_TYPE), ["event_type", "window_ts"])

    _add("win_hopping", hop, f"SELECT event_type, e AS window_ts, {_sql_round({'total': 'sum(value)', 'count': 'count(*)'})} FROM (SELECT event_type, value, date_trunc('hour', ts) + INTERVAL 1 HOUR * k AS e FROM ({_SIDES_SQL}), range(1, 3) AS x(k)) GROUP BY event_type, e")


def _tumbles() -> None:
    last = "max(wid) OVER (PARTITION BY {k})"
    triggers: dict[str, tuple[Callable, Order, str, str]] = {
        "time": (lambda: W.tumbling("1 day"), BY_TYPE, f"SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS wid FROM ({_SIDES_SQL})", "last"),
        "counter": (lambda: W.counter(50), BY_TYPE, _WINDOWS["counter"][2], "count"),
        "session": (lambda: W.session("6 hours"), BY_USER, _WINDOWS["session"][2], "last"),
        "cusum": (lambda: W.cusum(-2.0, "value"), BY_TYPE, "", "fired"),
    }
    fns = {"sum": ["value"], "avg": ["value"], "avg_weighted": ["value", "weight"], "count": [], "ohlc": ["value"], "simple_return": ["value"], "log_return": ["value"], "order_flow": ["buy", "sell"], "book_imba": ["buy", "sell"]}
    sql_of = {f: _AGG_SQL[f] for f in fns if f not in ("sum", "avg")} | {"sum": {"sum": "sum(value)"}, "avg": {"avg": "avg(value)"}}
    for trig, (assign, order, rows, rule) in triggers.items():
        for fn, cols in fns.items():

            def tumble(spark: SparkSession, d: str, fn: str = fn, cols: list = cols, assign: Callable = assign, order: Order = order) -> DataFrame:
                g = G.Graph()
                g.root("in", ["value", "buy", "sell", "weight"])
                op = G.running(fn)
                g.add("f", op, *(cols or ["value"]))
                g.aux("end", assign())
                g.set_output(*(f"f.{k}" for k in range(len(op.outputs))))
                out = G.TumbleGraph(g).run(sides(spark, d), order)
                return rounded(out.toDF(*order.groups, "window_ts", *op.outputs), [*order.groups, "window_ts"])

            key = order.groups[0]
            outs = _sql_round(sql_of[fn])
            names = ", ".join(sql_of[fn])
            if rule == "fired":
                sql = f"WITH RECURSIVE {_cusum_rows(2.0)} SELECT event_type, window_ts, {names} FROM (SELECT event_type, max(ts) AS window_ts, bool_or(fired) AS shut, {outs} FROM s JOIN r USING (event_type, rn) GROUP BY event_type, wid) WHERE shut"
            elif rule == "count":
                sql = f"SELECT {key}, max(ts) AS window_ts, {outs} FROM ({rows}) GROUP BY {key}, wid HAVING count(*) = 50"
            else:
                end = "wid" if trig == "time" else "max(ts)"
                sql = f"SELECT {key}, window_ts, {names} FROM (SELECT {key}, wid, {end} AS window_ts, {outs}, {last.format(k=key)} AS top FROM ({rows}) GROUP BY {key}, wid) WHERE wid < top"
            _add(f"tumble_{trig}_{fn}", tumble, sql)
    for fn, cols in fns.items():

        def executed(spark: SparkSession, d: str, fn: str = fn, cols: list = cols) -> DataFrame:
            g = G.Graph()
            g.root("in", ["value", "buy", "sell", "weight"])
            op = G.running(fn)
            g.add("f", op, *(cols or ["value"]))
            g.set_output(*(f"f.{k}" for k in range(len(op.outputs))))
            out = g.run(sides(spark, d), BY_TYPE).toDF(*BY_TYPE.columns, *op.outputs)
            return rounded(out.drop("ts"), ["event_type", "event_id"])

        o = "first_value(value) OVER w"
        per_row = {
            "sum": {"sum": "sum(value) OVER w"},
            "avg": {"avg": "avg(value) OVER w"},
            "avg_weighted": {"avg_weighted": "sum(value * weight) OVER w / sum(weight) OVER w"},
            "count": {"count": "count(*) OVER w"},
            "ohlc": {"open": o, "high": "max(value) OVER w", "low": "min(value) OVER w", "close": "value"},
            "simple_return": {"simple_return": f"value / {o} - 1"},
            "log_return": {"log_return": f"ln(value) - ln({o})"},
            "order_flow": {"order_flow": "sum(buy) OVER w - sum(sell) OVER w"},
            "book_imba": {"book_imba": "(sum(buy) OVER w - sum(sell) OVER w) / (sum(buy) OVER w + sum(sell) OVER w)"},
        }[fn]
        _add(f"run_{fn}", executed, f"SELECT event_type, event_id, {_sql_round(per_row)} FROM ({_SIDES_SQL}) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")


# sequential operators

_BAR_SQL = "SELECT event_type, bar_ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v FROM (SELECT *, date_trunc('hour', ts) AS bar_ts FROM events) GROUP BY event_type, bar_ts"


def _recursive(source: str, group: str, order: str, keys: list[str], state: dict[str, tuple[str, str]], outs: dict[str, str], extra: str = "", digits: int = 6) -> str:
    """Oracle of a recurrence: `state` has each variable's value on the first row and its step from e (state before), s (row)."""
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {n}" for n, (a, _) in state.items())
    step = ", ".join(f"CAST({b} AS DOUBLE)" for _, b in state.values())
    extra = f", {extra}" if extra else ""
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn{extra} FROM ({source})),
      e AS (SELECT {group}, rn, {first} FROM s WHERE rn = 1 UNION ALL SELECT s.{group}, s.rn, {step} FROM e JOIN s ON s.{group} = e.{group} AND s.rn = e.rn + 1)
      SELECT {", ".join("s." + k for k in keys)}, {_sql_round(outs, digits)} FROM s JOIN e ON s.{group} = e.{group} AND s.rn = e.rn"""


def _mix(v: str, x: str, a: float) -> str:
    return f"({v} + CAST({a!r} AS DOUBLE) * (({x}) - {v}))"


def _scans() -> None:
    a = 0.1
    d2 = f"(s.x - e.m - CAST({a} AS DOUBLE) * (s.x - e.m))"
    user = ["user_id", "event_id"]
    big = "1.7976931348623157e308"
    sf = lambda p: 2.0 / (p + 1)
    sw = lambda p: 1.0 / (p + 1)
    var = {"m": ("x", _mix("e.m", "s.x", a)), "v": ("0", _mix("e.v", f"(s.x - e.m) * {d2}", a))}
    y = "CAST(event_id % 7 + 1 AS DOUBLE) AS y, epoch_us(ts) / 3.6e9 AS hours"
    cov = {"m": ("x", _mix("e.m", "s.x", a)), "n": ("y", _mix("e.n", "s.y", a)), "c": ("0", _mix("e.c", f"CAST({1 - a} AS DOUBLE) * (s.x - e.m) * (s.y - e.n)", a))}
    lagged = "coalesce(hours - lag(hours) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS dt"
    unb = {"v": (f"{a} * x", _mix("e.v", "s.x", a)), "b": (f"1 - {a}", f"e.b * CAST({1 - a} AS DOUBLE)")}
    ew = {"z": ("x", f"CAST({1 - a} AS DOUBLE) * e.z + s.x"), "w": ("1", "e.w + e.q"), "q": (f"{1 - a}", f"e.q * CAST({1 - a} AS DOUBLE)")}
    # the clipped value of zband, with threshold 2 and influence 0.5
    clip = "(CASE WHEN abs(s.x - e.m) > 2.0 * e.sd THEN e.last + CAST(0.5 AS DOUBLE) * (s.x - e.last) ELSE s.x END)"
    znew = _mix("e.m", clip, a)
    zvar = _mix("e.v", f"({clip} - e.m) * ({clip} - {znew})", a)
    zb = {"m": ("x", znew), "v": ("0", zvar), "last": ("x", clip), "sd": (big, f"sqrt({zvar})")}
    plan: dict[str, tuple[str, list[str], dict, dict[str, str], dict, str]] = {
        # name: (kernel, inputs, options, outputs in SQL, state in SQL, extra columns in SQL)
        "ema": ("ema", ["x"], {"alpha": a}, {"ema": "e.m"}, {"m": ("x", _mix("e.m", "s.x", a))}, ""),
        "ema_period": ("ema", ["x"], {"alpha": 9.0}, {"ema": "e.m"}, {"m": ("x", _mix("e.m", "s.x", sf(9.0)))}, ""),
        "ema_unbiased": ("ema_unbiased", ["x"], {"alpha": a}, {"ema": "e.v / (1 - e.b)"}, unb, ""),
        "ema_time": ("ema_time", ["x", "dt"], {"tau": 24.0}, {"ema": "e.m"}, {"m": ("x", "e.m + (1 - exp(-s.dt / CAST(24.0 AS DOUBLE))) * (s.x - e.m)")}, lagged),
        "ewma": ("ewma", ["x"], {"alpha": a}, {"ewma": "e.z / e.w"}, ew, ""),
        "var_ew": ("var_ew", ["x"], {"alpha": a}, {"mean": "e.m", "var": "e.v"}, var, ""),
        "std_ew": ("std_ew", ["x"], {"alpha": a}, {"mean": "e.m", "std": "sqrt(e.v)"}, var, ""),
        "cov_ew": ("cov_ew", ["x", "y"], {"alpha": a}, {"mean_x": "e.m", "mean_y": "e.n", "cov": "e.c"}, cov, ""),
        "zscore_ew": ("zscore_ew", ["x"], {"alpha": a}, {"mean": "e.m", "z": "CASE WHEN e.v > 0 THEN (s.x - e.m) / sqrt(e.v) ELSE 0 END"}, var, ""),
        "zband": ("zband", ["x"], {"alpha": a, "threshold": 2.0, "influence": 0.5}, {"mean": "e.m", "std": "CASE WHEN e.sd > 1e300 THEN -1 ELSE e.sd END"}, zb, ""),
        "macd": ("macd", ["x", "y"], {"alpha": 9.0}, {"macd": "s.x - s.y", "signal": "e.m", "hist": "s.x - s.y - e.m"}, {"m": ("x - y", _mix("e.m", "s.x - s.y", sf(9.0)))}, ""),
        "rsi": ("rsi", ["x"], {"period": 14}, {"rsi": "CASE WHEN e.l < 2.220446049250313e-14 THEN 100 ELSE 100 - 100 / (1 + e.g / e.l) END"}, {"g": ("0", _mix("e.g", "greatest(s.d, 0)", sw(14))), "l": ("0", _mix("e.l", "greatest(-s.d, 0)", sw(14)))}, "coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS d"),
    }
    source = f"SELECT user_id, ts, event_id, CAST(value AS DOUBLE) AS x, {y} FROM events"
    for name, (k, ins, options, outs, state, extra) in plan.items():

        def run(spark: SparkSession, d: str, k: str = k, ins: list = ins, options: dict = options, outs: dict = outs) -> DataFrame:
            df = read(spark, d, "events").select(*BY_USER.columns, F.col("value").cast("double").alias("x"), (F.col("event_id") % 7 + 1).cast("double").alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("hours"))
            if "dt" in ins:
                df = df.withColumn("dt", F.coalesce(F.col("hours") - F.lag("hours").over(BY_USER.window()), F.lit(0.0)))
            g = G.Graph()
            g.root("in", ins)
            op = G.kernel(k, **options)
            g.add("op", op, *ins)
            out = g.set_output(*(f"op.{i}" for i in range(len(op.outputs)))).run(df, BY_USER).toDF(*BY_USER.columns, *outs).drop("ts")
            if k == "zband":
                out = out.withColumn("std", F.when(F.col("std") > 1e300, -1.0).otherwise(F.col("std")))
            return rounded(out, user)

        _add(f"scan_{name}", run, _recursive(source, "user_id", "ts, event_id", user, state, outs, extra))
    bar = ["event_type", "bar_ts"]
    w = "OVER (PARTITION BY event_type ORDER BY bar_ts)"
    tr = f"greatest(h - l, abs(h - coalesce(lag(c) {w}, l)), abs(l - coalesce(lag(c) {w}, h))) AS tr"
    up, dn = f"coalesce(h - lag(h) {w}, 0) AS u", f"coalesce(lag(l) {w} - l, 0) AS d"
    pu, pd_ = "(CASE WHEN s.u > 0 AND s.u > s.d THEN s.u ELSE 0 END)", "(CASE WHEN s.d > 0 AND s.d > s.u THEN s.d ELSE 0 END)"
    flow = "CASE WHEN h <> l THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END * v"
    ad = f"sum({flow}) {w} AS ad"
    w9 = "OVER (PARTITION BY event_type ORDER BY bar_ts ROWS 8 PRECEDING)"
    fast = f"CASE WHEN max(h) {w9} - min(l) {w9} < 2.220446049250313e-14 THEN 50 ELSE 100 * (c - min(l) {w9}) / (max(h) {w9} - min(l) {w9}) END AS f"
    k3 = _mix("e.k", "s.f", sf(3))
    bars: dict[str, tuple[list[str], dict, dict[str, str], dict, str]] = {
        "atr": (["high", "low", "close"], {"period": 14}, {"atr": "e.m"}, {"m": (f"{sf(14)!r} * tr", _mix("e.m", "s.tr", sf(14)))}, tr),
        "dm": (["high", "low"], {"period": 14}, {"plus": "e.p", "minus": "e.n"}, {"p": ("0", _mix("e.p", pu, sw(14))), "n": ("0", _mix("e.n", pd_, sw(14)))}, f"{up}, {dn}"),
        "adosc": (["high", "low", "close", "volume"], {}, {"adosc": "e.a - e.b"}, {"a": ("ad", _mix("e.a", "s.ad", sf(3))), "b": ("ad", _mix("e.b", "s.ad", sf(10)))}, ad),
        "kdj": (["high", "low", "close"], {}, {"k": "e.k", "d": "e.q", "j": "3 * e.q - 2 * e.k"}, {"k": ("f", k3), "q": ("f", _mix("e.q", k3, sf(3)))}, fast),
    }
    for name, (ins, options, outs, state, extra) in bars.items():

        def indicator(spark: SparkSession, d: str, name: str = name, ins: list = ins, options: dict = options, outs: dict = outs) -> DataFrame:
            g = G.Graph()
            g.root("in", ins)
            op = G.kernel(name, **options)
            g.add("op", op, *ins)
            out = g.set_output(*(f"op.{i}" for i in range(len(op.outputs)))).run(hourly_bars(read(spark, d, "events")), BARS).toDF(*bar, *outs)
            return rounded(out, bar)

        _add(f"scan_{name}", indicator, _recursive(_BAR_SQL, "event_type", "bar_ts", bar, state, outs, extra))

    def flow_multiplier(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["high", "low", "close"])
        g.add("mfm", G.money_flow(), "high", "low", "close")
        return rounded(g.set_output("mfm").run(hourly_bars(read(spark, d, "events")), BARS), bar)

    _add("op_mfm", flow_multiplier, f"SELECT event_type, bar_ts, {_sql_round({'mfm': 'CASE WHEN h <> l THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END'})} FROM ({_BAR_SQL})")

    def directional(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["high", "low", "close"])
        g.add("dm", G.kernel("dm", period=14), "high", "low")
        g.add("atr", G.kernel("atr", period=14), "high", "low", "close")
        g.add("di", G.directional(), "dm.0", "dm.1", "atr")
        return rounded(g.set_output("di.0", "di.1", "di.2").run(hourly_bars(read(spark, d, "events")), BARS).toDF(*bar, "plus_di", "minus_di", "dx"), bar)

    both = bars["dm"][3] | bars["atr"][3]
    _add("graph_directional", directional, _recursive(_BAR_SQL, "event_type", "bar_ts", bar, both, {"plus_di": "CASE WHEN e.m <> 0 THEN e.p / e.m ELSE 0 END", "minus_di": "CASE WHEN e.m <> 0 THEN e.n / e.m ELSE 0 END", "dx": "CASE WHEN e.p + e.n <> 0 THEN abs(e.p - e.n) / (e.p + e.n) * 100 ELSE 0 END"}, f"{up}, {dn}, {tr}"))

    def cusum_rows(spark: SparkSession, d: str) -> DataFrame:
        out = scan(sides(spark, d), BY_TYPE, [Node(KERNELS["cusum"], ["value"], ["bar", "fired"], {"threshold": 2.0})])
        return out.select("event_type", "event_id", F.col("bar").cast("long").alias("bar"), (F.col("fired") > 0).alias("fired"))

    _add("scan_cusum", cusum_rows, f"WITH RECURSIVE {_cusum_rows(2.0)} SELECT event_type, event_id, CAST(wid AS BIGINT) AS bar, fired FROM s JOIN r USING (event_type, rn)")

    def dynwin(spark: SparkSession, d: str) -> DataFrame:
        df = read(spark, d, "events").select(*BY_USER.columns, F.col("value").cast("double").alias("x"))
        g = G.Graph()
        g.root("in", ["x"])
        g.add("op", G.kernel("dynwin_avg", rows=4, threshold=200.0), "x")
        return rounded(g.set_output("op").run(df, BY_USER).toDF(*BY_USER.columns, "mean").drop("ts"), user)

    # the window's values are a list; values beyond the window leave one by one, each taken out of mean and M2
    _add(
        "scan_dynwin_avg",
        dynwin,
        f"""WITH RECURSIVE s AS (SELECT user_id, ts, event_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      e AS (SELECT user_id, rn, [x] AS w, x AS mean, CAST(0 AS DOUBLE) AS m2, 4 AS size, FALSE AS evict FROM s WHERE rn = 1
            UNION ALL
            SELECT user_id, rn, w, mean, CASE WHEN grow THEN CAST(0 AS DOUBLE) ELSE m2 END, CASE WHEN grow THEN 2 * size ELSE size END, len(w) > CASE WHEN grow THEN 2 * size ELSE size END FROM (
              SELECT *, m2 > CAST(40000.0 AS DOUBLE) AND NOT again AS grow FROM (
                SELECT s.user_id, s.rn, list_append(e.w, s.x) AS w, e.mean + (s.x - e.mean) / (len(e.w) + 1) AS mean, e.m2 + (s.x - e.mean) * (s.x - (e.mean + (s.x - e.mean) / (len(e.w) + 1))) AS m2, e.size, FALSE AS again
                FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1 WHERE NOT e.evict
                UNION ALL
                SELECT user_id, rn, w[2:], mean - (w[1] - mean) / (len(w) - 1), greatest(CAST(0 AS DOUBLE), m2 - (w[1] - mean) * (w[1] - (mean - (w[1] - mean) / (len(w) - 1)))), size, TRUE FROM e WHERE evict)))
      SELECT s.user_id, s.event_id, {_sql_round({"mean": "e.mean"})} FROM s JOIN e ON s.user_id = e.user_id AND s.rn = e.rn WHERE NOT e.evict""",
    )

    def parameters(spark: SparkSession, d: str) -> DataFrame:
        e = read(spark, d, "events").select(*BY_USER.columns, F.col("value").cast("double").alias("x"))
        p = e.select("user_id").distinct().select("user_id", (0.05 + F.col("user_id") % 5 * 0.1).cast("double").alias("alpha"))
        g = G.Graph()
        g.root("in", ["x"])
        g.add("op", G.kernel("ema", alpha=0.0), "x")
        g.supp_root("given", ["alpha"])
        g.supp_link("op", alpha="alpha")
        return rounded(g.set_output("op").run(e, BY_USER, parameters=p).toDF(*BY_USER.columns, "ema").drop("ts"), user)

    _add("graph_parameters", parameters, _recursive(source, "user_id", "ts, event_id", user, {"m": ("x", "e.m + (CAST(0.05 AS DOUBLE) + s.user_id % 5 * CAST(0.1 AS DOUBLE)) * (s.x - e.m)")}, {"ema": "e.m"}))


# graphs, pipelines, functors, time

def _graphs() -> None:
    keys = ["event_type", "event_id"]
    win = "PARTITION BY event_type ORDER BY ts, event_id"

    def fan_out(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["value"])
        g.add("left", G.rolling("sum", rows=2), "value")
        g.add("right", G.rolling("sum", rows=5), "value")
        g.add("both", G.binary("add"), "left", "right")
        return rounded(g.set_output("left", "right", "both").run(read(spark, d, "events"), BY_TYPE).toDF(*BY_TYPE.columns, "sum2", "sum5", "both").drop("ts"), keys, 4)

    s2, s5 = (f"sum(x) OVER ({win} ROWS {k} PRECEDING)" for k in (1, 4))
    _add("graph_fan_out", fan_out, f"SELECT event_type, event_id, {_sql_round({'sum2': s2, 'sum5': s5, 'both': f'{s2} + {s5}'}, 4)} FROM ({_EVENT_SQL})")

    def oscillator(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["value"])
        fast = g.add(G.kernel("ema", alpha=12.0), "value")
        slow = g.add(G.kernel("ema", alpha=26.0), "value")
        macd = g.add("macd", G.kernel("macd", alpha=9.0), fast[0], slow[0])
        out = g.set_output(macd[0], macd[1], macd[2]).run(read(spark, d, "events"), BY_USER)
        return rounded(out.toDF(*BY_USER.columns, "macd", "signal", "hist").drop("ts"), ["user_id", "event_id"])

    f, s = _mix("e.f", "s.x", 2 / 13), _mix("e.s", "s.x", 2 / 27)
    _add("graph_macd", oscillator, _recursive(_EVENT_SQL, "user_id", "ts, event_id", ["user_id", "event_id"], {"f": ("x", f), "s": ("x", s), "g": ("0", _mix("e.g", f"{f} - {s}", 0.2))}, {"macd": "e.f - e.s", "signal": "e.g", "hist": "e.f - e.s - e.g"}))

    def chain(spark: SparkSession, d: str) -> DataFrame:
        def stage() -> G.Graph:
            g = G.Graph()
            g.root("in", ["x"])
            g.add("sum", G.rolling("sum", rows=2), "x")
            return g.set_output("sum")

        df = read(spark, d, "events").withColumnRenamed("value", "x")
        return rounded(Pipeline().add_stage(stage()).add_stage(stage()).run(df, BY_TYPE).toDF(*BY_TYPE.columns, "sum").drop("ts"), keys, 4)

    _add("pipeline_sums", chain, f"SELECT event_type, event_id, {_sql_round({'sum': f'sum(x) OVER ({win} ROWS 1 PRECEDING)'}, 4)} FROM (SELECT event_type, ts, event_id, sum(x) OVER ({win} ROWS 1 PRECEDING) AS x FROM ({_EVENT_SQL}))")

    def chain_tumble(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["value"])
        g.add("log", G.unary("log"), "value")
        first = g.set_output("log")
        t = G.Graph()
        t.root("in", ["x"])
        t.add("total", G.running("sum"), "x")
        t.aux("end", W.counter(20))
        second = G.TumbleGraph(t.set_output("total"))
        r = G.Graph()
        r.root("in", ["x"])
        r.add("mean", G.rolling("avg", rows=3), "x")
        out = Pipeline().add_stage(first).add_stage(second).add_stage(r.set_output("mean")).run(read(spark, d, "events"), BY_TYPE)
        return rounded(out, ["event_type", "ts"])

    bars = f"SELECT event_type, max(ts) AS ts, sum(ln(x)) AS t FROM (SELECT *, (row_number() OVER ({win}) - 1) // 20 AS wid FROM ({_EVENT_SQL})) GROUP BY event_type, wid HAVING count(*) = 20"
    _add("pipeline_log_bars", chain_tumble, f"SELECT event_type, ts, {_sql_round({'mean': 'avg(t) OVER (PARTITION BY event_type ORDER BY ts ROWS 2 PRECEDING)'})} FROM ({bars})")

    def chain_time(spark: SparkSession, d: str) -> DataFrame:
        t = G.Graph()
        t.root("in", ["value"])
        t.add("bar", G.running("ohlc"), "value")
        t.aux("end", W.tumbling("1 hour"))
        bar = G.TumbleGraph(t.set_output("bar.1", "bar.2"))
        r = G.Graph()
        r.root("in", ["high", "low"])
        r.add("range", G.binary("sub"), "high", "low")
        out = Pipeline().add_stage(bar).add_stage(r.set_output("range")).run(read(spark, d, "events"), BY_TYPE)
        return rounded(out, ["event_type", "ts"])

    hours = f"SELECT event_type, wid, min(ts) AS first, max(x) - min(x) AS r FROM (SELECT *, date_trunc('hour', ts) AS wid FROM ({_EVENT_SQL})) GROUP BY event_type, wid"
    _add("pipeline_hour_range", chain_time, f"SELECT event_type, ts, {_sql_round({'range': 'r'})} FROM (SELECT event_type, r, lead(first) OVER (PARTITION BY event_type ORDER BY wid) AS ts FROM ({hours})) WHERE ts IS NOT NULL")

    def nested(spark: SparkSession, d: str) -> DataFrame:
        t = G.Graph()
        t.root("in", ["value"])
        t.add("total", G.running("sum"), "value")
        t.add("root", G.unary("sqrt"), "total")
        t.add("mean", G.running("avg"), "root")
        t.aux("end", W.counter(10))
        out = G.TumbleGraph(t.set_output("mean", "root")).run(read(spark, d, "events"), BY_TYPE)
        return rounded(out, ["event_type", "window_ts"])

    part = "PARTITION BY event_type, wid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"
    _add("tumble_nested", nested, f"SELECT event_type, max(ts) AS window_ts, {_sql_round({'mean': 'arg_max(m, (ts, event_id))', 'root': 'arg_max(r, (ts, event_id))'})} FROM (SELECT *, avg(r) OVER ({part}) AS m FROM (SELECT *, sqrt(sum(x) OVER ({part})) AS r FROM (SELECT *, (row_number() OVER ({win}) - 1) // 10 AS wid FROM ({_EVENT_SQL})))) GROUP BY event_type, wid HAVING count(*) = 10")

    def functors(spark: SparkSession, d: str) -> DataFrame:
        g = G.Graph()
        g.root("in", ["x", "y"])
        g.add("hyp", G.functor(lambda a, b: F.sqrt(a * a + b * b), 2), "x", "y")
        g.add("waves", G.functor(lambda a: (F.sin(a / 100), F.cos(a / 100)), 1, 2), "x")
        g.add("half", G.batch_functor(lambda a: (a / 2, a % 3), 1, 2), "x")
        g.add("answer", G.functor(lambda: 42.0, 0))
        out = g.set_output("hyp", "waves.0", "waves.1", "half.0", "half.1", "answer").run(_line(spark, d), BY_FLAG).toDF(*BY_FLAG.columns, "hyp", "s", "c", "half", "rest", "answer")
        return rounded(out.select(*LINE_KEYS, "hyp", "s", "c", "half", "rest", "answer"), LINE_KEYS)

    _add("udf_functors", functors, f"SELECT {', '.join(LINE_KEYS)}, {_sql_round({'hyp': 'sqrt(x * x + y * y)', 's': 'sin(x / 100)', 'c': 'cos(x / 100)', 'half': 'x / 2', 'rest': 'x % 3', 'answer': '42.0'})} FROM ({_LINE_SQL})")

    def accumulate(spark: SparkSession, d: str) -> DataFrame:
        class Sum:
            def __init__(self) -> None:
                self.total = 1.0

            def __call__(self, a: float, b: float) -> float:
                self.total += a * b
                return self.total

        g = G.Graph()
        g.root("in", ["value", "weight"])
        g.add("acc", G.stateful(Sum, 2), "value", "weight")
        return rounded(g.set_output("acc").run(sides(spark, d), BY_TYPE).drop("ts"), keys, 4)

    _add("udf_stateful", accumulate, f"SELECT event_type, event_id, {_sql_round({'acc': f'1 + sum(value * weight) OVER ({win} ROWS UNBOUNDED PRECEDING)'}, 4)} FROM ({_SIDES_SQL})")

    def times(spark: SparkSession, d: str) -> DataFrame:
        return read(spark, d, "events").select("event_id", since_epoch(F.col("ts"), "us").alias("us"), since_epoch(F.col("ts"), "ms").alias("ms"), since_epoch(F.col("ts"), "s").alias("s"), since_epoch(F.col("ts"), "h").alias("h"), since_epoch(F.col("ts"), "d").alias("d"), floor_time(F.col("ts"), Duration(15, "min")).cast("timestamp_ntz").alias("quarter"))

    _add("time_units", times, "SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 3600000000 AS h, epoch_us(ts) // 86400000000 AS d, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter FROM events")

    def arithmetic(spark: SparkSession, d: str) -> DataFrame:
        """A time moved by a sum of durations, counted in units that are rounded down, up and to the even side, and back."""
        step = Duration(90_000, "ms") + Duration(1, "h") - Duration(250, "ms")  # the left one gives the unit
        e = read(spark, d, "events")
        moved = since_epoch(F.col("ts"), "us") + F.lit(step.micros())
        whole = (step.floor("min"), step.ceil("min"), step.round("min"), Duration(2500, "ms").round("s"), Duration(3500, "ms").round("s"))
        back = from_epoch(F.floor(moved / 1_000_000), "s")
        return e.select("event_id", moved.alias("moved"), F.round(posix(F.col("ts")), 3).alias("posix"), F.unix_micros(back.cast("timestamp")).alias("back"), *(F.lit(w.micros()).cast("long").alias(f"d{k}") for k, w in enumerate(whole)))

    _add("time_arithmetic", arithmetic, "SELECT event_id, epoch_us(ts) + 3689750000 AS moved, round(epoch_us(ts) / 1e6, 3) AS posix, (epoch_us(ts) + 3689750000) // 1000000 * 1000000 AS back, 3660000000::BIGINT AS d0, 3720000000::BIGINT AS d1, 3660000000::BIGINT AS d2, 2000000::BIGINT AS d3, 4000000::BIGINT AS d4 FROM events")


class _Distinct:
    """A user's operator: how many whole values its span holds."""

    def __init__(self) -> None:
        self.n: dict[float, int] = {}

    def add(self, x: float) -> None:
        self.n[x] = self.n.get(x, 0) + 1

    def evict(self, x: float) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            del self.n[x]

    def value(self) -> float:
        return float(len(self.n))


def _spans() -> None:
    events = "SELECT event_type, event_id, ts, CAST(value AS DOUBLE) AS x FROM events"
    by = "PARTITION BY event_type ORDER BY ts, event_id"

    def own_rows(spark: SparkSession, d: str) -> DataFrame:
        """A rolling sum whose rows are a parameter of each group."""
        e = read(spark, d, "events").withColumn("x", F.col("value").cast("double"))
        own = e.select("event_type").distinct().withColumn("rows", (F.length("event_type") % 4 + 2).cast("double"))
        g = G.Graph()
        g.root("in", ["x"])
        g.supp_root("p", ["rows"])
        g.add("s", G.rolling("sum", rows=1), "x")
        g.supp_link("s", rows="rows").set_output("s")
        return rounded(g.run(e, BY_TYPE, parameters=own).drop("ts"), ["event_type", "event_id"])

    _add("graph_span_by_group", own_rows, f"SELECT event_type, event_id, {_sql_round({'s': 'sum(x) OVER w'})} FROM (SELECT *, length(event_type) % 4 + 1 AS k FROM ({events})) WINDOW w AS ({by} ROWS BETWEEN k PRECEDING AND CURRENT ROW)")

    def evicting(spark: SparkSession, d: str) -> DataFrame:
        """A user's operator over rows and over a time."""
        e = read(spark, d, "events").withColumn("x", F.floor(F.col("value") / 20).cast("double"))
        g = G.Graph()
        g.root("in", ["x"])
        g.add("rows", G.windowed_operator(_Distinct, 1, rows=12), "x")
        g.add("day", G.windowed_operator(_Distinct, 1, time=DAY), "x")
        return rounded(g.set_output("rows", "day").run(e, BY_TYPE).drop("ts"), ["event_type", "event_id"])

    whole = "SELECT event_type, event_id, ts, floor(value / 20) AS x FROM events"
    _add("udf_windowed", evicting, f"SELECT event_type, event_id, {_sql_round({'rows': f'count(DISTINCT x) OVER ({by} ROWS 11 PRECEDING)', 'day': 'count(DISTINCT x) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)'})} FROM ({whole})")


_scalar()
_rolling()
_spans()
_aggregates()
_tumbles()
_scans()
_graphs()


def queries() -> dict[str, Query]:
    from . import large

    return _queries | large.queries()


def oracle_sql() -> dict[str, str]:
    from . import large

    return _oracles | large.oracle_sql()
