"""Scalar functions at the edges of their domains, and durations."""

import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalar as S
from tidewell.functions.timeunits import Duration, as_size


def at(spark, f, *xs):
    df = spark.createDataFrame([tuple(xs)], ", ".join(f"c{k} double" for k in range(len(xs))))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("y")).first().y


def same(a, b):
    return (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name, x, y", [
    ("inv", 0.0, INF), ("log", 0.0, -INF), ("log", -1.0, NAN), ("log", NAN, NAN), ("log1p", -1.0, -INF), ("log1p", -2.0, NAN), ("log2", 8.0, 3), ("sqrt", -1.0, NAN), ("atanh", 1.0, INF),
    ("asin", 2.0, NAN), ("ceil", -0.5, 0), ("floor", 1e300, 1e300), ("ceil", NAN, NAN), ("trunc", -1.7, -1), ("round", 2.5, 3), ("round", -2.5, -3), ("erf", 0.5, math.erf(0.5)), ("erfc", 0.5, math.erfc(0.5)),
    ("tgamma", 5.0, 24), ("lgamma", 10.0, math.lgamma(10)), ("cbrt", -8.0, -2), ("log", None, None), ("erf", None, None),
])
def test_unary(spark, name, x, y):
    assert same(at(spark, S.UNARY[name], x), y)


@pytest.mark.parametrize("a, b, y", [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (3.0, 2.0, 1.5), (None, 0.0, None), (1.0, None, None)])
def test_division(spark, a, b, y):
    assert same(at(spark, S.ieee_div, a, b), y)


def test_others(spark):
    assert same(at(spark, S.fmod, -7.5, 2.0), -1.5) and same(at(spark, S.fmod, 1.0, 0.0), NAN)
    assert same(at(spark, lambda x: S.clamp(x, 0, 1), NAN), NAN) and at(spark, lambda x: S.clamp(x, 0, 1), 7.0) == 1
    assert at(spark, lambda a, b: S.lerp(a, b, 0.25), 0.0, 8.0) == 2


def test_durations():
    ms = Duration(1500, "ms")
    assert (ms.floor("s"), ms.ceil("s"), ms.cast("s")) == (Duration(1), Duration(2), Duration(1))
    assert [Duration(x, "ms").round("s").count for x in (1400, 1600, 1500, 2500)] == [1, 2, 2, 2]
    total = Duration(100, "ns") + Duration(250, "us") + Duration(500, "ms") + Duration(45) + Duration(30, "min") + Duration(1, "h")
    assert total.count == 5_445_500_250_100
    assert Duration(1, "h") == Duration(60, "min") and Duration(1) < Duration(1001, "ms") and -Duration(-3) == Duration(3)
    assert Duration(7) % Duration(4) == Duration(3) and Duration(1) + Duration(999, "ms") == Duration(1) and abs(Duration(-2, "d")).micros() == 172_800_000_000
    assert Duration.parse("5 seconds") == Duration(5) and as_size("2h") == 7_200_000_000 and as_size(3.5) == 3.5
    with pytest.raises(ValueError):
        Duration.parse("soon")
    with pytest.raises(ValueError):
        Duration(1, "fortnight")


def test_arrays_agree_with_columns(spark):
    """The array form of every function, used between kernels of a stream."""
    import numpy as np

    x = np.array([-2.5, -1.0, -0.5, 0.0, 0.3, 0.5, 1.0, 1.5, 2.5, 40.0, float("inf"), float("nan")])
    df = spark.createDataFrame([(k, float(v), float(w)) for k, (v, w) in enumerate(zip(x, x[::-1]))], "k int, x double, y double").coalesce(1)
    names = sorted(S.UNARY) + sorted(S.BINARY)
    got = df.select("k", *(S.UNARY[n](F.col("x")).alias(n) for n in sorted(S.UNARY)), *(S.BINARY[n](F.col("x"), F.col("y")).alias(n) for n in sorted(S.BINARY))).orderBy("k").toPandas()
    with np.errstate(all="ignore"):
        for n in names:
            want = S.on_array(n, x) if n in S.UNARY else S.BINARY_ARRAYS[n](x, x[::-1])
            np.testing.assert_allclose(got[n].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-12, err_msg=n)
