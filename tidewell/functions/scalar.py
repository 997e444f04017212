"""Scalar functions over double columns with IEEE results where ANSI SQL would raise an error or give NULL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Below this a denominator counts as zero: a hundred times the double epsilon.
TINY = 100 * 2.220446049250313e-16


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def ieee_div(a: Column, b: Column | float) -> Column:
    """a / b, with signed infinity or NaN for b = 0; a negative zero counts as zero."""
    a, b = _d(a), _d(b)
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a.isNotNull() & b.isNotNull(), F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def _ieee_log(f: Callable[[Column], Column], low: float) -> Callable[[Column], Column]:
    """Logarithm whose domain starts at `low`: minus infinity there, NaN below."""

    def log(x: Column) -> Column:
        x = _d(x)
        return F.when(x > low, f(x)).when(x == low, F.lit(-INF)).when(x < low, F.lit(NAN))

    return log


ieee_ln = _ieee_log(F.ln, 0.0)


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding that keeps doubles: values without a fraction, NaN and infinities are returned as they are."""

    def rounded(x: Column) -> Column:
        x = _d(x)
        return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))

    return rounded


def _guarded(f: Callable[[float], float]) -> Callable[[float], float]:
    """A function of Python's math with IEEE results outside its domain."""

    def one(v: float) -> float:
        if v is None or v != v:
            return NAN
        try:
            return f(v)
        except (ValueError, OverflowError):
            return INF if v > 0 or f is math.lgamma else NAN

    return one


def _special(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """A function that Spark lacks, in Arrow batches."""
    one = _guarded(f)

    def column(x: Column) -> Column:
        @F.pandas_udf("double")
        def apply(s: pd.Series) -> pd.Series:
            return s.map(one).astype("float64")

        x = _d(x)
        return F.when(x.isNotNull(), apply(x))

    return column


def trunc(x: Column) -> Column:
    return F.when(_d(x) < 0, _whole(F.ceil)(x)).otherwise(_whole(F.floor)(x))


#: One column in, one out.
UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda x: -_d(x),
    "inv": lambda x: ieee_div(F.lit(1.0), x),
    "abs": lambda x: F.abs(_d(x)),
    "exp": lambda x: F.exp(_d(x)),
    "expm1": lambda x: F.expm1(_d(x)),
    "log": ieee_ln,
    "log10": _ieee_log(F.log10, 0.0),
    "log2": _ieee_log(F.log2, 0.0),
    "log1p": _ieee_log(F.log1p, -1.0),
    "sqrt": lambda x: F.sqrt(_d(x)),
    "cbrt": lambda x: F.cbrt(_d(x)),
    "sin": lambda x: F.sin(_d(x)),
    "cos": lambda x: F.cos(_d(x)),
    "tan": lambda x: F.tan(_d(x)),
    "asin": lambda x: F.asin(_d(x)),
    "acos": lambda x: F.acos(_d(x)),
    "atan": lambda x: F.atan(_d(x)),
    "sinh": lambda x: F.sinh(_d(x)),
    "cosh": lambda x: F.cosh(_d(x)),
    "tanh": lambda x: F.tanh(_d(x)),
    "asinh": lambda x: F.asinh(_d(x)),
    "acosh": lambda x: F.acosh(_d(x)),
    "atanh": lambda x: F.atanh(_d(x)),
    "erf": _special(math.erf),
    "erfc": _special(math.erfc),
    "tgamma": _special(math.gamma),
    "lgamma": _special(math.lgamma),
    "ceil": _whole(F.ceil),
    "floor": _whole(F.floor),
    "trunc": trunc,
    "round": _whole(F.round),
}


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; NaN for b = 0."""
    a, b = _d(a), _d(b)
    return F.when(b != 0, a % b).when(a.isNotNull() & b.isNotNull(), F.lit(NAN))


#: Two columns in, one out.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: _d(a) + _d(b),
    "sub": lambda a, b: _d(a) - _d(b),
    "mul": lambda a, b: _d(a) * _d(b),
    "div": ieee_div,
    "fmod": fmod,
}


def clamp(x: Column, low: float, high: float) -> Column:
    """x held between low and high; NaN stays NaN."""
    x = _d(x)
    return F.when(F.isnan(x), x).when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def lerp(a: Column, b: Column, t: float) -> Column:
    a, b = _d(a), _d(b)
    return a + float(t) * (b - a)


def safe_ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or `otherwise` where b is nearly zero."""
    return F.when(F.abs(b) < TINY, F.lit(float(otherwise))).otherwise(a / b)


#: The functions of two columns, of arrays.
BINARY_ARRAYS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": lambda a, b: np.divide(a, b + 0.0), "fmod": np.fmod}

def _each(f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    return np.array(list(map(_guarded(f), x.tolist())), dtype=np.float64)


#: Functions of one column whose name with numpy is another one, or that are of Python's math.
_ARRAYS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "neg": np.negative,
    "inv": np.reciprocal,
    "asin": np.arcsin,
    "acos": np.arccos,
    "atan": np.arctan,
    "asinh": np.arcsinh,
    "acosh": np.arccosh,
    "atanh": np.arctanh,
    "round": lambda x: np.copysign(np.floor(np.abs(x) + 0.5), x),
    "erf": lambda x: _each(math.erf, x),
    "erfc": lambda x: _each(math.erfc, x),
    "tgamma": lambda x: _each(math.gamma, x),
    "lgamma": lambda x: _each(math.lgamma, x),
}


def on_array(name: str, x: np.ndarray) -> np.ndarray:
    """A function of UNARY of an array."""
    return (_ARRAYS.get(name) or getattr(np, name))(x)
