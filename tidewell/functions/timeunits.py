"""Durations and time points as whole counts of a unit."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit.
UNITS = {
    "ns": Fraction(1, 10**9),
    "us": Fraction(1, 10**6),
    "ms": Fraction(1, 1000),
    "s": Fraction(1),
    "min": Fraction(60),
    "h": Fraction(3600),
    "d": Fraction(86400),
    "w": Fraction(604800),
}
_LONG = {"nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "minute": "min", "hour": "h", "day": "d", "week": "w"}


def _unit(name: str) -> str:
    name = name.strip()
    short = _LONG.get(name.lower().rstrip("s") if name not in UNITS else name, name)
    if short not in UNITS:
        raise ValueError(f"unknown unit {name!r}")
    return short


def _half_even(x: Fraction) -> int:
    return round(x)


@dataclass(frozen=True)
class Duration:
    """A whole count of a unit. Arithmetic keeps the left operand's unit and truncates the right one to it."""

    count: int
    unit: str = "s"

    def __post_init__(self) -> None:
        object.__setattr__(self, "unit", _unit(self.unit))

    @classmethod
    def parse(cls, text: str) -> Duration:
        """'5 seconds', '1h', '250 ms'."""
        m = re.fullmatch(r"\s*(-?\d+)\s*([A-Za-z]+)\s*", text)
        if not m:
            raise ValueError(f"not a duration: {text!r}")
        return cls(int(m[1]), m[2])

    @property
    def seconds(self) -> Fraction:
        return self.count * UNITS[self.unit]

    def _in(self, unit: str) -> Fraction:
        return self.seconds / UNITS[_unit(unit)]

    def cast(self, unit: str) -> Duration:
        """In another unit, truncated toward zero."""
        x = self._in(unit)
        return Duration(int(x), unit)

    def floor(self, unit: str) -> Duration:
        return Duration(self._in(unit).__floor__(), unit)

    def ceil(self, unit: str) -> Duration:
        return Duration(self._in(unit).__ceil__(), unit)

    def round(self, unit: str) -> Duration:
        """To the nearest, halves to even."""
        return Duration(_half_even(self._in(unit)), unit)

    def micros(self) -> int:
        """Whole microseconds, truncated: the resolution of Spark's timestamps."""
        return int(self._in("us"))

    def posix(self) -> float:
        return float(self.seconds)

    def __abs__(self) -> Duration:
        return Duration(abs(self.count), self.unit)

    def __neg__(self) -> Duration:
        return Duration(-self.count, self.unit)

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.count + other.cast(self.unit).count, self.unit)

    def __sub__(self, other: Duration) -> Duration:
        return Duration(self.count - other.cast(self.unit).count, self.unit)

    def __mul__(self, k: int) -> Duration:
        return Duration(self.count * k, self.unit)

    def __floordiv__(self, k: int | Duration) -> Duration | int:
        if isinstance(k, Duration):
            return int(self.seconds / k.seconds)
        return Duration(int(Fraction(self.count, k)), self.unit)

    def __mod__(self, other: Duration) -> Duration:
        other = other.cast(self.unit)
        return Duration(self.count - int(Fraction(self.count, other.count)) * other.count, self.unit)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Duration) and self.seconds == other.seconds

    def __hash__(self) -> int:
        return hash(self.seconds)

    def __lt__(self, other: Duration) -> bool:
        return self.seconds < other.seconds

    def __le__(self, other: Duration) -> bool:
        return self.seconds <= other.seconds


def as_size(x: int | float | str | Duration) -> int | float:
    """Size of a time window in the units of the time key: durations in microseconds, numbers as they are."""
    if isinstance(x, str):
        x = Duration.parse(x)
    return x.micros() if isinstance(x, Duration) else x


def time_key(ts: Column, kind: str) -> Column:
    """Sortable number of a time column: microseconds of timestamps and dates, numbers as they are."""
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(ts.cast("timestamp"))
    return ts


def since_epoch(ts: Column, unit: str) -> Column:
    """Time since 1970 in a unit, as a whole number rounded down."""
    micros = F.unix_micros(ts.cast("timestamp"))
    k = UNITS[_unit(unit)] / UNITS["us"]
    if k < 1:
        return micros * int(1 / k)
    return F.floor(micros / F.lit(int(k))).cast("long") if k > 1 else micros


def floor_time(ts: Column, unit: Duration) -> Column:
    """Start of the unit-long interval since 1970 that holds ts, also before 1970."""
    k = unit.micros()
    m = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(m - F.pmod(m, F.lit(k)))


def now() -> Column:
    """The time at which the query started."""
    return F.current_timestamp()


def from_epoch(count: Column, unit: str) -> Column:
    """Timestamp from a whole count of a unit since 1970; what is finer than a microsecond is cut off."""
    k = UNITS[_unit(unit)] / UNITS["us"]
    return F.timestamp_micros((count * int(k)).cast("long") if k >= 1 else F.floor(count / F.lit(int(1 / k))).cast("long"))


def posix(ts: Column) -> Column:
    """Seconds since 1970 with a fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
