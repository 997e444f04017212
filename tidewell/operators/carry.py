"""Pieces of a kernel's state that can be carried over a cut in a group's rows.

A range of rows that is run without what lies before it ("cold") tells what it did to each piece, change(), in a form that
after() applies to any start. So ranges run side by side, their changes are put together in order, and every range then knows
the state it starts from. A start of None is that of a group's first row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd


def lost(a: Any, b: Any, total: Any) -> Any:
    """What rounding took from total = a + b; 0 where that is not finite."""
    with np.errstate(all="ignore"):
        added = total - a
        rest = (a - (total - added)) + (b - added)
        return np.where(np.isfinite(rest), rest, 0.0)


class Part:
    """A piece of state under `value`."""

    value: Any = None

    def get(self) -> Any:
        return self.value

    def set(self, value: Any) -> None:
        self.value = value

    def change(self) -> Any:
        """What the rows since the cold start did; None: nothing."""
        return self.value

    @staticmethod
    def after(start: Any, change: Any) -> Any:
        raise NotImplementedError


class Smooth(Part):
    """m <- m + alpha (x - m), from a seed or from the first value, over arrays: an affine map of the start, whose slope is the
    weight that is left of it. The map is kept as what becomes of one start, so that large values lose no digits."""

    def __init__(self, alpha: float, seed: float | None = None):
        self.alpha, self.value, self.ref, self.left = alpha, seed, seed, 1.0

    @property
    def m(self) -> float | None:
        return self.value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        if not len(x):
            return x
        if self.ref is None:
            self.ref = float(x[0])
        if self.alpha >= 1:
            self.value, self.left = float(x[-1]), 0.0
            return x
        self.left *= (1 - self.alpha) ** len(x)
        out, at = np.empty(len(x)), 0
        odd = np.flatnonzero(~np.isfinite(x))
        fine = int(odd[0]) if len(odd) else len(x)
        m = self.value
        if fine >= 8 and (m is None or np.isfinite(m)):
            z = x[:fine] if m is None else np.concatenate([[m], x[:fine]])
            out[:fine] = pd.Series(z).ewm(alpha=self.alpha, adjust=False, ignore_na=False).mean().to_numpy()[0 if m is None else 1 :]
            m, at = float(out[fine - 1]), fine
        for k, v in enumerate(x[at:].tolist(), at):
            m = v if m is None else m + self.alpha * (v - m)
            out[k] = m
        self.value = m
        return out

    def weigh(self, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """The same with a weight for each value."""
        if self.ref is None and len(x):
            self.ref = float(x[0])
        m, out = self.value, []
        for v, k in zip(x.tolist(), alpha.tolist(), strict=True):
            m = v if m is None else m + k * (v - m)
            out.append(m)
        self.value = m
        self.left *= float(np.prod(1 - alpha))
        return np.array(out)

    def change(self) -> tuple[float, float, float, bool] | None:
        return None if self.value is None else (self.ref, self.value, self.left, self.alpha >= 1 and self.left == 0.0)

    @staticmethod
    def after(start, change):
        if change is None:
            return start
        ref, end, left, forgets = change
        if start is None or forgets:
            return end
        if left == 1.0:
            return start
        return end + left * (start - ref) if math.isfinite(start) else math.nan


class Last(Part):
    """The latest value."""

    @staticmethod
    def after(start, change):
        return start if change is None else change


class First(Part):
    """The earliest value."""

    @staticmethod
    def after(start, change):
        return change if start is None else start


class Total(Part):
    """A sum from 0."""

    def __init__(self) -> None:
        self.value = 0

    @staticmethod
    def after(start, change):
        return change if start is None else start + change


class Summed(Part):
    """A sum from 0 of many numbers, as two: added one by one, and what rounding took from it."""

    def __init__(self) -> None:
        self.value = 0.0, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The sum at each of the next numbers."""
        with np.errstate(all="ignore"):
            total = np.cumsum(np.concatenate([[self.value[0]], x]))
            rest = np.cumsum(np.concatenate([[self.value[1]], lost(total[:-1], x, total[1:])]))
            self.value = float(total[-1]), float(rest[-1])
            return (total + rest)[1:]

    @staticmethod
    def after(start, change):
        if start is None:
            return change
        total = start[0] + change[0]
        return total, start[1] + change[1] + float(lost(start[0], change[0], total))


class Extreme(Part):
    """The largest or least value so far, by a function of numpy that takes two."""

    def __init__(self, pick: np.ufunc, none: float):
        self.pick, self.value = pick.__name__, none

    def change(self):
        return self.pick, self.value

    @staticmethod
    def after(start, change):
        pick, value = change
        return value if start is None else float(getattr(np, pick)(start, value))


class Tail(Part):
    """The last values, `rows` at most, of several series."""

    def __init__(self, rows: int, series: int):
        self.rows, self.value = rows, tuple(np.empty(0) for _ in range(series))

    def push(self, *x: np.ndarray) -> list[np.ndarray]:
        """The values held with new ones behind them, of which the last are held from now on."""
        both = [np.concatenate([a, b]) for a, b in zip(self.value, x, strict=True)]
        self.value = tuple(b[len(b) - min(self.rows, len(b)) :].copy() for b in both)
        return both

    def change(self):
        return self.rows, self.value

    @staticmethod
    def after(start, change):
        rows, value = change
        both = value if start is None else tuple(np.concatenate([a, b]) for a, b in zip(start, value, strict=True))
        return tuple(b[len(b) - min(rows, len(b)) :] for b in both)


class Merged(Part):
    """Partial results of all rows so far, one column of an array."""

    def __init__(self, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.merge = merge

    def change(self):
        return None if self.value is None else (self.merge, self.value)

    @staticmethod
    def after(start, change):
        if change is None:
            return start
        merge, value = change
        with np.errstate(all="ignore"):
            return value if start is None else merge(start, value)


class Guessed(Part):
    """State whose change can't be told for a start that was not tried, and a count that rows only add to: (state, count).

    Ranges are run from a guess, the state of a first row. Runs from two starts often meet, as a bar's end resets the state: from
    then on they are one. change() says what became of each start that was tried.
    """

    def __init__(self, state: tuple) -> None:
        self.cold, self.value = state, (state, 0)

    def change(self):
        return {self.cold: self.value}

    @staticmethod
    def after(start, change):
        """The value behind; None if that start was not tried."""
        state, count = start if start is not None else (next(iter(change)), 0)
        if state not in change:
            return None
        end, more = change[state]
        return end, count + more
