"""A group's rows of a micro-batch that are more than are held."""

import tracemalloc

import numpy as np
import pandas as pd

from tidewell.operators.scan import Node
from tidewell.operators.spans import SpanStatistic
from tidewell.streaming import runner, sorting
from tidewell.streaming.stages import Chain, Rows


def frames(n, step, shuffled):
    rng = np.random.default_rng(3)
    at = rng.permutation(n) if shuffled else np.arange(n)
    for a in range(0, n, step):
        t = at[a : a + step]
        yield pd.DataFrame({"at": t // 3, "came": np.arange(a, a + len(t))})


def test_rows_in_order_by_runs(monkeypatch):
    monkeypatch.setattr(sorting, "HELD", 500)
    monkeypatch.setattr(sorting, "BLOCK", 40)
    for shuffled in (False, True):
        pieces = list(sorting.in_order(frames(5000, 130, shuffled), "at"))
        assert len(pieces) > 10
        assert all(a["at"].max() < b["at"].min() for a, b in zip(pieces[:-1], pieces[1:], strict=True))
        got = pd.concat(pieces)
        assert sorted(got["came"]) == list(range(5000))
        assert all(p[p["at"] == t]["came"].is_monotonic_increasing for p in pieces for t in p["at"].unique())
    same = [pd.DataFrame({"at": np.zeros(300), "came": np.arange(300)}), pd.DataFrame({"at": [np.nan, 1.0] * 300, "came": np.arange(600)})]
    got = pd.concat(sorting.in_order(iter(same * 2), "at"))
    assert len(got) == 1800 and (got["at"].iloc[:600] == 0).all() and (got["at"].iloc[600:1200] == 1).all() and got["at"].iloc[1200:].isna().all()
    assert list(sorting.in_order(iter([]), "at")) == []


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


def test_memory_does_not_grow_with_a_micro_batch(monkeypatch):
    monkeypatch.setattr(sorting, "HELD", 4000)
    monkeypatch.setattr(sorting, "BLOCK", 200)
    chain = Chain([Rows([Node(SpanStatistic, ["x", "__tick"], ["sum"], {"name": "sum"})])])

    def peak(n):
        run = runner._Run(chain, ["x"], [runner.AT], ["v"], ["sum"], False, ["g"], False)
        run.state = Value()
        rows = (pd.DataFrame({runner.AT: np.arange(a, a + 1000), "tw_x0": 1.0, "tw_ok0": True, "v": [f"value {k}" for k in range(1000)]}) for a in range(0, n, 1000))
        tracemalloc.start()
        last, seen = 0.0, 0
        for out in run.handleInputRows(("a",), rows, None):
            last, seen = out["tw_y0"].iloc[-1], seen + len(out)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen == n and last == n
        return most

    assert peak(80_000) < 2 * peak(8_000)
