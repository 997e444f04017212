"""Graphs of operators over ordered series, checked when built and compiled to DataFrame plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.timeunits import as_size
from ..operators import aggs, overlap
from ..operators.frames import Frame, Order, Span
from ..operators.rolling import Rolling
from ..operators.rolling import rolling as rolling
from ..operators.ranges import can_carry, reach, scan_ranges, scan_rows, scan_times, wanted
from ..operators.scan import IS_ROW, KERNELS, Arrays, Functor, Kernel, Node, among, mfm, scan, with_versions
from ..operators.spans import STATISTICS, Since, SpanLag, SpanStatistic, Windowed
from ..operators.windows import WID, Windows, as_time, last_of

#: Most panes of a hopping window: beyond, states of panes would be copied more often than rows.
MOST_PANES = 4096


@dataclass(frozen=True)
class Projection:
    """An operator that is a column expression of its inputs; `arrays` computes the same of arrays, between kernels of a stream."""

    name: str
    inputs: int | None
    outputs: tuple[str, ...]
    make: Callable[..., list[Column]]
    arrays: Callable[..., list[np.ndarray]] | None = None

    def columns(self, frame: Frame, args: list[Column]) -> list[Column]:
        return self.make(*args)


@dataclass(frozen=True)
class Sequential:
    """An operator that is a kernel run over the rows in order."""

    name: str
    inputs: int
    outputs: tuple[str, ...]
    make: Callable[..., Kernel]
    options: dict = field(default_factory=dict)
    ticks: bool = False  #: whether the kernel's last input is the time


@dataclass(frozen=True)
class Running:
    """A functor that accumulates since the start of its window (or of the series): per row, and as an aggregate."""

    name: str
    inputs: int
    outputs: tuple[str, ...]
    make: Callable[..., list[Column]]
    agg: str

    def columns(self, frame: Frame, args: list[Column]) -> list[Column]:
        return self.make(frame, *args)


Op = Projection | Sequential | Running | Rolling


def unary(name: str, n: int = 1) -> Projection:
    """A scalar function applied to each of n ports."""
    f = S.UNARY[name]
    return Projection(name, n, tuple(f"{name}{k}" if n > 1 else name for k in range(n)), lambda *a: [f(x) for x in a], lambda *a: [S.on_array(name, x) for x in a])


def binary(name: str) -> Projection:
    return Projection(name, 2, (name,), lambda a, b: [S.BINARY[name](a, b)], lambda a, b: [S.BINARY_ARRAYS[name](a, b)])


def clamp(low: float, high: float, n: int = 1) -> Projection:
    if low > high:
        raise ValueError("low is above high")
    return Projection("clamp", n, tuple(f"clamp{k}" if n > 1 else "clamp" for k in range(n)), lambda *a: [S.clamp(x, low, high) for x in a], lambda *a: [np.clip(x, low, high) for x in a])


def lerp(t: float) -> Projection:
    return Projection("lerp", 2, ("lerp",), lambda a, b: [S.lerp(a, b, t)], lambda a, b: [a + t * (b - a)])


def functor(f: Callable[..., Column | tuple[Column, ...]], inputs: int, outputs: int | tuple[str, ...] = 1) -> Projection:
    """A user's function of columns; a tuple gives several ports. No inputs: a constant."""
    names = outputs if isinstance(outputs, tuple) else tuple(f"value{k}" if outputs > 1 else "value" for k in range(outputs))

    def make(*a: Column) -> list[Column]:
        got = f(*a)
        got = list(got) if isinstance(got, tuple) else [got]
        if len(got) != len(names):
            raise ValueError(f"the functor gave {len(got)} outputs, not {len(names)}")
        return [(g if isinstance(g, Column) else F.lit(g)).cast("double") for g in got]

    return Projection("functor", inputs, names, make)


def batch_functor(f: Callable[..., pd.Series | tuple[pd.Series, ...]], inputs: int, outputs: int | tuple[str, ...] = 1) -> Projection:
    """A user's function of pandas series, run in Arrow batches; a tuple gives several ports."""
    names = outputs if isinstance(outputs, tuple) else tuple(f"value{k}" if outputs > 1 else "value" for k in range(outputs))
    schema = ", ".join(f"`{n}` double" for n in names)

    def make(*a: Column) -> list[Column]:
        @F.pandas_udf(schema)
        def run(cols: pd.DataFrame) -> pd.DataFrame:
            got = f(*(cols[c].astype("float64") for c in cols.columns))
            return pd.DataFrame(dict(zip(names, got if isinstance(got, tuple) else (got,), strict=True)), index=cols.index).astype("float64")

        one = run(F.struct(*(x.alias(f"c{k}") for k, x in enumerate(a))))
        return [one[n] for n in names]

    def arrays(*a: np.ndarray) -> list[np.ndarray]:
        got = f(*(pd.Series(x) for x in a))
        return [np.asarray(y, dtype=np.float64) for y in (got if isinstance(got, tuple) else (got,))]

    return Projection("batch_functor", inputs, names, make, arrays)


def stateful(make: Callable[[], Callable], inputs: int, outputs: tuple[str, ...] = ("value",)) -> Sequential:
    """A user's stateful callable, made once a group and called for every row in order."""
    return Sequential("stateful", inputs, outputs, lambda: Functor(make, inputs, outputs))


def kernel(name: str, **options: Any) -> Sequential:
    """A sequential operator by name with its options."""
    k = KERNELS[name]
    return Sequential(name, k.inputs, k.outputs, k, options)


def sized(name: str, by: str) -> Sequential:
    """A rolling statistic whose span at each row goes as far back as its last input says, by "rows" or "time" (in units of the
    order's time, microseconds for timestamps); of what has left nothing comes back: see spans.SpanStatistic."""
    inputs, outputs, *_ = STATISTICS[name]
    if by not in ("rows", "time"):
        raise ValueError("a span is sized by rows or time")
    return Sequential(name, inputs + 1, outputs, SpanStatistic, {"name": name, "sized": by}, ticks=True)


def windowed_operator(make: Callable[[], object], inputs: int, outputs: tuple[str, ...] = ("value",), *, rows: int | None = None, time: object = None) -> Sequential:
    """A user's operator over the last rows or the last time, with add(), evict() and value(), and size() for a span that
    changes as it goes: see spans.Windowed."""
    span = Span(rows=rows, time=time)
    extent = {"rows": span.rows} if span.kind == "rows" else {"time": float(as_size(time))} if span.kind == "time" else {}
    return Sequential("windowed", inputs, outputs, lambda **e: Windowed(make, inputs, outputs, **e), extent, ticks=True)


def money_flow() -> Projection:
    return Projection("mfm", 3, ("mfm",), lambda h, lo, c: [F.when(h != lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0)], lambda h, lo, c: [mfm(h, lo, c)])


def directional() -> Projection:
    """+DI, -DI and DX from +DM, -DM and the range."""

    def make(p: Column, m: Column, a: Column) -> list[Column]:
        return [F.when(a != 0, p / a).otherwise(0.0), F.when(a != 0, m / a).otherwise(0.0), F.when(p + m != 0, F.abs(p - m) / (p + m) * 100).otherwise(0.0)]

    def arrays(p: np.ndarray, m: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
        part = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y != 0)
        return [part(p, a), part(m, a), part(np.abs(p - m), p + m) * 100]

    return Projection("directional", 3, ("plus_di", "minus_di", "dx"), make, arrays)


# a row with a null in an input of an accumulating functor leaves it as it was

def _first(f: Frame, x: Column) -> Column:
    return f.keep(F.first(x, ignorenulls=True).over(f.order.running()))


def _last(f: Frame, x: Column) -> Column:
    return f.keep(F.last(x, ignorenulls=True).over(f.order.running()))


def _pair(f: Frame, a: Column, b: Column) -> tuple[Column, Column]:
    both = a.isNotNull() & b.isNotNull()
    return f.keep(F.when(both, a)), f.keep(F.when(both, b))


def _ratio_to_first(f: Frame, x: Column) -> list[Column]:
    first, last = _first(f, x), _last(f, x)
    return [S.ieee_div(last - first, first)]


def _log_to_first(f: Frame, x: Column) -> list[Column]:
    first, last = _first(f, x), _last(f, x)
    return [S.ieee_ln(last) - S.ieee_ln(first)]


def _running_ohlc(f: Frame, x: Column) -> list[Column]:
    w = f.order.running()
    return [_first(f, x), f.keep(F.max(x).over(w)), f.keep(F.min(x).over(w)), _last(f, x)]


def _running_flow(f: Frame, b: Column, s: Column) -> list[Column]:
    b, s = _pair(f, b, s)
    return [f.total(b) - f.total(s)]


def _running_imba(f: Frame, b: Column, a: Column) -> list[Column]:
    b, a = _pair(f, b, a)
    sb, sa = f.total(b), f.total(a)
    return [S.ieee_div(sb - sa, sb + sa)]


def _running_weighted(f: Frame, x: Column, w: Column) -> list[Column]:
    x, w = _pair(f, x, w)
    s = f.total(w)
    return [F.when(s != 0, f.total(x * w) / s).when(s.isNotNull(), float("nan"))]


_RUNNING: dict[str, tuple[int, tuple[str, ...], Callable, str]] = {
    "sum": (1, ("sum",), lambda f, x: [f.total(x)], "sum"),
    "avg": (1, ("avg",), lambda f, x: [f.mean(x)], "avg"),
    "avg_weighted": (2, ("avg_weighted",), _running_weighted, "avg_weighted"),
    "count": (0, ("count",), lambda f, *a: [f.keep(F.row_number().over(f.order.window()).cast("double"))], "count"),
    "ohlc": (1, ("open", "high", "low", "close"), _running_ohlc, "ohlc"),
    "simple_return": (1, ("simple_return",), _ratio_to_first, "simple_return"),
    "log_return": (1, ("log_return",), _log_to_first, "log_return"),
    "order_flow": (2, ("order_flow",), _running_flow, "order_flow"),
    "book_imba": (2, ("book_imba",), _running_imba, "book_imba"),
}
RUNNING = tuple(_RUNNING)


def running(name: str) -> Running:
    inputs, outputs, make, agg = _RUNNING[name]
    return Running(name, inputs, outputs, make, agg)


@dataclass(frozen=True)
class Edge:
    node: str
    port: int = 0

    @classmethod
    def parse(cls, text: str) -> Edge:
        """'name' or 'name.port'."""
        parts = text.split(".")
        if len(parts) > 2 or not parts[0]:
            raise ValueError(f"not an edge: {text!r}")
        if len(parts) == 2 and not re.fullmatch(r"\d+", parts[1]):
            raise ValueError(f"not a port: {text!r}")
        return cls(parts[0], int(parts[1]) if len(parts) == 2 else 0)


class Ref:
    """A node of a graph; ref[port] is an edge from it."""

    def __init__(self, graph: Graph, name: str):
        self.graph, self.name = graph, name

    def __getitem__(self, port: int) -> Edge:
        return Edge(self.name, port)

    def __or__(self, port: int) -> Edge:
        return Edge(self.name, port)

    def alias(self, *names: str) -> Ref:
        self.graph._alias(self.name, names)
        return self

    def depends(self, *edges: EdgeLike) -> Ref:
        self.graph._depends(self.name, edges)
        return self


EdgeLike = str | Edge | Ref | Iterable[Any]


class Graph:
    """A directed acyclic graph of operators with one root, whose ports are the input columns.

    Nodes are named, or named for the caller; edges are "node", "node.port", an alias of a port, an Edge or a Ref, and
    may name nodes that are added later. Errors in structure raise ValueError, the last ones when compiled.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self._ops: dict[str, Op] = {}
        self._args: dict[str, list[Edge]] = {}
        self._ports: dict[str, list[str]] = {}
        self._aliases: dict[str, Edge] = {}
        self._root = self._aux = self._supp = None
        self._trigger: Callable | None = None
        self._aux_args: list[Edge] = []
        self._links: dict[str, dict[str, Edge]] = {}
        self._outputs: list[Edge] = []
        self._fresh = count()

    # building

    def _new(self, name: str | None) -> str:
        name = name if name is not None else f"node{next(self._fresh)}"
        if not name or "." in name:
            raise ValueError(f"not a name: {name!r}")
        if name in self._args or name in self._ports or name == self._aux or name in self._aliases:
            raise ValueError(f"name taken: {name!r}")
        return name

    def root(self, name: str = "root", ports: int | list[str] = 1) -> Ref:
        """The input; ports by number or by column name, which are aliases as well."""
        if self._root is not None:
            raise ValueError("the graph has a root")
        name = self._new(name)
        columns = [f"in{k}" for k in range(ports)] if isinstance(ports, int) else list(ports)
        self._root, self._ports[name] = name, columns
        if not isinstance(ports, int):
            self._alias(name, columns)
        return Ref(self, name)

    def _alias(self, name: str, names: Iterable[str]) -> None:
        names = list(names)
        if name not in self._ports:
            raise ValueError("only a root's ports have aliases")
        if len(names) > len(self._ports[name]):
            raise ValueError("more aliases than ports")
        for k, a in enumerate(names):
            if a in self._aliases or a in self._args or names.count(a) > 1:
                raise ValueError(f"alias taken: {a!r}")
            self._aliases[a] = Edge(name, k)

    def add(self, *args: Any) -> Ref:
        """add(name, op, *edges) or add(op, *edges)."""
        name, op, edges = (args[0], args[1], args[2:]) if isinstance(args[0], str) else (None, args[0], args[1:])
        name = self._new(name)
        self._ops[name], self._args[name] = op, []
        self._depends(name, edges)
        return Ref(self, name)

    def _edges(self, edges: Iterable[EdgeLike]) -> list[Edge]:
        out: list[Edge] = []
        for e in edges:
            if isinstance(e, Edge):
                out.append(e)
            elif isinstance(e, Ref):
                out.append(Edge(e.name))
            elif isinstance(e, str):
                out.append(self._aliases.get(e) or Edge.parse(e))
            else:
                out += self._edges(e)
        return out

    def _depends(self, name: str, edges: Iterable[EdgeLike]) -> None:
        got = self._edges(edges)
        if any(e.node in (self._aux, self._supp) for e in got):
            raise ValueError("a node can't depend on a trigger or on parameters")
        if name == self._aux:
            if any(e.node != self._root for e in got):
                raise ValueError("a trigger reads ports of the root")
            self._aux_args += got
        else:
            self._args[name] += got

    def aux(self, name: str, trigger: Callable[[DataFrame, Order], Windows], *edges: EdgeLike) -> Ref:
        """The trigger that ends windows; it reads ports of the root."""
        if self._aux is not None:
            raise ValueError("the graph has a trigger")
        self._aux, self._trigger = self._new(name), trigger
        self._depends(name, edges)
        return Ref(self, name)

    def supp_root(self, name: str, ports: list[str]) -> Ref:
        """Columns of a parameter table."""
        if self._supp is not None:
            raise ValueError("the graph has parameters")
        self._supp = self._new(name)
        self._ports[name] = list(ports)
        self._alias(name, ports)
        return Ref(self, name)

    def supp_link(self, node: str | Ref, **options: EdgeLike) -> Graph:
        """Takes options of a sequential or rolling node (there: rows or time) from ports of the parameters."""
        name = node.name if isinstance(node, Ref) else node
        if self._supp is None or not isinstance(self._ops.get(name), Sequential | Rolling):
            raise ValueError(f"no parameters for {name!r}")
        for k, e in options.items():
            edge = self._edges([e])[0]
            if edge.node != self._supp or edge.port >= len(self._ports[self._supp]):
                raise ValueError(f"not a parameter: {e!r}")
            self._links.setdefault(name, {})[k] = edge
        return self

    def add_output(self, *edges: EdgeLike) -> Graph:
        self._outputs += self._edges(edges)
        return self

    def set_output(self, *edges: EdgeLike) -> Graph:
        self._outputs = self._edges(edges)
        return self

    # looking

    @property
    def size(self) -> int:
        return len(self._args) + (self._root is not None)

    @property
    def empty(self) -> bool:
        return not self.size

    def __len__(self) -> int:
        return self.size

    def __contains__(self, name: str) -> bool:
        return name in self._args or name in self._ports

    contains = __contains__

    def node(self, name: str) -> Op | list[str]:
        return self._ops[name] if name in self._ops else self._ports[name]

    def args_of(self, name: str) -> list[Edge]:
        return list(self._args.get(name, ()))

    def pred_of(self, name: str) -> list[str]:
        return list(dict.fromkeys(e.node for e in self.args_of(name)))

    def succ_of(self, name: str) -> list[str]:
        return [n for n, a in self._args.items() if any(e.node == name for e in a)]

    def is_root(self, name: str) -> bool:
        return name == self._root or name in self._args and not self._args[name]

    def is_leaf(self, name: str) -> bool:
        return not self.succ_of(name)

    def roots(self) -> list[str]:
        return [n for n in ([self._root] if self._root else []) + list(self._args) if self.is_root(n)]

    def leaves(self) -> list[str]:
        return [n for n in ([self._root] if self._root else []) + list(self._args) if self.is_leaf(n)]

    def outputs(self) -> list[Edge]:
        return list(self._outputs)

    def num_inputs(self) -> int:
        return len(self._ports.get(self._root, ()))

    def num_outputs(self) -> int:
        return len(self._outputs)

    def _width(self, name: str) -> int:
        return len(self._ports[name]) if name in self._ports else len(self._ops[name].outputs)

    def order(self) -> list[str]:
        """Nodes so that every node comes behind those it reads; raises ValueError if there is a cycle."""
        left = {n: set(self.pred_of(n)) - set(self._ports) for n in self._args}
        out: list[str] = []
        while left:
            ready = [n for n, p in left.items() if not p & left.keys()]
            if not ready:
                raise ValueError("the graph has a cycle")
            out += ready
            for n in ready:
                del left[n]
        return out

    def validate(self) -> None:
        if self._root is None:
            raise ValueError("the graph has no root")
        for n, args in self._args.items():
            op = self._ops[n]
            if op.inputs is not None and len(args) != op.inputs and not (isinstance(op, Running) and op.inputs == 0):
                raise ValueError(f"{n!r} reads {op.inputs} inputs, not {len(args)}")
            for e in args:
                if e.node not in self:
                    raise ValueError(f"{n!r} reads unknown node {e.node!r}")
                if e.port >= self._width(e.node):
                    raise ValueError(f"{e.node!r} has no port {e.port}")
        if not self._outputs:
            raise ValueError("the graph has no output")
        for e in self._outputs:
            if e.node not in self or e.node == self._supp or e.port >= self._width(e.node):
                raise ValueError(f"no such output: {e}")
        if any(e.port >= self._width(self._root) for e in self._aux_args):
            raise ValueError("the trigger reads a port that the root lacks")
        self.order()

    # compiling

    def names(self) -> list[str]:
        """Column names of the outputs: node.port's own name behind its node's, made unique."""
        out: list[str] = []
        for e in self._outputs:
            port = self._ports[e.node][e.port] if e.node in self._ports else self._ops[e.node].outputs[e.port]
            name = port if e.node in self._ports else f"{e.node}_{port}" if self._width(e.node) > 1 else e.node
            while name in out:
                name += "_"
            out.append(name)
        return out

    def _needed(self) -> set[str]:
        need, todo = set(), [e.node for e in self._outputs]
        while todo:
            n = todo.pop()
            if n not in need:
                need.add(n)
                todo += self.pred_of(n)
        return need

    def _kernel(self, name: str, stream: bool, cut: bool = False) -> Sequential | None:
        """The node as a kernel, where it is or must be one: on a stream, over a time, with parameters, or where groups are cut;
        and of two series over rows, where a sliding frame would go through the span's rows anew for each of several statistics."""
        op = self._ops[name]
        if isinstance(op, Sequential):
            return op
        if isinstance(op, Rolling) and (stream or cut or op.span.kind == "time" or name in self._links or op.span.kind == "rows" and op.inputs == 2):
            make, options = op.kernel()
            if name in self._links:
                options = {k: v for k, v in options.items() if k not in ("rows", "time")}
            return Sequential(op.name, op.inputs, op.outputs, make, options, ticks=True)
        if isinstance(op, Projection) and stream and op.arrays is not None and any(self._kernel(p, True) for p in self.pred_of(name) if p in self._ops):
            return Sequential(op.name, len(self._args[name]), op.outputs, partial(Arrays, op.arrays, len(self._args[name]), op.outputs))
        if isinstance(op, Running) and (stream or cut):
            if op.name in ("sum", "avg", "avg_weighted"):
                return Sequential(op.name, op.inputs, op.outputs, SpanStatistic, {"name": op.name}, ticks=True)
            return Sequential(op.name, op.inputs, op.outputs, Since, {"name": op.name}, ticks=op.name == "count")
        return None

    def nodes(self, columns: dict[str, str], prefix: str = "__") -> tuple[list[Node], dict[Edge, str]]:
        """The whole graph as kernels of one pass, and the column of each edge: what a stream's stages run. `columns` says where
        ports are found; a user's function of columns has no place in it."""
        self.validate()
        need = self._needed()
        at = {Edge(self._root, k): columns[p] for k, p in enumerate(self._ports[self._root])}
        out: list[Node] = []
        if self._links:
            raise ValueError("a stage of a stream has no parameters")
        for n in self.order():
            if n not in need:
                continue
            op = self._kernel(n, True)
            if op is None:
                whole: Projection = self._ops[n]
                if whole.arrays is None or not self._args[n]:
                    raise ValueError(f"{n!r} is a function of columns, which can't stand in a stage of a stream")
                op = Sequential(whole.name, len(self._args[n]), whole.outputs, partial(Arrays, whole.arrays, len(self._args[n]), whole.outputs))
            names = [f"{prefix}{n}_{k}" for k in range(len(op.outputs))]
            args = [at[a] for a in self._args[n]][: op.inputs]
            out.append(Node(op.make, [*args, *(["__tick"] if op.ticks else [])], names, dict(op.options)))
            at |= {Edge(n, k): x for k, x in enumerate(names)}
        return out, at

    def run(self, df: DataFrame, order: Order, *, inputs: dict[str, str] | None = None, parameters: DataFrame | None = None, live: bool = False, since: str | None = None, ranges: int | None = None, late: str | None = None) -> DataFrame:
        """One row out for each row in: groups, order keys, and the outputs under names().

        Nodes that no output needs are left out. Column operators become projections and windows over one sorted
        shuffle of the groups; all sequential nodes that are ready run in one pass. On a stream every operator that looks
        at other rows is a kernel of one pass, whose state is kept by group between micro-batches; see stream_scan(). `parameters` has a
        row a group. With `live` the table's own columns hold the parameters, and a change takes effect from its row on; with
        `since`, a time column of `parameters`, these are versions, and the latest one not later than a row holds for it; on a
        stream they are a stream as well, and `late` should be given, as two streams come in no common order.

        `ranges` says into how many ranges a table's groups are cut (see ranges), 0 for none; by default they are where the table
        is large and a group is too large for a task. Where they are, every operator over other rows is a kernel, and only
        kernels that can't be cut (users' own, bands, doubling windows, lags over a time) take a group a task. `late` is for
        streams: see stream_scan().
        """
        self.validate()
        stream = df.isStreaming
        if stream:
            from ..streaming.runner import stream_scan
        ranges = 0 if stream else wanted(df, order) if ranges is None else ranges
        columns = {p: (inputs or {}).get(p, p) for p in self._ports[self._root]}
        given: list[str] = []
        if parameters is not None and since is not None and stream:
            df, given = among(df, order, parameters, since)
            live = True
        elif parameters is not None and since is not None:
            df, live = with_versions(df, order, parameters, since), True
        elif parameters is not None:
            df = df.join(parameters, list(order.groups), "left")
        need = self._needed()
        kernels = {n: k for n in self._args if n in need and (k := self._kernel(n, stream, ranges > 0)) is not None}
        at: dict[Edge, str] = {}
        taken = dict.fromkeys(order.columns)
        base = [F.col(c) for c in taken]
        for k, p in enumerate(self._ports[self._root]):
            at[Edge(self._root, k)] = f"__in{k}"
            base.append(F.col(columns[p]).cast("double").alias(f"__in{k}"))
        if self._supp is not None:
            for k, p in enumerate(self._ports[self._supp]):
                at[Edge(self._supp, k)] = f"__p{k}"
                base.append(F.col(f"__v_{p}" if p in given else p).cast("double").alias(f"__v{k}" if given else f"__p{k}"))
            if given:
                base.append(F.col(IS_ROW))
        if any(k.ticks for k in kernels.values()):
            base.append(order.tick(df).cast("double").alias("__tick"))
        df = df.select(*base)
        todo, passed, ready = [n for n in self.order() if n in need], False, False
        while todo:
            rest: list[str] = []
            for n in todo:  # columns first
                op = self._ops[n]
                if n in kernels or any(a not in at for a in self._args[n]):
                    rest.append(n)
                    continue
                frame = Frame(df, order, op.span if isinstance(op, Rolling) else Span())
                made = op.columns(frame, [F.col(at[a]) for a in self._args[n]])
                df, ready = frame.df, ready or isinstance(op, Rolling | Running)
                names = {f"__{n}.{k}": c for k, c in enumerate(made)}
                df = df.withColumns(names).drop(*frame.added)
                df = df.withColumnsRenamed({x: x.replace(".", "_") for x in names})
                at |= {Edge(n, k): x.replace(".", "_") for k, x in enumerate(names)}
            nodes: list[Node] = []
            later: list[str] = []
            kind: str | None = None
            for n in rest:  # then every sequential node that is ready or reads one of this pass, of the kind of the first
                op = kernels.get(n)
                if op is None or any(a not in at for a in self._args[n]):
                    later.append(n)
                    continue
                names = [f"__{n}_{k}" for k in range(len(op.outputs))]
                links = {k: at[e] for k, e in self._links.get(n, {}).items()}
                args = [at[a] for a in self._args[n]][: op.inputs]
                node = Node(op.make, [*args, *(["__tick"] if op.ticks else [])], names, dict(op.options) | links, live and bool(links))
                own = _kind(node) if ranges else ""
                if kind not in (None, own):
                    later.append(n)
                    continue
                kind = own
                nodes.append(node)
                at |= {Edge(n, k): x for k, x in enumerate(names)}
            if nodes:
                if stream and passed:
                    raise ValueError("a stream has one pass of kernels; a user's function of columns can't stand between two of them")
                passed = True
                df = stream_scan(df, order, nodes, late, {f"__v{k}": f"__p{k}" for k in range(len(self._ports[self._supp]))} if given else None) if stream else _pass(df, order, nodes, kind, ranges, ready)
                ready = False
            todo = later
        return df.select(*taken, *(F.col(at[e]).alias(name) for e, name in zip(self._outputs, self.names(), strict=True)))


def _kind(node: Node) -> str:
    """How a node's groups can be cut: by what is carried over, in blocks of rows or of time, or not at all ("")."""
    if node.make in (SpanStatistic, SpanLag) and not node.asked and not node.options.get("sized"):
        for kind in ("rows", "time"):
            if node.options.get(kind):
                return "" if node.make is SpanLag and kind == "time" else kind
    return "carry" if not node.live and can_carry(node) else ""


def _pass(df: DataFrame, order: Order, nodes: list[Node], kind: str, ranges: int, ready: bool) -> DataFrame:
    if kind == "carry":
        return scan_ranges(df, order, nodes, ranges)
    if kind == "rows":
        back = reach(nodes, {n.names[0]: n.options["rows"] for n in nodes})
        return scan_rows(df, order, nodes, int(back), ranges)
    if kind == "time":
        return scan_times(df, order, nodes, "__tick", reach(nodes, {n.names[0]: n.options["time"] for n in nodes}), ranges)
    return scan(df, order, nodes, ready)


@dataclass
class AggGraph:
    """Windowed aggregation: named input columns, one window, aggregators."""

    _inputs: list[str] = field(default_factory=list)
    _window: Callable[[DataFrame, Order], Windows] | None = None
    _aggs: list[tuple[str | Callable, list[str], dict, list[str]]] = field(default_factory=list)

    def input(self, *columns: str) -> AggGraph:
        self._inputs += columns
        return self

    def window(self, assign: Callable[[DataFrame, Order], Windows]) -> AggGraph:
        if self._window is not None:
            raise ValueError("the graph has a window")
        self._window = assign
        return self

    def add(self, name: str | aggs.Mergeable | Callable[..., list[Column]], columns: list[str] | tuple[str, ...] = (), *, into: list[str] | None = None, **options: Any) -> AggGraph:
        """An aggregator of columns by name, a user's one by parts (aggs.Mergeable), or a user's function of the row order and
        columns that gives aggregate columns; `into` names its outputs, and must for a user's function."""
        for c in columns:
            if c not in self._inputs:
                raise ValueError(f"unknown column {c!r}")
        if callable(name) and not into:
            raise ValueError("a user's aggregator needs names for its outputs")
        names = list(name.outputs) if isinstance(name, aggs.Mergeable) else into if callable(name) else aggs.outputs(name, list(columns))
        if into is not None and len(into) != len(names):
            raise ValueError(f"{name} has {len(names)} outputs")
        self._aggs.append((name, list(columns), options, into or names))
        return self

    def _by_parts(self) -> list[tuple[aggs.Mergeable, list[str], list[str]]]:
        """Every aggregator as one that is put together from parts: (aggregator, columns, outputs)."""
        out = []
        for name, cols, options, into in self._aggs:
            if isinstance(name, aggs.Mergeable):
                out.append((name, cols, into))
            elif isinstance(name, str):
                alone = aggs.AGGREGATORS[name][0] is None  # one output a column
                out += [(aggs.by_parts(name, **options), [c], [n]) for n, c in zip(into, cols, strict=True)] if alone else [(aggs.by_parts(name, **options), cols, into)]
            else:
                raise ValueError("a function of columns can't be put together from parts; an aggregator by parts can")
        return out

    def run(self, df: DataFrame, order: Order, *, emit_partial: bool = True, time_name: str = "window_ts", late: str | None = None) -> DataFrame:
        """One row a window: groups, the window's time, the aggregates. Without emit_partial each group's open last
        window is left out; with it, it comes as at the end of input. On a stream windows come when they have ended: see
        stream_windows()."""
        if self._window is None or not self._aggs:
            raise ValueError("the graph needs a window and an aggregator")
        if df.isStreaming:
            from ..streaming.runner import stream_body

            return stream_body(df, order, self._window, [(into, agg, cols) for agg, cols, into in self._by_parts()], late, time_name)
        if hasattr(self._window, "emitter"):
            make, read = self._window.emitter
            what = {f"a{k}": x for k, x in enumerate(self._by_parts())}
            return overlap.emitted(df, order, make, read, what, time_name).select(*order.groups, time_name, *(n for *_, into in self._aggs for n in into))
        df = df.select(*dict.fromkeys([*order.columns, *self._inputs]))
        if hasattr(self._window, "hops") and emit_partial and all(isinstance(a[0], str | aggs.Mergeable) for a in self._aggs):
            size, step = self._window.hops
            pane = overlap.pane_of(size, step)
            if pane is not None and size >= 4 * step and size / pane <= MOST_PANES:
                out = overlap.paned(df, order, size, step, pane, WID, {f"a{k}": x for k, x in enumerate(self._by_parts())})
                ends = as_time(df, order, F.col(WID) * F.lit(step) + F.lit(size))
                return out.select(*order.groups, ends.alias(time_name), *(n for *_, into in self._aggs for n in into))
        parts = {f"a{k}": (name, cols, into) for k, (name, cols, _, into) in enumerate(self._aggs) if isinstance(name, aggs.Mergeable)}

        def make(seq: Column) -> dict[str, Column]:
            out = {}
            for name, cols, options, into in self._aggs:
                if not isinstance(name, aggs.Mergeable):
                    out |= dict(zip(into, name(seq, *cols, **options) if callable(name) else aggs.columns(name, seq, cols, **options), strict=True))
            return out

        if not parts:
            return windowed(df, order, self._window, make, emit_partial, time_name)
        w = self._window(df, order)
        ids = [*order.groups, WID]
        out = windowed(df, order, lambda *_: w, make, emit_partial, time_name, keep_id=True)
        user = aggs.merged(w.df, order, ids, parts).withColumnsRenamed({c: f"__{c}" for c in ids})
        out = out.join(user, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ids], "left")
        return out.select(*order.groups, time_name, *(n for *_, into in self._aggs for n in into))


def windowed(df: DataFrame, order: Order, assign: Callable[[DataFrame, Order], Windows], make: Callable[[Column], dict[str, Column]], emit_partial: bool, time_name: str, arrival: str | None = None, keep_id: bool = False) -> DataFrame:
    """Rows by window, aggregated; optionally with the time of the row that ended each window, and the window's number."""
    w = assign(df, order)
    made = make(order.seq())
    by_rows = w.inclusive or not _uses_only_id(w.ends)
    extra = {"__shut": w.shut} if w.shut is not None else {}
    if by_rows:
        extra["__end"] = w.ends
    if arrival:
        extra |= {"__first": F.min(order.time), "__last": F.max(order.time)}
    extra = extra or {"__rows": F.count("*")}
    out = w.df.groupBy(*order.groups, WID).agg(*(c.alias(n) for n, c in {**made, **extra}.items()))
    out = out.withColumn(time_name, F.col("__end") if by_rows else w.ends)
    if arrival:
        nxt = F.lead("__first").over(Window.partitionBy(*order.groups).orderBy(WID))
        out = out.withColumn(arrival, F.col("__last") if w.inclusive else nxt)
    if not emit_partial:
        out = out.withColumn("__top", last_of(order))
        out = out.filter(F.col("__shut") if w.shut is not None else F.col(WID) < F.col("__top"))
    return out.select(*order.groups, time_name, *([arrival] if arrival else []), *made, *([WID] if keep_id else []))


def _uses_only_id(ends: Column) -> bool:
    return WID in str(ends)


class TumbleGraph:
    """A graph of functors that start anew with every window, and the trigger that ends windows.

    Where every output is an accumulating functor of input columns, it is a grouped aggregate; other graphs run per
    row within their window and the last row of each window is taken.
    """

    def __init__(self, graph: Graph):
        graph.validate()
        if graph._trigger is None:
            raise ValueError("the graph has no trigger")
        self.graph = graph

    def num_inputs(self) -> int:
        return self.graph.num_inputs()

    def num_outputs(self) -> int:
        return self.graph.num_outputs()

    def names(self) -> list[str]:
        return self.graph.names()

    def _direct(self) -> bool:
        g = self.graph
        return all(isinstance(g._ops.get(e.node), Running) and all(a.node == g._root for a in g._args[e.node]) for e in g._outputs)

    def run(self, df: DataFrame, order: Order, *, inputs: dict[str, str] | None = None, emit_partial: bool = False, time_name: str = "window_ts", arrival: str | None = None, late: str | None = None) -> DataFrame:
        """One row a window that has ended: groups, the window's time, the outputs at its last row. On a stream a window ends with
        the row or, given `late`, with the time that ends it: see stream_scan()."""
        g = self.graph
        ports = g._ports[g._root]
        columns = {p: (inputs or {}).get(p, p) for p in ports}
        df = df.select(*dict.fromkeys(order.columns), *(F.col(columns[p]).cast("double").alias(p) for p in dict.fromkeys(ports) if p not in order.columns))
        if df.isStreaming:
            from .pipeline import Pipeline

            return Pipeline().add_stage(self).run(df, order, late=late, time_name=time_name).drop(*([] if arrival else [order.time])).withColumnsRenamed({order.time: arrival} if arrival else {})
        if self._direct():

            def make(seq: Column) -> dict[str, Column]:
                out = {}
                for e, name in zip(g._outputs, g.names(), strict=True):
                    op = g._ops[e.node]
                    cols = [ports[a.port] for a in g._args[e.node]][: op.inputs]
                    out[name] = aggs.columns(op.agg, seq, cols)[e.port]
                return out

            return windowed(df, order, g._trigger, make, emit_partial, time_name, arrival)
        w = g._trigger(df, order)
        inner = Order((*order.groups, WID), order.time, order.ties)
        rows = g.run(w.df, inner)
        given = lambda d, o: Windows(rows, w.ends, None if w.shut is None else F.lit(True), w.inclusive)
        if w.shut is not None and not emit_partial:
            shut = w.df.groupBy(*order.groups, WID).agg(w.shut.alias("__s")).filter("__s").drop("__s")
            rows = rows.join(shut, [*order.groups, WID])
        return windowed(rows, order, given, lambda seq: {n: F.max_by(n, seq) for n in g.names()}, emit_partial, time_name, arrival)
