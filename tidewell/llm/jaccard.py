"""Similarity join on word shingles: group counts as points, leaf nodes and trees whose boxes bound the overlap, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BITS_AT_MOST, bit_table, by_group, components, cut, discard, in_table, keep, lean, release, slices

#: Coordinates of a point: shingles are hashed into so many groups and counted.
GROUPS = 256
#: A set's keys are as many as linked sets need to share one of, and one more for so many of its members.
SLACK = 20
#: Sets with a key in common up to which all their pairs are counted: at first, and among sets with many heavier keys.
LIGHT, MEDIUM = 16, 64
#: Members of a leaf of a tree, and of a leaf node that is kept as a row.
LEAF, NODE = 32, 256
#: Keys just before a key that are looked at, to make a pair that shares several keys from few of them.
BEFORE = 8
#: Rows of one key that one task orders, members that one task compares with a copy of the centre's set, and nodes that it
#: joins with a copy of a node.
SALTED, STAR, PARTNERS = 4096, 2000, 8
#: Pairs for each member of joined nodes, up to which all pairs are candidates at once, and how often less than all are tried.
CROWDED, TRIES = 4, 6

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.array([(i * 0x9E3779B97F4A7C15) % (1 << 64) for i in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The text's distinct `width`-word shingles, fewer words: the whole sequence as one, in the order that all sets share.

    A shingle is a 64-bit integer: 255 less its words' bytes, at most 255, above 56 bits of its hash. So the longest come
    first, which are the rarest: neither a statistic nor a sample of the corpus is needed to tell.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k * (k < width), dtype=np.uint64)
    for i in range(k):
        out = mix(out + h[i : n + i] + _STEP[i % 8])
    total = np.cumsum(np.concatenate([[0], size]))
    short = 255 - np.minimum(total[k:] - total[:n], 255)
    return np.unique(out >> np.uint64(8) | short.astype(np.uint64) << np.uint64(56))


def links(a: int, b: int, both: int, percent: int) -> bool:
    """Whether sets of a and b members with `both` in common reach the similarity."""
    return 100 * both >= percent * (a + b - both)


def left_out(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a set of n that are not among its keys."""
    return np.maximum(0, -(-n * percent // 100) - 1 - n // SLACK)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Keys that linked sets of a and b members have in common at least.

    Linked sets have percent (a + b) / (100 + percent) members in common. Let A be the set whose last key comes first:
    members in common that are keys of A are keys of both, so only those that A leaves out can be missing.
    """
    return np.maximum(1, -(-percent * (a + b) // (100 + percent)) - np.maximum(left_out(a, percent), left_out(b, percent)))


def needed_of(n: Column, percent: int) -> Column:
    """The least that needed() gives for a set of n members and any that can be linked with it."""
    share = lambda x: F.floor((x * percent + 99) / 100)
    least = share(n)
    return F.least(share(least), 1 + F.floor(least / SLACK)).cast("long")


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def packed(p: np.ndarray) -> bytes:
    """A point as one byte a coordinate, or four where a count needs them."""
    return p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Points as rows, in one byte a coordinate if all fit."""
    if all(len(r) == GROUPS for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, dtype=np.uint8 if len(r) == GROUPS else np.uint32).astype(np.uint32) for r in rows])


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No more members than the summed smaller counts can be in common."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


class CountRTree:
    """R-tree of group counts, packed by sorting; its boxes bound the overlap of everything below them.

    With labels, points of a frequent label are packed together, and only pairs of different labels are of interest: two
    nodes that hold one label between them are not joined, so a label with many points costs no more than their number.
    A label below 0 is like no other. The points may themselves be boxes, with the least size below each in `least`;
    then a box is also joined with itself. `visited` counts the pairs of nodes looked at.
    """

    def __init__(self, points: np.ndarray, percent: int, labels: np.ndarray | None = None, least: np.ndarray | None = None):
        self.percent, self.boxes, self.visited = percent, least is not None, 0
        one = np.arange(len(points)) if labels is None else np.unique(labels, return_inverse=True)[1]
        if labels is not None:
            one = np.where(labels < 0, -1, one)
        size = points.sum(axis=1, dtype=np.int64) if least is None else least
        first = np.where((np.bincount(one[one >= 0], minlength=1)[one] >= LEAF) & (one >= 0), one, -1) if len(points) else one
        self.order = np.lexsort((*points.T[::-1], size, first))
        self.points, self.size, self.labels = points[self.order], size[self.order], one[self.order]
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}

    def _box(self, a: int, b: int) -> tuple[np.ndarray, int, int]:
        """Largest counts, smallest size, and the label that all have, or -1, of a range of the sequence."""
        got = self.nodes.get((a, b))
        if got is None:
            if b - a <= LEAF:
                one = self.labels[a:b]
                got = self.points[a:b].max(axis=0), int(self.size[a:b].min()), int(one[0]) if (one == one[0]).all() else -1
            else:
                m = (a + b) // 2
                (x, p, i), (y, q, j) = self._box(a, m), self._box(m, b)
                got = np.maximum(x, y), min(p, q), i if i == j else -1
            self.nodes[a, b] = got
        return got

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of members that may be linked, each pair once, found by joining the tree with itself."""
        n, p = len(self.size), self.percent
        stack = [(0, n, 0, n)] if n > 1 or n and self.boxes else []
        while stack:
            a, b, c, d = stack.pop()
            self.visited += 1
            (x, least_x, i), (y, least_y, j) = self._box(a, b), self._box(c, d)
            if i == j >= 0 or (100 + p) * int(overlap_bound(x, y)) < p * (least_x + least_y):
                continue
            if b - a <= LEAF and d - c <= LEAF:
                may = (100 + p) * overlap_bound(self.points[a:b, None], self.points[None, c:d]) >= p * (self.size[a:b, None] + self.size[None, c:d])
                u, v = np.nonzero(may & ((self.labels[a:b, None] != self.labels[None, c:d]) | (self.labels[a:b, None] < 0)))
                one = u + a <= v + c if self.boxes else u + a < v + c
                if one.any():
                    yield self.order[u[one] + a], self.order[v[one] + c]
            elif (a, b) == (c, d):
                m = (a + b) // 2
                stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                stack += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                stack += [(a, b, c, m), (a, b, m, d)]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(batch.column(n)) for n in names]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


@lean
def _describe(batches: Iterator[pa.RecordBatch], width: int, percent: int, more: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Size, digest, point and keys of each text's set, and columns `more` as they are; a set that a batch holds again has no keys there."""
    for whole in batches:
        seen: set[bytes] = set()
        for batch in slices(whole, "text"):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            digests = [_digest(s) for s in sets]
            got = []
            for s, d in zip(sets, digests, strict=True):
                got.append(np.empty(0, dtype=np.int64) if d in seen else s[: len(s) - int(left_out(np.int64(len(s)), percent))].view(np.int64))
                seen.add(d)
            s1, s2 = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T
            columns = {"n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(s1), "s2": pa.array(s2), "point": pa.array([packed(point(s)) for s in sets], pa.binary()), "keys": pa.array(got, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns.values(), *(batch.column(n) for n in more)], ["doc_id", "row", *columns, *more])


def _digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


@lean
def _sets(batches: Iterator[pa.RecordBatch], width: int, table: object) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose doc_id may be wanted; a null doc_id always may. Without a table, of all texts."""
    for whole in batches:
        if table is not None:
            ids = whole.column("doc_id")
            whole = whole.filter(pa.array(in_table(table.value, np.asarray(ids.fill_null(0))) | ~np.asarray(ids.is_valid())))
        for batch in slices(whole, "text"):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            s1, s2 = np.frombuffer(b"".join(map(_digest, sets)), dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "members"])


@lean
def _count_pairs(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, size and row: all pairs of a key's sets whose sizes allow a link (kind 0: a, b), and of a key
    with more than `most` sets the sets themselves (kind 1: a is the key). What is held of a key is bounded."""
    k, r, n = (np.empty(0, dtype=np.int64) for _ in range(3))
    heavy = None  # the open key, once it is known to have many sets

    def done(k: np.ndarray, r: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        a, b = [], []
        for q in range(2, most + 1):
            at = start[size == q]
            if len(at):
                at = at[:, None] + np.arange(q)
                i, j = np.triu_indices(q, 1)
                near = 100 * n[at][:, i] >= percent * n[at][:, j]
                a.append(r[at][:, i][near])
                b.append(r[at][:, j][near])
        one, two = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (a, b))
        many = np.repeat(size > most, size)
        return _batch(kind=np.repeat(np.array([0, 1], dtype=np.int32), [len(one), many.sum()]), a=np.concatenate([np.minimum(one, two), k[many]]), b=np.concatenate([np.maximum(one, two), r[many]]))

    def again(k: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        return _batch(kind=np.ones(len(k), dtype=np.int32), a=k, b=r)

    for batch in batches:
        k, r, n = (np.concatenate(x) for x in zip((k, r, n), _columns(batch, ("key", "row", "n")), strict=True))
        if heavy is not None and len(k):
            end = int(np.searchsorted(k != heavy, True)) if k[0] == heavy else 0
            if end:
                yield again(k[:end], r[:end])
                k, r, n = k[end:], r[end:], n[end:]
            if len(k):
                heavy = None
        if not len(k):
            continue
        last = len(k) - int(np.searchsorted((k != k[-1])[::-1], True))
        if last:
            yield done(k[:last], r[:last], n[:last])
            k, r, n = k[last:], r[last:], n[last:]
        if len(k) > most:
            heavy = k[0]
            yield again(k, r)
            k, r, n = k[:0], r[:0], n[:0]
    if len(k):
        yield done(k, r, n)


@lean
def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, salt, size and row: each set with the first one before it that its size allows a link with."""
    key: tuple | None = None
    center = least = 0
    for batch in batches:
        a, b = [], []
        for k, salt, r, n in zip(*(x.tolist() for x in _columns(batch, ("key", "salt", "row", "n"))), strict=True):
            if (k, salt) != key or 100 * least < percent * n:
                key, center, least = (k, salt), r, n
            else:
                a.append(min(r, center))
                b.append(max(r, center))
        if a:
            yield _batch(a=np.array(a), b=np.array(b))


@lean
def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with keys enough in common, whose summed smaller counts leave the similarity possible.

    `count` is null where the keys in common were not counted. Keys that sets of many heavier keys share and that were
    not counted are at most `heavy` of either, for other sets `wide`.
    """
    for batch in batches:
        na, nb, wa, wb, ha, hb = _columns(batch, ("na", "nb", "wa", "wb", "ha", "hb"))
        count = np.asarray(batch.column("count").fill_null(1 << 40))
        missed = np.where((ha >= 0) & (hb >= 0), np.minimum(ha, hb), np.minimum(wa, wb))
        may = count + missed >= needed(na, nb, percent)
        if may.any():
            at = pa.array(np.flatnonzero(may))
            x, y = (unpacked(batch.column(c).take(at).to_pylist()) for c in ("pa", "pb"))
            may[may] = (100 + percent) * overlap_bound(x, y) >= percent * (na + nb)[may]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(may)) for c in ("a", "b")], ["a", "b"])


@lean
def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by centre, the centre's own set first: members linked with their centre."""
    center, own = None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        out: list[tuple[int, int]] = []
        for c, s, role, members in zip(*(batch.column(n).to_pylist() for n in ("center", "row", "role")), batch.column("members"), strict=True):
            x = np.frombuffer(members.as_buffer(), dtype=np.uint64)  # not copied
            if not role:
                center, own = c, x.copy()
            elif c == center:
                i = np.searchsorted(own, x)
                if links(len(x), len(own), int((own[np.minimum(i, len(own) - 1)] == x).sum()), percent):
                    out.append((s, c))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], ["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) that are linked. A set that is b of many pairs is copied for every STAR of them."""
    sizes = pairs.groupBy(F.col("b").alias("center")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    crowds = sizes.filter("salts > 1")
    p = pairs.toDF("row", "center").join(crowds, "center", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int"))
    members = p.join(sets, "row").select("center", "salt", "row", "members", F.lit(1).alias("role"))
    centers = sizes.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("row", "center"), "center")
    both = members.unionAll(centers.select("center", "salt", F.col("center").alias("row"), "members", F.lit(0).alias("role")))
    dealt = both.repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", "role")
    return dealt.select("center", "row", "role", "members").mapInArrow(partial(_verify, percent=percent), "a long, b long")


def _owned(i: str, j: str) -> list[Column]:
    """A pair as its owner and the other, so that no end has all the pairs."""
    turned = F.pmod(F.xxhash64(i, j), F.lit(2)) == 0
    return [F.when(turned, F.col(i)).otherwise(F.col(j)).alias("owner"), F.when(turned, F.col(j)).otherwise(F.col(i)).alias("i")]


_NODE = "key long, top binary, least long, label long, n int, rows binary, comps binary, points binary, before binary"


@lean
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and component: leaf nodes of a key's sets as rows, with their box and members."""
    held: list = []
    key = None

    def node() -> list:
        points = unpacked([h[2] for h in held])
        comps = np.array([h[1] for h in held])
        before = np.zeros((len(held), BEFORE), dtype=np.int64)
        for i, h in enumerate(held):
            before[i, : len(h[3])] = h[3]
        size = points.sum(axis=1, dtype=np.int64)
        label = int(comps[0]) if (comps == comps[0]).all() else -1
        return [key, packed(points.max(axis=0)), int(size.min()), label, len(held), np.array([h[0] for h in held]).tobytes(), comps.tobytes(), points.tobytes(), before.tobytes()]

    def ready(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _NODE.split(", ")])

    rows: list = []
    for batch in batches:
        for k, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "row", "comp", "point", "before")), strict=True):
            if held and (k != key or len(held) >= NODE):
                rows.append(node())
                held = []
            key = k
            held.append(row)
        if len(rows) >= 64:
            yield ready(rows)
            rows = []
    if held:
        rows.append(node())
    if rows:
        yield ready(rows)


@lean
def _join_nodes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From nodes sorted by key: pairs of one key's nodes that its R-tree can't rule out."""

    def join(rows: list) -> pa.RecordBatch | None:
        name = np.array([r[0] for r in rows])
        tree = CountRTree(unpacked([r[1] for r in rows]), percent, np.array([r[3] for r in rows]), np.array([r[2] for r in rows]))
        got = list(tree.pairs())
        return _batch(i=name[np.concatenate([u for u, _ in got])], j=name[np.concatenate([v for _, v in got])]) if got else None

    key, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "node", "top", "least", "label")), strict=True):
            if held and k != key:
                if (got := join(held)) is not None:
                    yield got
                held = []
            key = k
            held.append(row)
    if held and (got := join(held)) is not None:
        yield got


def _earlier(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 16 most frequent earlier keys each member of two nodes has, as bits."""
    values, n = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_counts=True)
    n[values == 0] = 0
    top = values[np.argsort(-n, kind="stable")[:16]]
    bits = [np.zeros(len(z), dtype=np.uint32) for z in (x, y)]
    for k, v in enumerate(top.tolist()):
        if v:
            for out, z in zip(bits, (x, y), strict=True):
                out |= (z == v).any(axis=1).astype(np.uint32) << np.uint32(k)
    return bits[0], bits[1]


def _cross(nodes: pa.Table, percent: int, full: bool) -> pa.Table:
    """From a node and the nodes to join it with: pairs of members in different components that their group counts do not
    rule out, with the bound of what they have in common.

    A pair that also shares one of the keys just before this one is left to that key. Where there are more than CROWDED
    pairs for each member and not `full`, only each member's likeliest pair is given, marked as a choice.
    """

    def side(r: dict) -> tuple[np.ndarray, ...]:
        points = np.frombuffer(r["points"], dtype=np.uint8 if len(r["points"]) == GROUPS * r["n"] else np.uint32).reshape(-1, GROUPS)
        return np.frombuffer(r["rows"], dtype=np.int64), np.frombuffer(r["comps"], dtype=np.int64), points, np.frombuffer(r["before"], dtype=np.int64).reshape(-1, BEFORE)

    place = {(r, i): k for k, (r, i) in enumerate(zip(nodes.column("role").to_pylist(), nodes.column("i").to_pylist(), strict=True))}
    row = lambda k: {c: nodes.column(c)[k].as_py() for c in ("rows", "comps", "points", "before", "n")}
    (own,) = (i for r, i in place if not r)
    rx, cx, px, bx = side(row(place[0, own]))
    found: list[np.ndarray] = []
    members = len(rx)
    for (role, i), k in place.items():
        if not role:
            continue
        ry, cy, py, by = side(row(k))
        members += len(ry)
        mx, my = _earlier(bx, by)
        new = ((mx[:, None] & my[None]) == 0) & (cx[:, None] != cy[None])
        if i == own:
            new &= np.triu(np.ones(new.shape, dtype=bool), 1)
        u, v = np.nonzero(new)
        size = px.sum(axis=1, dtype=np.int64), py.sum(axis=1, dtype=np.int64)
        for at in range(0, len(u), 1 << 12):
            p, q = u[at : at + (1 << 12)], v[at : at + (1 << 12)]
            bound = overlap_bound(px[p], py[q])
            share = size[0][p] + size[1][q]
            may = (100 + percent) * bound >= percent * share
            if may.any():
                found.append(np.stack([rx[p[may]], ry[q[may]], 1_000_000 * bound[may] // share[may]]))
    a, b, bound = np.concatenate(found, axis=1) if found else np.empty((3, 0), dtype=np.int64)
    choice = not full and len(a) > CROWDED * members
    if choice:
        a, b, bound = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([bound, bound])
        order = np.lexsort((b, -bound, a))
        order = order[np.unique(a[order], return_index=True)[1]]
        a, b, bound = a[order], b[order], bound[order]
    return pa.table({"a": a, "b": b, "bound": bound, "choice": np.full(len(a), choice)})


def text_hashes(text: Column) -> dict[str, Column]:
    """Two 64-bit hashes of a text, which stand for it in a row's identity; a null text differs from an empty one."""
    text = text.cast("string")
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(17), text)}


def link_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: bool = False) -> DataFrame:
    """Links `docs` (doc_id, text) whose shingle sets have a Jaccard similarity of `percent` or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links). Texts are lower-cased in A-Z
    and split at space and the controls 9 to 13. Null, empty and blank texts have an empty set, link with nothing
    and are their own component; a null doc_id has links but is never a component's name unless all are null.
    Repeated rows are equal sets. Other columns are ignored. As a doc_id that occurs again can name several components,
    `rows` adds text_hashes() of the row's text and `component`, which is one number for one component and null for empty
    sets.

    1. Equal sets (by 128 bits) are one class, known by one of its rows. A set's keys are its first shingles in an order
       that all sets share. How many keys linked sets have in common at least is known from their sizes: see needed().
    2. All pairs of sets that share a key of few sets are counted by key. A pair is a candidate if its count, and what
       the two can share besides, reaches what is needed, and if their group counts allow the similarity.
    3. Sets with many keys of many sets are few: copies of one another in the main, or made of common passages. Each is
       first tied to one centre a key. Then leaf nodes of such a key's sets are made and joined by an R-tree, whose boxes
       bound the overlap by summed minima and skip nodes of one component; pairs of different components that survive are
       candidates. Where these are many, each member's likeliest one is tried first, as long as that finds links, and the
       trees are joined anew.
    4. Candidates are verified on the sets themselves. So every linked pair is found or already connected.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    extra = tuple(text_hashes(F.col("text"))) if rows else ()
    named = narrow.withColumn("row", F.monotonically_increasing_id())  # fixed by writing them down
    named = named.withColumns(text_hashes(F.col("text"))) if rows else named
    wide = keep(named.mapInArrow(partial(_describe, width=width, percent=percent, more=extra), ", ".join(["doc_id long, row long, n long, s1 long, s2 long, point binary, keys array<long>", *(f"{n} long" for n in extra)])))
    all_docs = keep(wide.select("doc_id", "row", "n", "s1", "s2", *extra))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    classes = keep(all_docs.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id").alias("doc_id")))
    own = keep(wide.join(classes.select("row"), "row", "left_semi").select("row", "n", "point", "keys"))
    discard(wide)

    def by_key(held: DataFrame, *order: str) -> DataFrame:
        return held.repartition(parts, "key", *order[:-2]).sortWithinPartitions("key", *order)

    tiers = "kind int, a long, b long"
    first = keep(by_key(own.select(F.explode("keys").alias("key"), "row", "n"), "n", "row").mapInArrow(partial(_count_pairs, most=LIGHT, percent=percent), tiers))
    own_points = keep(own.select("row", "n", "point"))
    discard(own)
    release(spark)
    size = own_points.select("row", "n")
    heavier = lambda tier: tier.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("row"))
    many = lambda held: held.groupBy("row").agg(F.count("*").alias("k")).join(size, "row").withColumn("inside", F.col("k") >= needed_of(F.col("n"), percent))
    wide_keys = keep(many(heavier(first)))
    inside = wide_keys.filter("inside").select("row", "n")
    second = keep(by_key(heavier(first).join(inside, "row"), "n", "row").mapInArrow(partial(_count_pairs, most=MEDIUM, percent=percent), tiers))
    heavy_keys = keep(many(heavier(second)))
    heavy = heavier(second).join(heavy_keys.filter("inside").select("row", "n"), "row")
    crowds = heavy.groupBy("key").agg(F.ceil(F.count("*") / SALTED).alias("salts")).filter("salts > 1")
    heavy = keep(heavy.join(crowds, "key", "left").select("key", "row", "n", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")))
    stars = by_key(heavy, "salt", "n", "row").mapInArrow(partial(_stars, percent=percent), "a long, b long").distinct().select("a", "b", F.lit(None).cast("long").alias("count"))
    counted = first.filter("kind = 0").unionAll(second.filter("kind = 0")).groupBy("a", "b").agg(F.count("*").alias("count"))
    known = own_points.join(wide_keys.select("row", F.col("k").alias("w"), "inside"), "row", "left").join(heavy_keys.select("row", F.col("k").alias("h")), "row", "left")
    known = known.select("row", "n", F.coalesce("w", F.lit(0)).alias("w"), F.when(F.col("inside"), F.coalesce("h", F.lit(0))).otherwise(-1).alias("h"), F.col("point").alias("p"))

    def side(x: str) -> DataFrame:
        return known.select(F.col("row").alias(x), *(F.col(c).alias(c + x) for c in ("n", "w", "h", "p")))

    pairs = cut(counted.unionAll(stars).join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_bounded, percent=percent), "a long, b long").distinct())
    discard(first, second, wide_keys, heavy_keys)
    release(spark)

    def linked(p: DataFrame) -> DataFrame:
        """The pairs that are linked; their sets come from the texts, and other texts are left out before anything is shuffled."""
        wanted = cut(p.select(F.col("a").alias("row")).unionAll(p.select("b")).distinct().join(classes, "row"))
        n = wanted.count()
        if not n:
            return p
        small = n * 16 <= BITS_AT_MOST
        table = spark.sparkContext.broadcast(bit_table(wanted, "doc_id", n * 16)) if small else None
        texts = narrow if small else narrow.join(wanted.select("doc_id").distinct(), narrow.doc_id.eqNullSafe(wanted.doc_id), "left_semi")
        found = texts.mapInArrow(partial(_sets, width=width, table=table), "s1 long, s2 long, members binary")
        sets = keep(found.join(wanted.select("row", "s1", "s2"), ["s1", "s2"]).select("row", "members").dropDuplicates(["row"]))
        out = cut(_linked(p, sets, percent, parts))
        discard(sets)
        if table is not None:
            table.unpersist()
        release(spark)
        return out

    edges = linked(pairs)
    comp = cut(components(edges))
    recent = Window.partitionBy("row").orderBy("key").rowsBetween(-BEFORE, -1)
    before = keep(heavy.withColumn("before", F.collect_list("key").over(recent)).join(own_points.select("row", "point"), "row"))
    full, tries = False, 0
    while heavy.limit(1).count():
        held = before.join(comp.select(F.col("node").alias("row"), F.col("component").alias("comp")), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        nodes = keep(by_key(held, "salt", "comp", "n").mapInArrow(_nodes, _NODE).withColumn("node", F.monotonically_increasing_id()))
        boxes = nodes.select("key", "node", "top", "least", "label").repartition(parts, "key").sortWithinPartitions("key", "node")
        asked = cut(boxes.mapInArrow(partial(_join_nodes, percent=percent), "i long, j long").select(*_owned("i", "j")))
        salts = asked.groupBy("owner").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
        payload = nodes.select(F.col("node").alias("i"), "n", "rows", "comps", "points", "before")
        others = asked.join(salts, "owner").select("owner", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "i").join(payload, "i")
        owners = salts.select(F.col("owner").alias("i"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(payload, "i").withColumns({"owner": F.col("i"), "role": F.lit(0)})
        both = others.unionByName(owners).repartition(parts, "owner", "salt")
        cross = cut(by_group(both, ["owner", "salt"], _cross, "a long, b long, bound long, choice boolean", percent=percent, full=full))
        discard(nodes)
        likeliest = cross.filter("choice").groupBy("a").agg(F.max_by("b", F.struct("bound", F.col("b"))).alias("b"))
        more = cross.filter("not choice").select("a", "b").unionAll(likeliest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        some = cross.filter("choice").limit(1).count() > 0
        known_edges = edges.count()
        if more.limit(1).count():
            edges = cut(edges.unionAll(linked(more)))
            pairs = cut(pairs.unionAll(more))
            comp = cut(components(edges))
        if not some:
            break
        tries += 1
        full = tries == TRIES or edges.count() == known_edges
    discard(before)
    named = classes.join(comp.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = named.join(least, "component").select("s1", "s2", "component_id", *(["component"] if rows else []))
    out = all_docs.select("doc_id", "n", "s1", "s2", *extra).join(whole, ["s1", "s2"], "left")
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *extra, *([F.when(F.col("n") > 0, F.col("component")).alias("component")] if rows else [])))
    discard(all_docs, classes, own_points, heavy)
    return out
