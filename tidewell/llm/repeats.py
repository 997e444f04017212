"""Removal of byte strings that occur twice or more: suffixes at the places of a difference cover, sorted one bucket at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, few, keep, lean, release, slices, spread
from .jaccard import mix

#: Suffixes of the cover in a bucket, about, and in what of a bucket is sorted at once.
BUCKET, BLOCK = 1_000_000, 2_000_000
#: Suffixes with one start in a block from which on they are told at once and one of them is held.
CROWD = 64
#: Pieces with one start that a task compares at once; those of more are spread by their strings.
PIECES = 2_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


class Prints:
    """Hashes of any substring of a text in constant time: prefix sums of bytes times powers, modulo 2^64."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, dtype=np.uint8)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of each substring of `width` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * _power(_INVERSE, n)) if n > 0 else np.empty(0, dtype=np.uint64)


def singer(q: int) -> list[int]:
    """Perfect difference set of q + 1 residues modulo q^2 + q + 1, for a prime q: each difference but 0 occurs once.

    The powers of a generator x of the field of q^3 elements whose coordinate of x^2 is 0, up to factors.
    """
    p = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                found, v = [], (1, 0, 0)
                for i in range(p):
                    if v[2] == 0:
                        found.append(i)
                    v = (c * v[2] % q, (v[0] + b * v[2]) % q, (v[1] + a * v[2]) % q)  # x^3 = a x^2 + b x + c
                if len(found) == q + 1 and len({(i - j) % p for i in found for j in found}) == p:
                    return found
    raise ValueError(f"not a prime: {q}")


@lru_cache
def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and residues of the cover for strings of `length` bytes: the longest period of at most 0.77 of it.

    For two places of any texts there is a distance below the period at which both texts have a sampled place.
    """
    q = max((q for q in range(2, 64) if all(q % k for k in range(2, q)) and q * q + q + 1 <= 0.77 * length), default=1)
    return (q * q + q + 1, tuple(singer(q))) if q > 1 else (1, (0,))


def sampled(n: int, gram: int, period: int, residues: tuple[int, ...]) -> np.ndarray:
    """Places of the cover in a text of n bytes at which `gram` bytes can be read."""
    at = (np.arange(0, n, period)[:, None] + np.array(residues)[None]).ravel()
    return at[at <= n - gram]


@lean
def _suffixes(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The cover's suffixes by bucket of their starts, packed: 32 more bits of the start's hash, row and place.

    Of texts that a slice holds several times all rows are marked as a whole (bucket -1), and one is sampled.
    """
    period, residues = cover_of(length)
    gram = length - period + 1
    for whole in batches:
        for batch in slices(whole, "text"):
            seen: dict[bytes, int] = {}
            alike: set[int] = set()
            hashes, owners, places = [], [], []
            rows = np.asarray(batch.column("row"))
            for i, text in enumerate(batch.column("text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < length:
                    continue
                first = seen.setdefault(data, i)
                if first != i:
                    alike |= {first, i}
                    continue
                at = sampled(len(data), gram, period, residues)
                hashes.append(Prints(data).of(at, at + gram))
                owners.append(np.full(len(at), i))
                places.append(at)
            out: list[tuple] = [(-1, int(rows[i]), b"") for i in sorted(alike)]
            if hashes:
                h, place = np.concatenate(hashes), np.concatenate(places)
                row = rows[np.concatenate(owners)]
                bucket = (h >> np.uint64(32)) % np.uint64(buckets)
                high = row >> 32
                order = np.lexsort((high, bucket))
                h, row, place, bucket, high = (x[order] for x in (h, row, place, bucket, high))
                cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (high[1:] != high[:-1]), [True]]))
                low, own, place = (x.astype("<u4") for x in (h & np.uint64(0xFFFFFFFF), row & 0xFFFFFFFF, place))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out.append((int(bucket[a]), int(high[a]), low[a:b].tobytes() + own[a:b].tobytes() + place[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "high", "packed"])


@lean
def _sort_suffixes(batches: Iterator[pa.RecordBatch], period: int, first: int) -> Iterator[pa.RecordBatch]:
    """From packed suffixes sorted by bucket: those whose start occurs elsewhere, with its rank, one bucket at a time. Rows that
    are marked as a whole (bucket -1) come out with the place -1.

    Places with one residue are all compared at the `first` residue alone. A bucket is sorted in blocks; of a start that a
    block holds often one suffix is held on, so memory is bounded by a bucket's different starts.
    """
    held: list[tuple[np.ndarray, ...]] = []
    bucket, count, most = None, 0, BLOCK

    def told(rank: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        real = row >= 0
        return pa.RecordBatch.from_arrays([pa.array(row[real]), pa.array(place[real].astype(np.int32)), pa.array(rank[real])], ["row", "place", "rank"])

    def groups(last: bool) -> pa.RecordBatch | None:
        """Suffixes of starts with several; unless it is the last block, only those of crowds, and what to hold."""
        nonlocal held, count, most
        h, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, row, place = h[order], row[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        rank = bucket << 32 | h.astype(np.int64)
        if last:
            x = place.astype(np.int64) % period
            mixed = (np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start)) | np.logical_or.reduceat(row < 0, start)
            tell = np.repeat(size > 1, size) & (np.repeat(mixed, size) | (x == first))
            held, count, most = [], 0, BLOCK
        else:
            tell = np.repeat(size > CROWD, size)
            rest = ~tell
            crowd = start[size > CROWD]
            held = [(h[rest], row[rest], place[rest]), (h[crowd], np.full(len(crowd), -1), place[crowd])]
            count = int(rest.sum()) + len(crowd)
            most = max(BLOCK, 2 * count)
        return told(rank[tell], row[tell], place[tell]) if tell.any() else None

    for batch in batches:
        whole: list[int] = []
        for b, high, packed in zip(*(batch.column(c) for c in ("bucket", "high", "packed")), strict=True):
            b, high, data = b.as_py(), high.as_py(), packed.as_buffer()
            if b < 0:
                whole.append(high)
                continue
            if held and b != bucket:
                if (got := groups(True)) is not None:
                    yield got
            elif count >= most:
                if (got := groups(False)) is not None:
                    yield got
            bucket = b
            h, row, place = np.frombuffer(data, dtype="<u4").reshape(3, -1)
            held.append((h, row.astype(np.int64) | high << 32, place))
            count += len(h)
        if whole:
            yield told(np.zeros(len(whole), dtype=np.int64), np.array(whole, dtype=np.int64), np.full(len(whole), -1))
    if held and (got := groups(True)) is not None:
        yield got


@lean
def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each place asked for: all strings of `length` bytes that it stands for, as their first and last start and the hash
    of the stretch that they cover."""
    period, _ = cover_of(length)
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            out: list[list[np.ndarray]] = []
            lists = batch.column("asked")
            ends = np.asarray(lists.offsets)
            flat = lists.flatten()
            place, rank = (np.asarray(flat.field(k)).astype(np.int64) for k in ("place", "rank"))
            base = ends[0]
            for row, text, a, b in zip(batch.column("row").to_pylist(), batch.column("text"), (ends[:-1] - base).tolist(), (ends[1:] - base).tolist(), strict=True):
                data = text.as_buffer().to_pybytes()
                prints = Prints(data)
                at, r = place[a:b], rank[a:b]
                first = np.maximum(at - period + 1, 0)
                last = np.minimum(at, len(data) - length)
                some = first <= last
                at, r, first, last = at[some], r[some], first[some], last[some]
                stretch = mix(prints.of(first, last + length) ^ mix((at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
                out.append([r, stretch.view(np.int64), np.full(len(r), row), first, last])
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], ["rank", "stretch", "row", "first", "last"])


@lean
def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked for."""
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            rows: list[tuple] = []
            for row, text, asked in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                data = text.as_buffer()
                rows += [(r["rank"], row, r["first"], data.slice(r["first"], r["last"] + length - r["first"]).to_pybytes()) for r in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["rank", "row", "first", "piece"])


def _window_prints(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Hash of every `length`-byte string of each piece, all pieces at once."""
    sizes = np.array([len(p) for p in pieces])
    at = np.concatenate([[0], np.cumsum(sizes)])
    n = sizes - length + 1
    out: list[np.ndarray] = []
    step = 500
    for lo in range(0, len(pieces), step):  # powers stay short
        hi = min(lo + step, len(pieces))
        prints = Prints(b"".join(pieces[lo:hi]))
        h = prints.every(length)
        out += [h[a - at[lo] : a - at[lo] + k] for a, k in zip(at[lo:hi], n[lo:hi], strict=True)]
    return out


@lean
def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by rank: marks of strings that start at two places with one rank, several ranks at a time.

    Places of one rank can be near each other in one text, so a string may be met twice at one start; that is no repeat.
    """
    held: list[tuple[int, int, int, bytes]] = []

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        prints = _window_prints([r[3] for r in rows], length)
        size = np.array([len(p) for p in prints])
        rank, row, first = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 2))
        h = mix(np.concatenate(prints) ^ np.repeat(mix(rank.view(np.uint64)), size))
        order = np.argsort(h)
        s = h[order]
        tie = np.concatenate([[False], s[1:] == s[:-1], [False]])
        some = order[tie[1:] | tie[:-1]]
        if not len(some):
            return None
        s = h[some]
        owner = np.searchsorted(np.cumsum(size), some, side="right")
        start = first[owner] + some - (np.cumsum(size) - size)[owner]
        own = row[owner]
        order = np.lexsort((start, own, s))
        s, own, start = s[order], own[order], start[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (own[1:] != own[:-1]) | (start[1:] != start[:-1])])
        s, own, start = s[new], own[new], start[new]
        tie = np.concatenate([[False], s[1:] == s[:-1], [False]])
        twice = tie[1:] | tie[:-1]
        own, start = own[twice], start[twice]
        if not len(own):
            return None
        order = np.lexsort((start, own))
        own, start = own[order], start[order]
        apart = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + length)])
        at = np.flatnonzero(apart)
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(start[at]), pa.array(start[np.append(at[1:], len(own)) - 1] + length)], ["row", "start", "end"])

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            for r in zip(*(batch.column(n).to_pylist() for n in ("rank", "row", "first", "piece")), strict=True):
                if len(held) >= 512 and r[0] != held[-1][0]:
                    if (got := solve(held)) is not None:
                        yield got
                    held = []
                held.append(r)
    if held and (got := solve(held)) is not None:
        yield got


@lean
def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "piece", 1 << 20):
            prints = _window_prints(batch.column("piece").to_pylist(), length)
            size = [len(p) for p in prints]
            start = np.concatenate([np.arange(k) + f for k, f in zip(size, batch.column("first").to_pylist(), strict=True)])
            rank, row = (pa.array(np.repeat(np.asarray(batch.column(c)), size)) for c in ("rank", "row"))
            yield pa.RecordBatch.from_arrays([rank, pa.array(np.concatenate(prints).view(np.int64)), row, pa.array(start)], ["rank", "h", "row", "start"])


@lean
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a task with those that meet put together, so that a text of one letter does not bring a mark for each place."""
    for batch in batches:
        row, start, end = (np.asarray(batch.column(c)).astype(np.int64) for c in ("row", "start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        new = np.concatenate([[True], row[1:] != row[:-1]])
        group = np.cumsum(new) - 1
        shift = group * (int(end.max()) + 1)  # rows apart, ends of one row never fall
        reach = np.maximum.accumulate(end + shift) - shift
        apart = new | np.concatenate([[True], start[1:] > reach[:-1]])
        at = np.flatnonzero(apart)
        yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(start[at]), pa.array(reach[np.append(at[1:], len(row)) - 1])], ["row", "start", "end"])


@lean
def _apply(batches: Iterator[pa.RecordBatch], texts: bool, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            out: list[tuple] = []
            kept: list[bytes] = []
            for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans: list[list[int]] = []
                for a, b in sorted((m["start"], len(data) if m["end"] < 0 else m["end"]) for m in marks or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                rest = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True)) if spans else data
                out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                kept.append(rest)
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            more = [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *more, *(batch.column(c) for c in carried)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * texts, *carried])


def remove_repeats(docs: DataFrame, *, length: int = 400, texts: bool = False, carry: bool = False) -> DataFrame:
    """Removes from `docs` (doc_id, text) every byte covered by a `length`-byte string that also starts elsewhere.

    Texts are UTF-8 bytes (null: empty); matches never cross texts; strings are judged on the input. Returns one
    row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `texts` the text that is kept, from which the
    broken halves of characters that a cut runs through are left out; with `carry` also the row's other columns as
    _row. Repeated rows are copies of each other, so they lose all strings of that length; texts shorter than `length`
    lose nothing. An empty table gives no rows.

    1. Suffixes at the places of a difference cover (18 of 307 for 400 bytes) are dealt to buckets by their starts, as
       long as two equal strings have in common at such a place at least, and sorted one bucket at a time. Starts that
       occur once, nearly all, are let go; the others have a rank.
    2. A place stands for all strings of `length` bytes that begin less than a period before it. Places with one rank and
       the same such stretch are repeats of one another as a whole, whatever their number: long ties need no comparison.
    3. Of different stretches with one rank, one each is cut out, and their strings are compared.

    Suffixes are compared as hashes, of the start and of the stretch or string, of 96 bits together or more. The texts are
    written down once with a number for each row, by which marks find them.
    """
    spark = docs.sparkSession
    rest = [F.struct(*(c for c in docs.columns if c != "text")).alias("_row")] if carry else []
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest))
    source = keep(source.withColumn("row", F.monotonically_increasing_id()))
    d = source.filter(F.octet_length("text") >= length).select("row", "text")
    period, residues = cover_of(length)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, int(total * len(residues) / period) // BUCKET + 1)
    packed = d.mapInArrow(partial(_suffixes, length=length, buckets=buckets), "bucket int, high long, packed binary")
    dealt = F.when(F.col("bucket") < 0, F.col("high") % buckets).otherwise(F.col("bucket"))  # whole rows are many in a table of copies
    sorted_ = packed.repartition(parts, dealt).sortWithinPartitions("bucket")
    found = keep(sorted_.mapInArrow(partial(_sort_suffixes, period=period, first=residues[0]), "row long, place int, rank long"))
    alike = keep(found.filter("place < 0").select("row", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))
    release(spark)
    asked = found.filter("place >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "rank")).alias("asked"))
    runs = keep(d.join(asked, "row").mapInArrow(partial(_contexts, length=length), "rank long, stretch long, row long, first int, last int"))
    discard(found)
    release(spark)
    kinds = keep(runs.groupBy("rank", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("one")))
    marks = "row long, start long, end long"
    equal = runs.join(kinds.filter("n > 1").select("rank", "stretch"), ["rank", "stretch"]).select("row", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end"))
    equal = keep(equal.mapInArrow(_joined, marks))
    discard(runs)
    several = kinds.groupBy("rank").agg(F.count("*").alias("k")).filter("k > 1")
    close = keep(kinds.join(several, "rank").select("rank", "k", "one.*"))
    discard(kinds)
    release(spark)
    wanted = close.groupBy("row").agg(F.collect_list(F.struct("rank", "first", "last")).alias("asked"))
    pieces = d.join(wanted, "row").select("row", "text", "asked").mapInArrow(partial(_cut_out, length=length), "rank long, row long, first long, piece binary")
    crowds = close.filter(F.col("k") > PIECES).select("rank").distinct()
    hot = crowds.limit(1).count() > 0
    if hot:  # read twice
        pieces = keep(pieces)
        release(spark)
    cold = pieces.join(crowds, "rank", "left_anti") if hot else pieces
    differ = cold.repartition(parts, "rank").sortWithinPartitions("rank").mapInArrow(partial(_compare, length=length), marks)
    if hot:
        windows = pieces.join(crowds, "rank", "left_semi").select("rank", "row", "first", "piece").mapInArrow(partial(_windows, length=length), "rank long, h long, row long, start long").distinct()
        twice = windows.groupBy("rank", "h").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "h")
        differ = differ.unionAll(windows.join(twice, ["rank", "h"]).select("row", "start", (F.col("start") + length).alias("end")).mapInArrow(_joined, marks))
    differ = keep(differ)
    discard(close, *([pieces] if hot else []))
    release(spark)
    by_row = equal.unionAll(differ).unionAll(alike).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("marks"))
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts)
    carried = ["_row"] if carry else []
    if carry:
        schema = schema.add(source.schema["_row"])
    return few(source.join(by_row, "row", "left").select("doc_id", "text", "marks", *carried).mapInArrow(partial(_apply, texts=texts, carried=carried), schema))
