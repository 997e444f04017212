"""Byte-level BPE through an automaton compiled from the merges; decoding by the arcs' labels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the pattern by which byte-level tokenizers of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256.

    Fixed values: these are the ranges of visible bytes that byte-level vocabularies are written with.
    """
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """Deterministic automaton over tokens that accepts exactly the token sequences that the merges produce.

    It starts as one state that loops on every byte. Merges are added one after another, each as a gadget: where
    an arc u leads to a state with an arc v, a new arc uv goes from the first state to the end of v, and v is taken
    from the state behind u. So a state is known by the last token read, an arc (t, w) is born with the later of
    its tokens as a copy of an arc of that token's half at that time, and dies when a merge joins t and w. The
    gadgets are kept as arrays (both halves and the time of birth of each token, the time of death of each arc that
    dies), from which an arc is told when it is first asked for: all pairs of tokens would be far too many.

    Through the states at hand, a word has one path, and every prefix of a word has one too. The labels are compiled into
    a table of transitions by byte, whose states know the tokens that end there, the longest first. Encoding reads a word
    through it once from left to right: at each byte, the prefix's last arc is the first of these tokens that leaves the
    state which the rest of the prefix has reached. So the time follows the word's length, whatever the word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        of = byte_names()
        self.label = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}
        size = max(vocab.values()) + 1
        self.first, self.second, self.birth = [-1] * size, [-1] * size, [-1] * size
        self.death: dict[int, int] = {}
        self.token: dict[bytes, int] = {bytes([b]): vocab[c] for c, b in of.items() if c in vocab}
        self.arcs: dict[int, bool] = {}
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self.steps = ahocorasick.Automaton()
        for label, w in self.token.items():
            self.steps.add_word(label.decode("latin-1"), (w, len(label)))
        self.steps.make_automaton()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        key = u << 32 | v
        if key in self.death or not self._at(u, v, time):
            return  # u is never followed by v: the merge is never used
        self.death[key] = time
        if self.birth[w] < 0 and self.label[w] not in self.token:
            self.first[w], self.second[w], self.birth[w] = u, v, time
            self.token[self.label[w]] = w

    def _at(self, t: int, w: int, time: int) -> bool:
        """Whether the arc w leaves the state behind t once the merges before `time` are in."""
        birth, death = self.birth, self.death
        while True:
            dead = death.get(t << 32 | w)
            if dead is not None and dead < time:
                return False
            bt, bw = birth[t], birth[w]
            if bw > bt:
                if self.first[w] == self.second[w] == t:
                    return False  # equal halves join from the left
                time, w = bw, self.first[w]
            elif bt > bw:
                time, t = bt, self.second[t]
            elif bt >= 0:  # a token behind itself
                time, t, w = bt, self.second[t], self.first[t]
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """Tokens of the word's path."""
        got = self.token.get(word)
        if got is not None:
            return [got]
        arcs = self.arcs
        last = [-1] * (len(word) + 1)
        for end, (w, size) in self.steps.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            t = last[end - size] if end > size else -1
            if t >= 0:
                key = t << 32 | w
                ok = arcs.get(key)
                if ok is None:
                    if len(arcs) > 2_000_000:
                        arcs.clear()
                    ok = arcs[key] = self._at(t, w, 1 << 60)
                if not ok:
                    continue
            elif end > size:
                continue
            last[end] = w
        out, at, label = [], len(word), self.label
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the word")
            out.append(last[at])
            at -= len(label[last[at]])
        return out[::-1]


class ByteCodec:
    """Encodes and decodes texts with the automaton of a byte-level tokenizer file; each distinct word once."""

    def __init__(self, path: str, most: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        plain = all(not t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or odd or spec["normalizer"] or not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = dict(self.automaton.label) | {i: t.encode() for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(WORDS).findall
        self.words: dict[str, bytes] = {}
        self.most = most

    def _words(self, text: str) -> list[str]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.split(text)
        return [w for k, part in enumerate(self.at_special.split(text)) for w in ([part] if k % 2 else self.split(part))]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        words = [self._words(t) for t in texts]
        if len(self.words) > self.most:
            self.words.clear()
        for w in set().union(*words).difference(self.words):
            ids = [self.special[w]] if w in self.special else self.automaton.encode(w.encode())
            self.words[w] = np.array(ids, dtype="<u4").tobytes()
        get = self.words.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, joined; what is not UTF-8 becomes the replacement character."""
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    """One codec a worker process."""
    return ByteCodec(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = c.encode_many([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in c.encode_many([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        texts = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text of `docs` (doc_id, text); null and empty texts have no ids; no shuffle."""
    return _narrow(docs).mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of `encoded` (doc_id, ids); null ids give an empty text; an unknown id is an error."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(partial(_decode, path=path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text and returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

    A null text counts as empty. Repeated rows are encoded each; other columns are ignored; nothing is shuffled.
    """
    return _narrow(docs).mapInArrow(partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
