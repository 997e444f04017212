"""Ranked search against scores by hand: ties, repeats, nulls, long texts, several ranges and passes."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidewell.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def by_hand(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Straße", "日本語", "naïve", "a", "B2"]
    text = lambda n: rng.choice([" ", ", ", "\x00-", "_"]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(d, text(rng.randint(1, 60))) for d in range(300)]
    docs += [(1000 + d, docs[7][1]) for d in range(40)]  # ties beyond the top
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, docs[7][1]), (500, None), (501, ""), (502, " .,;"), (503, text(20000)), (504, "É é E e")]
    items = [(i, text(rng.randint(1, 25))) for i in range(20)] + [(90, docs[7][1]), (91, "w1 w1 w1 W1"), (92, "nothinglikeit"), (93, None), (94, ""), (None, "w3 w5"), (90, "w2")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, codes string"), spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")


def test_search(spark, monkeypatch):
    docs, items = tables()
    d, q = frames(spark, docs, items)
    got = lexical.search(d.repartition(3), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(docs, items, 10)
    monkeypatch.setattr(lexical, "TERMS", 30)  # several passes
    assert sorted((tuple(r) for r in lexical.search(d, q, top=3).collect()), key=repr) == by_hand(docs, items, 3)


def test_no_rows(spark):
    docs, items = tables()
    d, q = frames(spark, docs, items)
    assert lexical.search(d.limit(0), q).collect() == [] and lexical.search(d, q.limit(0)).collect() == []


def test_trees_open_few_nodes_and_all_ties():
    rng = np.random.default_rng(5)
    n, vocabulary = 4000, 50
    rows = np.repeat(np.arange(n), 6)
    codes = np.minimum(rng.geometric(0.1, len(rows)) - 1, vocabulary - 1)
    key = np.unique(rows * vocabulary + codes)
    rows, codes = key // vocabulary, key % vocabulary
    gain = rng.integers(1, 4, len(rows))  # many equal scores
    block = lexical.Block(np.arange(n) * 3, rows, codes, gain, vocabulary)
    opened = []
    plain = block.scores
    block.scores = lambda leaf, *a: opened.append(leaf) or plain(leaf, *a)
    for _ in range(20):
        c = np.unique(rng.integers(0, vocabulary, 5))
        times = rng.integers(1, 3, len(c))
        score = defaultdict(int)
        for r, k, g in zip(rows.tolist(), codes.tolist(), gain.tolist(), strict=True):
            if k in c:
                score[r * 3] += g * int(times[np.searchsorted(c, k)])
        assert block.search(c, times, 10, []) == sorted((-s, d) for d, s in score.items())[:10]
    assert len(opened) < 20 * block.leaves  # whole ranges are left unopened


def test_norms_beyond_64_bits():
    assert lexical.length_norms(np.array([10**7]), 10**13, 10**15).tolist() == [25 + 75 * 10**20 // 10**15]
