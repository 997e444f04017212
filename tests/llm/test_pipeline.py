"""The whole pipeline on a small planted corpus: every stage recomputed in plain Python from what the one before kept."""

import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from test_operators import covered, lowest, prose, shingle_sets, words
from tidewell.llm import classifier
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(41)
    good = [prose(rng, rng.randint(50, 150)) for _ in range(60)]
    passage = prose(rng, 70)
    texts = [*good]
    texts += [good[3], good[3], good[4] + " tail", " ".join(["changed", *good[5].split()[1:]])]  # exact and near copies
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(4)]  # a passage over 50 words
    texts += [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(30)]  # junk
    texts += ["too short", "", None, "same words here " * 40, prose(rng, 3000)]
    rows = [(i, t, "en", "x", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, prose(rng, 80), "en", None, None)]
    labels = [(i, int("$$$" not in (t or "$$$")), 0) for i, t, *_ in rows if i is not None and i % 7]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def statistics(text):
    """The classifier's features of one text, in plain Python."""
    t = text or ""
    w, lines = words(t), t.split("\n")
    n, count = len(w), lambda p: len(re.findall(p, t))
    part = lambda a, b: a / b if b > 0 else 0.0
    chars = sum(map(len, w))
    return dict(n_words=n, word_length=part(chars, n), symbols=part(count(r"[#*$%&|<>]"), n), capitals=part(count("[A-Z]"), count("[A-Za-z]")), marks=part(count("!"), n), digits=part(count("[0-9]"), len(t)),
                letters=part(count("[A-Za-z]"), chars), distinct_words=part(len(set(w)), n), adjacent_repeats=part(sum(a == b for a, b in zip(w, w[1:])), n), distinct_lines=part(len(set(lines)), len(lines)),
                line_words=part(n, len(lines)), stops=part(count("[.]"), n))


def score(model, text):
    s = statistics(text)
    return 1 / (1 + math.exp(-model.intercept - sum(w for c, w in model.rules if all((s[f] > at) == above for f, above, at in c))))


def failed(text):
    """Whether the newest policy drops a text, from the rules' definitions."""
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = len({i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)})
    lines = [x for x in t.split("\n") if words(x)]
    twice, chars, n = len(lines) - len(set(lines)), sum(map(len, w)), len(w)
    upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
    return (n < 20 or 100 * again > 30 * n or chars < 2 * n or chars > 24 * n or 10 * len(re.findall(r"[#*$%&|<>]", t)) > 4 * n
            or (10 * twice > 3 * len(lines) and twice > 1) or (letters > 0 and 10 * upper > 6 * letters) or 10 * t.count("!") > 5 * n)


def test_every_stage(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    labels = spark.read.parquet(f"{corpus_dir}/labels.parquet")
    model = classifier.train(docs, labels)
    assert model.rules
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    kept, at = [docs], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, corpus_dir)
        assert at.columns == docs.columns, name
        at.write.parquet(f"{corpus_dir}/stage{k}")
        at = spark.read.parquet(f"{corpus_dir}/stage{k}")
        kept.append(at)
    whole, first, second, third, fourth = map(rows, kept)
    assert first == Counter({(d, t): n for (d, t), n in whole.items() if score(model, t) >= 0.3})
    assert not any("$$$" in (t or "") for _, t in first) and len(first) > 60
    assert second == Counter({(d, t): n for (d, t), n in first.items() if not failed(t)})
    own = list(second)
    sets = shingle_sets(own, 5)
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = {}
    for i, c in lowest(pairs, range(len(own))).items():
        parts.setdefault(c, []).append(own[i])
    want = [min(p, key=lambda r: (r[0] is None, r[0])) for p in parts.values()]
    assert third == Counter(want) and len(third) < len(second)
    data = [(d, (t or "").encode()) for d, t in third.elements()]
    want = Counter()
    for (d, b), f in zip(data, covered([b for _, b in data], corpus_pipeline.PASSAGE)):
        left = bytes(x for x, gone in zip(b, f) if not gone).decode("utf-8", "ignore")
        if not f.any() or words(left):
            want[d, left] += 1
    assert fourth == want and fourth != third
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in kept[4].collect())
    out = corpus_pipeline.run(spark, corpus_dir).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, text in fourth.elements():
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        for k, a in enumerate(range(0, n, 2048)):
            want[d, k, a, min(2048, n - a)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length) for r in out.itertuples()) == want
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1


def test_empty_documents(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus_dir).count() == 0
