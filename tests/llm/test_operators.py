"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, classifier, jaccard, language, neardup, packing, quality_rules, repeats, sharding, warc
from tidewell.llm.common import components, forest
from tidewell.llm.tokens import WordEncoder

WORDS = "the of and to in is that for it was on are as with his they at be this from stone river light apple window garden silver paper market winter".split()
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, tid string, n int, key string, marks string, _row string, members string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, odd and empty texts; repeated rows; a null doc_id."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 400)) for _ in range(30)]
    passage = prose(rng, 120)
    texts = list(base)
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper()]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "One", "a b c", "aaaa " * 300, "é" * 500, "naïve <|endoftext|> text\x1f x", "日本語 🙂 test", "\x00odd\x0b\x0c", prose(rng, 5000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[0]), (None, None), (7, "another text under an id that is taken")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", "m", "r", "s") for r in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowest(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = lowest(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    nodes, low = forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert dict(zip(nodes.tolist(), low.tolist())) == lowest(pairs, {x for p in pairs for x in p})


def test_word_encoder():
    t = Tokenizer.from_file(WORD)
    e = WordEncoder(WORD, most=5000)
    for _, text in corpus():
        assert e.encode(text or "").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_packing(spark):
    rows = corpus()
    t = Tokenizer.from_file(WORD)
    got = packing.pack_documents(frame(spark, rows), WORD).toPandas()
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0


def test_packing_in_several_groups(spark):
    rng = random.Random(23)
    rows = [(i, 0, 0, rng.randint(1, 600), i) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), group_rows=500).toPandas()
    assert len(got) == 3000 and 1 < len(set(got.sequence_id // (1 << 32))) <= 6
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert got.sequence_id.nunique() <= -(-sum(r[3] for r in rows) // 2048) + 6


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 300, 500).astype(float)
    items, cap = np.column_stack([n, np.ones(500), n**2]), np.array([1000.0, 6.0, 150_000.0])
    bins = packing.best_fit(items, cap, np.array([1.0, 0.5, 0.5]), score)
    total = np.zeros((bins.max() + 1, 3))
    np.add.at(total, bins, items)
    assert (total <= cap + 1e-6).all() and len(packing.best_fit(items[:0], cap, np.ones(3))) == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_by_definition(score):
    """Each item, largest first, against all bins one by one; the three capacities all bind somewhere."""
    rng = np.random.default_rng(15)
    for _ in range(6):
        n = rng.integers(1, 100, 120).astype(float)
        items, cap, w = np.column_stack([n, np.ones(120), n**2]), np.array([220.0, 4.0, 9000.0]), np.array([1.0, 0.4, 0.7])
        part = items / cap
        order = sorted(range(120), key=lambda i: (-part[i, 0], -float(part[i] ** 2 @ w), i))
        free, want = [], {}
        for i in order:
            open_bins = [k for k, room in enumerate(free) if all(room[d] >= part[i, d] - 1e-12 for d in range(3))]
            if open_bins:
                value = lambda k: -sum(w[d] * (free[k][d] - part[i, d]) ** 2 for d in range(3)) if score == "norm" else sum(w[d] * free[k][d] * part[i, d] for d in range(3))  # noqa: E731, B023
                best = max(open_bins, key=lambda k: (round(value(k), 12), -k))
            else:
                best = len(free)
                free.append([1.0] * 3)
            free[best] = [free[best][d] - part[i, d] for d in range(3)]
            want[i] = best
        assert packing.best_fit(items, cap, w, score).tolist() == [want[i] for i in range(120)]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 12))
    vectors = [*base, *(base[:15] + rng.normal(size=(15, 12)) * 0.08), *base[:5], *(base[:3] * 7)]
    rows = [(i, v.astype(np.float32).tolist(), "x") for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0]]
    rows += [(100 + k, v, "x") for k, v in enumerate(odd)] + [(None, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    got = {r.vec_id: r for r in neardup.link_embeddings(df, interval_rows=16).collect()}
    x = np.array([r[1] for r in rows[: len(vectors)]], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = lowest(list(zip(*np.nonzero(hit))), range(len(x)))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), want[i], want[i] == i)
    assert all((got[100 + k].n_links, got[100 + k].component_id) == (0, 100 + k) for k in range(len(odd))) and got[None].n_links == 0
    assert neardup.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_of_any_magnitude_and_length(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_FITTED", 2)
    monkeypatch.setattr(neardup, "MOST_PARTS", 3)
    monkeypatch.setattr(neardup, "PARTNERS", 1)
    rng = np.random.default_rng(17)
    rows = [(0, [1e-200, 2e-200]), (1, [1.0, 0.01]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [5e-324, 1e-323]), (5, [1.7e308, 0.0])]
    for d in (1, 3, 4, 12):
        base = rng.normal(size=(25, d))
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate([*base, *(base[:8] * 1e-170), *(base[:9] + rng.normal(size=(9, d)) * 0.1)])]
    got = {r.vec_id: r for r in neardup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), interval_rows=4).collect()}
    unit = [neardup.scaled(np.array([v]))[0] for _, v in rows]
    unit = [u / np.linalg.norm(u) for u in unit]
    hit = np.array([[i != j and len(u) == len(v) and float(u @ v) >= 0.95 for j, v in enumerate(unit)] for i, u in enumerate(unit)])
    want = lowest(list(zip(*np.nonzero(hit))), range(len(rows)))
    assert want[0] == want[2] == want[3] == want[4] == 0 and want[1] == want[5] == 1
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == [(hit[i].sum(), want[i]) for i in range(len(rows))]


def test_boxes_never_lose_a_link():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6))
    x = x[np.lexsort(x.T)]
    seen = np.zeros((600, 600), dtype=bool)
    for a, b, c, d in neardup._leaves(x, x, True, 0.9):
        seen[a:b, c:d] = True
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.81
    assert not (np.triu(near) & ~(seen | seen.T)).any()


def test_language(spark):
    docs = spark.createDataFrame([("the house and the river are here", "en"), ("das haus und der fluss sind hier", "de"), (None, "en"), ("x", None)], "text string, lang string")
    langs, table = language.train(docs)
    assert langs == ["de", "en"]
    page = lambda body, lang: f"<html lang='{lang}'><script>var the = 'the'</script><body><p>{body}</p></body></html>"
    rows = [(i, f"https://h{i % 3}.example.de/{i}", page("das haus und der fluss", "de"), "x") for i in range(9)]
    rows += [(9, "http://en.example.org/", page("the house and the river", "en"), "x"), (10, "https://h0.example.de/x", None, "x"), (11, None, "", "x"), (12, "::", "<p>", "x"), (9, "http://en.example.org/", page("the house and the river", "en"), "x")]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), langs, table).collect()
    best = {r.page_id: r.lang for r in got}
    assert len(got) == len(rows) and all(best[i] == "de" for i in [*range(9), 10]) and best[9] == "en"
    assert all(0 < r.confidence <= 1 for r in got)
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), langs, table).count() == 0
    assert language.train(docs.limit(0))[0] == ["und"]


def test_declared_language_anywhere_in_the_page(spark):
    far = {
        "<!--" + "licence " * 700 + "--><html lang='de'>": "de",
        "<!--<html lang='fr'>" + "x" * 5000 + "--><html lang='de'>": "de",
        " \n" * 3000 + "<HTML class=a\nLANG = de-AT>": "de",
        f"<html {'data-x=1 ' * 800}lang=de>": "de",
        "<html lang=" + " " * 5000 + "'de'>": "de",
        "<script>" + "x" * 5000 + "</script><html lang=de>": "de",
        "<!--><html lang=de><!-- -->": "de",
        "<html>" + "x" * 5000 + "<script>'<html lang=fr>'</script><!--<html lang=fr>-->": "",
        "x" * 9000: "",
    }
    langs, table = language.train(spark.createDataFrame([("the house", "en"), ("das haus", "de")], "text string, lang string"))
    pages = spark.createDataFrame([(i, "http://a.example/", x) for i, x in enumerate(far)], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language.identify(pages, langs, table).collect()} == dict(enumerate(far.values()))
    for piece in ("<html ", "<!--", "<script ", "<html lang=" + " " * 1000, "lang "):  # linear, or these take minutes
        assert language.declared_language("<html " + piece * (1_000_000 // len(piece))) == ""


def test_declared_codes_of_three_letters():
    want = {"fil": "fil", "fi": "fi", "fin": "fi", "haw": "haw", "hau": "ha", "eng": "en", "EN-us": "en", "deu": "de", "ger-AT": "de", "spa": "es", "zho": "zh", "chi": "zh", "gsw": "gsw", "x-odd": ""}
    assert {x: language.declared_language(f"<html lang='{x}'>") for x in want} == want
    assert len(language.TWO_LETTERS) == 205 and all(len(k) == 3 and len(v) == 2 for k, v in language.TWO_LETTERS.items())


def posteriors(pages, langs, table, without=""):
    """Plain recomputation of identify() for pages (host, declared, html); `without` leaves out one piece of evidence."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    text = [table[:, language.triples(language.page_text(h))].sum(axis=1) * language.TEXT_SHARE for _, _, h in pages]
    post = [soft(t) for t in text]
    total = 1 + sum(post)
    base = total / total.sum()
    labels = [{"host": h, "domain": ".".join(h.split(".")[-2:]), "suffix": h.split(".")[-1], "declared": d} for h, d, _ in pages]
    out = []
    for i, own in enumerate(labels):
        others = {by: sum((post[j] for j in range(len(pages)) if j != i and labels[j][by] == v), np.zeros(len(langs))) for by, v in own.items()}
        domain = base if without == "domain" else (others["domain"] + 8 * base) / (others["domain"].sum() + 8)
        host = domain if without == "host" else (others["host"] + 4 * domain) / (others["host"].sum() + 4)
        log = text[i] + np.log(host)
        for by in {"suffix", "declared"} - {without}:
            log = log + np.log((others[by] + 0.5) / (total + 1))
        p = soft(log)
        out.append((langs[int(post[i].argmax())], langs[int(p.argmax())], float(p.max())))
    return out


def test_language_posterior(spark):
    rng = random.Random(22)
    texts = {"en": "the house and the river are here", "de": "das haus und der fluss sind hier", "fr": "la maison et la riviere sont ici"}
    langs, table = language.train(spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string"))
    hosts = ["a.one.de", "b.one.de", "c.two.de", "a.three.fr", "b.three.fr", "x.four.com", "y.four.com", "z.five.com", "localhost", ""]
    pages, rows = [], []
    for i in range(90):
        host, said = rng.choice(hosts), rng.choice(["de", "fr", "en", "fil", ""])
        mine = {"de": "de", "fr": "fr", "one": "de"}.get(host.split(".")[-1], rng.choice([said, "en"]))
        words = texts.get(mine, texts["en"]).split()
        html = rng.choice([None, ""]) if not said and i % 3 == 0 else (f"<html lang='{said}'>" if said else "<html>") + " ".join(rng.sample(words, rng.randint(0, 4)))
        pages.append((host, said, html))
        rows.append((i, f"https://u:p@{host.upper()}:8080/p/{i}?q#f" if host else rng.choice([None, "::"]), html))
    want = posteriors(pages, langs, table)
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, table).collect()}
    assert len(got) == len(rows)
    for i, (first, best, confidence) in enumerate(want):
        r = got[i]
        assert (r.host, r.declared, r.text_lang, r.lang) == (*pages[i][:2], first, best)
        assert abs(r.confidence - confidence) < 2e-6
    for piece in ("host", "domain", "suffix", "declared"):  # each one is seen by the comparison
        assert max(abs(a[2] - b[2]) for a, b in zip(want, posteriors(pages, langs, table, piece))) > 1e-3, piece


def test_warc(spark):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (1, 30, 400, 9000)]
    rows = [(i, f"http://a/{i}", t) for i, t in enumerate([*texts, *texts, None, "", "ü" * 40_000, "x\r\n\r\nWARC/1.1\r\n\r\n" * 50, texts[2]])]
    rows += [(20, None, texts[1]), (21, "http://b/\r\nX: y", texts[3]), (1, "http://a/1", texts[1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter(tuple(r) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        first = min(j for j, _, u in rows if (u or "").encode() == b) if len(b) >= 100 else i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_revisits_name_their_response(spark, tmp_path):
    """Standard fields of revisits; records of foreign types are skipped unless asked for."""
    body = "x" * 150
    df = spark.createDataFrame([(3, "http://a/3", body), (1, "http://a/1", body), (2, "http://a/2", "y")], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/a")
    foreign = "".join(f"WARC/1.1\r\nWARC-Type: {t}\r\nWARC-Record-ID: <{t}>\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n" for t, b in (("warcinfo", "software: x\r\n\r\nmore"), ("request", "GET / HTTP/1.1\r\n\r\nq"), ("resource", "plain\r\n\r\ntext")))
    (tmp_path / "a" / "b.warc.gz").write_bytes(zlib.compress(foreign.encode(), wbits=31))
    fields = [f for p in (tmp_path / "a").glob("*.gz") for f, _ in warc.parse_records(warc.unpack(p.read_bytes()))]
    of = {f.get("warc-page-id"): f for f in fields}
    assert of["3"]["warc-type"] == "revisit" and of["3"]["warc-refers-to"] == of["1"]["warc-record-id"]
    assert of["3"]["warc-refers-to-target-uri"] == "http://a/1" and of["3"]["warc-profile"] == warc.SAME_PAYLOAD and "warc-refers-to" not in of["1"]
    got = sorted((r.record_type, bytes(r.payload or b"")) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect())
    assert got == [("resource", b"plain\r\n\r\ntext"), ("response", body.encode()), ("response", b"y"), ("revisit", b"")]
    every = {r.record_type: bytes(r.payload or b"") for r in warc.read_warc(spark, f"file://{tmp_path}/a", types=None).collect()}
    assert every["warcinfo"] == b"software: x\r\n\r\nmore" and every["request"] == b"q"


def test_warc_framing():
    assert warc.dechunk(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
    for bad in (b"3\r\nab", b"zz\r\n", b"3\r\nabcX"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_missing_segment_is_an_error(spark, tmp_path):
    record = lambda kind, n, more, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <u{n}>\r\nWARC-Segment-Number: {n}\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    head = record("response", 1, "", "HTTP/1.1 200 OK\r\n\r\nab")
    tail = record("continuation", 3, "WARC-Segment-Origin-ID: <u1>\r\nWARC-Segment-Total-Length: 23\r\n", "cd")
    (tmp_path / "a.warc.gz").write_bytes(zlib.compress((head + tail).encode(), wbits=31))
    with pytest.raises(Exception, match="do not add up"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_archive_of_many_members(spark, tmp_path):
    def record(kind, n, more, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <u{n}>\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    rng = random.Random(14)
    bodies = {n: prose(rng, rng.randint(1, 60)) for n in range(40)} | {40: rng.randbytes(100_000).hex()}
    records = [record("response", n, f"WARC-Page-ID: {n}\r\n", f"HTTP/1.1 200 OK\r\n\r\n{b}") for n, b in bodies.items()]
    head = record("response", 50, "WARC-Page-ID: 50\r\nWARC-Segment-Number: 1\r\n", "HTTP/1.1 200 OK\r\n\r\nab")
    tail = record("continuation", 51, "WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <u50>\r\nWARC-Segment-Total-Length: 24\r\n", "cde")
    data = b"".join([head, *records, tail])
    split = sorted(rng.sample(range(1, len(data)), 30))
    gz = lambda parts: b"".join(zlib.compress(p, wbits=31) for p in parts)
    for k, packed in enumerate([gz([head, *records, tail]), gz([data[a:b] for a, b in zip([0, *split], [*split, len(data)])]), gz([b"", data, b""])]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc.gz").write_bytes(packed)
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, f"file://{tmp_path}/{k}").collect()}
        assert got == bodies | {50: "abcde"}
        assert warc.unpack(packed, 7) == data
        for bad in (packed + b"garbage", packed[:-1], packed + packed[:5], b""):
            with pytest.raises((ValueError, zlib.error)):
                warc.unpack(bad)
    (tmp_path / "0" / "a.warc.gz").write_bytes(gz(records) + b"garbage")
    with pytest.raises(Exception, match="incorrect header"):
        warc.read_warc(spark, f"file://{tmp_path}/0").collect()


def test_rules(spark):
    rows = corpus() + [(900, "a b c d e f g h a b c d e f g h"), (901, "line\nline\n\nline\n x"), (902, "one two three four five six seven eight nine " * 3), (903, "# * $ % & | < >")]
    got = Counter(tuple(r)[:8] for r in quality_rules.check(frame(spark, rows)).collect())
    want, bits = Counter(), {}
    for d, t in rows:
        w, t = words(t), t or ""
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        row = (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), base)
        want[row] += 1
    assert Counter({k: v for k, v in Counter(r[:7] for r in got.elements()).items()}) == want
    assert all(not (r[6] and r[7]) for r in got)
    book = quality_rules.ledger(frame(spark, rows)).cache()
    found = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(book).collect()}
    bits = [r.rule_bits & quality_rules.mask("v2") for r in book.collect()]
    for k, name in enumerate(quality_rules.POLICIES["v2"]):
        assert found[name] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert quality_rules.check(frame(spark, [])).count() == 0 and quality_rules.keep_good(frame(spark, rows)).columns == frame(spark, rows).columns


def test_rules_run_without_python(spark):
    plan = quality_rules.check(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_bpe(spark):
    t = Tokenizer.from_file(BYTE)
    rows = corpus() + [(950, "<|endoftext|><|endoftext|>  a"), (951, "x" * 3000), (952, "\x1c\x1d a\x85b\xa0c")]
    df = frame(spark, rows)
    want = Counter()
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(df, BYTE).collect()) == want
    back = bpe.decode(bpe.encode(df, BYTE), BYTE)
    assert Counter(tuple(r) for r in back.collect()) == Counter((d, x or "") for d, x in rows)


def test_long_words_take_time_by_their_length():
    a, t = bpe.codec(BYTE).automaton, Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    for word in ("a" * 100_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "ab" * 50_000):
        began = time.process_time()
        got = a.encode(word.encode())
        assert time.process_time() - began < 2
        assert got == t.encode(word, add_special_tokens=False).ids


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteCodec(WORD)


def test_automaton_on_random_merges():
    """Merges learnt on random words; the path must equal what joining the first merge at a time gives."""
    rng = random.Random(6)
    for _ in range(20):
        texts = ["".join(rng.choice("abc") for _ in range(12)) for _ in range(30)]
        seqs, merges = [list(t) for t in texts], []
        vocab = {c: b for c, b in bpe.byte_names().items()}
        for _ in range(15):
            pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
            if not pairs:
                break
            best = max(pairs, key=lambda p: (pairs[p], p))
            merges.append(best)
            vocab.setdefault("".join(best), len(vocab))
            seqs = [join(s, best) for s in seqs]
        a = bpe.MergeAutomaton(vocab, merges)
        for t in texts + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 25))) for _ in range(60)]:
            s = list(t)
            for m in merges:
                s = join(s, m)
            assert a.encode(t.encode()) == [vocab[x] for x in s]


def join(s, pair):
    out, i = [], 0
    while i < len(s):
        two = i + 1 < len(s) and (s[i], s[i + 1]) == pair
        out.append(s[i] + s[i + 1] if two else s[i])
        i += 1 + two
    return out


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard(spark, width, percent):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 7]
    got = jaccard.link_documents(frame(spark, rows), width=width, percent=percent).collect()
    sets = shingle_sets(rows, width)
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = lowest(pairs, {r[0] for r in rows})
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(s), want[d]) for (d, _), s in zip(rows, sets))


def test_jaccard_odd_rows(spark):
    rows = corpus()
    got = jaccard.link_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert jaccard.link_documents(frame(spark, [])).count() == 0


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    base = rng.poisson(3, size=(30, jaccard.GROUPS))
    points = np.concatenate([base, np.maximum(base + rng.integers(-1, 2, size=base.shape), 0), rng.poisson(1, size=(100, jaccard.GROUPS))]).astype(np.uint32)
    got = {tuple(sorted(p)) for u, v in jaccard.CountRTree(points, 80).pairs() for p in zip(u.tolist(), v.tolist())}
    size = points.sum(axis=1, dtype=np.int64)
    want = {(i, j) for j in range(len(points)) for i in range(j) if 180 * np.minimum(points[i], points[j]).sum() >= 80 * (size[i] + size[j])}
    assert got == want


def test_linked_sets_share_the_keys_that_their_sizes_ask_for():
    rng = np.random.default_rng(9)
    for percent in (60, 80, 85):
        for n in [*range(1, 60), 150, 400, 1500]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b, drop = a.copy(), rng.random()
                while True:
                    c = np.delete(b, rng.integers(len(b))) if rng.random() < drop else np.union1d(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                    if not len(c) or not jaccard.links(len(a), len(c), len(np.intersect1d(a, c)), percent):
                        break
                    b = c
                x, y = (s[: len(s) - int(jaccard.left_out(np.int64(len(s)), percent))] for s in (a, b))
                assert len(np.intersect1d(x, y)) >= jaccard.needed(np.int64(len(a)), np.int64(len(b)), percent) >= 1


def test_least_keys_needed(spark):
    for percent in (60, 80, 85):
        rows = spark.range(1, 400).withColumn("f", jaccard.needed_of(F.col("id"), percent)).collect()
        for r in rows:
            n = np.int64(r.id)
            partners = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
            assert 1 <= r.f <= jaccard.needed(n, partners, percent).min()


def test_shingles_that_are_longest_come_first():
    s = jaccard.shingles("a bb ccc " + "d" * 300 + " e", 2)
    assert (255 - (s >> np.uint64(56)).astype(int)).tolist() == [255, 255, 5, 3]
    assert len(jaccard.shingles("A b a B a b", 2)) == 2 and len(jaccard.shingles("one two", 4)) == 1


@pytest.mark.parametrize("light, medium, node, crowded", [(2, 3, 4, 0), (2, 8, 2, 4)])
def test_jaccard_with_crowded_keys(spark, monkeypatch, light, medium, node, crowded):
    """Families of near copies, and a passage that many texts share, through every tier."""
    for name, value in (("LIGHT", light), ("MEDIUM", medium), ("NODE", node), ("SALTED", 9), ("STAR", 3), ("PARTNERS", 2), ("CROWDED", crowded)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(31)
    passage, texts = prose(rng, 40), []
    for _ in range(3):
        w = prose(rng, 60).split()
        for _ in range(14):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(v))
    texts += [f"{passage} {prose(rng, rng.randint(1, 8))}" for _ in range(25)] + [passage]
    rows = list(enumerate(texts))
    got = jaccard.link_documents(frame(spark, rows)).collect()
    sets = shingle_sets(rows, 5)
    want = lowest([(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], range(len(rows)))
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(want.items())


def test_shards(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill(names, 1009)
    counts = np.bincount(table, minlength=7)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    free, want, turn = set(range(1009)), {}, 0
    orders = [sharding.preference(s, 1009).tolist() for s in sorted(names)]
    while free:
        s = next(x for x in orders[turn % 7] if x in free)
        want[s] = turn % 7
        free.remove(s)
        turn += 1
    assert table.tolist() == [want[k] for k in range(1009)]
    fewer = sharding.fill(names[:-1], 1009)
    kept = table != 6
    assert (fewer[kept] == table[kept]).mean() > 0.85
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (2, "d")], "doc_id long, shard string")
    got = sharding.place(df, "doc_id", names, slots=1009).collect()
    where = lambda d: xxhash.xxh64_intdigest(b"" if d is None else str(d).encode(), seed=42) % (1 << 64)
    assert len(got) == 5
    for r in got:
        h = where(r.doc_id)
        assert r.slot == (h - (1 << 64) if h >> 63 else h) % 1009 and r.shard == table[r.slot]
    assert sharding.place(df.limit(0), "doc_id", names, slots=1009).columns == ["doc_id", "slot", "shard"]
    for bad in ([], ["a"] * 3):
        with pytest.raises(ValueError):
            sharding.fill(bad, 1000)


def test_written_shards(spark, tmp_path):
    rows = corpus()
    names = [f"s{k}" for k in range(5)]
    got = Counter(tuple(r) for r in sharding.shard_documents(frame(spark, rows), names).collect())
    placed = {r.doc_id: (r.slot, r.shard) for r in sharding.place(frame(spark, rows), "doc_id", names).collect()}
    want = Counter((d, *placed[d], None if t is None else len(t.encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert got == want
    assert sharding.shard_documents(frame(spark, []), names).count() == 0
    sharding.write_shards(frame(spark, rows), "key", names, f"{tmp_path}/x", files=4)  # one key has all rows
    back = sharding.read_shards(spark, f"{tmp_path}/x")
    assert back.count() == len(rows) and set(back.columns) == {*frame(spark, rows).columns, "slot", "shard"}
    (one,) = {r.shard for r in back.select("shard").distinct().collect()}
    assert 1 < len(list((tmp_path / "x" / f"shard={one}").glob("*.parquet"))) <= 4
    assert sharding.read_shards(spark, f"{tmp_path}/x", (one + 1) % 5).count() == 0


def test_classifier(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = prose(rng, rng.randint(20, 90))
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad and i % 2 else " ".join([text.split()[0]] * 40) if bad else text))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "some text here"), (5, rows[5][1])]
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(frame(spark, rows), lab)
    got = classifier.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    want = {d: q for d, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in held if r.doc_id in want) >= 0.97 * len([r for r in held if r.doc_id in want])
    again = classifier.RuleModel.from_json(model.to_json())
    assert again == model and 0 < len(model.rules) < 200
    none = classifier.train(frame(spark, rows), lab.limit(0))
    assert {r.score for r in classifier.score(frame(spark, rows), none).collect()} == {0.5}
    assert classifier.score(frame(spark, []), model).count() == 0
    kept = classifier.keep_good(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns


def test_classifier_on_held_out_documents(spark):
    """Accuracy and ranking on labelled rows that the fit has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.classify(docs, labels).filter("held_out").join(labels.filter("quality is not null"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(got) > 300 and (got.predicted == got.quality).mean() > 0.98
    good, bad = (got.score[got.quality == q].to_numpy() for q in (1, 0))
    assert ((good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2) > 0.97


@pytest.mark.parametrize("keep", [lambda d: quality_rules.keep_good(d), lambda d: classifier.keep_good(d, classifier.RuleModel(0.1, [((("symbols", True, 0.2), ("n_words", False, 9.0)), -3.0), ((("marks", True, 0.1),), -1.0)]))])
def test_filters_stay_above_what_they_test(spark, keep):
    """Measurements are not computed anew inside the filter's condition."""
    plan = keep(frame(spark, corpus()))._jdf.queryExecution().optimizedPlan().toString()
    conditions = [x for x in plan.split("\n") if re.match(r"[\s:+-]*Filter ", x)]
    assert conditions and not any("split(" in x or "regexp_replace" in x for x in conditions)


def covered(texts, n):
    starts = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        f = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if starts[b[i : i + n]] > 1:
                f[i : i + n] = True
        out.append(f)
    return out


@pytest.mark.parametrize("length, pieces, crowd, block", [(400, 20_000, 64, 4_000_000), (60, 20_000, 64, 4_000_000), (60, 3, 2, 50), (40, 5, 1, 10), (7, 20_000, 2, 200)])
def test_repeats(spark, monkeypatch, length, pieces, crowd, block):
    for name, value in (("PIECES", pieces), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    if length < 40:
        rows = [(i, (t or "")[:1500]) for i, t in rows]
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), b, f in zip(rows, data, covered(data, length)):
        kept = np.frombuffer(b, dtype=np.uint8)[~f].tobytes()
        want[d, len(b), int(f.sum()), int((np.diff(np.concatenate([[0], f.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.remove_repeats(frame(spark, rows), length=length)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_hold_little_on_disk(spark, monkeypatch):
    """Suffixes are not written down beside their shuffle, and the texts' shuffle is let go of before pieces are compared."""
    log = []
    keep, release = repeats.keep, repeats.release
    monkeypatch.setattr(repeats, "keep", lambda df: log.append(df.columns) or keep(df))
    monkeypatch.setattr(repeats, "release", lambda s: log.append("release") or release(s))
    monkeypatch.setattr(repeats, "PIECES", 3)
    assert repeats.remove_repeats(frame(spark, corpus()), length=60).filter("n_removed > 0").count() > 0
    assert not any("packed" in x for x in log)
    at = [k for k, x in enumerate(log) if "piece" in x]
    assert len(at) == 1 and log[at[0] + 1] == "release"


def test_repeats_within_periodic_texts(spark):
    """Places of one text that are near each other have one start; a string met twice at one place is no repeat."""
    rng = random.Random(19)
    once = prose(rng, 200)
    texts = ["ab" * 400, "a" * 900, "xyz" * 40 + once, once[:150] + "q" * 61, "0123456789" * 7, once[40:180] + once[40:180], "k" * 60, "k" * 59]
    data = [t.encode() for t in texts]
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, list(enumerate(texts))), length=60, texts=True).collect()}
    for i, (b, f) in enumerate(zip(data, covered(data, 60))):
        assert got[i].n_removed == int(f.sum())
        assert got[i].text.encode() == np.frombuffer(b, dtype=np.uint8)[~f].tobytes()


def test_difference_covers():
    for q in (2, 3, 5, 7, 11, 13, 17):
        d, p = repeats.singer(q), q * q + q + 1
        assert len(d) == q + 1 and {(i - j) % p for i in d for j in d} == set(range(p))
    assert repeats.cover_of(400)[0] == 307 and repeats.cover_of(240)[0] == 183 and repeats.cover_of(5) == (1, (0,))
    period, residues = repeats.cover_of(60)
    gram = 60 - period + 1
    at = set(repeats.sampled(200, gram, period, residues).tolist())
    for i in range(0, 140):
        for j in range(0, 140):
            assert any(i + k in at and j + k in at for k in range(period))


def test_word_encoder_on_odd_white_space_and_long_words():
    t = Tokenizer.from_file(WORD)
    e = WordEncoder(WORD, most=5000)
    texts = ["a\x0bb\x85c\xa0d\x0ce", "it's IT'S 'tis we'll''s --'s 'd", "x" * 3000, "1234 5.6e-7 é ÉÀ ſ ŉ ß", "\xa0", "", "İstanbul ı", "a—b–c “q” €5"]
    for found, text in zip(e.encode_many(texts), texts, strict=True):
        assert found.tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert max(map(len, e.known)) <= 256


def test_packing_keeps_ids_exact_beside_a_null(spark):
    ids = [9007199254740993, None, 9007199254740995, -(2**63), 2**63 - 1]
    got = packing.pack_documents(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string"), WORD).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    assert sorted(r.offset for r in got) == [k * got[0].length for k in range(5)]
