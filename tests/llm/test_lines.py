"""Shared lines against brute force: ties, repeats, nulls, odd white space, clashing columns, no rows."""

import hashlib
import random
from collections import defaultdict

from tidewell.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def by_hand(rows, least, documents):
    found = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else ():
            found[key(line)].add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if d is None or len(key(x)) < least or len(found[key(x)]) < documents or d == max(found[key(x)])]
        out.append((d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def test_lines(spark):
    rng = random.Random(4)
    stock = [f"line {k} " + "ab Ünïcödé 日本 " * rng.randint(0, 5) for k in range(40)]
    rows = []
    for d in range(80):
        picked = [rng.choice(stock) for _ in range(rng.randint(0, 12))]
        rows.append((d, "\n".join(rng.choice(["", " ", "\t\x0b", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \r"]) for x in picked)))
    long = "a line that every document of this table holds at its end"
    rows = [(d, t + "\n" + long + "\n" + long) for d, t in rows]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, long), (103, long), (103, "\x1f" + long), (None, long), (None, None), (5, long + "\nanother row of a doc_id that is taken"), (104, "x " * 50000 + "\n" + long)]
    df = spark.createDataFrame([(*r, "row", 1, 2, [3]) for r in rows], "doc_id long, text string, _row string, n_lines int, pos int, drop array<int>")
    for least, documents in ((40, 5), (20, 2)):
        got = lines.drop_shared_lines(df, least=least, documents=documents)
        assert got.columns == ["doc_id", "text", "_row", "pos", "drop", "n_lines", "n_dropped"]
        have = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr)
        assert have == sorted(by_hand(rows, least, documents), key=repr)
    assert any(r[3] for r in by_hand(rows, 40, 5))


def test_digests_and_no_rows(spark):
    df = spark.createDataFrame([(d, f"short\n{'shared ' * 9}") for d in range(6)], "doc_id long, text string")
    out = {r.doc_id: r for r in lines.digests(df).collect()}
    assert out[0].kept_sha256 == hashlib.sha256(b"short").hexdigest() and (out[0].n_lines, out[0].n_dropped) == (2, 1)
    assert out[5].n_dropped == 0
    assert lines.digests(df.limit(0)).collect() == []


def test_heavy_lines_and_others(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", 2)  # one line of many takes the broadcast, the others the join
    rows = [(d, "\n".join([f"the line that all of these documents do hold {'x' * 10}", f"a line of a few documents, number {d % 7} of {'y' * 20}"])) for d in range(50)]
    got = lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(by_hand(rows, 40, 5))
