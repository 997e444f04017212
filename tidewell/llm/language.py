"""Language of web pages: text likelihoods, declared language, address suffix and host priors in one posterior."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Buckets of hashed letter triples, which bound the model at any number of texts.
BUCKETS = 1 << 14
#: Most languages of a model, so that its table has a bounded size.
MOST_LANGUAGES = 256
#: Weight of the level above in a host's and a domain's prior, in pages.
HOST_WEIGHT, DOMAIN_WEIGHT = 4.0, 8.0
#: Share of the text's log-likelihood that counts: neighbouring triples are not independent.
TEXT_SHARE = 0.25

#: Where a comment or an element without visible text begins, and where such elements end.
_OPEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_TAG = re.compile(r"<[^>]*>")
#: The html tag, anywhere outside comments and elements that hold no markup; each branch takes in what it reads, so a search is linear.
_HTML = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template)\b.*?(?:</\1\b|\Z)|<html\b(?P<tag>[^>]*)", re.S | re.I)
_LANG = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,})", re.I)
#: Terminological codes of ISO 639-2, and the codes of ISO 639-1 of the same languages.
TERMINOLOGICAL = """
aar aa, abk ab, afr af, aka ak, amh am, ara ar, arg an, asm as, ava av, ave ae, aym ay, aze az, bak ba, bam bm,
bel be, ben bn, bih bh, bis bi, bod bo, bos bs, bre br, bul bg, cat ca, ces cs, cha ch, che ce, chu cu, chv cv,
cor kw, cos co, cre cr, cym cy, dan da, deu de, div dv, dzo dz, ell el, eng en, epo eo, est et, eus eu, ewe ee,
fao fo, fas fa, fij fj, fin fi, fra fr, fry fy, ful ff, gla gd, gle ga, glg gl, glv gv, grn gn, guj gu, hat ht,
hau ha, heb he, her hz, hin hi, hmo ho, hrv hr, hun hu, hye hy, ibo ig, ido io, iii ii, iku iu, ile ie, ina ia,
ind id, ipk ik, isl is, ita it, jav jv, jpn ja, kal kl, kan kn, kas ks, kat ka, kau kr, kaz kk, khm km, kik ki,
kin rw, kir ky, kom kv, kon kg, kor ko, kua kj, kur ku, lao lo, lat la, lav lv, lim li, lin ln, lit lt, ltz lb,
lub lu, lug lg, mah mh, mal ml, mar mr, mkd mk, mlg mg, mlt mt, mol mo, mon mn, mri mi, msa ms, mya my, nau na,
nav nv, nbl nr, nde nd, ndo ng, nep ne, nld nl, nno nn, nob nb, nor no, nya ny, oci oc, oji oj, ori or, orm om,
oss os, pan pa, pli pi, pol pl, por pt, pus ps, que qu, roh rm, ron ro, run rn, rus ru, sag sg, san sa, sin si,
slk sk, slv sl, sme se, smo sm, sna sn, snd sd, som so, sot st, spa es, sqi sq, srd sc, srp sr, ssw ss, sun su,
swa sw, swe sv, tah ty, tam ta, tat tt, tel te, tgk tg, tgl tl, tha th, tir ti, ton to, tsn tn, tso ts, tuk tk,
tur tr, twi tw, uig ug, ukr uk, urd ur, uzb uz, ven ve, vie vi, vol vo, wln wa, wol wo, xho xh, yid yi, yor yo,
zha za, zho zh, zul zu
"""
#: Bibliographic codes of ISO 639-2 that differ from the terminological ones.
BIBLIOGRAPHIC = """
alb sq, arm hy, baq eu, bur my, chi zh, cze cs, dut nl, fre fr, geo ka, ger de, gre el, ice is, mac mk, mao mi,
may ms, per fa, rum ro, slo sk, tib bo, wel cy
"""
TWO_LETTERS = dict(pair.split() for pair in f"{TERMINOLOGICAL}, {BIBLIOGRAPHIC}".split(","))


def page_text(markup: str | None) -> str:
    """Visible text of a page: scripts, styles, comments and tags are left out, entities decoded. What is opened and never closed
    stays; that there is no end is found out once, so a page takes time in proportion to its length."""
    page, kept, at, pos, endless = markup or "", [], 0, 0, set()
    while m := _OPEN.search(page, pos):
        name, end = (m[1] or "").lower(), -1
        if name not in endless:
            if not name:
                end = page.find("-->", m.end()) + 3 if page.find("-->", m.end()) >= 0 else -1
            elif (tag := page.find(">", m.end())) >= 0 and (close := _CLOSE[name].search(page, tag + 1)):
                end = close.end()
            if end < 0:
                endless.add(name)
        pos = m.end() if end < 0 else end
        if end >= 0:
            kept.append(page[at : m.start()])
            at = end
    page = " ".join([*kept, page[at:]])
    last = page.rfind(">") + 1  # no tag ends behind it
    return html.unescape(_TAG.sub(" ", page[:last]) + page[last:])


def declared_language(markup: str | None) -> str:
    """Language that the page's html tag declares, wherever the tag stands; the first of several, empty if there is none.

    It is the whole primary subtag in lower case; a code of three letters that has one of two letters becomes that.
    """
    for tag in _HTML.finditer(markup or ""):
        if m := _LANG.search(tag["tag"] or ""):
            code = m[1].lower()
            return TWO_LETTERS.get(code, code)
    return ""


def triples(text: str) -> np.ndarray:
    """Buckets of the lower-case text's triples of code points, runs of non-letters as one space."""
    kept = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    c = np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F)
    return ((h ^ (h >> np.uint64(17))) * np.uint64(0x165667B1) >> np.uint64(13)).astype(np.int64) % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples by language, summed over a task before anything is sent."""
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in total:
                    if len(total) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    total[lang] = np.zeros(BUCKETS, dtype=np.int64)
                total[lang] += np.bincount(triples(text), minlength=BUCKETS)
    for lang, n in total.items():
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int32)), pa.array(n[k])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of triples from `docs` (text, lang), over all rows; null languages don't count."""
    rows = docs.filter("lang is not null and text is not null").select(F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text"))
    n = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(n["lang"].unique())
    if not langs:
        langs, table = ["und"], np.ones((1, BUCKETS))
        return langs, np.log(table / BUCKETS)
    table = np.full((len(langs), BUCKETS), 0.5)
    table[n["lang"].map({x: k for k, x in enumerate(langs)}), n["bucket"]] += n["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _describe(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            scores, declared = [], []
            for markup in batch.column("html").to_pylist():
                declared.append(declared_language(markup))
                s = table[:, triples(page_text(markup))].sum(axis=1) * TEXT_SHARE
                scores.append(s - s.max())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(declared), pa.array(scores, pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"])


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def identify(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Language of `pages` (page_id, url, html): page_id, host, declared, text_lang, lang, confidence.

    The posterior of a page is the product of its text's likelihood (tempered), the probability of its declared
    language and of its address suffix given each language, and its host's prior. These come from grouped sums of the
    pages' text posteriors: a host's prior leans on its domain's, and that on the prior of all pages, the more the
    fewer pages there are; a page's own posterior is taken out of its host's and domain's sums. The declared language is
    that of the html tag anywhere in the page, outside comments, scripts, styles and templates. Null or empty html
    has the same likelihood in every language; a null or odd url has the empty host, suffix and domain; ties go to
    the first language by name. Repeated rows count each; other columns are ignored; no pages give no rows.
    """
    k = len(langs)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    d = rows.mapInArrow(partial(_describe, table=table), "page_id long, host string, declared string, text array<double>")
    d = d.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    d = cut(d.withColumn("post", _softmax(F.col("text"))))
    sums = [F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(k)]
    whole = d.agg(*sums).first()
    total = [float(x or 0.0) + 1.0 for x in whole]
    base = F.array(*(F.lit(x / sum(total)) for x in total))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    for by in ("host", "domain", "suffix", "declared"):
        got = d.groupBy(by).agg(*sums).select(by, F.array(*(F.col(f"s{i}") for i in range(k))).alias(f"_{by}"))
        d = d.join(got, by)
    rest = lambda c: F.transform(F.arrays_zip(F.col(c).alias("a"), F.col("post").alias("b")), lambda z: F.greatest(z.a - z.b, F.lit(0.0)))
    blend = lambda own, above, w: F.transform(F.arrays_zip(own.alias("a"), above.alias("b")), lambda z: (z.a + w * z.b) / (size(own) + w))
    d = d.withColumn("_d0", rest("_domain")).withColumn("_h0", rest("_host"))
    d = d.withColumn("_dp", blend(F.col("_d0"), base, DOMAIN_WEIGHT)).withColumn("_hp", blend(F.col("_h0"), F.col("_dp"), HOST_WEIGHT))
    totals = F.array(*(F.lit(x) for x in total))
    given = lambda c: F.transform(F.arrays_zip(F.col(c).alias("a"), F.col("post").alias("b"), totals.alias("t")), lambda z: F.ln((F.greatest(z.a - z.b, F.lit(0.0)) + 0.5) / (z.t + 1.0)))
    d = d.withColumn("_e1", given("_suffix")).withColumn("_e2", given("_declared"))
    log = F.transform(F.arrays_zip("text", "_hp", "_e1", "_e2"), lambda z: z.text + F.ln(z["_hp"]) + z["_e1"] + z["_e2"])
    d = d.withColumn("_post", _softmax(log))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return d.select("page_id", "host", "declared", best(F.col("post")).alias("text_lang"), best(F.col("_post")).alias("lang"), F.round(F.array_max("_post"), 6).alias("confidence"))
