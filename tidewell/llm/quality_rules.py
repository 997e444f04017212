"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies are masks over the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Window of the repetition measure, in words.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def _rules() -> list[tuple[str, Column]]:
    """Name and failure condition of each rule; the place in the list is the bit and never changes."""
    c = F.col
    return [
        ("few_words", c("n_words") < 20),
        ("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 24 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > 4 * c("n_words")),
        ("repeated_lines", (10 * c("n_dup_lines") > 3 * c("n_lines")) & (c("n_dup_lines") > 1)),
        ("capitals", (10 * c("n_upper") > 6 * c("n_letters")) & (c("n_letters") > 0)),
        ("exclamations", 10 * c("n_marks") > 5 * c("n_words")),
    ]


#: Versioned policies: the rules whose failure drops a document. "base" holds the fixed rules only.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols"),
    "v2": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "exclamations"),
}


def mask(policy: str) -> int:
    names = [n for n, _ in _rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words from the array _w of word hashes: sorted window hashes show which places recur, and the
    places' gaps, at most a window each, add up to the words covered."""
    n = F.size("_w")
    spans = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", spans).withColumn("_some", F.size(F.array_distinct("_g")) < F.size("_g"))
    pairs = F.when(F.col("_some"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", pairs)
    hash_at = lambda k: F.get("_s", k)["h"]
    again = F.filter("_s", lambda e, k: (F.when(k > 0, hash_at(k - 1)).eqNullSafe(e.h)) | (hash_at(k + 1).eqNullSafe(e.h)))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda e: e.i)))
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.col("_some"), covered).otherwise(0).cast("long")).drop("_g", "_some", "_s", "_p")


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The measurements of every whole text of `docs` (doc_id, text), in row order of the input and without a shuffle.
    With `carry`, the whole row comes along as _row.

    Words are runs of characters other than space and the controls 9 to 13. A null or empty text has no words, no
    lines and zeros. Repeated rows are measured each; other columns are dropped.
    """
    rows = [F.struct(*docs.columns).alias("_row")] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), *rows)
    rows = ["_row"] if carry else []
    df = df.withColumn("_words", F.array_remove(F.split("_t", SPACES), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    count = lambda p: F.length(F.regexp_replace("_t", p, "")).cast("long")
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        count(r"[^A-Z]+").alias("n_upper"),
        count(r"[^A-Za-z]+").alias("n_letters"),
        count(r"[^!]+").alias("n_marks"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"),
        *rows,
    )
    return _repeated(df).select("doc_id", *MEASURES, *rows)


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Measurements and rule_bits (bit k: the k-th rule fails) of each document; no rule is evaluated twice."""
    m = measure(docs, carry)
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("rule_bits", bits)


def fails(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept under a policy; nothing is measured again."""
    return book.withColumn("base_failed", fails(F.col("rule_bits"), "base")).withColumn("kept", ~fails(F.col("rule_bits"), "base") & ~fails(F.col("rule_bits"), policy))


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it drops; one grouped pass over bits.

    Rows are grouped by their bit pattern first, so the shuffle has one row a pattern and task. An empty ledger
    gives no rows.
    """
    names = [n for n, _ in _rules()]
    m = mask(policy)
    seen = book.groupBy(F.col("rule_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy])))
    seen = seen.select("*", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return seen.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of `docs` that pass a policy, with all their columns and without a shuffle."""
    book = apply_policy(ledger(docs, carry=True), policy).withColumn("_place", F.monotonically_increasing_id())
    # the condition on _place keeps the filter above the measurements: below, each rule would compute them anew
    return book.filter("_place >= 0 and kept").select("_row.*")


def check(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, the contract's measures, rule_bits, base_failed and kept of every document."""
    return apply_policy(ledger(docs), policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
                  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
     g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
     g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
     c AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, range(8) AS x(k) GROUP BY r),
     m AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters,
                  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_marks, coalesce(c.n, 0) AS n_repeat_words
           FROM w LEFT JOIN c ON c.r = w.r),
     b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
                  | (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) | (CASE WHEN word_chars > 24 * n_words THEN 8 ELSE 0 END)
                  | (CASE WHEN 10 * n_symbols > 4 * n_words THEN 16 ELSE 0 END) | (CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1 THEN 32 ELSE 0 END)
                  | (CASE WHEN 10 * n_upper > 6 * n_letters AND n_letters > 0 THEN 64 ELSE 0 END) | (CASE WHEN 10 * n_marks > 5 * n_words THEN 128 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS rule_bits
FROM b
"""


#: The ablations of the newest policy, from the measurements above: each rule's bit in every document's pattern.
ABLATIONS_SQL = f"""
WITH book AS ({ORACLE_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{n}', {1 << k})" for k, n in enumerate(POLICIES['v2']))})
SELECT rule, CAST(count(*) FILTER (WHERE rule_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE rule_bits = bit) AS BIGINT) AS n_only
FROM book, r GROUP BY rule
"""
