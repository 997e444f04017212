"""The pipeline's stages on small planted tables, against brute force."""

import random

import corpus_pipeline
from test_operators import lowest, prose, shingle_sets


def survivors(rows):
    """Components of rows (doc_id, text) as lists of rows; rows without a shingle are alone."""
    rows = list(dict.fromkeys(rows))
    sets = shingle_sets(rows, 5)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = {}
    for i, c in lowest(pairs, range(len(rows))).items():
        parts.setdefault(c, []).append(rows[i])
    return list(parts.values())


def test_near_copies_with_repeated_and_null_ids(spark):
    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = lambda t: t + " changed"
    rows = [(7, a), (7, near(a)), (3, b), (9, near(b)), (9, c), (None, ""), (None, None), (None, d), (None, near(d)), (None, d), (5, e), (None, near(e)), (None, e), (11, None), (11, None), (11, " "), (3, b)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    parts = survivors(rows)
    assert len(kept) == len(set(kept)) == len(parts) == 9
    for part in parts:
        (one,) = set(part) & set(kept)
        assert one[0] == min((i for i, _ in part if i is not None), default=None)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0
