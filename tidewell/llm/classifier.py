"""Quality classifier: an ensemble of rules taken from trees, weighted by a lasso logistic fit, run as Spark columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Most labelled rows that a model is fitted on, the first ones by a hash of doc_id; labels beyond it are not used.
FIT_ROWS = 20_000
FEATURES = ("n_words", "word_length", "symbols", "capitals", "marks", "digits", "letters", "distinct_words", "adjacent_repeats", "distinct_lines", "line_words", "stops")


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and FEATURES of every whole text of `docs` (doc_id, text); a null text counts as empty, ratios of nothing
    as 0. With `carry`, the whole row comes along as _row."""
    rows = [F.struct(*docs.columns).alias("_row")] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), *rows)
    rows = ["_row"] if carry else []
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACES), ""))
    left = lambda p: F.length(F.regexp_replace("_t", p, "")).cast("double")
    df = df.select(
        "doc_id",
        F.size("_w").cast("double").alias("_n"),
        F.length("_t").cast("double").alias("_chars"),
        F.length(F.array_join("_w", "")).cast("double").alias("_wchars"),
        left(r"[^#*$%&|<>]+").alias("_sym"),
        left(r"[^A-Z]+").alias("_up"),
        left(r"[^A-Za-z]+").alias("_abc"),
        left(r"[^!]+").alias("_bang"),
        left(r"[^0-9]+").alias("_dig"),
        left(r"[^.]+").alias("_stop"),
        F.size(F.array_distinct("_w")).cast("double").alias("_dw"),
        F.size(F.filter("_w", lambda w, i: w.eqNullSafe(F.when(i > 0, F.get("_w", i - 1))))).cast("double").alias("_adj"),
        F.size(F.split("_t", "\n")).cast("double").alias("_l"),
        F.size(F.array_distinct(F.split("_t", "\n"))).cast("double").alias("_dl"),
        *rows,
    )
    c = F.col
    part = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return df.select(
        "doc_id",
        c("_n").alias("n_words"),
        part("_wchars", "_n").alias("word_length"),
        part("_sym", "_n").alias("symbols"),
        part("_up", "_abc").alias("capitals"),
        part("_bang", "_n").alias("marks"),
        part("_dig", "_chars").alias("digits"),
        part("_abc", "_wchars").alias("letters"),
        part("_dw", "_n").alias("distinct_words"),
        part("_adj", "_n").alias("adjacent_repeats"),
        part("_dl", "_l").alias("distinct_lines"),
        part("_n", "_l").alias("line_words"),
        part("_stop", "_n").alias("stops"),
        *rows,
    )


Condition = tuple[str, bool, float]  #: feature, whether above (else not above), threshold


@dataclass
class RuleModel:
    """Conjunctive rules with weights; the score is the logistic function of the intercept and the weights of rules that hold."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in conditions:
                holds = holds & ((F.col(name) > at) if above else (F.col(name) <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "rules": self.rules})

    @classmethod
    def from_json(cls, text: str) -> RuleModel:
        d = json.loads(text)
        return cls(d["intercept"], [(tuple((n, bool(a), float(t)) for n, a, t in c), float(w)) for c, w in d["rules"]])


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> list[tuple[tuple[int, bool, int], ...]]:
    """Paths of a regression tree on binned features: every inner step from the root is a rule."""
    paths: list[tuple[tuple[int, bool, int], ...]] = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if len(path) == depth or len(rows) < 2 * least:
            return
        r, best = residual[rows], (0.0, -1, -1)
        for f in rng.choice(x.shape[1], size=max(3, x.shape[1] // 2), replace=False):
            k = len(cuts[f]) + 1
            n = np.bincount(x[rows, f], minlength=k).cumsum()[:-1]
            s = np.bincount(x[rows, f], weights=r, minlength=k).cumsum()[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), 0) - r.sum() ** 2 / len(rows)
                b = int(gain.argmax())
                if gain[b] > best[0] + 1e-9:
                    best = (float(gain[b]), int(f), b)
        _, f, b = best
        if f < 0:
            return
        for above in (False, True):
            step = (*path, (f, above, b))
            paths.append(step)
            split(rows[(x[rows, f] > b) == above], step)

    split(np.arange(len(x)), ())
    return paths


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic weights under an absolute penalty, by accelerated proximal steps; the intercept is free."""
    n, k = m.shape
    bound = 0.25 * (np.linalg.norm(m, 2) ** 2 / n + 1) if k else 0.25
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ z[1:] + z[0], -40, 40)))
        g = np.concatenate([[(p - y).mean()], m.T @ (p - y) / n])
        new = z - g / bound
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / bound, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / after * (new - w)
        w, t = new, after
    return float(w[0]), w[1:]


def fit(values: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, bins: int = 48, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """Fits rules on statistics (rows of FEATURES) and labels 0/1; without both classes the score is constant."""
    n = len(y)
    prior = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    if n < 20 or y.min() == y.max():
        return RuleModel(base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 2)[1:-1])) for c in values.T]
    x = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, values.T, strict=True)])
    score, paths = np.full(n, base), {}
    for _ in range(trees):
        some = rng.choice(n, size=max(20, n // 2), replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        grown = _grow(x[some], cuts, residual[some], depth, max(5, n // 500), rng)
        if not grown:
            break
        for p in grown:
            paths[tuple(sorted(p))] = None
        for p in [p for p in grown if not any(q[: len(p)] == p and len(q) > len(p) for q in grown)]:  # leaves
            hit = np.all([(x[:, f] > b) == above for f, above, b in p], axis=0)
            if hit.any():
                score[hit] += np.clip(4 * residual[hit].mean(), -1, 1)
    rules = list(paths)
    m = np.column_stack([np.all([(x[:, f] > b) == above for f, above, b in p], axis=0) for p in rules]).astype(np.float64) if rules else np.zeros((n, 0))
    columns, kept = np.unique(m, axis=1, return_index=True)
    intercept, w = _lasso(columns, y.astype(np.float64), penalty)
    return RuleModel(intercept, [(tuple((FEATURES[f], above, float(cuts[f][b])) for f, above, b in rules[k]), float(v)) for k, v in zip(kept, w, strict=True) if abs(v) > 1e-6])


def held_out() -> Column:
    """Every document whose crc32 of doc_id as text is divisible by 5; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> RuleModel:
    """Fits on at most `fit_rows` labelled documents that are not held out. `labels` has doc_id and quality.

    The chosen labels are a table of a bounded size and are broadcast, so texts are not shuffled.
    """
    from pyspark.sql.functions import broadcast

    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = statistics(texts).join(broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES, "y").limit(fit_rows).select(*FEATURES, "y").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text), in Spark columns only.

    Empty and null texts are scored by their statistics, all zero. Repeated rows are scored each; other columns are
    ignored; an empty table gives no rows.
    """
    s = statistics(docs).withColumn("score", model.column())
    return s.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns and without a shuffle."""
    s = statistics(docs, carry=True).withColumn("_place", F.monotonically_increasing_id())
    # the condition on _place keeps the filter above the statistics: below, each rule would compute them anew
    return s.filter((F.col("_place") >= 0) & (model.column() >= threshold)).select("_row.*")
