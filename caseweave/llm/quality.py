"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of measures of its whole text.  Of a pair of documents with labels 1 and 0 the
first is preferred; the weights minimise the logistic loss on the differences of the pairs' measures, so they rank rather
than fit label frequencies.  Strengths are then cut at a quantile of the training strengths: the share of label 0.

Fit: at most ``SAMPLE_LABELS`` labelled documents (those with the smallest md5 of their id) and ``PAIRS`` pairs of them.
Everything else covers every whole text.

Null and empty texts have measures of zero words and are scored like any text.  Labels that are null are not used; where
a document has several labels each is used.  Without labels of both kinds every score is 0.5.  Repeated rows are scored
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, hash_order, map_arrow, table
from .textwork import SPACE, Words, chunks, windows

SAMPLE_LABELS = 8_000
PAIRS = 60_000
RIDGE = 1e-3
NEWTON_STEPS = 25

# fixed values: byte classes that the measures count
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
           "marks": b"#*$%&<>~^=_\\{}[]@+", "bang": b"!", "bar": b"|", "stops": b".,;:?'\"()-/", "newline": b"\n"}
MEASURES = ["upper", "digit", "marks", "bang", "bar", "stops", "worst", "word_len", "log_words", "distinct", "repeats", "dup_lines",
            "line_words", "no_letter", "single", "empty"]


def measures(texts: list[bytes]) -> np.ndarray:
    """One row of MEASURES per text."""
    w = Words(texts)
    n_docs = w.n_docs
    n_words = np.diff(w.first)
    some = np.maximum(n_words, 1)
    per_byte = lambda flags: np.add.reduceat(flags.astype(np.int64), w.doc_start[:-1])
    lut = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in CLASSES.items()}
    count = {k: per_byte(t[w.buf]) for k, t in lut.items()}
    count["newline"] = np.minimum(count["newline"], np.maximum(n_words, 1))
    solid = np.maximum(per_byte(~SPACE[w.buf]), 1)
    share = {k: count[k] / solid for k in ("upper", "digit", "marks", "bang", "bar", "stops")}
    per_word = lambda flags: np.bincount(w.doc, flags, n_docs)
    lengths = w.ends - w.starts
    letters = np.concatenate([[0], np.cumsum(lut["lower"][w.buf] | lut["upper"][w.buf] | (w.buf >= 128))])
    h = w.hashes()
    # words seen before in the same text, found by sorting word hashes inside each text
    order = np.lexsort((h, w.doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    distinct = 1 - np.bincount(w.doc[order], again, n_docs) / some
    at, run = windows(h, w.first, 5)
    d = w.doc[at]
    o = np.lexsort((run, d))
    same = np.zeros(len(run), bool)
    same[1:] = (run[o][1:] == run[o][:-1]) & (d[o][1:] == d[o][:-1])
    repeats = np.bincount(d[o], same, n_docs) / some
    dup = np.zeros(n_docs)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    out = np.stack([
        *[np.sqrt(share[k]) for k in ("upper", "digit", "marks", "bang", "bar", "stops")],
        np.sqrt(np.maximum.reduce([share["marks"], share["bang"], share["bar"], share["upper"] - 0.15, repeats])),
        np.log1p(per_word(lengths) / some), np.log1p(n_words), distinct * np.sqrt(some / (some + 200.0)), np.sqrt(repeats), np.sqrt(dup),
        np.log1p(n_words / (count["newline"] + 1)), per_word(letters[w.ends] == letters[w.starts]) / some, per_word(lengths == 1) / some,
        (n_words == 0).astype(float)], axis=1)
    return out


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(measures, *keep) for docs (text, *keep)."""
    def run(batches):
        for batch in batches:
            rows = [measures(t) for _, t in chunks(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *[batch.column(c) for c in keep]], ["measures", *keep])

    rows = docs.select("text", *keep)
    return map_arrow(rows, run, ", ".join(["measures array<double>", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]]))


@dataclass
class Ranking:
    """Strength = weights . (measures - mean) / spread; score = logistic of (strength - threshold) * slope."""
    mean: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - np.array(self.mean)) / np.array(self.spread)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip((s - self.threshold) * self.slope, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Ranking:
    """Weights from preference pairs of a bounded sample, by Newton steps on the logistic loss of differences."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking([0.0] * d, [1.0] * d, [0.0] * d, 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rng = np.random.default_rng(7)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))     # chance given to the wrong order
        grad = -diff.T @ p / pairs + RIDGE * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    return Ranking(mean.tolist(), spread.tolist(), w.tolist(), float(np.quantile(s, len(bad) / len(y))), 1.0)


def score(docs: DataFrame, ranking: Ranking, keep: list[str]) -> DataFrame:
    """(score, *keep) for docs (text, *keep)."""
    def run(batches):
        for batch in batches:
            rows = [ranking.score(measures(t)) for _, t in chunks(batch.column("text"))]
            s = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), *[batch.column(c) for c in keep]], ["score", *keep])

    rows = docs.select("text", *keep)
    return map_arrow(rows, run, ", ".join(["score double", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]]))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Ranking from docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sample = known.withColumn("key", hash_order()).orderBy("key", "quality").limit(SAMPLE_LABELS).drop("key")
    rows = measure(docs.join(F.broadcast(sample), "doc_id"), ["doc_id", "quality"]).toPandas()     # bounded by the sample
    rows = rows.sort_values(["doc_id", "quality"])
    x = np.array(rows["measures"].tolist()).reshape(len(rows), len(MEASURES))
    return fit(x, rows["quality"].to_numpy())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ranking = learn(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, ranking, ["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
