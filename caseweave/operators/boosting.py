"""Multiclass gradient boosting by histograms: trees over binned features, grown level by level in Spark.

Every pass over the training rows sums the gradients of all classes per (class, node, feature, bin) in the tasks, adds the
sums in Spark and finds the best split of each node there; the driver sees one row per node.  Gradients are rounded to
multiples of 2^-20 and summed as integers, so the trees do not depend on partitions or on the order of rows.

A missing value (NaN) has a bin of its own and goes to the side that gains more, learned per split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import cut, ship

BINS = 64
ROUNDS = 8
DEPTH = 3
RATE = 0.5
#: Added to the sum of second derivatives of a node, and the least such sum of a child.
RIDGE = 1.0
LEAST = 0.5
#: Gradients are multiples of one over this.
GRAIN = 1 << 20
#: Combinations of bins of features that are counted at once.
CELLS = 1_024
#: Rounds after which the scores of the rows are written, so that later passes start from them.
WRITE_EVERY = 4


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i+1 and 2i+2; feature -1 marks a leaf."""
    feature: np.ndarray
    threshold: np.ndarray                 # a bin goes left if it is at most this
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node each row of ``bins`` reaches (0 is the bin of missing values)."""
        at = np.zeros(len(bins), np.uint8 if len(self.feature) <= 256 else np.int64)
        for i in np.flatnonzero(self.feature >= 0):             # parents come before their children
            b = bins[:, self.feature[i]]
            right = b > int(self.threshold[i])
            if not self.missing_left[i]:
                right |= b == 0
            at += (at == i) * (right + at.dtype.type(i + 1))
        return at.astype(np.int64)


@dataclass
class Model:
    classes: list[str]
    features: list[str]
    edges: list[np.ndarray]               # upper bounds of the bins from 1 on, per feature
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left") + 1)
        return out

    def scores(self, bins: np.ndarray, rounds: list[list[Tree]] | None = None, start: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds if rounds is None else rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.node(bins)]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(self.bins(x)))

    def split_features(self) -> list[str]:
        """Features that some tree splits on; no other can change a prediction."""
        return [self.features[j] for j in self._split_on()]

    def _split_on(self) -> list[int]:
        return sorted({int(f) for trees in self.rounds for t in trees for f in t.feature if f >= 0})

    def narrowed(self) -> "Model":
        """The same trees over ``split_features`` alone."""
        used = self._split_on()
        place = np.full(len(self.features) + 1, -1, np.int32)               # the last is that of leaves, -1
        place[used] = np.arange(len(used))
        rounds = [[replace(t, feature=place[t.feature]) for t in trees] for trees in self.rounds]
        return Model(self.classes, self.split_features(), [self.edges[j] for j in used], self.base, rounds)

    def rows(self) -> Iterator[tuple]:
        """The model as rows (part, a, b, c, number, flag), to be stored as a table."""
        for i, c in enumerate(self.classes):
            yield ("class", i, 0, 0, float(self.base[i]), False, c)
        for j, (name, e) in enumerate(zip(self.features, self.edges)):
            yield ("feature", j, 0, 0, 0.0, False, name)
            for b, v in enumerate(e):
                yield ("edge", j, b, 0, float(v), False, None)
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                for i in range(len(t.feature)):
                    yield ("node", r, k, i, float(t.value[i]), bool(t.missing_left[i]), f"{t.feature[i]},{t.threshold[i]}")

    @classmethod
    def of_rows(cls, rows: list) -> "Model":
        part: dict[str, list] = {"class": [], "feature": [], "edge": [], "node": []}
        for r in sorted(map(tuple, rows), key=lambda r: r[:4]):
            part[r[0]].append(r)
        edges: list[list[float]] = [[] for _ in part["feature"]]
        for r in part["edge"]:
            edges[r[1]].append(r[4])
        model = cls([r[6] for r in part["class"]], [r[6] for r in part["feature"]], [np.array(e) for e in edges], np.array([r[4] for r in part["class"]]))
        size = max((r[3] for r in part["node"]), default=0) + 1
        for r in part["node"]:
            if r[1] == len(model.rounds):
                model.rounds.append([])
            if r[2] == len(model.rounds[r[1]]):
                model.rounds[r[1]].append(Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size)))
            t = model.rounds[r[1]][r[2]]
            t.feature[r[3]], t.threshold[r[3]] = map(int, r[6].split(","))
            t.missing_left[r[3]], t.value[r[3]] = r[5], r[4]
        return model


ROW_TYPES = "part string, a int, b int, c int, number double, flag boolean, name string"


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bin_edges(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Bounds of up to ``bins`` - 1 bins per entry of ``features``, from quantile sketches over all rows."""
    share = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    value = lambda j: F.nanvl(F.element_at("features", j + 1), F.lit(None).cast("double"))
    got = rows.agg(*[F.percentile_approx(value(j), share, 2_000).alias(f"q{j}") for j in range(width)]).first()
    return [np.unique(np.array(got[j] or [], float)) for j in range(width)]


def _binned(rows: DataFrame, models: list[Model]) -> DataFrame:
    """(y, fold, bins, scores): what training reads, narrow; scores of all models, one after the other."""
    first = models[0]
    label = F.array_position(F.array(*map(F.lit, first.classes)), F.col("label")).cast("int") - 1
    base = np.concatenate([m.base for m in models])

    def run(batches):
        for batch in batches:
            b = first.bins(numbers(batch.column("features"), len(first.features)))
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(base)), pa.array(np.tile(base, len(b))))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), packed(b), scores], names=["y", "fold", "bins", "scores"])

    return rows.select(label.alias("y"), "fold", "features").mapInArrow(run, "y int, fold int, bins binary, scores array<double>")


def numbers(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of arrays of ``width`` numbers, an absent number as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def packed(bins: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(bins))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """``packed`` back, a feature's bytes side by side as trees read them."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.asfortranarray(np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, start).reshape(len(column), width))


def _unpack(batch: pa.RecordBatch, models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = unpacked(batch.column("bins"), len(models[0].features))
    scores = numbers(batch.column("scores"), len(models) * len(models[0].classes)).reshape(len(bins), len(models), len(models[0].classes))
    return batch.column("y").to_numpy(), batch.column("fold").to_numpy(), bins, scores


def _joined(sizes: list[int], most: int = CELLS) -> list[list[int]]:
    """Features in groups whose combinations of bins are at most ``most``, those of few bins together."""
    groups: list[list[int]] = []
    for j in sorted(range(len(sizes)), key=lambda j: sizes[j]):
        if groups and np.prod([sizes[i] for i in groups[-1]]) * sizes[j] <= most:
            groups[-1].append(j)
        else:
            groups.append([j])
    return groups


def _histograms(rows: DataFrame, models: list[Model], since: list[list[list[Tree]]], growing: list[list[Tree]], level: int) -> DataFrame:
    """(k, node, j, bin, g, h): sums over all rows whose deepest node in a growing tree is on this level; k counts the classes of all models."""
    first_model = models[0]
    classes = len(first_model.classes)
    first, count = (1 << level) - 1, 1 << level

    sizes = [len(e) + 2 for e in first_model.edges]
    groups = _joined(sizes)

    def run(batches):
        kinds = len(models) * classes
        # cells of a group are the combinations of its features' bins, so that one count serves them all
        joint = [np.zeros((2, kinds, count, int(np.prod([sizes[j] for j in js]))), np.int64) for js in groups]
        for batch in batches:
            y, fold, bins, scores = _unpack(batch, models)
            for v, m in enumerate(models):
                mine = np.flatnonzero((fold != v - 1) | (v == 0))                                    # model 0 sees all rows, model v all but fold v - 1
                b, own = bins if v == 0 else np.asfortranarray(bins[mine]), y[mine]
                p = softmax(m.scores(b, since[v], scores[mine, v]))
                g = np.rint((p - (own[:, None] == np.arange(classes))) * GRAIN)
                h = np.rint(p * (1 - p) * GRAIN)
                cells = []
                for js in groups:
                    cell = b[:, js[0]].astype(np.int64)
                    for j in js[1:]:
                        cell = cell * sizes[j] + b[:, j]
                    cells.append(cell)
                for k in range(classes):
                    at = growing[v][k].node(b) - first
                    here = np.flatnonzero(at >= 0)
                    at, gh = at[here], (g[here, k], h[here, k])
                    for total, cell in zip(joint, cells):
                        width = total.shape[-1]
                        cell = (cell if len(here) == len(cell) else cell[here]) + at * width
                        for i, x in enumerate(gh):
                            total[i, v * classes + k] += np.bincount(cell, x, count * width).astype(np.int64).reshape(count, width)
        total = np.zeros((2, kinds, count, len(sizes), max(sizes, default=0)), np.int64)
        for js, t in zip(groups, joint):
            t = t.reshape(2, kinds, count, *[sizes[j] for j in js])
            for i, j in enumerate(js):
                total[:, :, :, j, :sizes[j]] = t.sum(tuple(3 + o for o in range(len(js)) if o != i))
        k, node, j, b = np.nonzero(total[0] | total[1])
        cols = {"k": k, "node": node + first, "j": j, "bin": b}
        yield pa.RecordBatch.from_pydict({**{c: x.astype(np.int32) for c, x in cols.items()}, "g": total[0][k, node, j, b], "h": total[1][k, node, j, b]})

    part = rows.mapInArrow(run, "k int, node int, j int, bin int, g long, h long")
    return part.groupBy("k", "node", "j", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best_splits(hist: DataFrame) -> list:
    """Per (k, node) its sums and its best split; gain 0 where none is worth it."""
    slot = W.partitionBy("k", "node", "j")
    run = slot.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    known = lambda c: F.when(F.col("bin") > 0, F.col(c)).otherwise(0)
    rows = hist.withColumns({
        "sg": F.sum("g").over(slot), "sh": F.sum("h").over(slot), "lg": F.sum(known("g")).over(run), "lh": F.sum(known("h")).over(run),
        "mg": F.sum("g").over(slot) - F.sum(known("g")).over(slot), "mh": F.sum("h").over(slot) - F.sum(known("h")).over(slot)})
    grain = F.lit(float(GRAIN))
    part = lambda g, h: (g / grain) * (g / grain) / (h / grain + RIDGE)

    def gain(lg: Column, lh: Column) -> Column:
        rg, rh = F.col("sg") - lg, F.col("sh") - lh
        whole = part(lg, lh) + part(rg, rh) - part(F.col("sg"), F.col("sh"))
        return F.when((lh >= LEAST * GRAIN) & (rh >= LEAST * GRAIN) & (whole > 1e-6), whole).otherwise(0.0)

    side = lambda left, g, h: F.struct(F.lit(left).alias("left"), gain(g, h).alias("gain"), g.alias("lg"), h.alias("lh"))
    sides = F.explode(F.array(side(False, F.col("lg"), F.col("lh")), side(True, F.col("lg") + F.col("mg"), F.col("lh") + F.col("mh"))))
    rows = rows.select("k", "node", "j", "bin", "sg", "sh", sides.alias("s")).select("k", "node", "j", "bin", "sg", "sh", "s.*")
    order = F.struct(F.round("gain", 9), -F.col("j"), -F.col("bin"), ~F.col("left"))
    best = F.max_by(F.struct("gain", "j", "bin", "left", "lg", "lh"), order)
    # every feature holds all rows of the node, so any gives the sums
    return rows.groupBy("k", "node").agg(F.max_by(F.struct("sg", "sh"), F.lit(0)).alias("t"), best.alias("b")).select("k", "node", "t.*", "b.*").collect()


def fit(rows: DataFrame, classes: list[str], features: list[str], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Model of rows (label, features); a label outside ``classes`` is an error, no rows give even chances."""
    return fit_folds(rows.select("label", "features", F.lit(-1).alias("fold")), classes, features, 0, rounds, depth, rate)[0]


def fit_folds(rows: DataFrame, classes: list[str], features: list[str], folds: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list[Model]:
    """The model of all rows (label, features, fold), then for each fold one of all other rows, grown side by side in the same passes."""
    ship(rows.sparkSession)
    counts: dict[tuple, int] = {(r["label"], r["fold"]): r["n"] for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {c for c, _ in counts} - set(classes):
        raise ValueError(f"labels {sorted(map(str, {c for c, _ in counts} - set(classes)))} are not among the classes")
    edges, models = bin_edges(rows, len(features)), []
    for v in range(folds + 1):
        own = [sum(n for (c, f), n in counts.items() if c == cls and (v == 0 or f != v - 1)) for cls in classes]
        models.append(Model(list(classes), list(features), edges, np.log((np.array(own) + 1) / (sum(own) + len(classes)))))
    if not counts:
        return models
    data = cut(_binned(rows, models))
    since: list[list[list[Tree]]] = [[] for _ in models]
    value = lambda g, h: -rate * g / (h + RIDGE * GRAIN)
    for r in range(rounds):
        growing = [[Tree.empty(depth) for _ in classes] for _ in models]
        for level in range(depth):
            for s in _best_splits(_histograms(data, models, since, growing, level)):
                v, k = divmod(s["k"], len(classes))
                t, i = growing[v][k], s["node"]
                t.value[i] = value(s["sg"], s["sh"])
                if s["gain"] > 0:
                    t.feature[i], t.threshold[i], t.missing_left[i] = s["j"], s["bin"], s["left"]
                    t.value[2 * i + 1], t.value[2 * i + 2] = value(s["lg"], s["lh"]), value(s["sg"] - s["lg"], s["sh"] - s["lh"])
        for v, m in enumerate(models):
            since[v].append(growing[v])
            m.rounds.append(growing[v])
        if (r + 1) % WRITE_EVERY == 0 and r + 1 < rounds:
            data, since = cut(_advanced(data, models, since)), [[] for _ in models]
    return models


def _advanced(data: DataFrame, models: list[Model], since: list[list[list[Tree]]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            _, _, bins, scores = _unpack(batch, models)
            grown = np.concatenate([m.scores(bins, since[v], scores[:, v]) for v, m in enumerate(models)], axis=1)
            ends = pa.array(np.arange(len(grown) + 1, dtype=np.int32) * grown.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("y", "fold", "bins")] + [pa.ListArray.from_arrays(ends, pa.array(grown.ravel()))],
                                             names=["y", "fold", "bins", "scores"])

    return data.mapInArrow(run, data.schema)


def swapped_hits(model: Model, own: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of bins ``own`` classed as ``y`` when one feature is taken from ``other``, per feature; last, when none is.

    A row whose bin stays keeps its class.  The others add up the same tree values in the same order as ``Model.scores``,
    those of trees without the feature as they were.
    """
    values = [[t.value[t.node(own)] for t in trees] for trees in model.rounds]
    full = np.tile(model.base, (len(own), 1))
    for trees in values:
        for k, v in enumerate(trees):
            full[:, k] += v
    good = full.argmax(1) == y
    hits = np.full(own.shape[1] + 1, good.sum(), np.int64)
    for j in range(own.shape[1]):
        moved = np.flatnonzero(own[:, j] != other[:, j])
        if not len(moved):
            continue
        bins = np.asfortranarray(own[moved])
        bins[:, j] = other[moved, j]
        scores = full[moved]
        for k in range(len(model.classes)):
            on = [j in trees[k].feature for trees in model.rounds]
            if any(on):
                scores[:, k] = model.base[k]
                for trees, old, split in zip(model.rounds, values, on):
                    scores[:, k] += trees[k].value[trees[k].node(bins)] if split else old[k][moved]
        hits[j] += (scores.argmax(1) == y[moved]).sum() - good[moved].sum()
    return hits


def probabilities(model: Model, features: Column) -> Column:
    """Class probabilities of an array of numbers, as an array in the order of the model's classes."""
    width = len(model.features)
    ship(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proba(x: pd.Series) -> pd.Series:
        return pd.Series(list(model.proba(np.array(x.tolist(), float).reshape(len(x), width))))

    return proba(features)


def fold_probabilities(models: list[Model], features: Column, fold: Column) -> Column:
    """As ``probabilities``, of each row by the model of its fold (``fit_folds``: the first is that of all rows)."""
    width = len(models[0].features)
    ship(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proba(x: pd.Series, f: pd.Series) -> pd.Series:
        rows, which = np.array(x.tolist(), float).reshape(len(x), width), f.to_numpy()
        out = np.zeros((len(x), len(models[0].classes)))
        for v, m in enumerate(models[1:]):
            out[which == v] = m.proba(rows[which == v])
        return pd.Series(list(out))

    return proba(features, fold)


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame(list(model.rows()), ROW_TYPES).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.of_rows(spark.read.parquet(path).collect())
