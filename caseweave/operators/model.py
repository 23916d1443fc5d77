"""Training, calibration, evaluation, gate, store and registry of the traffic classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import constants as C
from ..functions import expr as X
from ..session import cut, ship
from ..sources.snapshots import Pointer, Snapshots
from . import boosting

GATE_FPR = 1.05
HOLDOUT = 25


def training_set(events: DataFrame) -> DataFrame:
    """Labelled rows with the group key that must not straddle a split."""
    bucket = F.floor(F.col("ts_us") / F.lit(600 * C.US)).cast("long").cast("string")
    key = F.when(F.coalesce(F.col("session_id"), F.lit("")) != "", F.concat(F.lit("sess:"), F.col("session_id"))
                 ).otherwise(F.concat(F.lit("ip:"), F.col("src_ip"), F.lit(":"), bucket))
    return events.where(F.col("pred_class").isNotNull()).withColumns({"label": F.col("pred_class"), "group_key": key})


def in_holdout(group_key: Column, seed: int = 42) -> Column:
    """A quarter of the groups by stable hash: no shuffle, and the same rows on every retrain."""
    return X.md5_number(F.concat(group_key, F.lit(f":{seed}"))) % 100 < HOLDOUT


def grouped_holdout(rows: DataFrame, seed: int = 42) -> DataFrame:
    return rows.withColumn("is_test", in_holdout(F.col("group_key"), seed))


def frozen_holdout(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Reuse stored holdout ids (event_id): same test rows for every candidate."""
    mark = stored.select("event_id").distinct().withColumn("_held", F.lit(True))
    return rows.join(mark, "event_id", "left").withColumn("is_test", F.coalesce("_held", F.lit(False))).drop("_held")


def model_inputs(rows: DataFrame) -> DataFrame:
    """Adds ``features``, the numbers in fixed order: an absent browser number stays missing (NaN), an absent server number is 0."""
    browser = set(C.BROWSER_FEATURES)
    nan = F.lit(float("nan"))
    arr = F.array(*[F.coalesce(F.col(f).cast("double"), nan) if f in browser else F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
                    for f in C.FEATURES])
    return rows.withColumn("features", arr)


def fit_classifier(train: DataFrame, rounds: int = boosting.ROUNDS, depth: int = boosting.DEPTH) -> boosting.Model:
    """Gradient boosting over the seven classes, grown on histograms summed in Spark; missing values go the way that gains more.

    The label index is the fixed class list, so every fold and version agrees on it.
    """
    return boosting.fit(train.select("label", "features"), C.CLASSES, C.FEATURES, rounds, depth)


def fit_forest(train: DataFrame, trees: int = 20, depth: int = 6, seed: int = 42):
    """MLlib random forest on the same rows, missing numbers as -1: what the boosted model is measured against."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexerModel

    index = StringIndexerModel.from_labels(C.CLASSES, inputCol="label", outputCol="label_ix")
    forest = RandomForestClassifier(labelCol="label_ix", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[index, forest]).fit(_vectors(train.select("label", "features")))


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("vector", array_to_vector(F.transform("features", lambda v: F.nanvl(v, F.lit(-1.0)))))


def predict_forest(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return _decided(model.stages[1].transform(_vectors(rows)).withColumn("proba", vector_to_array("probability")), C.CLASSES)


def class_labels(model: boosting.Model) -> list[str]:
    return list(model.classes)


def _decided(rows: DataFrame, labels: list[str]) -> DataFrame:
    best = F.array_position("proba", F.array_max("proba")).cast("int")
    return rows.withColumns({"model_class": F.element_at(F.array(*map(F.lit, labels)), best), "model_confidence": F.array_max("proba")})


def predict(model: boosting.Model, rows: DataFrame, maps: dict | None = None) -> DataFrame:
    """Class probabilities as an array, best class and its probability; ``maps`` calibrate them."""
    out = _decided(rows.withColumn("proba", boosting.probabilities(model, F.col("features"))), class_labels(model))
    return out if maps is None else apply_calibration(out, maps)


def _check_labels(labels: list[str]) -> None:
    """``proba`` follows ``C.CLASSES``; a map fitted in another order would calibrate another class's column."""
    if list(labels) != list(C.CLASSES):
        raise ValueError(f"labels must be {C.CLASSES} in this order, not {labels}")


def calibrate(scored: DataFrame, labels: list[str] = C.CLASSES):
    """One isotonic map per class, its (score, value) knots, on out-of-fold scores; ``apply_calibration`` renormalises."""
    from pyspark.ml.regression import IsotonicRegression

    _check_labels(labels)
    maps = {}
    for i, cls in enumerate(labels):
        rows = scored.select(F.element_at("proba", i + 1).alias("features"),
                             (F.col("label") == cls).cast("double").alias("label"))
        fitted = IsotonicRegression().fit(rows)
        maps[cls] = [(float(b), float(v)) for b, v in zip(fitted.boundaries, fitted.predictions)]
    return maps


def fit_with_folds(rows: DataFrame, folds: int = 3, seed: int = 7) -> tuple[boosting.Model, DataFrame]:
    """The model of all rows, and (event_id, label, proba) of each row by a model that did not see its group."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("group_key", F.lit(seed)), F.lit(folds)).cast("int"))
    models = boosting.fit_folds(rows.select("label", "features", "fold"), C.CLASSES, C.FEATURES, folds)
    return models[0], rows.select("event_id", "label", boosting.fold_probabilities(models, F.col("features"), F.col("fold")).alias("proba"))


def out_of_fold(rows: DataFrame, folds: int = 3, seed: int = 7) -> DataFrame:
    """Scores of each row by a model that did not see its group."""
    return fit_with_folds(rows, folds, seed)[1]


def apply_calibration(scored: DataFrame, maps: dict, labels: list[str] = C.CLASSES) -> DataFrame:
    """Piecewise-linear isotonic maps as literal lookup arrays: no join and no Python."""
    _check_labels(labels)

    def mapped(cls: str, x: Column) -> Column:
        knots = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(v).alias("v")) for b, v in maps[cls]])
        low = F.try_element_at(F.filter(knots, lambda k: k["b"] <= x), F.lit(-1))
        high = F.try_element_at(F.filter(knots, lambda k: k["b"] >= x), F.lit(1))
        span = high["b"] - low["b"]
        between = F.when(span == 0, low["v"]).otherwise(
            low["v"] + (high["v"] - low["v"]) * F.try_divide(x - low["b"], span))
        return F.coalesce(between, low["v"], high["v"])

    raw = F.array(*[mapped(cls, F.element_at("proba", i + 1)) for i, cls in enumerate(labels)])
    out = scored.withColumn("_raw", raw)
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    fair = F.when(total > 0, F.transform("_raw", lambda v: v / total)).otherwise(F.col("proba"))
    return _decided(out.withColumn("proba", fair), labels).drop("_raw")


def attack_score(labels: list[str]) -> Column:
    if "normal" in labels:
        return 1.0 - F.element_at("proba", labels.index("normal") + 1)
    return F.array_max("proba")


# --- metrics: plain aggregates over (label, pred) or (is_attack, score) ---------------

def confusion_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Label x prediction counts over the seven classes, one column per prediction."""
    return rows.groupBy("label").agg(*[F.count_if(F.col("pred") == c).alias(c) for c in C.CLASSES])


def macro_prf(rows: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 over the classes seen; 0 where undefined."""
    n = confusion_counts(rows)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    per = n.select(F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), hit.alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("tp")))).alias("r")).select("r.*")
    per = per.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("actual", "called", "tp")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("called")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return per.agg(X.half_up(F.avg(p), 6).alias("precision"), X.half_up(F.avg(r), 6).alias("recall"),
                   X.half_up(F.avg(f1), 6).alias("f1"))


#: Distinct scores that a task orders.
RANGE_SCORES = 100_000


def threshold_table(rows: DataFrame) -> DataFrame:
    """Cumulative true and false positives at every distinct score, as it is, and the place of the score from the lowest.

    A prefix sum in two passes: distinct scores are range-partitioned and written, the sums of the parts are ordered,
    and scores are ordered inside their part only, so no task orders more than ``RANGE_SCORES`` of them or so.
    """
    g = cut(rows.groupBy("score").agg(F.sum(F.col("is_attack").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")))
    size = g.count()
    g = cut(g.repartitionByRange(max(1, -(-size // RANGE_SCORES)), "score").withColumn("part", F.spark_partition_id()))
    zero = F.lit(0).cast("long")
    above, below = (W.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.desc("part"), F.asc("part")))      # over one row per part
    tops = g.groupBy("part").agg(F.sum("tp").alias("b_tp"), F.sum("n").alias("b_n"), F.count(F.lit(1)).alias("b_c"))
    tops = tops.select("part", F.coalesce(F.sum("b_tp").over(above), zero).alias("a_tp"), F.coalesce(F.sum("b_n").over(above), zero).alias("a_n"),
                       F.coalesce(F.sum("b_c").over(below), zero).alias("base"))
    inside, rising = W.partitionBy("part").orderBy(F.desc("score")), W.partitionBy("part").orderBy("score")
    cum = g.join(tops, "part").select(
        "score", (F.col("a_tp") + F.sum("tp").over(inside)).alias("cum_tp"), (F.col("a_n") + F.sum("n").over(inside)).alias("cum_n"),
        F.col("tp").alias("step_tp"), (F.col("base") + F.row_number().over(rising) - 1).alias("pos_ix"))
    total = g.agg(F.sum("tp").alias("pos"), F.sum("n").alias("all_n"))
    return cum.join(F.broadcast(total)).select(
        F.col("score").alias("threshold"), "pos_ix", "cum_tp", (F.col("cum_n") - F.col("cum_tp")).alias("cum_fp"),
        "step_tp", "pos", (F.col("all_n") - F.col("pos")).alias("neg"),
        F.try_divide(F.col("cum_tp"), F.col("cum_n")).alias("precision"), F.try_divide(F.col("cum_tp"), F.col("pos")).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision."""
    t = threshold_table(rows)
    return t.agg(X.half_up(F.sum(F.try_divide(F.col("step_tp"), F.col("pos")) * F.col("precision")), 6
                           ).alias("average_precision"))


def fpr_at_90_recall(rows: DataFrame) -> DataFrame:
    """False-positive rate at the highest threshold that reaches 90 % recall."""
    t = threshold_table(rows).where(F.col("recall") >= 0.9)
    top = t.agg(F.max_by(F.struct("cum_fp", "neg"), F.col("threshold")).alias("m"))
    return top.select(X.half_up(F.col("m.cum_fp") / F.greatest(F.lit(1), F.col("m.neg")), 6).alias("fpr_at_90_recall"))


def pr_curve(rows: DataFrame, points: int = 14) -> DataFrame:
    """Evenly spaced points of the precision-recall curve, from the lowest threshold to the (recall 0, precision 1) end.

    A position is the rank of a threshold from the lowest.
    """
    t = threshold_table(rows)
    size = t.agg(F.count(F.lit(1)).alias("size"))
    picks = size.select("size", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select(
        "size", F.floor(F.col("k") * F.col("size") / (points - 1)).cast("long").alias("pos_ix")).distinct()
    hit = picks.join(t.select("pos_ix", "recall", "precision"), "pos_ix", "left")
    end = F.col("pos_ix") == F.col("size")
    return hit.select("pos_ix", X.half_up(F.when(end, 0.0).otherwise(F.col("recall")), 3).alias("recall"),
                      X.half_up(F.when(end, 1.0).otherwise(F.col("precision")), 3).alias("precision"))


def numbered(rows: DataFrame, salt: str, buckets: int = 4096) -> DataFrame:
    """Numbers the rows from 0 in a hash order (``rn``): counts per bucket, then places inside it."""
    order = F.xxhash64("event_id", F.lit(salt))
    rows = rows.withColumn("_o", order).withColumn("_b", F.pmod(F.shiftright("_o", 20), F.lit(buckets)))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)                     # over one row per bucket
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_o", "event_id"))
    return rows.join(counts, "_b").withColumn("rn", F.col("base") + place - 1).drop("_o", "_b", "base")


def permutation_importance(model: boosting.Model, rows: DataFrame, repeats: int = 3, top: int = 12) -> DataFrame:
    """Mean accuracy drop when one feature is shuffled among all rows.

    Rows are numbered once in a hash order.  In each repeat a row's donor is the one a fixed distance further round, a
    bijection that needs no second numbering, and the row meets it in one join: rows shuffled do not depend on the
    number of features.  Rows travel as the bins of the features that trees split on (no other can change a prediction).
    Tasks then swap one feature at a time, score just the rows whose bin it changes, by the trees that split on it, and
    only sums leave them.
    """
    spark, small = rows.sparkSession, model.narrowed()
    width, used = len(small.features), [model.features.index(f) for f in small.features]
    if not used:
        return spark.createDataFrame([], "feature string, importance double")
    ship(spark)
    label = F.coalesce(F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")), F.lit(0)).cast("int") - 1
    kept = rows.select("event_id", label.alias("y"), F.array(*[F.element_at("features", j + 1) for j in used]).alias("features"))

    def binned(batches):
        for batch in batches:
            b = small.bins(boosting.numbers(batch.column("features"), width))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("y"), boosting.packed(b)], names=["event_id", "y", "bins"])

    rows = numbered(kept.mapInArrow(binned, T.StructType([rows.schema["event_id"], *T.StructType.fromDDL("y int, bins binary")])), "donors")
    rows = cut(rows.select("rn", "y", "bins"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "feature string, importance double")
    shifts = [1 + (n // (repeats + 1) * (r + 1) + r) % max(n - 1, 1) for r in range(repeats)]
    donor = F.explode(F.array(*[F.pmod(F.col("rn") + F.lit(s), F.lit(n)) for s in shifts]))
    given = rows.select(F.col("rn").alias("donor"), F.col("bins").alias("given"))
    pairs = rows.select("y", "bins", donor.alias("donor")).join(given, "donor").select("y", "bins", "given")

    def run(batches):
        hits, count = np.zeros(width + 1, np.int64), 0
        for batch in batches:
            own, other = (boosting.unpacked(batch.column(c), width) for c in ("bins", "given"))
            y = batch.column("y").to_numpy()
            hits += boosting.swapped_hits(small, own, other, y)
            count += len(y)
        yield pa.RecordBatch.from_pydict({"j": pa.array([*used, -1], pa.int32()), "hits": hits, "n": np.full(width + 1, count)})

    sums = pairs.mapInArrow(run, "j int, hits long, n long").groupBy("j").agg((F.sum("hits") / F.sum("n")).alias("acc"))
    whole = sums.where("j = -1").select(F.col("acc").alias("full"))
    name = F.element_at(F.array(*map(F.lit, model.features)), F.col("j") + 1)
    drop = sums.where("j >= 0").join(F.broadcast(whole)).select(name.alias("feature"), (F.col("full") - F.col("acc")).alias("drop"))
    return (drop.where(F.col("drop") > 0).select("feature", X.half_up(F.col("drop"), 4).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


# --- registry -------------------------------------------------------------------------

def promotion_gate(candidates: DataFrame, champion: DataFrame) -> DataFrame:
    """Reject a candidate whose PR-AUC falls or whose false-positive rate grows by more than 5 %."""
    ch = champion.select(F.col("pr_auc").alias("c_auc"), F.col("fpr_at_90_recall").alias("c_fpr"))
    j = candidates.join(F.broadcast(ch), F.lit(True), "left")
    worse_auc = F.col("pr_auc") < F.col("c_auc")
    worse_fpr = (F.col("c_fpr") > 0) & (F.col("fpr_at_90_recall") > F.col("c_fpr") * GATE_FPR)
    reason = (F.when(worse_auc, "PR-AUC regressed").when(worse_fpr, "FPR at 90% recall regressed"))
    return j.withColumn("rejection_reason", reason).withColumn("promoted", reason.isNull()).drop("c_auc", "c_fpr")


def _patch(version: Column) -> Column:
    return F.regexp_extract(version, r"(\d+)$", 1).try_cast("int")


def next_version(registry: DataFrame) -> DataFrame:
    n = F.coalesce(F.max(_patch(F.col("version"))) + 1, F.lit(0))
    return registry.agg(F.concat(F.lit("v1.0."), n.cast("string")).alias("version"))


def current_model(registry: DataFrame) -> DataFrame:
    """Latest promoted version."""
    at = F.struct("trained_us", "version")
    return registry.where("promoted").agg(F.max_by(F.struct(*registry.columns), at).alias("m")).where("m is not null").select("m.*")


def demote_others(registry: DataFrame, version: str) -> DataFrame:
    """Registry with exactly one promoted version: promotion and rollback are the same projection."""
    return registry.withColumn("promoted", F.col("version") == version)


rollback = demote_others


def model_history(registry: DataFrame) -> DataFrame:
    return registry.select("version", "trained_us", "pr_auc", "fpr_at_90_recall", "promoted", "rejection_reason",
                           "n_feedback").orderBy(F.desc("trained_us"), F.desc("version"))


def append_model_version(row: DataFrame, registry: Snapshots) -> None:
    """Adds a version to the registry; if it is promoted, all earlier ones are not any more."""
    old = registry.read()
    if old is None:
        registry.publish(row)
        return
    kept = old.join(row.select("version"), "version", "left_anti")                      # a version that is written again
    demoted = kept.crossJoin(F.broadcast(row.agg(F.bool_or("promoted").alias("_new")))).withColumn(
        "promoted", F.col("promoted") & ~F.coalesce("_new", F.lit(False))).drop("_new")
    registry.publish(demoted.unionByName(row, allowMissingColumns=True))


class ModelStore:
    """Fitted versions below a folder: trees and isotonic maps per version, the registry, the frozen holdout, one pointer.

    The pointer alone says which version is in use, so a promotion and a rollback are one switch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.registry = Snapshots(spark, f"{folder}/registry")
        self.holdout = Snapshots(spark, f"{folder}/holdout")
        self.pointer = Pointer(spark, f"{folder}/current")

    def _path(self, version: str, part: str) -> str:
        return f"{self.folder}/versions/{version}/{part}"

    def save(self, version: str, model: boosting.Model, maps: dict) -> None:
        boosting.save(model, self.spark, self._path(version, "trees"))
        knots = [(c, i, b, v) for c, kn in maps.items() for i, (b, v) in enumerate(kn)]
        self.spark.createDataFrame(knots, "class string, i int, bound double, value double").coalesce(1).write.mode("overwrite").parquet(self._path(version, "maps"))

    def load(self, version: str | None = None) -> tuple[boosting.Model, dict] | None:
        """Model and maps of a version, by default the one in use."""
        version = version or self.pointer.current()
        if version is None:
            return None
        maps: dict[str, list] = {}
        for r in self.spark.read.parquet(self._path(version, "maps")).orderBy("class", "i").collect():
            maps.setdefault(r["class"], []).append((r["bound"], r["value"]))
        return boosting.load(self.spark, self._path(version, "trees")), maps

    def promote(self, version: str) -> None:
        """Puts a saved version into use: a promotion, or a rollback to an older one."""
        known = self.registry.read()
        if known is None or known.where(F.col("version") == version).isEmpty():
            raise ValueError(f"no version {version}")
        self.pointer.switch(version)
        self.registry.publish(demote_others(known, version))


def freeze_holdout(rows: DataFrame, store: ModelStore) -> DataFrame:
    """Rows with ``is_test``: the ids stored by the first training, or a quarter of the groups, stored now."""
    stored = store.holdout.read()
    if stored is None:
        store.holdout.publish(grouped_holdout(rows).where("is_test").select("event_id"))
        stored = store.holdout.read()
    return frozen_holdout(rows, stored)


def retrain(events: DataFrame, feedback_rows: DataFrame, store: ModelStore, trained_us: int) -> str:
    """Base rows and human labels to a fitted, calibrated, evaluated, gated and saved version; returns its name.

    The holdout is frozen by the first training.  The champion of the gate is the version in use; a candidate that
    passes is promoted, one that does not is kept in the registry with the reason.
    """
    base = freeze_holdout(training_set(events), store)
    base = cut(model_inputs(base).select("event_id", "group_key", "label", "features", "is_test"))
    train, test = base.where(~F.col("is_test")), base.where("is_test")
    # labels of held-out rows are never trained on
    human = train.join(feedback_rows.select("event_id", "train_class"), "event_id").withColumn("label", F.col("train_class")).drop("train_class")
    both = cut(train.unionByName(human))
    model, unseen = fit_with_folds(both)
    maps = calibrate(cut(unseen))
    scored = cut(predict(model, test, maps).select(
        "event_id", "label", F.col("model_class").alias("pred"), (F.col("label") != "normal").alias("is_attack"),
        attack_score(class_labels(model)).alias("score")))
    known = store.registry.read()
    version = "v1.0.0" if known is None else next_version(known).first()["version"]
    row = (macro_prf(scored).join(average_precision(scored)).join(fpr_at_90_recall(scored))
           .join(both.agg(F.count(F.lit(1)).alias("n_rows"))).join(human.agg(F.count(F.lit(1)).alias("n_feedback"))))
    row = row.select(F.lit(version).alias("version"), F.lit(trained_us).cast("long").alias("trained_us"), (F.col("n_rows") - F.col("n_feedback")).alias("n_base"), "n_feedback",
                     "precision", "recall", "f1", F.col("average_precision").alias("pr_auc"), "fpr_at_90_recall")
    used = store.pointer.current()
    if used is None:
        row = row.withColumns({"rejection_reason": F.lit(None).cast("string"), "promoted": F.lit(True)})
    else:
        row = promotion_gate(row, known.where(F.col("version") == used))
    row = cut(row)
    store.save(version, model, maps)
    append_model_version(row, store.registry)
    if row.first()["promoted"]:
        store.promote(version)
    return version
