"""Boosting, importance, the model store and snapshots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave import constants as C
from caseweave.operators import boosting, model
from caseweave.plans import pipeline as P, queries as Q
from caseweave.session import forget_stages
from caseweave.sources.snapshots import Pointer, Snapshots
from caseweave.streaming.replay import scratch

WIDTH = len(C.FEATURES)


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that need two features, one of them only through its being missing; all others are noise."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(1_500):
        x = rng.random(WIDTH).round(3)
        gone = rng.random() < 0.3
        label = "flood" if x[0] > 0.6 else "scraper" if gone else "normal"
        if gone:
            x[40] = np.nan
        out.append((i, label, [float(v) for v in x]))
    return spark.createDataFrame(out, "event_id long, label string, features array<double>")


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit_classifier(rows.where("event_id < 1000"), rounds=4)


def accuracy(m, df):
    return model.predict(m, df).agg(F.avg((F.col("model_class") == F.col("label")).cast("double"))).first()[0]


def test_learns_from_values_and_from_missing_ones(rows, fitted):
    assert accuracy(fitted, rows.where("event_id >= 1000")) > 0.99
    assert {C.FEATURES[0], C.FEATURES[40]} <= set(fitted.split_features())


def test_same_trees_from_any_partitions(rows, fitted):
    again = model.fit_classifier(rows.where("event_id < 1000").repartition(7).orderBy(F.desc("event_id")), rounds=4)
    assert list(again.rows()) == list(fitted.rows())


def test_histograms_equal_brute_force(spark, rows):
    m = boosting.Model(C.CLASSES, C.FEATURES, boosting.bin_edges(rows, WIDTH), np.log(np.full(len(C.CLASSES), 1 / len(C.CLASSES))))
    data = boosting._binned(rows.withColumn("fold", F.lit(-1)), [m])
    grow = [boosting.Tree.empty(2) for _ in C.CLASSES]
    got = {(r["k"], r["j"], r["bin"]): (r["g"], r["h"]) for r in boosting._histograms(data, [m], [[]], [grow], 0).collect()}
    want = {}
    p = 1 / len(C.CLASSES)
    for r in rows.collect():
        b = m.bins(np.array([r["features"]]))[0]
        for k, c in enumerate(C.CLASSES):
            g, h = round((p - (r["label"] == c)) * boosting.GRAIN), round(p * (1 - p) * boosting.GRAIN)
            for j in (0, 17, 40):
                a = want.get((k, j, int(b[j])), (0, 0))
                want[k, j, int(b[j])] = (a[0] + g, a[1] + h)
    assert {k: v for k, v in got.items() if k[1] in (0, 17, 40)} == want
    # the best first split of a class, searched over all bounds and both sides for missing values
    best = {s["k"]: s for s in boosting._best_splits(boosting._histograms(data, [m], [[]], [grow], 0))}
    k = C.CLASSES.index("flood")
    score = lambda g, h: (g / boosting.GRAIN) ** 2 / (h / boosting.GRAIN + boosting.RIDGE)
    cells = {}
    for (kk, j, b), (g, h) in got.items():
        if kk == k:
            cells.setdefault(j, {})[b] = np.array([g, h], float)
    gains = []
    for j, own in cells.items():
        total, missing = sum(own.values()), own.get(0, np.zeros(2))
        for b in own:
            low = sum((v for i, v in own.items() if 0 < i <= b), np.zeros(2))
            for left in (low, low + missing):
                right = total - left
                if min(left[1], right[1]) >= boosting.LEAST * boosting.GRAIN:
                    gains.append((score(*left) + score(*right) - score(*total), j))
    assert best[k]["j"] == max(gains)[1] == 0 and abs(best[k]["gain"] - max(gains)[0]) < 1e-6


def test_histograms_count_few_groups_of_features():
    """Features are counted in groups of few combinations of bins; each is in one group."""
    sizes = [3] * 20 + [64] * 4 + [2]
    groups = boosting._joined(sizes, 1_024)
    assert sorted(j for js in groups for j in js) == list(range(25)) and len(groups) == 8
    assert all(len(js) == 1 or np.prod([sizes[j] for j in js]) <= 1_024 for js in groups) and boosting._joined([]) == []


def test_folds_grow_like_fits_of_their_own(rows):
    """Models grown side by side equal those fitted alone, and none sees its fold."""
    some = rows.where("event_id < 600").withColumn("fold", (F.col("event_id") % 3).cast("int"))
    models = boosting.fit_folds(some, C.CLASSES, C.FEATURES, 3, rounds=2)
    alone = boosting.fit(some, C.CLASSES, C.FEATURES, rounds=2)
    assert list(models[0].rows()) == list(alone.rows())
    changed = some.withColumn("label", F.when(F.col("fold") == 1, F.lit("flood")).otherwise(F.col("label")))
    assert list(boosting.fit_folds(changed, C.CLASSES, C.FEATURES, 3, rounds=2)[2].rows()) == list(models[2].rows())


def test_no_rows_and_unknown_labels(spark, rows):
    none = model.fit_classifier(rows.limit(0))
    assert none.rounds == [] and abs(none.proba(np.zeros((1, WIDTH))).sum() - 1) < 1e-12
    with pytest.raises(ValueError):
        model.fit_classifier(rows.limit(3).withColumn("label", F.lit("other")))


def test_importance_finds_what_matters(rows, fitted):
    out = {r["feature"]: r["importance"] for r in model.permutation_importance(fitted, rows).collect()}
    assert sorted(out, key=out.get)[-2:] in ([C.FEATURES[0], C.FEATURES[40]], [C.FEATURES[40], C.FEATURES[0]])
    n = model.numbered(rows, "x").select("rn").orderBy("rn").collect()
    assert [r["rn"] for r in n] == list(range(1_500))
    assert model.permutation_importance(fitted, rows.limit(0)).count() == 0


def test_swapped_features_count_like_rescored_rows(rows, fitted):
    """Scoring just the rows that a swap changes, by just the trees that read the feature, over narrow bins, counts what scoring all anew does."""
    data = rows.collect()
    x = np.array([r["features"] for r in data])
    own, y = fitted.bins(x), np.array([C.CLASSES.index(r["label"]) if r["event_id"] % 7 else -1 for r in data])
    other = own[np.random.default_rng(1).permutation(len(own))]
    used = [C.FEATURES.index(f) for f in fitted.split_features()]
    want = []
    for j in used:
        b = own.copy()
        b[:, j] = other[:, j]
        want.append((fitted.scores(b).argmax(1) == y).sum())
    want.append((fitted.scores(own).argmax(1) == y).sum())
    small = fitted.narrowed()
    assert (small.scores(small.bins(x[:, used])) == fitted.scores(own)).all()
    assert boosting.swapped_hits(small, own[:, used], other[:, used], y).tolist() == want and len(set(want)) > 2
    assert boosting.swapped_hits(small, own[:0, used], other[:0, used], y[:0]).tolist() == [0] * len(want)


def test_importance_grows_the_stored_trees_alone(spark, folder, monkeypatch):
    """The query grows one model, from the same rows as the store, and stores neither the log nor its scored events."""
    columns = ["event_id", "group_key", "label", "features", "is_test"]
    stored = model.model_inputs(model.grouped_holdout(model.training_set(P.scored_events(spark, folder)))).select(columns)
    trees = list(Q.trained_store(spark, folder).load()[0].rows())
    forget_stages()
    grown, fit = [], boosting.fit_folds
    monkeypatch.setattr(Q, "_trained", {})
    monkeypatch.setattr(boosting, "fit_folds", lambda *a, **k: grown.append(fit(*a, **k)) or grown[-1])
    for name in ("event_log", "scored_events"):
        monkeypatch.setattr(P, name, lambda *a, name=name, **k: pytest.fail(name))
    out = Q.QUERIES["permutation_importance"](spark, folder)
    assert all(r["ok"] for r in out.collect()) and [len(g) for g in grown] == [1] and list(grown[0][0].rows()) == trees
    rows = P.labelled_events(spark, folder)
    assert rows.columns == columns and rows.exceptAll(stored).isEmpty() and stored.exceptAll(rows).isEmpty()


def test_store_keeps_and_switches_versions(spark, rows, fitted):
    store = model.ModelStore(spark, scratch(spark, "store-test"))
    assert store.load() is None
    scored = model.predict(fitted, rows)
    maps = model.calibrate(scored)
    for i, m in enumerate((fitted, model.fit_classifier(rows, rounds=1))):
        store.save(f"v1.0.{i}", m, maps)
        model.append_model_version(spark.createDataFrame([(f"v1.0.{i}", i, True)], "version string, trained_us long, promoted boolean"), store.registry)
        store.promote(f"v1.0.{i}")
    back, knots = store.load("v1.0.0")
    assert list(back.rows()) == list(fitted.rows()) and knots == {c: [tuple(p) for p in kn] for c, kn in maps.items()}
    assert len(store.load()[0].rounds) == 1
    store.promote("v1.0.0")
    assert len(store.load()[0].rounds) == 4 and [r["version"] for r in store.registry.read().where("promoted").collect()] == ["v1.0.0"]
    with pytest.raises(ValueError):
        store.promote("v9")
    assert store.pointer.history() == ["v1.0.0", "v1.0.1", "v1.0.0"]


def test_frozen_holdout_stays(spark, rows):
    store = model.ModelStore(spark, scratch(spark, "holdout-test"))
    grouped = rows.select("event_id", (F.col("event_id") % 50).cast("string").alias("group_key"))
    first = {r["event_id"] for r in model.freeze_holdout(grouped, store).where("is_test").collect()}
    again = {r["event_id"] for r in model.freeze_holdout(grouped.withColumn("group_key", F.lit("x")), store).where("is_test").collect()}
    assert first == again and 0 < len(first) < 1_500


def test_readers_see_whole_versions(spark):
    table = Snapshots(spark, scratch(spark, "snap-test"))
    assert table.read() is None
    table.publish(spark.range(5))
    old = table.read()
    table.publish(old.selectExpr("id + 10 as id"))                                      # reads the table it replaces
    assert sorted(r["id"] for r in old.collect()) == list(range(5))
    assert sorted(r["id"] for r in table.read().collect()) == list(range(10, 15))
    table.publish(spark.range(1))
    assert len(table.pointer.history()) == 3 and table.read().count() == 1
    with pytest.raises(Exception):                                                      # the third version is the last but one to be kept
        spark.read.parquet(table.path(table.pointer.history()[0])).count()


def test_two_writers_cannot_take_one_place(spark):
    p = Pointer(spark, scratch(spark, "pointer-test"))
    p.switch("a")
    stale = p._entries()
    q = Pointer(spark, p.folder)
    q.switch("b")
    p._entries = lambda: stale
    with pytest.raises(Exception):
        p.switch("c")
    assert q.history() == ["a", "b"]
