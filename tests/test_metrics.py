"""Ranking metrics on scores that no rounding may merge."""

import random

import pytest

from caseweave.operators import model


def brute(rows):
    """(average precision, false-positive rate at 90 % recall) from the definition."""
    pos, ap, seen, hits, fpr = sum(a for _, a in rows), 0.0, 0, 0, None
    for t in sorted({s for s, _ in rows}, reverse=True):
        new = [a for s, a in rows if s == t]
        seen, before = seen + len(new), hits
        hits += sum(new)
        ap += (hits - before) / pos * (hits / seen)
        if fpr is None and hits / pos >= 0.9:
            fpr = (seen - hits) / max(1, len(rows) - pos)
    return round(ap, 6), round(fpr, 6)


@pytest.mark.parametrize("per_task", [7, 100_000])
def test_scores_that_differ_late(spark, monkeypatch, per_task):
    monkeypatch.setattr(model, "RANGE_SCORES", per_task)
    rng = random.Random(2)
    rows = [(0.5 + rng.randrange(60) * 1e-9 + a * 2e-8, a) for a in (rng.random() < 0.4 for _ in range(300))]
    df = spark.createDataFrame([(s, bool(a)) for s, a in rows], "score double, is_attack boolean")
    want = brute(rows)
    assert model.average_precision(df).first()[0] == pytest.approx(want[0], abs=1e-6)
    assert model.fpr_at_90_recall(df).first()[0] == pytest.approx(want[1], abs=1e-6)
    t = model.threshold_table(df).orderBy("pos_ix").collect()
    assert [r["threshold"] for r in t] == sorted({s for s, _ in rows}) and [r["pos_ix"] for r in t] == list(range(len(t)))
    curve = model.pr_curve(df).orderBy("pos_ix").collect()
    assert len(curve) == 14 and (curve[-1]["recall"], curve[-1]["precision"]) == (0.0, 1.0) and curve[0]["recall"] == 1.0
