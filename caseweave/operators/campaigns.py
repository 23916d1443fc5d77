"""Campaign fingerprints and the match of an incident with an earlier one."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import expr as X

# workers may run where this package is not installed
register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048
SHARED_NETWORK_BONUS = 0.05
MATCH_DDL = "tenant_id string, target string, score double, opened_us bigint, match string"


def timing_bucket(n: Column, first_us: Column, last_us: Column) -> Column:
    per_event = (last_us - first_us) / F.lit(float(C.US)) / F.greatest(F.lit(1), n - 1)
    return (F.when(n < 2, "burst").when(per_event < 10, "burst").when(per_event < 180, "steady")
            .otherwise("low_and_slow"))


def fingerprint(incidents: DataFrame) -> DataFrame:
    """How a campaign behaved, not who it was.  Works on the columns of ``build_incidents``."""
    tactics = F.array_sort(F.transform("kill_chain", lambda s: s["tactic"]))
    return incidents.select(
        "tenant_id", "component", "incident_id", "status", "opened_us",
        F.array_sort("techniques").alias("techniques"), tactics.alias("tactics"), F.col("asns"),
        timing_bucket(F.col("event_count"), F.col("opened_us"), F.col("last_us")).alias("timing_bucket"),
        X.half_up(F.col("asset_tier"), 2).alias("asset_tier"),
        F.array(*[X.half_up(F.col(f"h{h}") / F.col("event_count"), 3) for h in range(24)]).alias("hour_profile"),
        X.half_up(F.log1p(F.col("event_count").cast("double")), 2).alias("event_count_log"))


def fingerprint_vector(vocabulary: list[str] | None = None) -> Column:
    """One-hot techniques over a vocabulary, one-hot timing, 24 hours, scaled size."""
    vocab = vocabulary or sorted(C.TECHNIQUES)
    tech = [F.array_contains("techniques", t).cast("double") for t in vocab]
    timing = [(F.col("timing_bucket") == t).cast("double") for t in C.TIMINGS]
    size = F.least(F.lit(1.0), F.col("event_count_log") / 10.0)
    return F.concat(F.array(*tech, *timing), "hour_profile", F.array(size))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _compare(left, right):
    """Best earlier fingerprint for each target of one grid cell (two blocks of bounded size)."""
    import numpy as np
    import pandas as pd

    if left.empty or right.empty:
        return pd.DataFrame(columns=["tenant_id", "target", "score", "opened_us", "match"])
    right = right.sort_values(["opened_us", "incident_id"], kind="stable")
    t_tech, h_tech = set(left["techniques"].iloc[0]), set(right["techniques"].iloc[0])
    same_time = float(left["timing_bucket"].iloc[0] == right["timing_bucket"].iloc[0])
    fixed = len(t_tech & h_tech) + same_time

    def dense(df):
        size = np.minimum(1.0, df["event_count_log"].to_numpy(float) / 10.0)[:, None]
        return np.hstack([np.vstack(df["hour_profile"].to_numpy()), size])

    a, b = dense(left), dense(right)
    norm_a = np.sqrt(len(t_tech) + 1 + (a * a).sum(1))
    norm_b = np.sqrt(len(h_tech) + 1 + (b * b).sum(1))
    score = (fixed + a @ b.T) / norm_a[:, None] / norm_b[None, :]
    nets = {n: i for i, n in enumerate(sorted({x for df in (left, right) for r in df["asns"] for x in r}))}
    if nets:
        ma, mb = np.zeros((len(left), len(nets)), np.float32), np.zeros((len(right), len(nets)), np.float32)
        for m, df in ((ma, left), (mb, right)):
            for i, r in enumerate(df["asns"]):
                m[i, [nets[x] for x in r]] = 1
        score = np.where(ma @ mb.T > 0, np.minimum(1.0, score + SHARED_NETWORK_BONUS), score)
    score = np.round(score, 9)
    h_open = right["opened_us"].to_numpy()
    earlier = h_open[None, :] < left["opened_us"].to_numpy()[:, None]
    score = np.where(earlier, score, -1.0)
    best = score.argmax(1)                      # the first maximum is the earliest one
    top = score[np.arange(len(left)), best]
    ok = top >= C.SIMILARITY_CUT
    return pd.DataFrame({
        "tenant_id": left["tenant_id"].to_numpy()[ok], "target": left["incident_id"].to_numpy()[ok],
        "score": top[ok], "opened_us": h_open[best][ok], "match": right["incident_id"].to_numpy()[best][ok]})


def best_matches(targets: DataFrame, history: DataFrame) -> DataFrame:
    """(target, score, opened_us, match): the most similar strictly earlier campaign, if similar enough.

    Exact nearest neighbour without emitting pairs.  Equal fingerprints are
    first folded to their earliest holder.  Campaigns with the same techniques
    and timing form a class; classes are cut into blocks of about 2,048 and
    every pair of blocks that shares a technique is one grid cell, which
    returns at most one row per target.
    """
    look = ["techniques", "timing_bucket", "hour_profile", "event_count_log", "asns"]
    sig = F.xxhash64("techniques", "timing_bucket")
    t = targets.select("tenant_id", "incident_id", "opened_us", *look).withColumn("sig", sig)
    h = (history.groupBy("tenant_id", *look).agg(F.min(F.struct("opened_us", "incident_id")).alias("f"))
         .select("tenant_id", *look, "f.*").withColumn("sig", sig))

    def blocks(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("tenant_id", "sig").agg(
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"{prefix}_n"), F.first("techniques").alias("techniques")
        ).select("tenant_id", F.col("sig").alias(f"{prefix}_sig"), f"{prefix}_n",
                 F.explode("techniques").alias("technique"))

    # at most a few hundred classes: one per set of known techniques and timing
    cells = (blocks(t, "t").join(blocks(h, "h"), ["tenant_id", "technique"])
             .select("tenant_id", "t_sig", "t_n", "h_sig", "h_n").distinct())
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("incident_id"), n).cast("int")
    left = (t.withColumnRenamed("sig", "t_sig").join(cells, ["tenant_id", "t_sig"])
            .withColumn("t_b", mine(F.col("t_n"))).withColumn("h_b", spread(F.col("h_n"))))
    right = (h.withColumnRenamed("sig", "h_sig").join(cells, ["tenant_id", "h_sig"])
             .withColumn("h_b", mine(F.col("h_n"))).withColumn("t_b", spread(F.col("t_n"))))
    cell = ["tenant_id", "t_sig", "h_sig", "t_b", "h_b"]
    cols = [*cell, "incident_id", "opened_us", *look]
    found = (left.select(*cols).toDF(*cols).groupBy(*cell).cogroup(right.select(*cols).toDF(*cols).groupBy(*cell))
             .applyInPandas(_compare, MATCH_DDL))
    rank = F.struct("score", (-F.col("opened_us")).alias("o"))
    return found.groupBy("tenant_id", "target").agg(F.max_by(F.struct("score", "opened_us", "match"), rank).alias("m")
                                                    ).select("tenant_id", "target", "m.*")


def match_campaign(prints: DataFrame, history: DataFrame, as_of_us: Column) -> DataFrame:
    """Similar earlier campaign of each incident: similarity, what is shared, age and verdict."""
    found = best_matches(prints, history)
    mine = prints.select("tenant_id", F.col("incident_id").alias("target"), F.col("techniques").alias("t_tech"),
                         F.col("asns").alias("t_asns"), F.col("timing_bucket").alias("t_timing"))
    past = history.select("tenant_id", F.col("incident_id").alias("match"), F.col("opened_us"), "techniques", "asns",
                          "timing_bucket", "status")
    j = found.join(mine, ["tenant_id", "target"]).join(past, ["tenant_id", "match", "opened_us"])
    shared = F.concat(
        F.array_sort(F.array_intersect("t_tech", "techniques")),
        F.transform(F.array_sort(F.array_intersect("t_asns", "asns")), lambda a: F.concat(F.lit("ASN "), a)),
        F.when(F.col("t_timing") == F.col("timing_bucket"), F.array(F.concat(F.col("t_timing"), F.lit(" timing")))
               ).otherwise(F.array().cast("array<string>")))
    days = F.greatest(F.lit(0), F.floor((as_of_us - F.col("opened_us")) / F.lit(86400 * C.US))).cast("long")
    return j.select(
        "tenant_id", F.col("target").alias("incident_id"), F.col("match").alias("similar_id"),
        X.half_up(F.col("score"), 2).alias("similarity"), days.alias("days_ago"),
        F.when(F.col("status") == "confirmed", "confirmed_malicious").otherwise(F.col("status")).alias("verdict"),
        shared.alias("shared"))


def fingerprint_history(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored fingerprints plus the ones not stored yet (by tenant and stable key)."""
    return known.unionByName(fresh.join(known, ["tenant_id", "component"], "left_anti"))
