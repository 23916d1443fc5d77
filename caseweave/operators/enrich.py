"""Enrichment and single-event scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import expr as X
from ..sources import feeds as feeds_mod
from ..sources.feeds import Feeds


def exploitability(with_reputation: bool = True) -> Column:
    """How exploitable the probe is, from the joined vulnerability columns."""
    # a zero score counts as missing, like an absent one
    epss = F.nullif(F.col("epss"), F.lit(0.0))
    landed = F.when(F.col("in_kev"), 1.0).otherwise(F.greatest(F.coalesce(epss, F.lit(0.5)), F.lit(0.5)))
    missed = F.when(F.col("in_kev"), 0.45).otherwise(F.coalesce(epss, F.lit(0.2)) * 0.5)
    base = (F.when(F.col("cve").isNotNull() & F.col("product_match") & F.col("probe_succeeded"), landed)
            .when(F.col("cve").isNotNull() & F.col("product_match"), missed)
            .when(F.col("cve").isNotNull(), 0.15)
            .when(F.col("sensitive_prefix"), 0.10).otherwise(0.0))
    if not with_reputation:
        return base
    return F.when(F.col("reputation_source").isNotNull(), F.least(F.lit(1.0), base + 0.30)).otherwise(base)


def threat_intel() -> Column:
    """Array of intel entries: the probed vulnerability, then the listed address."""
    cve = F.when(F.col("cve").isNotNull(), F.struct(
        F.lit("cve").alias("kind"), F.col("cve").alias("value"), F.col("cve_name").alias("name"),
        F.col("in_kev").alias("in_kev"), F.col("kev_added").alias("kev_added"), F.col("epss").alias("epss"),
        F.col("matched_asset").alias("matched_asset"), F.col("matched_software").alias("matched_software"),
        X.strip_query(F.col("url_path")).alias("triggered_by_path"),
        F.when(F.col("in_kev"), "CISA KEV").otherwise("NVD / EPSS").alias("source")))
    null = F.lit(None).cast("string")
    ip = F.when(F.col("reputation_source").isNotNull(), F.struct(
        F.lit("ip_reputation").alias("kind"), F.col("src_ip").alias("value"),
        F.concat(F.lit("Listed on "), F.col("reputation_source")).alias("name"),
        F.lit(False).alias("in_kev"), null.alias("kev_added"), F.lit(None).cast("double").alias("epss"),
        null.alias("matched_asset"), null.alias("matched_software"), null.alias("triggered_by_path"),
        F.col("reputation_source").alias("source")))
    return F.array_compact(F.array(cve, ip))


def with_reputation(df: DataFrame, feeds: Feeds) -> DataFrame:
    """Add ``reputation_source``, NULL where the address is on no list."""
    return df.join(feeds.reputation().withColumnRenamed("ip", "src_ip"), "src_ip", "left").drop("is_tor")


def enrich(df: DataFrame, feeds: Feeds, spark=None) -> DataFrame:
    """Asset, vulnerability and reputation facts.

    The two broadcast sides are fixed tables of ten and nine rows: feeds are
    folded into the nine path entries first, so the event side never meets the
    whole feed.  ``reputation_source`` is joined here only if the features did
    not bring it.
    """
    spark = spark or df.sparkSession
    out = df
    if "reputation_source" not in df.columns:
        out = with_reputation(out, feeds)
    out = out.withColumns({
        "asset_id": F.coalesce("asset_id", X.asset_for_path(F.col("url_path"))) if "asset_id" in df.columns
        else X.asset_for_path(F.col("url_path")),
        "ordinal": X.path_cve_ordinal(F.col("url_path"))})
    inventory = feeds_mod.assets(spark).select("asset_id", F.col("name").alias("asset_name"), "criticality")
    out = (out.join(F.broadcast(inventory), "asset_id", "left")
           .join(F.broadcast(feeds_mod.cve_dimension(spark, feeds)), "ordinal", "left"))
    out = out.withColumns({
        "asset_criticality": F.coalesce("criticality", F.lit(0.1)),
        "in_kev": F.coalesce("in_kev", F.lit(False)),
        "product_match": F.coalesce("product_match", F.lit(False)),
        "probe_succeeded": F.coalesce(F.col("http_status") == F.col("hit_status"), F.lit(False)),
        "sensitive_prefix": X.sensitive_prefix(F.col("url_path")) | F.col("ordinal").isNotNull()})
    return out.withColumn("exploitability", exploitability()).drop("criticality", "ordinal", "hit_status")


def score_event(df: DataFrame, as_of_us: Column, weights: dict | None = None) -> DataFrame:
    """The risk formula on one event: one asset, no users, one tactic."""
    terms = X.risk_term_columns(
        F.coalesce("pred_confidence", F.lit(0.0)), F.col("asset_criticality"), F.col("exploitability"),
        F.lit(1), F.lit(0), F.lit(1), F.col("ts_us"), as_of_us)
    out = df.withColumn("event_risk", X.weighted_risk(terms, weights))
    return out.withColumn("individual_priority", X.priority_band(F.col("event_risk")))


def score_unscored(df: DataFrame, as_of_us: Column, weights: dict | None = None) -> DataFrame:
    """Fill the priority of rows that have none; rows that have one keep it."""
    scored = score_event(df.withColumnRenamed("individual_priority", "_old"), as_of_us, weights)
    return scored.withColumn("individual_priority", F.coalesce("_old", "individual_priority")).drop("_old")


__all__ = ["C", "enrich", "exploitability", "score_event", "score_unscored", "threat_intel", "with_reputation"]
