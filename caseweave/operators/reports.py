"""Reporting over the event log and the incident table.  Conditional aggregates, one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions import expr as X

DAY_US = 24 * C.HOUR_US


def overview_counters(events: DataFrame, incidents: DataFrame, as_of_us: int) -> DataFrame:
    e = events.agg(F.count(F.lit(1)).alias("events_total"),
                   F.count_if(F.col("ts_us") >= as_of_us - DAY_US).alias("events_last_24h"))
    i = incidents.agg(F.count_if(F.col("status") == "open").alias("incidents_open"),
                      F.count_if(F.col("priority") == "P1").alias("incidents_p1"))
    return e.join(F.broadcast(i))           # one row each


def noise_reduction(events: DataFrame, incidents: DataFrame) -> DataFrame:
    e = events.agg(F.count(F.lit(1)).alias("events"))
    i = incidents.agg(F.count(F.lit(1)).alias("incidents"))
    ratio = F.col("incidents") / F.greatest(F.lit(1), F.col("events"))
    return e.join(F.broadcast(i)).withColumn("noise_reduction_pct", X.half_up(100.0 * (1 - ratio), 2))


def daily_trend(events: DataFrame, incidents: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd").alias("date")
    e = events.groupBy(day("ts_us")).agg(F.count(F.lit(1)).alias("events"))
    i = incidents.groupBy(day("opened_us")).agg(F.count(F.lit(1)).alias("incidents"))
    zero = F.lit(0)
    return e.join(i, "date", "full_outer").select(
        "date", F.coalesce("events", zero).alias("events"), F.coalesce("incidents", zero).alias("incidents"))


def priority_split(incidents: DataFrame) -> DataFrame:
    """Counts for P1..P4, zeros included."""
    counted = incidents.groupBy("priority").agg(F.count(F.lit(1)).alias("incidents"))
    bands = incidents.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, C.BANDS))).alias("priority"))
    return bands.join(counted, "priority", "left").select("priority", F.coalesce("incidents", F.lit(0)).alias("incidents"))


def class_split(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("pred_class", F.lit("unscored")).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("events"))


def top_sources(events: DataFrame, k: int = 5) -> DataFrame:
    """Top networks by events, with name, hosting flag, first-seen country and reputation."""
    at = F.struct("ts_us", "event_id")
    g = events.where(F.col("asn").isNotNull() & (F.col("asn") != 0)).groupBy("asn").agg(
        F.count(F.lit(1)).alias("events"), F.min_by("country", at).alias("country"),
        F.bool_or(F.col("reputation_source").isNotNull()).alias("reputation_hit"))
    name = F.concat(F.lit("AS"), F.col("asn").cast("string"))
    for n, text in C.ASN_NAMES.items():
        name = F.when(F.col("asn") == n, text).otherwise(name)
    return g.orderBy(F.desc("events"), "asn").limit(k).select(
        "asn", name.alias("asn_name"), "country", "events",
        F.col("asn").isin(C.HOSTING_ASNS).alias("is_hosting"), "reputation_hit")


def ticker(events: DataFrame, k: int = 25) -> DataFrame:
    """Newest events: a top-k, each task keeps k rows."""
    return events.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(k).select(
        "event_id", X.iso_us(F.col("ts_us")).alias("ts"), "src_ip", "url_path", "pred_class", "pred_confidence",
        "incident_id")


def incident_queue(incidents: DataFrame, priority: str | None = None, status: str | None = None,
                   limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of incidents by falling risk, with the total number that pass the filter."""
    rows = incidents
    if priority:
        rows = rows.where(F.col("priority") == priority)
    if status:
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("risk_score"), "incident_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total)).select(
        "incident_id", "title", "status", "priority", "risk_score", X.iso_us(F.col("opened_us")).alias("opened_at"),
        X.iso_us(F.col("last_us")).alias("last_seen_at"), "event_count", "primary_class",
        F.col("depth").alias("kill_chain_depth"), F.col("n_users").alias("users_affected"), "top_asn", "total")


def incident_detail(incidents: DataFrame, events: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Events of incidents with the incident's headline; one incident's page, or all of them as a table."""
    head = incidents if incident_id is None else incidents.where(F.col("incident_id") == incident_id)
    ev = events if incident_id is None else events.where(F.col("incident_id") == incident_id)
    head = head.select("tenant_id", "incident_id", "title", "status", "priority", "risk_score")
    band = F.coalesce("individual_priority", F.lit("P4"))
    return ev.where(F.col("incident_id").isNotNull()).join(head, ["tenant_id", "incident_id"]).select(
        "incident_id", "title", "status", "priority", "risk_score", "event_id", X.iso_us(F.col("ts_us")).alias("ts"),
        "src_ip", "url_path", "http_status", "user_id", "asset_id", "pred_class", "pred_confidence",
        band.alias("individual_priority"), "attack_technique")


def funnel(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """events, candidate alerts, incidents, actionable, with the drop from the stage before."""
    e = events.agg(F.count(F.lit(1)).alias("n0"), F.count_if(F.col("pred_class") != "normal").alias("n1"))
    i = incidents.agg(F.count(F.lit(1)).alias("n2"), F.count_if(F.col("priority").isin("P1", "P2")).alias("n3"))
    names = ["events", "candidate_alerts", "incidents", "actionable"]
    rows = e.join(F.broadcast(i)).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("stage_order"), F.lit(n).alias("stage"), F.col(f"n{k}").alias("n"),
                 (F.col(f"n{k - 1}") if k else F.lit(None).cast("long")).alias("before"))
        for k, n in enumerate(names)])).alias("r")).select("r.*")
    drop = 100.0 * (1 - F.try_divide(F.col("n"), F.col("before")))
    return rows.select("stage_order", "stage", "n", X.half_up(drop, 2).alias("drop_pct"))


def correlation_metrics(incidents: DataFrame, matched: DataFrame) -> DataFrame:
    """Mean and upper-median size, incidents of several events, matched, and escalated by correlation."""
    n = incidents.agg(
        F.count(F.lit(1)).alias("n"), F.avg("event_count").alias("mean"),
        F.count_if(F.col("event_count") > 1).alias("incidents_multi_event"),
        F.count_if(F.col("priority").isin("P1", "P2") & (F.col("depth") >= 2)).alias("incidents_escalated_by_correlation"))
    # upper median from the size histogram: element n div 2 of the sorted sizes
    sizes = incidents.groupBy("event_count").agg(F.count(F.lit(1)).alias("c"))
    upto = sizes.withColumn("upto", F.sum("c").over(W.orderBy("event_count")))
    middle = F.floor(F.sum("c").over(W.partitionBy()) / 2)
    med = (upto.withColumn("middle", middle).where(F.col("upto") > F.col("middle"))
           .agg(F.min("event_count").alias("events_per_incident_median")))
    m = matched.agg(F.count(F.lit(1)).alias("incidents_with_historical_match"))
    return n.join(F.broadcast(med)).join(F.broadcast(m)).select(
        X.half_up(F.col("mean"), 1).alias("events_per_incident_mean"),
        F.coalesce("events_per_incident_median", F.lit(0)).alias("events_per_incident_median"),
        "incidents_multi_event", "incidents_with_historical_match", "incidents_escalated_by_correlation")


def invariants(events: DataFrame, incidents: DataFrame, stamped: DataFrame) -> DataFrame:
    """Acceptance checks as a table (check, ok, detail)."""
    e = events.agg(
        F.count_if(F.col("individual_priority").isin("P1", "P2")).alias("loud"),
        F.count_if((F.col("pred_class") == "normal") & F.col("attack_technique").isNotNull()).alias("odd"))
    points = F.aggregate("risk_breakdown", F.lit(0.0), lambda a, t: a + t["points"])
    i = incidents.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(points - F.col("risk_score")) >= 0.35).alias("bad_sum"),
        F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("depth") >= 3).alias("deep"),
        F.count_if(F.col("event_count") < 2).alias("single"), F.sum("event_count").alias("members"),
        F.count_if(~F.col("risk_score").between(0, 100)).alias("range"),
        F.count_if(F.col("last_us") < F.col("opened_us")).alias("backwards"))
    s = stamped.agg(F.count_if(F.col("incident_id").isNotNull()).alias("stamped"))
    row = e.join(F.broadcast(i)).join(F.broadcast(s))
    c = F.col
    checks = [
        ("no event is P1 or P2 by itself", c("loud") == 0, c("loud")),
        ("normal events carry no technique", c("odd") == 0, c("odd")),
        ("correlation produced incidents", c("n") > 0, c("n")),
        ("points sum to the score", c("bad_sum") == 0, c("bad_sum")),
        ("correlation created P1 incidents", c("p1") > 0, c("p1")),
        ("a three-tactic campaign was found", c("deep") > 0, c("deep")),
        ("incidents have two or more events", c("single") == 0, c("single")),
        ("stamped events equal incident members", c("stamped") == c("members"), c("stamped")),
        ("scores lie in 0..100", c("range") == 0, c("range")),
        ("incidents do not end before they open", c("backwards") == 0, c("backwards")),
    ]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.cast("long").alias("detail")) for n, ok, d in checks
    ])).alias("r")).select("r.*")
