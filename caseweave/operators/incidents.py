"""From components to incidents.

Two aggregates carry everything: ``incident_facts`` (one row per component,
map-side combined) and ``incident_profile`` (one row per component, attribute
and value, with its count and first sight).  No list of member events is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions import expr as X
from . import classify, graph

CID = ["tenant_id", "component"]
AT = ["ts_us", "event_id"]
MEMBER_COLUMNS = [
    "tenant_id", "event_id", "ts_us", "src_ip", "asn", "country", "user_id", "asset_id", "session_id", "user_agent",
    "url_path", "http_status", "pred_class", "pred_confidence", "individual_priority", "attack_technique",
    "technique_id", "technique", "tactic", "exploitability", "asset_criticality", "asset_name", "cve", "cve_name",
    "in_kev", "kev_added", "epss", "product_match", "matched_asset", "matched_software", "probe_succeeded",
    "reputation_source", "browser_telemetry_present", "resp_bytes_60s",
]


def members(seeds: DataFrame, membership: DataFrame) -> DataFrame:
    """Seed events with their component."""
    return graph.on_runs(seeds.select(*MEMBER_COLUMNS), membership.drop("run_id"))


def keep_clusters(member_rows: DataFrame) -> DataFrame:
    """Components of two or more events, or holding an event that is P1/P2 by itself: (component, size)."""
    g = member_rows.groupBy(*CID).agg(F.count(F.lit(1)).alias("size"), F.min("individual_priority").alias("best_band"))
    return g.where((F.col("size") >= 2) | F.col("best_band").isin("P1", "P2"))


def incident_facts(m: DataFrame) -> DataFrame:
    at = F.struct(*AT)
    first = lambda value, when=None: F.min_by(value, at if when is None else F.when(when, at))
    vuln = F.struct("cve", "cve_name", "matched_asset", "matched_software", "kev_added", "epss")
    landed = F.col("cve").isNotNull() & F.col("probe_succeeded")
    spot = F.struct("cve", F.coalesce(F.col("matched_asset"), F.col("asset_id")).alias("asset"))
    hour = F.hour(F.timestamp_micros("ts_us"))
    return m.groupBy(*CID).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts_us").alias("opened_us"), F.max("ts_us").alias("last_us"),
        F.max("exploitability").alias("max_exploitability"), F.max("asset_criticality").alias("max_criticality"),
        F.max(F.coalesce("pred_confidence", F.lit(0.0))).alias("max_conf"),
        F.avg(F.coalesce("pred_confidence", F.lit(0.0))).alias("mean_conf"),
        F.min(F.coalesce("individual_priority", F.lit("P4"))).alias("max_individual_priority"),
        first(F.col("src_ip")).alias("first_ip"),
        F.bool_and(F.col("browser_telemetry_present") == 0).alias("no_browser"),
        first(vuln, F.col("in_kev")).alias("kev"),
        first(spot, landed).alias("landed"), F.max_by(spot, F.when(F.col("cve").isNotNull(), at)).alias("probed"),
        F.coalesce(F.max(F.when(F.col("asset_name").isNotNull(), F.col("asset_criticality"))), F.lit(0.0)).alias("asset_tier"),
        *[F.count_if(hour == h).alias(f"h{h}") for h in range(24)])


def incident_profile(m: DataFrame, agents: bool = False) -> DataFrame:
    """(component, attr, value) with event count and first sight; attr = entity kind, class, technique or tactic."""
    ents = graph.entities_of(m, keep=["component", "technique_id"], agents=agents)
    ents = ents.select(*CID, F.col("kind").alias("attr"), "value", *AT, "technique_id")
    other = F.explode(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(a).alias("attr"), F.col(c).alias("value")))
        for a, c in (("class", "pred_class"), ("technique", "technique_id"), ("tactic", "tactic"))])))
    rest = m.select(*CID, other.alias("e"), *AT, "technique_id").select(*CID, "e.*", *AT, "technique_id")
    return ents.unionByName(rest).groupBy(*CID, "attr", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*AT, "technique_id")).alias("first"))


def entity_counts(profile: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """Events per entity of each component; with ``reputation`` (ip, ...) also whether an address is listed there."""
    kinds = list(C.LINKS)
    out = profile.where(F.col("attr").isin(kinds)).select(
        *CID, F.col("attr").alias("kind"), "value", F.col("n").alias("event_count"))
    if reputation is None:
        return out
    listed = reputation.select(F.col("ip").alias("_ip")).distinct()
    return out.join(listed, (F.col("kind") == "ip") & (F.col("value") == F.col("_ip")), "left").withColumn(
        "reputation_hit", F.col("_ip").isNotNull()).drop("_ip")


def _ordered(attr: str) -> Column:
    """Values of a bounded attribute (assets, techniques) by first sight."""
    pairs = F.sort_array(F.collect_list(F.when(F.col("attr") == attr, F.struct(
        F.col("first.ts_us").alias("t"), F.col("first.event_id").alias("i"), F.col("value").alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _mode(attr: str) -> Column:
    """Most frequent value, the earlier seen one on ties."""
    rank = F.struct("n", (-F.col("first.ts_us")).alias("t"), (-F.col("first.event_id")).alias("i"))
    return F.max_by("value", F.when(F.col("attr") == attr, rank))


def profile_summary(profile: DataFrame) -> DataFrame:
    """Per component: classes, networks, assets, users, techniques and the kill chain.

    Only attributes with a fixed number of values become arrays: assets (the
    inventory), techniques, tactics and network numbers.
    """
    chain = F.sort_array(F.collect_list(F.when(F.col("attr") == "tactic", F.struct(
        classify.tactic_rank(F.col("value")).alias("rank"), F.col("first.ts_us").alias("first_us"),
        F.col("value").alias("tactic"), F.col("first.technique_id").alias("technique_id"),
        F.col("n").alias("event_count")))))
    return profile.groupBy(*CID).agg(
        _mode("class").alias("primary_class"), _mode("asn").cast("int").alias("top_asn"),
        _ordered("asset").alias("assets"), F.count_if(F.col("attr") == "asset").alias("n_assets"),
        F.count_if(F.col("attr") == "user").alias("n_users"), F.count_if(F.col("attr") == "ip").alias("n_ips"),
        _ordered("technique").alias("techniques"), chain.alias("kill_chain"),
        F.sort_array(F.collect_list(F.when(F.col("attr") == "asn", F.col("value")))).alias("asns"),
        F.count_if(F.col("attr") == "tactic").alias("depth"))


def kill_chain_rows(profile: DataFrame) -> DataFrame:
    name = F.lit(None).cast("string")
    for tech, (n, _) in C.TECHNIQUES.items():
        name = F.when(F.col("first.technique_id") == tech, n).otherwise(name)
    return profile.where(F.col("attr") == "tactic").select(
        *CID, F.col("value").alias("tactic"), F.col("first.technique_id").alias("technique_id"),
        name.alias("technique"), F.col("first.ts_us").alias("first_us"), F.col("n").alias("event_count"),
        classify.tactic_rank(F.col("value")).alias("tactic_order"))


def numbered(incidents: DataFrame) -> DataFrame:
    """``INC-%04d`` in (opened, component) order.

    A global row number without a global sort: positions inside ten-minute
    slices plus the running count of earlier slices (one row per slice).
    """
    rows = incidents.withColumn("_slice", F.floor(F.col("opened_us") / F.lit(graph.SLICE_US)))
    counts = rows.groupBy("tenant_id", "_slice").agg(F.count(F.lit(1)).alias("_c"))
    earlier = W.partitionBy("tenant_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("tenant_id", "_slice", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy("tenant_id", "_slice").orderBy("opened_us", "component")
    rows = rows.withColumn("_pos", F.row_number().over(inside)).join(counts, ["tenant_id", "_slice"])
    number = (F.col("_base") + F.col("_pos")).cast("long")
    digits = number.cast("string")
    label = F.concat(F.lit("INC-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    return rows.withColumn("incident_id", label).drop("_slice", "_pos", "_base")


def title(primary: Column, depth: Column, assets: Column) -> Column:
    base = F.lit("Suspicious activity")
    for cls, text in C.CLASS_TITLES.items():
        base = F.when(primary == cls, text).otherwise(base)
    return (F.when(depth >= C.ESCALATE_TACTICS, C.MULTI_STAGE_TITLE)
            .when(F.size(assets) > 0, F.concat(base, F.lit(" against "), F.try_element_at(assets, F.lit(1))))
            .otherwise(base))


def incident_terms(df: DataFrame, as_of_us: Column) -> dict:
    conf = 0.6 * F.col("max_conf") + 0.4 * F.col("mean_conf")
    return X.risk_term_columns(conf, F.col("max_criticality"), F.col("max_exploitability"), F.col("n_assets"),
                               F.col("n_users"), F.col("depth"), F.col("last_us"), as_of_us)


def score_incident(df: DataFrame, as_of_us: Column, weights: dict | None = None) -> DataFrame:
    """Risk, band, six stored terms and the breakdown; the terms allow rescoring without re-correlation."""
    terms = incident_terms(df, as_of_us)
    out = df.withColumns({f"term_{t}": c for t, c in terms.items()})
    stored = {t: F.col(f"term_{t}") for t in C.RISK_TERMS}
    out = out.withColumns({"risk_score": X.weighted_risk(stored, weights),
                           "risk_breakdown": X.risk_breakdown(stored, weights)})
    return out.withColumns({"priority": X.priority_band(F.col("risk_score")),
                            "escalated": F.col("depth") >= C.ESCALATE_TACTICS})


def rescore(incidents: DataFrame, scenarios: DataFrame) -> DataFrame:
    """All incidents under every weight scenario (a table of a handful of rows), from the stored terms."""
    stored = {t: F.col(f"term_{t}") for t in C.RISK_TERMS}
    cols = {t: F.col(f"w_{t}") for t in C.RISK_TERMS}
    s = scenarios.select("scenario", *[F.col(t).alias(f"w_{t}") for t in C.RISK_TERMS])
    out = incidents.crossJoin(F.broadcast(s)).withColumn("new_risk", X.weighted_risk(stored, cols))
    return out.withColumn("new_priority", X.priority_band(F.col("new_risk")))


def validate_weights(weights: DataFrame) -> DataFrame:
    """One verdict per (tenant, scenario) of a long table (tenant_id, scenario, term, weight)."""
    known = F.col("term").isin(C.RISK_TERMS)
    g = weights.groupBy("tenant_id", "scenario").agg(
        F.count_distinct(F.when(known, F.col("term"))).alias("n_known"), F.count_if(~known).alias("n_unknown"),
        F.count_if(~F.col("weight").between(0.0, 1.0)).alias("n_range"), F.sum("weight").alias("total"))
    verdict = (F.when(F.col("n_known") < len(C.RISK_TERMS), "missing terms").when(F.col("n_unknown") > 0, "unknown terms")
               .when(F.col("n_range") > 0, "weight out of range")
               .when(F.abs(F.col("total") - 1.0) > 0.001 + 1e-9, "weights must sum to 1").otherwise("ok"))
    return g.select("tenant_id", "scenario", verdict.alias("verdict"))


def incident_intel(m: DataFrame, intel: Column) -> DataFrame:
    """Intel entries of an incident, once per kind and value, as first seen."""
    rows = m.select(*CID, *AT, F.explode(intel).alias("t"))
    return (rows.groupBy(*CID, F.col("t.kind").alias("kind"), F.col("t.value").alias("value"))
            .agg(F.min_by("t", F.struct(*AT)).alias("t"))
            .select(*CID, "kind", "value", "t.name", "t.in_kev", "t.kev_added", "t.epss", "t.matched_asset",
                    "t.matched_software", "t.triggered_by_path", "t.source"))


def entity_graph_nodes(counts: DataFrame) -> DataFrame:
    """Ten most frequent non-session entities per incident; Spark limits ranks before the shuffle."""
    order = W.partitionBy(*CID).orderBy(F.desc("event_count"), "kind", "value")
    return (counts.where(F.col("kind") != "session").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= 10))


def entity_graph_edges(nodes: DataFrame) -> DataFrame:
    """Edges between neighbouring kinds among the ten nodes of an incident."""
    pos = F.lit(None).cast("int")
    for i, k in enumerate(C.GRAPH_KINDS):
        pos = F.when(F.col("kind") == k, i).otherwise(pos)
    n = nodes.withColumn("pos", pos)
    a = n.select(*CID, (F.col("pos") + 1).alias("pos"), F.concat_ws(":", "kind", "value").alias("source"))
    b = n.select(*CID, "pos", F.concat_ws(":", "kind", "value").alias("target"))
    return a.join(b, [*CID, "pos"]).select(*CID, "source", "target")


def build_incidents(m: DataFrame, as_of_us: int, previous: DataFrame | None = None,
                    weights: dict | None = None) -> DataFrame:
    """One row per kept component, scored, numbered and titled.

    ``previous`` (component, status) carries analyst verdicts over a rebuild by
    the stable key, the smallest member event.
    """
    kept = keep_clusters(m).select(*CID)
    df = kept.join(incident_facts(m), CID).join(profile_summary(incident_profile(m)), CID)
    df = score_incident(df, F.lit(as_of_us), weights)
    df = numbered(df)
    df = df.withColumn("title", title(F.col("primary_class"), F.col("depth"), F.col("assets")))
    if previous is None:
        return df.withColumn("status", F.lit("open"))
    return status_carryover(df, previous)


def status_carryover(incidents: DataFrame, previous: DataFrame) -> DataFrame:
    prior = previous.select(*CID, F.col("status").alias("_prior"))
    out = incidents.drop("status").join(prior, CID, "left")
    return out.withColumn("status", F.coalesce("_prior", F.lit("open"))).drop("_prior")


def assign_incidents(events: DataFrame, membership: DataFrame, incidents: DataFrame, since_us: int | None = None) -> DataFrame:
    """Stamp ``incident_id`` on events: ids ride on the small (address, slot) table, then meet the log there.

    ``since_us`` is where the lookback of the membership starts: it cuts through a slot, and what lies before is no member.
    """
    stamped = membership.join(incidents.select(*CID, "incident_id"), CID).select(*graph.RUN_KEY, "incident_id")
    seed = F.col("pred_class").isNotNull() & (F.col("pred_class") != "normal")
    if since_us is not None:
        seed = seed & (F.col("ts_us") >= since_us)
    out = graph.with_slot(events.drop("incident_id")).join(stamped, graph.RUN_KEY, "left").drop("slot")
    return out.withColumn("incident_id", F.when(seed, F.col("incident_id")))
