"""Registry of named queries: each takes (spark, folder of tables) and returns a DataFrame.

Intermediate tables (event log, scored events, membership, incidents) are
written once per application and folder, as a deployment would keep them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import expr as X
from ..operators import (boosting, campaigns, classify, communities, enrich, features, fusion, graph, incidents as inc_ops, model, reports,
                         respond, review)
from ..session import cut, fingerprint, stage
from ..sources import events as E, feeds as feeds_mod
from ..sources.feeds import Feeds
from ..sources.snapshots import Snapshots
from ..streaming import live, replay
from . import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


# --- inputs derived from the given tables ---------------------------------------------

def actions(spark, d) -> DataFrame:
    """Raw browser interactions, one per event row."""
    e = E.table(spark, d, "events")
    kinds = ["mousemove", "mousemove", "mousemove", "mousemove", "keydown", "keydown", "click", "scroll", "paste", "focus", "blur", "submit"]
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("s_"), F.col("user_id").cast("string")).alias("session_id"), i.alias("seq"),
        (i * 20 + F.length("event_type") % 7).alias("ts_ms"),
        F.element_at(F.array(*map(F.lit, kinds)), (F.expr("event_id * 7 div 3") % 12 + 1).cast("int")).alias("kind"),
        (i * 37 % 1920).alias("x"), (i * 53 % 1080).alias("y"))


def feedback(spark, d) -> DataFrame:
    """Labels on incidents (by number) and on some events; every other one already consumed."""
    def build() -> DataFrame:
        n = F.substring("incident_id", 5, 12).cast("long")
        label = F.when(n % 5 == 0, "confirmed_threat").when(n % 5 == 1, "false_positive").otherwise("reclassify")
        i = P.incident_table(spark, d).where(n % 5 < 3).select(
            n.alias("feedback_id"), "incident_id", F.lit(None).cast("long").alias("event_id"), label.alias("label"),
            F.when(n % 5 == 2, "scraper").alias("new_class"), F.col("last_us").alias("ts_us"),
            F.when(n % 2 == 0, "v1.0.0").alias("consumed_by"))
        e = P.seeds(spark, d).where(F.col("event_id") % 97 == 0)
        i2 = e.select(
            (F.col("event_id") + 1_000_000).alias("feedback_id"), F.lit(None).cast("string").alias("incident_id"), "event_id",
            F.when(F.col("event_id") % 2 == 0, "false_positive").otherwise("confirmed_threat").alias("label"),
            F.lit(None).cast("string").alias("new_class"), "ts_us", F.lit(None).cast("string").alias("consumed_by"))
        return i.unionByName(i2)
    return stage(spark, "feedback", d, build)


def model_rows(spark, d) -> DataFrame:
    """Labels, predictions and scores for the metric queries; many scores differ in the eighth decimal only."""
    ev = E.web_events(spark, d)
    name = F.element_at(F.array(*map(F.lit, ["normal", "slow_recon", "credential_stuffing", "brute_force", "dir_scan", "scraper", "flood"])),
                        F.greatest(F.lit(1), F.col("kind") - 2))
    attack = (F.col("kind") >= 4).cast("int")
    return ev.select(
        "event_id", name.alias("label"), F.when(F.col("k") % 10 == 0, "normal").when(F.col("k") % 17 == 0, "flood").otherwise(name).alias("pred"),
        (attack == 1).alias("is_attack"), ((F.col("k") + attack * 30) / 130.0 + (F.col("event_id") % 97) * F.lit(1e-8)).alias("score"))


def registry(spark, d) -> DataFrame:
    """Model versions, one per part."""
    p = E.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("v1.0."), k.cast("string")).alias("version"), (k * 1_000_000 + F.col("p_size")).alias("trained_us"),
        (F.lit(0.5) + F.col("p_size") / 100.0).alias("pr_auc"), ((k % 20) / 100.0).alias("fpr_at_90_recall"),
        (k % 3 == 0).alias("promoted"), F.when(k % 3 == 1, "PR-AUC regressed").alias("rejection_reason"),
        (k % 50).alias("n_feedback"))


def weight_rows(spark, d) -> DataFrame:
    """Weight tables, one scenario per customer: valid ones and every kind of mistake."""
    k = F.col("c_custkey")
    items = F.array(*[F.struct(
        F.when((k % 5 == 1) & F.lit(t == "recency"), "freshness").otherwise(F.lit(t)).alias("term"),
        F.when((k % 5 == 2) & F.lit(t == "recency"), F.lit(0.2)).when((k % 5 == 3) & F.lit(t == "recency"), F.lit(-0.1))
        .otherwise(F.lit(w)).alias("weight")) for t, w in C.DEFAULT_WEIGHTS.items()])
    extra = F.when(k % 5 == 4, F.array(F.struct(F.lit("luck").alias("term"), F.lit(0.0).alias("weight")))).otherwise(
        F.array().cast("array<struct<term:string,weight:double>>"))
    return E.table(spark, d, "customer").select(
        F.lit(E.TENANT).alias("tenant_id"), k.alias("scenario"), F.explode(F.concat(items, extra)).alias("i")).select(
        "tenant_id", "scenario", "i.*")


def scenarios(spark, d) -> DataFrame:
    r = F.col("r_regionkey") * 0.02
    w = {**{t: F.lit(v) for t, v in C.DEFAULT_WEIGHTS.items()}}
    w["model_confidence"], w["recency"] = F.lit(0.2) + r, F.lit(0.1) - r
    return E.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("scenario"), *[w[t].alias(t) for t in C.RISK_TERMS])


def stamped(spark, d) -> DataFrame:
    """Scored events with their incident."""
    return stage(spark, "stamped", d, lambda: inc_ops.assign_incidents(
        P.scored_events(spark, d).select(*sorted(set(inc_ops.MEMBER_COLUMNS) | {"rule"})),
        P.membership(spark, d), P.incident_table(spark, d), P.lookback_start(spark, d)))


def prints(spark, d) -> DataFrame:
    return campaigns.fingerprint(P.incident_table(spark, d))


def matches(spark, d) -> DataFrame:
    def build():
        fp = prints(spark, d)
        return campaigns.match_campaign(fp, fp, F.lit(P.as_of(spark, d)))
    return stage(spark, "matches", d, build)


def links_index(spark, d) -> DataFrame:
    return stage(spark, "entity_index", d, lambda: graph.entity_index(graph.entities_of(graph.with_values(P.seeds(spark, d)), keep=["vals"]), keep=["vals"]))


def all_links(spark, d) -> DataFrame:
    return stage(spark, "links", d, lambda: graph.neighbour_pairs(links_index(spark, d)))


def text(c) -> "F.Column":
    return F.array_join(c, ",")


# --- 2.1 sources and sinks --------------------------------------------------------------

@query("scan_events")
def _(s, d):
    return P.seeds(s, d).select("event_id", "ts_us", "src_ip", "pred_class")


def _with_counts(dimension: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every row of a dimension with the number of events that have its key, 0 where none has."""
    n = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    return dimension.join(n, key, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long")))


@query("scan_assets_csv")
def _(s, d):
    path = replay.scratch(s, "assets-csv")
    feeds_mod.assets(s).coalesce(1).write.option("header", True).csv(path)
    ev = P.event_log(s, d).select(X.asset_for_path(F.col("url_path")).alias("asset_id"))
    return _with_counts(feeds_mod.read_assets(s, path), ev, "asset_id").select("asset_id", "name", "kind", "criticality", "cpe_product", "events")


@query("scan_path_cve")
def _(s, d):
    ev = P.event_log(s, d).select(X.path_cve_ordinal(F.col("url_path")).alias("ordinal"))
    return _with_counts(feeds_mod.path_cves(s), ev, "ordinal").select("ordinal", "path", "cve", "product", "events")


@query("scan_attack_map")
def _(s, d):
    return _with_counts(feeds_mod.techniques(s), P.scored_events(s, d).select("technique_id"), "technique_id").select(
        "technique_id", "technique", "tactic", F.col("tactic_order").cast("long"), "events")


@query("scan_kev_json")
def _(s, d):
    return feeds_mod.parse_kev(feeds_mod.kev_documents(s, d))


@query("scan_epss_json")
def _(s, d):
    return feeds_mod.parse_epss(feeds_mod.epss_documents(s, d))


@query("scan_blocklists")
def _(s, d):
    f = Feeds.from_tables(s, d)
    return f.feodo.withColumn("list", F.lit("feodo")).unionByName(f.tor.withColumn("list", F.lit("tor")))


@query("scan_playbooks")
def _(s, d):
    return _with_counts(feeds_mod.playbooks(s), P.scored_events(s, d).select("technique_id"), "technique_id").select(
        "technique_id", "section", F.col("ordinal").cast("long"), "action_id", "action", "owner", F.col("eta_min").cast("long"), "events")


@query("feeds_status")
def _(s, d):
    return Feeds.from_tables(s, d).status()


def _json_events(s, d) -> DataFrame:
    """Scored events with features as JSON text, some of it missing or broken."""
    i = F.col("event_id")
    j = F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, F.lit("{broken")).otherwise(fusion.features_json())
    return P.scored_events(s, d).select("event_id", j.alias("features_json"))


@query("parse_features")
def _(s, d):
    return fusion.parse_features(_json_events(s, d)).select(
        "event_id", "req_rate_60s", "path_entropy", "unique_paths_60s", "mouse_move_count", "browser_telemetry_present")


@query("write_events")
def _(s, d):
    path = replay.scratch(s, "log")
    E.write_events(P.event_log(s, d), path)
    return E.read_events(s, path, "2024-01-01").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"))


@query("replace_days")
def _(s, d):
    """A log of three appends whose last two days are scored again and whose first week is compacted: no row twice, none lost."""
    path, log = replay.scratch(s, "log"), P.event_log(s, d)
    for part in range(3):
        E.write_events(log.where(F.col("event_id") % 3 == part), path)
    newest = (P.as_of(s, d) // (24 * C.HOUR_US) - 1) * 24 * C.HOUR_US            # start of the last day but one
    E.replace_days(E.since(log, newest), path)
    E.compact_days(s, path, "2024-01-01", "2024-01-07")
    return E.read_events(s, path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("lookback_seeds")
def _(s, d):
    return P.seeds(s, d, days=2).groupBy("pred_class").agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"))


@query("write_incidents")
def _(s, d):
    table = Snapshots(s, replay.scratch(s, "incidents"))
    for _run in range(2):                       # idempotent: a rebuild replaces the table, readers of the old one keep it
        table.publish(P.incident_table(s, d).drop("kev", "landed", "probed"))
    return table.read().select("incident_id", "priority", "risk_score", "event_count")


@query("assign_incidents")
def _(s, d):
    return stamped(s, d).select("event_id", "incident_id")


@query("append_feedback")
def _(s, d):
    path = replay.scratch(s, "feedback")
    review.append_feedback(feedback(s, d), path)
    return s.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("labels"))


@query("append_model_version")
def _(s, d):
    table = Snapshots(s, replay.scratch(s, "registry"))
    rows = registry(s, d)
    for part in (F.col("trained_us") <= 100_000_000, F.col("trained_us") > 100_000_000):
        model.append_model_version(rows.where(part), table)
    return model.current_model(table.read()).select("version", "pr_auc", "n_feedback")


@query("stream_telemetry_source")
def _(s, d):
    t = E.telemetry(s, d)
    out = replay.drain(E.widget_event_rows(replay.as_stream(t)))
    return out.select("session_id", F.unix_millis("ts").alias("ts_ms"), "source", "url_path", "pred_class",
                      F.get_json_object("features_json", "$.mouse_move_count").cast("double").alias("mouse_move_count"))


# --- 2.2 request features ------------------------------------------------------------------

def _rolling(*cols):
    return lambda s, d: features.rolling_features(P.event_log(s, d)).select("event_id", *cols)


for _name in ("req_rate_10s", "req_rate_60s", "req_rate_300s", "auth_fail_ip_60s", "distinct_users_tried_60s",
              "auth_success_after_fails", "unique_paths_60s", "p404_ratio_60s", "path_entropy", "interarrival_mean_ms",
              "interarrival_std_ms", "payload_bytes", "payload_bytes_std", "resp_bytes_60s", "session_age_s",
              "requests_this_session", "header_count"):
    QUERIES[_name] = _rolling(_name)


@query("auth_fail_user_60s")
def _(s, d):
    ev = P.event_log(s, d)
    return features.account_failures(features.rolling_features(ev), ev).select("event_id", "auth_fail_user_60s")


def _row(**cols):
    return lambda s, d: P.event_log(s, d).select("event_id", *[c().alias(n) for n, c in cols.items()])


QUERIES["sensitive_path_hit"] = _row(sensitive_path_hit=lambda: X.sensitive_path(F.col("url_path")))
QUERIES["ua_missing"] = _row(ua_missing=lambda: (F.coalesce("user_agent", F.lit("")) == "").cast("int"))
QUERIES["ua_known_tool"] = _row(ua_known_tool=lambda: X.known_tool(F.col("user_agent")))
QUERIES["ua_entropy"] = _row(ua_entropy=lambda: X.half_up(X.text_entropy(F.col("user_agent")), 4))
QUERIES["accept_lang_missing"] = _row(accept_lang_missing=lambda: F.col("accept_lang").isNull().cast("int"))
QUERIES["header_order_hash_known"] = _row(header_order_hash_known=lambda: F.lit(1))
QUERIES["asn_is_hosting"] = _row(asn_is_hosting=lambda: F.col("asn").isin(C.HOSTING_ASNS).cast("int"))
QUERIES["country_risk"] = _row(country_risk=lambda: F.when(F.col("country").isin(C.HIGH_RISK_COUNTRIES), 0.8).otherwise(0.1))
QUERIES["hour_of_day"] = _row(hour_of_day=lambda: F.hour("ts"), is_off_hours=lambda: ((F.hour("ts") < 6) | (F.hour("ts") >= 22)).cast("int"))
QUERIES["strip_query"] = _row(path=lambda: X.strip_query(F.col("url_path")))
QUERIES["asset_for_path"] = _row(asset_id=lambda: X.asset_for_path(F.col("url_path")))
QUERIES["sensitive_prefix"] = _row(sensitive=lambda: X.sensitive_prefix(F.col("url_path")))
QUERIES["path_cve_match"] = _row(ordinal=lambda: F.coalesce(X.path_cve_ordinal(F.col("url_path")), F.lit(-1)))
QUERIES["subnet24"] = _row(subnet=lambda: X.subnet24(F.col("src_ip")))


@query("ip_reputation_hit")
def _(s, d):
    rep = Feeds.from_tables(s, d).reputation().withColumnRenamed("ip", "src_ip")
    return P.event_log(s, d).select("event_id", "src_ip").join(rep, "src_ip", "left").select(
        "event_id", F.col("reputation_source").isNotNull().cast("int").alias("ip_reputation_hit"),
        F.coalesce("is_tor", F.lit(0)).alias("is_tor_exit"))


@query("last_user")
def _(s, d):
    return features.rolling_features(P.event_log(s, d)).select("event_id", X.user_hash(F.col("last_account")).alias("last_user"))


@query("server_features")
def _(s, d):
    ev = P.event_log(s, d)
    return features.server_features(ev, Feeds.from_tables(s, d).reputation()).select("event_id", *C.SERVER_FEATURES)


# --- 2.3 browser features and vectors --------------------------------------------------------

QUERIES["browser_counts"] = lambda s, d: fusion.browser_counts(actions(s, d))
QUERIES["mouse_path_entropy"] = lambda s, d: fusion.mouse_path_entropy(actions(s, d))
QUERIES["keystroke_interval_stats"] = lambda s, d: fusion.keystroke_interval_stats(actions(s, d))
QUERIES["session_timings"] = lambda s, d: fusion.session_timings(actions(s, d)).select(
    "session_id", *[F.col(c).cast("double").alias(c) for c in ("time_to_first_click_ms", "form_fill_ms", "page_dwell_ms")])


@query("fuse_telemetry")
def _(s, d):
    return fusion.fuse_telemetry(P.event_log(s, d).select("tenant_id", "event_id", "session_id", "ts_us"), E.telemetry(s, d)).select(
        "event_id", "browser_telemetry_present", *C.BROWSER_FEATURES)


@query("feature_vector")
def _(s, d):
    v = P.scored_events(s, d).select("event_id", fusion.feature_vector().alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))
    return v.select("event_id", F.size("v").alias("n"), F.size(F.filter("v", F.isnan)).alias("missing"), X.half_up(total, 2).alias("total"))


@query("feature_matrix")
def _(s, d):
    v = fusion.parse_features(_json_events(s, d)).select("event_id", fusion.feature_vector().alias("v"))
    return v.select("event_id", F.size("v").alias("n"), F.size(F.filter("v", F.isnan)).alias("missing"),
                    F.element_at("v", 2).alias("req_rate_60s"))


@query("validate_features")
def _(s, d):
    i = F.col("event_id")
    j = fusion.features_json()
    j = F.when(i % 5 == 0, F.replace(j, F.lit('"req_rate_60s"'), F.lit('"req_rate_61s"'))).when(
        i % 7 == 0, F.replace(j, F.lit('"click_count":null'), F.lit('"click_count":0'))).otherwise(j)
    return fusion.validate_features(P.scored_events(s, d).select("event_id", j.alias("features_json")))


# --- 2.4 classification ------------------------------------------------------------------------

def _rule(rule):
    def run(s, d):
        return P.decided_events(s, d).select("event_id", classify.rule_hit(rule).alias("h")).where("h IS NOT NULL").select(
            "event_id", F.col("h.rule_class").alias("rule_class"), X.half_up(F.col("h.confidence"), 2).alias("confidence"))
    return run


for _name in classify.RULES:
    QUERIES[f"rule_{_name}"] = _rule(_name)

QUERIES["classify_rules"] = lambda s, d: P.decided_events(s, d).select("event_id", "pred_class", "pred_confidence")


@query("classify_with_model")
def _(s, d):
    k = F.col("event_id") % 10
    rows = P.scored_events(s, d).withColumns({
        "model_class": F.when(k < 3, "scraper").when(k < 6, F.col("pred_class")), "model_confidence": F.when(k < 6, 0.4 + k / 10.0)})
    return classify.classify_with_model(rows).select("event_id", "final_class", "final_confidence")


QUERIES["technique_on_event"] = lambda s, d: P.decided_events(s, d).select("event_id", "attack_technique")
QUERIES["technique_overrides"] = lambda s, d: P.decided_events(s, d).select(
    "event_id", classify.technique_overrides().alias("technique_id"))
QUERIES["technique_resolve"] = lambda s, d: P.decided_events(s, d).select("event_id", "technique_id", "technique", "tactic")


@query("evidence")
def _(s, d):
    return P.scored_events(s, d).select("event_id", F.posexplode(classify.evidence()).alias("pos", "e")).select(
        "event_id", "pos", "e.feature", "e.value", "e.baseline", "e.deviation", "e.note")


# --- 2.5 enrichment, 2.6 risk ------------------------------------------------------------------

def _scored(*cols):
    return lambda s, d: P.scored_events(s, d).select("event_id", *cols)


QUERIES["asset_criticality"] = _scored("asset_id", "asset_criticality")
QUERIES["kev_epss_join"] = _scored("cve", "in_kev", "kev_added", "epss")
QUERIES["product_match"] = _scored("product_match", "matched_asset", "matched_software")
QUERIES["exploitability"] = lambda s, d: P.scored_events(s, d).select("event_id", X.half_up(F.col("exploitability"), 4).alias("exploitability"))


@query("threat_intel")
def _(s, d):
    rows = enrich.enrich(P.event_log(s, d), Feeds.from_tables(s, d))             # intel needs no request features
    return rows.select("event_id", F.explode(enrich.threat_intel()).alias("t")).select(
        "event_id", "t.kind", "t.value", "t.name", "t.in_kev", "t.epss", "t.matched_asset", "t.source")


@query("enrich_event")
def _(s, d):
    ev = P.event_log(s, d)
    out = enrich.enrich(ev, Feeds.from_tables(s, d))
    return out.select("event_id", "asset_id", "asset_name", "asset_criticality", X.half_up(F.col("exploitability"), 4).alias("exploitability"),
                      F.col("sensitive_prefix").alias("sensitive_path"), "cve", "in_kev", "probe_succeeded", "matched_asset",
                      "reputation_source")


@query("entities_of")
def _(s, d):
    return graph.entities_of(P.seeds(s, d), agents=True).select("event_id", "kind", "value")


@query("score_unscored")
def _(s, d):
    half = F.when(F.col("event_id") % 2 == 0, F.lit("P4"))
    rows = enrich.enrich(P.decided_events(s, d), Feeds.from_tables(s, d)).withColumn("individual_priority", half)
    return enrich.score_unscored(rows, F.lit(P.latest_us(E.web_events(s, d)))).select("event_id", "individual_priority")


@query("risk_terms")
def _(s, d):
    return P.incident_table(s, d).select("incident_id", *[X.half_up(F.col(f"term_{t}"), 6).alias(t) for t in C.RISK_TERMS])


@query("risk_score")
def _(s, d):
    return P.incident_table(s, d).select("incident_id", F.posexplode("risk_breakdown").alias("pos", "b")).select(
        "incident_id", "pos", "b.term", "b.raw", "b.weight", "b.points")


QUERIES["priority_band"] = lambda s, d: P.incident_table(s, d).select("incident_id", "risk_score", "priority")
QUERIES["score_event"] = _scored("event_risk", "individual_priority")
QUERIES["score_incident"] = lambda s, d: P.incident_table(s, d).select("incident_id", "risk_score", "priority", "escalated")
QUERIES["validate_weights"] = lambda s, d: inc_ops.validate_weights(weight_rows(s, d))
QUERIES["rescore_what_if"] = lambda s, d: inc_ops.rescore(P.incident_table(s, d), scenarios(s, d)).select(
    "incident_id", "scenario", "new_risk", "new_priority")


# --- 2.7 correlation --------------------------------------------------------------------------

QUERIES["seed_events"] = lambda s, d: P.seeds(s, d).select("event_id", "pred_class", "pred_confidence")
QUERIES["entity_index"] = lambda s, d: graph.entity_index(graph.entities_of(P.seeds(s, d))).select(
    "event_id", "kind", "value", "fanout")
QUERIES["fanout_split"] = lambda s, d: graph.fanout_split(links_index(s, d)).groupBy("kind", "value", "path").agg(F.count(F.lit(1)).alias("events"))
QUERIES["pair_links"] = lambda s, d: graph.pair_links(all_links(s, d)).select("kind", "a", "b", X.half_up(F.col("w"), 6).alias("w"))
QUERIES["chain_links"] = lambda s, d: graph.chain_links(links_index(s, d)).select("kind", "a", "b", X.half_up(F.col("w"), 6).alias("w"))
QUERIES["edge_weights"] = lambda s, d: graph.edge_weights(all_links(s, d)).select("a", "b", X.half_up(F.col("w"), 6).alias("w"))
QUERIES["components"] = lambda s, d: graph.event_components(P.seeds(s, d).select("event_id"), graph.edge_weights(all_links(s, d)))
QUERIES["cluster_filter"] = lambda s, d: inc_ops.keep_clusters(P.member_events(s, d)).select("component", "size")
QUERIES["cluster_span"] = lambda s, d: P.incident_table(s, d).select(
    "component", X.iso_us(F.col("opened_us")).alias("opened_at"), X.iso_us(F.col("last_us")).alias("last_seen_at"), "event_count")


@query("split_communities")
def _(s, d):
    """What must hold of every re-cut component of the dense log, from the communities that the incident flow uses."""
    seeds, runs = P.seeds(s, d, dense=True), P.membership(s, d, dense=True)
    rc = graph.run_components(seeds, runs.select(*graph.RUN_KEY, "run_id"))
    big = stage(s, "oversized_dense", d, lambda: communities.oversized(seeds, rc))
    edges = stage(s, "link_graph_dense", d, lambda: communities.link_graph(seeds, rc.join(big, "component", "left_semi")))
    label = stage(s, "communities_dense", d, lambda: rc.join(big, "component", "left_semi").select("component", F.col("run_id").alias("node")).distinct().join(
        runs.select(F.col("run_id").alias("node"), F.col("component").alias("community")).distinct(), "node"))
    q = lambda of, name: communities.modularity(edges, communities._strength(edges), of).withColumnRenamed("q", name)
    level = communities.one_level(edges)
    parts = label.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("node").alias("runs"), F.count_distinct("community").alias("parts"))
    held = communities.connected(edges, label).groupBy("component").agg(F.count_distinct("community").alias("joint"))
    size = graph.on_runs(seeds.select("tenant_id", "event_id", "ts_us", "src_ip"), rc.drop("run_id")).groupBy("component").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("src_ip").alias("sources"))
    rows = big.join(size, "component").join(parts, "component").join(held, "component").join(q(label, "final"), "component").join(q(level, "first"), "component")
    return rows.select("component", "events", "sources", (F.col("rows") == F.col("runs")).alias("is_partition"), (F.col("parts") > 1).alias("is_cut"),
                       (F.col("joint") == F.col("parts")).alias("is_connected"), (F.col("final") >= F.col("first") - 1e-9).alias("not_under_one_level"))


@query("recut_incidents")
def _(s, d):
    """Incidents of the dense log: none reaches over two components, and together they hold the events of the kept components."""
    seeds, runs = P.seeds(s, d, dense=True), P.membership(s, d, dense=True)
    rc = graph.run_components(seeds, runs.select(*graph.RUN_KEY, "run_id")).select(*graph.RUN_KEY, F.col("component").alias("whole"))
    rows = graph.on_runs(P.member_events(s, d, dense=True).drop("slot"), rc)
    parts = rows.groupBy("component").agg(F.min("whole").alias("whole"), F.count_distinct("whole").alias("wholes"), F.count(F.lit(1)).alias("n"))
    inc = P.incident_table(s, d, dense=True).select("component", "event_count")
    both = parts.join(inc, "component", "left")
    return both.groupBy("whole").agg(F.sum("n").alias("events"), F.max("wholes").alias("components"),
                                     F.bool_and((F.col("event_count") == F.col("n")) | (F.col("event_count").isNull() & (F.col("n") == 1))).alias("counts_agree"))


@query("kill_chain")
def _(s, d):
    return inc_ops.kill_chain_rows(P.profile_table(s, d)).select(
        "component", "tactic", "technique_id", "technique", X.iso_us(F.col("first_us")).alias("first_seen"), "event_count", "tactic_order")


QUERIES["kill_chain_depth"] = lambda s, d: P.incident_table(s, d).select("component", "depth", F.col("escalated").alias("escalate"))
QUERIES["primary_class"] = lambda s, d: P.incident_table(s, d).select("component", "primary_class", "top_asn")
QUERIES["entity_counts"] = lambda s, d: inc_ops.entity_counts(P.profile_table(s, d), Feeds.from_tables(s, d).reputation()).drop("tenant_id")
QUERIES["affected_assets"] = lambda s, d: P.incident_table(s, d).select("component", text("assets").alias("assets"), "n_users")
QUERIES["max_individual_priority"] = lambda s, d: P.incident_table(s, d).select("component", "max_individual_priority")
QUERIES["techniques_set"] = lambda s, d: P.incident_table(s, d).select("component", text("techniques").alias("techniques"))
QUERIES["incident_ids"] = lambda s, d: P.incident_table(s, d).select("component", "incident_id")
QUERIES["incident_title"] = lambda s, d: P.incident_table(s, d).select("incident_id", "title")


@query("status_carryover")
def _(s, d):
    i = P.incident_table(s, d)
    old = i.where(F.col("component") % 3 == 0).select("tenant_id", "component", F.lit("confirmed").alias("status"))
    return inc_ops.status_carryover(i, old).select("component", "status")


@query("incident_intel")
def _(s, d):
    return inc_ops.incident_intel(P.member_events(s, d), enrich.threat_intel()).select(
        "component", "kind", "value", "name", "in_kev", "matched_asset", "source")


@query("entity_graph")
def _(s, d):
    n = inc_ops.entity_graph_nodes(inc_ops.entity_counts(P.profile_table(s, d)))
    e = inc_ops.entity_graph_edges(n)
    none = F.lit(None).cast("string")
    return n.select("component", F.lit("node").alias("part"), F.concat_ws(":", "kind", "value").alias("source"), none.alias("target"),
                    "event_count").unionByName(
        e.select("component", F.lit("edge").alias("part"), "source", "target", F.lit(0).cast("long").alias("event_count")))


@query("build_incidents")
def _(s, d):
    return P.incident_table(s, d).select(
        "incident_id", "title", "status", "priority", "risk_score", X.iso_us(F.col("opened_us")).alias("opened_at"),
        X.iso_us(F.col("last_us")).alias("last_seen_at"), "event_count", "primary_class", F.col("depth").alias("kill_chain_depth"),
        text("assets").alias("assets_affected"), F.col("n_users").alias("users_affected"), "top_asn", text("techniques").alias("techniques"))


# --- 2.8 campaigns ------------------------------------------------------------------------------

QUERIES["timing_bucket"] = lambda s, d: prints(s, d).select("incident_id", "timing_bucket")
QUERIES["hour_profile"] = lambda s, d: prints(s, d).select("incident_id", F.posexplode("hour_profile").alias("hour", "share")).where("share > 0")
QUERIES["fingerprint"] = lambda s, d: prints(s, d).select(
    "incident_id", text("techniques").alias("techniques"), text("tactics").alias("tactics"), text("asns").alias("asns"),
    "timing_bucket", "asset_tier", "event_count_log")
QUERIES["fingerprint_vector"] = lambda s, d: prints(s, d).select(
    "incident_id", F.posexplode(campaigns.fingerprint_vector()).alias("pos", "v")).where("v <> 0").select(
    "incident_id", "pos", X.half_up(F.col("v"), 4).alias("v"))


@query("cosine")
def _(s, d):
    """Similarity of each incident with the one numbered before it."""
    v = prints(s, d).select("tenant_id", F.substring("incident_id", 5, 12).cast("long").alias("n"), campaigns.fingerprint_vector().alias("v"))
    b = v.select("tenant_id", (F.col("n") + 1).alias("n"), F.col("v").alias("before"))
    return v.join(b, ["tenant_id", "n"]).select("n", X.half_up(campaigns.cosine(F.col("v"), F.col("before")), 4).alias("cosine"))


QUERIES["match_campaign"] = lambda s, d: matches(s, d).select(
    "incident_id", "similar_id", "similarity", "days_ago", "verdict", text("shared").alias("shared"))


@query("fingerprint_history")
def _(s, d):
    fp = prints(s, d)
    known = fp.where(F.col("component") % 2 == 0).withColumn("status", F.lit("confirmed"))
    return campaigns.fingerprint_history(known, fp).select("component", "status", "timing_bucket")


# --- 2.9 responses --------------------------------------------------------------------------------

QUERIES["playbook_actions"] = lambda s, d: respond.playbook_actions(P.incident_table(s, d), feeds_mod.playbooks(s)).select(
    "incident_id", "technique_id", "section", "action_id")
QUERIES["dedup_actions"] = lambda s, d: respond.dedup_actions(
    respond.playbook_actions(P.incident_table(s, d), feeds_mod.playbooks(s))).select("incident_id", "action_id", "technique_id", "section")
QUERIES["playbook_context"] = lambda s, d: respond.playbook_context(P.incident_table(s, d)).select("incident_id", *respond.CTX_FIELDS)
QUERIES["fill_template"] = lambda s, d: respond.recommend(P.incident_table(s, d), feeds_mod.playbooks(s)).select(
    "incident_id", "action_id", "owner", F.col("eta_min").cast("long").alias("eta_min"), "action", "rollback", "query")
QUERIES["incident_summary"] = lambda s, d: P.incident_table(s, d).select("incident_id", respond.incident_summary().alias("summary"))


@query("incident_narrative")
def _(s, d):
    rows = respond.playbook_context(P.incident_table(s, d)).join(matches(s, d).drop("tenant_id"), "incident_id", "left")
    return rows.select("incident_id", respond.incident_narrative().alias("narrative"))


QUERIES["no_browser_share"] = lambda s, d: P.incident_table(s, d).agg(
    F.count_if("no_browser").alias("without_browser"), F.count(F.lit(1)).alias("incidents"))
QUERIES["hunt_exposed_endpoints"] = lambda s, d: P.scored_events(s, d).where(
    F.col("url_path").like("/actuator/%") & (F.col("http_status") == 200)).select("asset_id").distinct()
QUERIES["hunt_catalogue_coverage"] = lambda s, d: P.scored_events(s, d).groupBy("asn").agg(F.count_distinct("url_path").alias("paths"))
QUERIES["hunt_auth_by_asn"] = lambda s, d: P.scored_events(s, d).where((F.col("asn") == 14061) & (F.col("url_path") == "/login")).select(
    "event_id", "src_ip", "user_id", "http_status")
QUERIES["hunt_users_in_subnet"] = lambda s, d: P.scored_events(s, d).where(
    F.col("src_ip").startswith("185.220.101.") & (F.col("http_status") == 200) & F.col("user_id").isNotNull()).select("user_id").distinct()


@query("hunt_vulnerable_assets")
def _(s, d):
    hit = feeds_mod.assets(s).where(F.col("software").like("%Spring%")).select("asset_id", "software")
    return P.scored_events(s, d).join(F.broadcast(hit), "asset_id").groupBy("asset_id", "software").agg(F.count(F.lit(1)).alias("events"))


QUERIES["hunt_masked_by_flood"] = lambda s, d: P.scored_events(s, d).where(F.col("asn") != 14061).groupBy("url_path").agg(
    F.count(F.lit(1)).alias("events"))
QUERIES["hunt_large_responses"] = lambda s, d: P.scored_events(s, d).where(F.col("resp_bytes_60s") > 5_000_000).select(
    "event_id", "src_ip", "resp_bytes_60s")
QUERIES["hunt_subnet_activity"] = lambda s, d: P.scored_events(s, d).where(F.col("src_ip").startswith("45.155.205.")).select(
    "event_id", "src_ip", "url_path", "pred_class")


# --- 2.10 reports ------------------------------------------------------------------------------------

QUERIES["overview_counters"] = lambda s, d: reports.overview_counters(P.scored_events(s, d), P.incident_table(s, d), P.as_of(s, d))
QUERIES["noise_reduction"] = lambda s, d: reports.noise_reduction(P.scored_events(s, d), P.incident_table(s, d))
QUERIES["daily_trend"] = lambda s, d: reports.daily_trend(P.scored_events(s, d), P.incident_table(s, d))
QUERIES["priority_split"] = lambda s, d: reports.priority_split(P.incident_table(s, d))
QUERIES["class_split"] = lambda s, d: reports.class_split(P.scored_events(s, d))
QUERIES["top_sources"] = lambda s, d: reports.top_sources(enrich.with_reputation(P.event_log(s, d), Feeds.from_tables(s, d)))
QUERIES["ticker"] = lambda s, d: reports.ticker(stamped(s, d))
QUERIES["incident_queue"] = lambda s, d: reports.incident_queue(P.incident_table(s, d), status="open", limit=10, offset=2)
QUERIES["incident_detail"] = lambda s, d: reports.incident_detail(P.incident_table(s, d), stamped(s, d))
QUERIES["funnel"] = lambda s, d: reports.funnel(P.scored_events(s, d), P.incident_table(s, d))
QUERIES["correlation_metrics"] = lambda s, d: reports.correlation_metrics(P.incident_table(s, d), matches(s, d))
QUERIES["invariants"] = lambda s, d: reports.invariants(P.scored_events(s, d), P.incident_table(s, d), stamped(s, d))


# --- 2.11 review ----------------------------------------------------------------------------------------

def _candidates(s, d):
    return review.review_candidates(P.scored_events(s, d), feedback(s, d).where(F.col("event_id").isNotNull()))


QUERIES["review_candidates"] = lambda s, d: _candidates(s, d).select("event_id", "pred_class")
QUERIES["review_groups"] = lambda s, d: review.review_groups(_candidates(s, d)).withColumn("mean_conf", X.half_up(F.col("mean_conf"), 2))
QUERIES["review_group_events"] = lambda s, d: review.group_events(_candidates(s, d))
QUERIES["uncertainty_rank"] = lambda s, d: review.uncertainty_rank(review.review_groups(_candidates(s, d))).select(
    "pred_class", "path", "n", "uncertainty")
QUERIES["review_sample"] = lambda s, d: review.review_sample(review.uncertainty_rank(review.review_groups(_candidates(s, d)))).select(
    "pred_class", "path", "uncertainty", "sampled_by")
QUERIES["feedback_status"] = lambda s, d: review.feedback_status(P.incident_table(s, d), feedback(s, d)).select("incident_id", "status")
QUERIES["feedback_fingerprints"] = lambda s, d: review.feedback_status(prints(s, d), feedback(s, d)).select("component", "status")
QUERIES["labels_pending"] = lambda s, d: review.labels_pending(feedback(s, d))
QUERIES["feedback_training_rows"] = lambda s, d: review.feedback_training_rows(feedback(s, d), stamped(s, d))
QUERIES["mark_consumed"] = lambda s, d: review.mark_consumed(
    feedback(s, d), review.feedback_training_rows(feedback(s, d), stamped(s, d)), "v1.0.7", True).select("feedback_id", "consumed_by")


# --- 2.12 model --------------------------------------------------------------------------------------------

QUERIES["training_set"] = lambda s, d: model.training_set(P.decided_events(s, d)).select("event_id", "label", "group_key")


@query("grouped_holdout")
def _(s, d):
    rows = model.grouped_holdout(model.training_set(P.scored_events(s, d)))
    return rows.groupBy("group_key").agg(F.max("is_test").alias("is_test"), F.count_distinct("is_test").alias("sides"))


@query("frozen_holdout")
def _(s, d):
    rows = model.training_set(P.scored_events(s, d))
    held = rows.where(F.col("event_id") % 4 == 0).select("event_id")
    return model.frozen_holdout(rows, held).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _check(name: str, n, ok):
    return F.struct(F.lit(name).alias("name"), n.cast("long").alias("n"), ok.alias("ok"))


def _checks(row: DataFrame, *checks) -> DataFrame:
    return row.select(F.explode(F.array(*checks)).alias("r")).select("r.*")


_trained: dict[tuple, model.ModelStore] = {}


def trained_store(s, d) -> model.ModelStore:
    """A store with one version, trained on the scored log without feedback, calibrated and in use; once per application and folder."""
    key = (s.sparkContext.applicationId, d, fingerprint(s, d))
    if key not in _trained:
        store = model.ModelStore(s, replay.scratch(s, "models"))
        model.retrain(P.scored_events(s, d), s.createDataFrame([], "event_id long, train_class string"), store, P.as_of(s, d))
        _trained[key] = store
    return _trained[key]


def held_out(s, d) -> DataFrame:
    return model.model_inputs(model.grouped_holdout(model.training_set(P.scored_events(s, d)))).where("is_test")


def stored_trees(s, d) -> tuple[boosting.Model, DataFrame]:
    """The model of ``trained_store`` and the held-out rows, for a query that reads nothing else of the store.

    Where this application has no store yet, its trees are grown from the same rows, without the folds that its maps need
    and the evaluation that its registry needs, and neither log nor scored events are stored on the way.
    """
    if (s.sparkContext.applicationId, d, fingerprint(s, d)) in _trained:
        return trained_store(s, d).load()[0], held_out(s, d)
    rows = stage(s, "labelled", d, lambda: P.labelled_events(s, d))
    return model.fit_classifier(rows.where(~F.col("is_test"))), rows.where("is_test")


@query("fit_classifier")
def _(s, d):
    """What a fitted model must keep on the held-out groups, as (name, n, ok)."""
    rows = cut(model.model_inputs(model.grouped_holdout(model.training_set(P.scored_events(s, d)))).select("event_id", "label", "features", "is_test"))
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    pred = lambda out: out.select("label", F.col("model_class").alias("pred"))
    boosted = model.macro_prf(pred(model.predict(model.fit_classifier(train), test))).select(F.col("f1").alias("boosted"))
    forest = model.macro_prf(pred(model.predict_forest(model.fit_forest(train), test))).select(F.col("f1").alias("forest"))
    size = test.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("features", F.isnan))).alias("missing"))
    return _checks(size.join(F.broadcast(boosted)).join(F.broadcast(forest)),
                   _check("held-out rows", F.col("n"), F.lit(True)), _check("missing numbers stay missing", F.col("missing"), F.col("missing") > 0),
                   _check("macro F1 not under the forest's", F.lit(0), F.col("boosted") >= F.col("forest")))


@query("calibrate")
def _(s, d):
    """The stored map of each class: it never falls and stays between 0 and 1."""
    fitted, maps = trained_store(s, d).load()
    steps = lambda kn: all(a[1] <= b[1] and a[0] <= b[0] for a, b in zip(kn, kn[1:])) and all(0 <= v <= 1 for _, v in kn)
    found = s.createDataFrame([(c, steps(maps[c])) for c in fitted.classes], "class string, is_monotone boolean")
    labels = model.training_set(P.scored_events(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(found, F.col("label") == F.col("class")).select("label", "n", "is_monotone")


@query("calibrate_checks")
def _(s, d):
    """What calibration must keep, as (name, n, ok)."""
    raw = stage(s, "oof", d, lambda: model.out_of_fold(model.model_inputs(model.training_set(P.scored_events(s, d)))))
    done = model.apply_calibration(raw, model.calibrate(raw))
    best = F.element_at(F.array(*map(F.lit, C.CLASSES)), F.array_position("proba", F.array_max("proba")).cast("int"))
    right = lambda c: F.avg((c == F.col("label")).cast("double"))
    before = raw.agg(right(best).alias("before"), F.count(F.lit(1)).alias("rows"))
    after = done.agg(right(F.col("model_class")).alias("after"), F.max(F.size("proba")).alias("classes"),
                     F.count_if(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6).alias("whole"))
    return _checks(before.join(F.broadcast(after)), _check("rows", F.col("rows"), F.lit(True)), _check("classes", F.col("classes"), F.lit(True)),
                   _check("probabilities sum to one", F.col("whole"), F.col("whole") == F.col("rows")),
                   _check("accuracy not lowered", F.lit(0), F.col("after") >= F.col("before") - 0.005))


@query("model_checks")
def _(s, d):
    """What the stored model must keep on the held-out groups, as (name, n, ok)."""
    rows = model.grouped_holdout(model.training_set(P.scored_events(s, d)))
    fitted, maps = trained_store(s, d).load()
    test = held_out(s, d)
    scored = model.predict(fitted, test, maps)
    good = scored.agg(F.avg((F.col("model_class") == F.col("label")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("rows"))
    f1 = model.macro_prf(scored.select("label", F.col("model_class").alias("pred"))).select("f1")
    sides = rows.groupBy("group_key").agg(F.count_distinct("is_test").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split"))
    common = test.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("common"))
    return _checks(good.join(F.broadcast(sides)).join(F.broadcast(common)).join(F.broadcast(f1)),
                   _check("held-out rows", F.col("rows"), F.lit(True)), _check("not worse than the commonest class", F.lit(0), F.col("acc") >= F.col("common") / F.col("rows")),
                   _check("macro F1 of 0.9", F.lit(0), F.col("f1") >= 0.9), _check("no group on both sides", F.col("split"), F.col("split") == 0))


@query("predict")
def _(s, d):
    """Held-out rows scored by the stored model: the named class is the likeliest, and chances sum to one."""
    fitted, maps = trained_store(s, d).load()
    out = model.predict(fitted, held_out(s, d), maps)
    named = F.element_at("proba", F.array_position(F.array(*map(F.lit, C.CLASSES)), F.col("model_class")).cast("int"))
    sums = F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    return out.select("event_id", (named == F.col("model_confidence")).alias("is_likeliest"), sums.alias("sums_to_one"))


@query("score_with_model")
def _(s, d):
    """The flow with the stored model: rules keep their class, the model decides the rest, technique and evidence follow."""
    ev = P.event_log(s, d)
    rows = P.score_log(ev, E.telemetry(s, d), Feeds.from_tables(s, d), P.latest_us(ev), scorer=trained_store(s, d).load())
    ruled = F.col("rule").isNotNull()
    shown = F.transform(classify.evidence(by_model=True), lambda e: e["feature"])
    return rows.select("event_id", ruled.alias("ruled"), F.when(ruled, F.col("pred_class")).alias("rule_class"),
                       F.col("attack_technique").eqNullSafe(classify.technique_on_event()).alias("technique_agrees"),
                       F.when(~ruled, F.array_join(shown, ",")).alias("model_evidence"),
                       (ruled | (F.col("pred_class") == F.col("model_class"))).alias("model_decides"))


@query("model_store")
def _(s, d):
    """Fit, save, promote, load, score and roll back on stored files, as (name, n, ok)."""
    store = model.ModelStore(s, replay.scratch(s, "models"))
    fitted, maps = trained_store(s, d).load()
    rows = registry(s, d).where("version in ('v1.0.1', 'v1.0.2', 'v1.0.3')").withColumn("promoted", F.lit(False))
    for v, m in (("v1.0.1", fitted), ("v1.0.2", replace(fitted, rounds=fitted.rounds[:1])), ("v1.0.3", fitted)):
        store.save(v, m, maps)
        model.append_model_version(rows.where(F.col("version") == v).withColumn("promoted", F.lit(True)), store.registry)
        store.promote(v)
    store.promote("v1.0.1")                     # a rollback
    test = held_out(s, d)
    score = lambda of, name: model.predict(*P._on(of, test)).select("event_id", F.col("proba").alias(name))
    same = score((fitted, maps), "a").join(score(store.load(), "b"), "event_id").join(score(store.load("v1.0.2"), "c"), "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") == F.col("c")).alias("other"))
    known = store.registry.read().agg(F.count(F.lit(1)).alias("versions"), F.max(F.when(F.col("promoted"), F.col("version"))).alias("used"), F.count_if("promoted").alias("promoted"))
    return _checks(same.join(F.broadcast(known)), _check("rows scored alike by the loaded model", F.col("same"), F.col("same") == F.col("n")),
                   _check("another version scores differently", F.lit(0), F.col("other") < F.col("n")),
                   _check("versions", F.col("versions"), F.col("used") == store.pointer.current()), _check("one version in use", F.col("promoted"), F.col("used") == "v1.0.1"))


QUERIES["macro_prf"] = lambda s, d: model.macro_prf(model_rows(s, d))
QUERIES["confusion_matrix"] = lambda s, d: model.confusion_matrix(model_rows(s, d))
QUERIES["average_precision"] = lambda s, d: model.average_precision(model_rows(s, d))
QUERIES["fpr_at_90_recall"] = lambda s, d: model.fpr_at_90_recall(model_rows(s, d))
QUERIES["pr_curve"] = lambda s, d: model.pr_curve(model_rows(s, d))


@query("permutation_importance")
def _(s, d):
    """What the ranking of the stored model's features must keep, as (name, n, ok)."""
    fitted, test = stored_trees(s, d)
    out = model.permutation_importance(fitted, test)
    found = out.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("feature").isin(fitted.split_features())).alias("used"), F.min("importance").alias("least"), F.max("importance").alias("most"))
    return _checks(test.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(found)), _check("rows", F.col("n"), F.lit(True)),
                   _check("some features, twelve at most", F.lit(0), F.col("found").between(1, 12)), _check("trees split on all of them", F.lit(0), F.col("used") == F.col("found")),
                   _check("drops of accuracy", F.lit(0), (F.col("least") >= 0) & (F.col("most") <= 1) & (F.col("most") > 0)))


QUERIES["promotion_gate"] = lambda s, d: model.promotion_gate(
    registry(s, d).drop("promoted", "rejection_reason"), model.current_model(registry(s, d))).select("version", "promoted", "rejection_reason")
QUERIES["next_version"] = lambda s, d: model.next_version(registry(s, d))
QUERIES["current_model"] = lambda s, d: model.current_model(registry(s, d)).select("version", "pr_auc", "fpr_at_90_recall", "n_feedback")
QUERIES["rollback"] = lambda s, d: model.rollback(registry(s, d), "v1.0.3").select("version", "promoted")
QUERIES["model_history"] = lambda s, d: model.model_history(registry(s, d))


@query("retrain")
def _(s, d):
    """Training with feedback beside an older version: the frozen holdout, the gate, the registry and the pointer agree."""
    rows = review.feedback_training_rows(feedback(s, d), stamped(s, d))
    store = model.ModelStore(s, replay.scratch(s, "models"))
    scored, now = P.scored_events(s, d), P.as_of(s, d)
    # a champion of one round, whose training froze the holdout
    base = model.model_inputs(model.freeze_holdout(model.training_set(scored), store)).where(~F.col("is_test"))
    store.save("v1.0.0", model.fit_classifier(base, rounds=1), {c: [(0.0, 0.0), (1.0, 1.0)] for c in C.CLASSES})
    first = base.agg(F.lit("v1.0.0").alias("version"), F.lit(0).cast("long").alias("trained_us"), F.count(F.lit(1)).alias("n_base"), F.lit(0).cast("long").alias("n_feedback"),
                     *[F.lit(v).alias(c) for c, v in (("precision", 0.0), ("recall", 0.0), ("f1", 0.0), ("pr_auc", 0.0), ("fpr_at_90_recall", 1.0))],
                     F.lit(None).cast("string").alias("rejection_reason"), F.lit(True).alias("promoted"))
    model.append_model_version(first, store.registry)
    store.promote("v1.0.0")
    model.retrain(scored, rows, store, now)
    used = F.col("version") == store.pointer.current()
    return store.registry.read().select("version", "n_base", "n_feedback", F.col("promoted").eqNullSafe(used).alias("pointer_agrees"),
                                        (F.col("promoted") | F.col("rejection_reason").isNotNull() | (F.col("version") == "v1.0.0")).alias("reason_given"))


# --- 2.13 streaming, by replay --------------------------------------------------------------------------------

def _replay(fn):
    def run(s, d):
        ev = E.web_events(s, d)
        out = replay.drain(fn(replay.as_stream(replay.with_sentinel(ev)), replay.whole_log(ev)))
        return out.where(F.col("src_ip") != replay.SENTINEL_IP).drop("tenant_id")
    return run


QUERIES["stream_rate_tumbling"] = _replay(live.rate_windows)
QUERIES["stream_rate_sliding"] = _replay(lambda st, delay: live.rate_windows(st, delay, "60 seconds", "10 seconds"))
QUERIES["stream_sessions"] = _replay(live.activity_sessions)
def shuffled():
    """Arrival of replayed rows: up to eight minutes after their time, in no order, under a watermark of ten."""
    return F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(480)) * C.US


QUERIES["stream_rolling_features"] = lambda s, d: replay.in_slices(E.web_events(s, d), live.rolling_features, arrival=shuffled()).select(
    "event_id", "req_rate_60s", "unique_paths_60s", "path_entropy", "payload_bytes_std", "requests_this_session", "auth_success_after_fails")


@query("stream_fuse")
def _(s, d):
    cols = ["tenant_id", "event_id", "ts", "ts_us", "session_id", "src_ip"]
    ev = E.web_events(s, d).select(*cols)
    tel = E.telemetry(s, d).withColumns({"ts": F.timestamp_micros("ts_us"), "src_ip": F.lit(""), "event_id": F.col("telemetry_id")})
    out = replay.drain(live.fuse(replay.as_stream(replay.with_sentinel(ev)), replay.as_stream(replay.with_sentinel(tel)), replay.whole_log(ev.select("ts_us").unionByName(tel.select("ts_us")))))
    return out.where(F.col("event_id") >= 0).select("event_id", "browser_telemetry_present", "mouse_move_count", "click_count")


@query("stream_classify")
def _(s, d):
    tel, feeds = E.telemetry(s, d), Feeds.from_tables(s, d)
    out = replay.in_slices(E.web_events(s, d), lambda st, f, o: live.classify_stream(st, tel, feeds, f, o), arrival=shuffled())
    return out.select("event_id", "pred_class", "pred_confidence", "attack_technique")


QUERIES["stream_skip_paths"] = lambda s, d: replay.drain(live.skip_paths(replay.as_stream(E.web_events(s, d).withColumn(
    "url_path", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/static"), "url_path")).otherwise(F.col("url_path")))))).select("event_id", "url_path")


@query("stream_dedup")
def _(s, d):
    t = E.telemetry(s, d).withColumn("ts", F.timestamp_micros("ts_us"))
    again = t.unionByName(t.where(F.col("telemetry_id") % 3 == 0))
    return replay.drain(live.dedup(replay.as_stream(again), ["session_id", "telemetry_id"], replay.whole_log(t))).select("session_id", "telemetry_id")


@query("stream_correlate")
def _(s, d):
    """Classified events fed in four micro-batches by event time; the incidents after the last equal the batch result."""
    out, now = replay.scratch(s, "corr-out"), P.as_of(s, d)

    def rebuild(members, batch_id):
        built = inc_ops.build_incidents(members.where(F.col("event_id") >= 0), now)
        built.select("incident_id", "component", "event_count", "priority", "risk_score").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows = P.seeds(s, d).select(*inc_ops.MEMBER_COLUMNS).withColumn("ts", F.timestamp_micros("ts_us"))
    replay.in_slices(rows, lambda st, f, _: live.correlate_stream(st, f, rebuild), 4, out=out)
    built = s.read.parquet(out)
    return built.join(built.agg(F.max("batch").alias("batch")), "batch").drop("batch", "tenant_id")


@query("late_events")
def _(s, d):
    """Rows behind the watermark when they arrive, and by how much: the first half of the log replayed after the second."""
    ev = E.web_events(s, d)
    half = ev.agg(F.expr("max(ts_us) div 2 + min(ts_us) div 2")).first()[0]
    folder = replay.scratch(s, "late")
    arrival = F.when(F.col("ts_us") > half, F.lit(0)).otherwise(F.lit(1))
    replay.in_slices(ev, live.rolling_features, 2, arrival, folder).count()
    return live.AddressState(folder, 0).late_rows(s).select("event_id", (F.col("mark_us") - F.col("ts_us")).alias("behind_us"))
