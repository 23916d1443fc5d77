"""Web-event sources: the stored log, the test projection over the given tables, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions import expr as X
from ..session import cut, rebalanced

TENANT = "sample-store"
EPOCH_MS = 1_704_067_200_000          # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(kind: Column, normal, *attacks) -> Column:
    """CASE over the traffic kind: 0-3 normal, then kinds 4..9."""
    out = F.when(kind < 4, normal)
    for i, value in enumerate(attacks):
        out = out.when(kind == 4 + i, value)
    return out


def web_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Deterministic web-traffic view of the given ``events`` table.

    Integer arithmetic and CASE only, so that any engine gives the same rows.
    ``dense`` lets the slow probes come from two addresses, which yields an
    incident with more than three sources.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    blk = F.expr("event_id div 100")
    pos = F.col("event_id") % 100
    ev = ev.select("event_id", "user_id", "event_type", "value",
                   k.alias("k"), blk.alias("blk"), pos.alias("pos"), (blk % 10).alias("kind"))
    kind, k, blk, pos, uid = (F.col(c) for c in ("kind", "k", "blk", "pos", "user_id"))
    lit, s = F.lit, lambda c: c.cast("string")
    blk7 = blk % 7
    step = _pick(kind, lit(7000), lit(90000), lit(3000), lit(2000), lit(2000), lit(3000), lit(200))
    ts_us = (lit(EPOCH_MS) + blk * 1_200_000 + pos * step) * 1000
    recon_host = (10 + blk7 + 20 * (pos % 2)) if dense else 10 + blk7
    src_ip = _pick(
        kind,
        F.concat(lit("49."), s(uid % 200), lit("."), s(k), lit("."), s(2 + uid % 250)),
        F.concat(lit("185.220.101."), s(recon_host)), F.concat(lit("185.220.101."), s(60 + blk7)),
        F.concat(lit("45.155.205."), s(10 + blk7)), F.concat(lit("45.155.205."), s(60 + blk7)),
        F.concat(lit("138.201.44."), s(10 + blk7)), F.concat(lit("185.220.101."), s(200 + blk7)))
    shop = (F.when(F.col("event_type") == "view", "/products").when(F.col("event_type") == "click", "/search")
            .when(F.col("event_type") == "purchase", "/checkout").when(F.col("event_type") == "signup", "/account")
            .otherwise("/cart"))
    probe = (F.when(pos % 5 == 0, "/.env").when(pos % 5 == 1, "/.git/config").when(pos % 5 == 2, "/wp-admin/")
             .when(pos % 5 == 3, "/admin.php").otherwise("/actuator/env"))
    path = _pick(kind, shop, probe, lit("/login"), lit("/login"), F.concat(lit("/backup.sql"), s(pos)),
                 F.concat(lit("/products/"), s(pos), lit("?ref="), s(k)), lit("/checkout"))
    status = _pick(
        kind, F.when(F.col("event_type") == "error", 404).otherwise(200),
        F.when(pos % 5 == 4, 200).otherwise(404), F.when(pos == 99, 200).otherwise(401),
        lit(401), lit(404), lit(200), lit(503))
    user = (F.when(kind == 5, F.concat(lit("u_"), s(pos % 40)))
            .when(kind == 6, F.concat(lit("u_9"), s(F.expr("blk div 10") % 5)))
            .when((kind < 4) & (F.col("event_type") == "purchase"), F.concat(lit("u_"), s(uid))))
    agent = _pick(
        kind, F.concat(lit("Mozilla/5.0 (X11) rv:"), s(k)),
        F.when(pos % 5 == 0, lit(None)).otherwise(F.concat(lit("curl/8."), s(pos % 3))),
        lit("Go-http-client/1.1"), lit("Mozilla/5.0"), lit("Mozilla/5.0 Nikto/2.1"),
        F.concat(lit("python-requests/2."), s(k % 5)), lit(""))
    resp = _pick(kind, 1000 + k * 13, lit(180), 300 + k, 300 + k, lit(120), 250_000 + k * 1000, lit(0))
    return ev.select(
        lit(TENANT).alias("tenant_id"), "event_id", F.timestamp_micros(ts_us).alias("ts"), ts_us.alias("ts_us"),
        F.when(kind < 4, F.concat(lit("s_"), s(uid))).alias("session_id"), lit("server").alias("source"),
        src_ip.alias("src_ip"),
        _pick(kind, lit(55836), lit(14061), lit(14061), lit(9009), lit(9009), lit(24940), lit(14061)).alias("asn"),
        _pick(kind, lit("IN"), lit("NL"), lit("NL"), lit("RO"), lit("RO"), lit("DE"), lit("NL")).alias("country"),
        user.alias("user_id"), path.alias("url_path"), status.cast("int").alias("http_status"),
        F.floor("value").cast("long").alias("payload_bytes"), resp.cast("long").alias("resp_bytes"),
        agent.alias("user_agent"), F.when(kind < 4, "en-IN").alias("accept_lang"),
        _pick(kind, 9 + k % 6, 4 + pos % 3, lit(4), lit(5), lit(6), lit(5), lit(2)).cast("int").alias("header_count"),
        kind.cast("int").alias("kind"), "k", pos.cast("int").alias("pos"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser snapshots: one per even normal request, a second earlier, same session."""
    ev = web_events(spark, sf_dir).where((F.col("kind") < 4) & (F.col("pos") % 2 == 0))
    k, p = F.col("k"), F.col("payload_bytes")
    values = {
        "mouse_move_count": k * 3, "mouse_path_entropy": k % 40 / 10.0, "keystroke_count": k % 30,
        "keystroke_interval_mean": 80 + k / 2.0, "keystroke_interval_std": 20 + k / 4.0,
        "form_fill_ms": F.when(k % 3 == 0, 5000 + k * 100), "paste_events": k % 2, "click_count": k % 7,
        "time_to_first_click_ms": F.when(k % 4 != 0, 300 + p), "scroll_events": k % 11,
        "page_dwell_ms": 4000 + k * 50, "focus_blur_count": k % 3, "screen_w": F.lit(1920),
        "screen_h": F.lit(1080), "tz_offset": F.lit(-330), "hardware_concurrency": 2 + k % 8,
    }
    return ev.select(
        "tenant_id", "session_id", (F.col("ts_us") - 1_000_000).alias("ts_us"),
        F.col("event_id").alias("telemetry_id"), F.col("url_path").alias("page"),
        *[values[f].cast("double").alias(f) for f in C.BROWSER_FEATURES])


def with_day(events: DataFrame) -> DataFrame:
    """The UTC day of each event, by which the log is partitioned.  Null for an event without a time."""
    return events.withColumn("day", F.to_date(F.timestamp_micros("ts_us")))


def since(events: DataFrame, since_us: int) -> DataFrame:
    """Events from a time on; a log with a ``day`` reads the folders of these days only."""
    at = F.col("ts_us") >= since_us
    return events.where(at & (F.col("day") >= F.to_date(F.timestamp_micros(F.lit(since_us)))) if "day" in events.columns else at)


def scan_events(events: DataFrame, since_us: int | None = None) -> DataFrame:
    """Classified, non-normal rows of the lookback window.  Ordering is left to the consumer."""
    out = events.where(F.col("pred_class").isNotNull() & (F.col("pred_class") != "normal"))
    return out if since_us is None else since(out, since_us)


def widget_event_rows(telemetry_df: DataFrame) -> DataFrame:
    """Telemetry payloads as event rows: source ``widget``, no prediction, features as JSON."""
    feats = F.to_json(F.struct(*C.BROWSER_FEATURES, F.lit(1).alias("browser_telemetry_present")),
                      {"ignoreNullFields": "false"})
    return telemetry_df.select(
        "tenant_id", F.timestamp_micros("ts_us").alias("ts"), "session_id", F.lit("widget").alias("source"),
        F.col("page").alias("url_path"), F.lit(None).cast("int").alias("http_status"),
        feats.alias("features_json"), F.lit(None).cast("string").alias("pred_class"))


def write_events(events: DataFrame, path: str) -> None:
    """Append to the log, one folder per UTC day, so a lookback prunes whole folders."""
    rebalanced(with_day(events), "day").write.mode("append").partitionBy("day").parquet(path)


def replace_days(events: DataFrame, path: str) -> None:
    """The days of these events hold just these events from now on; all other days stay as they are.

    For days that are scored again or arrive corrected.  No rows change nothing."""
    out = rebalanced(with_day(events), "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("day").parquet(path)


def compact_days(spark: SparkSession, path: str, first: str, last: str) -> None:
    """Rewrites days (both included) that many appends have left in small files; the rows stay the same."""
    days = spark.read.parquet(path).where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    replace_days(cut(days), path)


def read_events(spark: SparkSession, path: str, since=None) -> DataFrame:
    """The log, from a UTC time on where one is given: folders of earlier days are not read."""
    log = spark.read.parquet(path)
    if since is not None:
        at = F.lit(since).cast("timestamp")
        log = log.where((F.col("day") >= F.to_date(at)) & (F.col("ts_us") >= F.unix_micros(at)))
    return log


__all__ = ["X", "compact_days", "read_events", "replace_days", "scan_events", "since", "table", "telemetry", "web_events", "widget_event_rows", "with_day", "write_events"]
