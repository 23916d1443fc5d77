"""Browser telemetry: per-session summaries of raw interactions, and the as-of join to requests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions import expr as X
from .sweep import dealt, keyed, previous_in_slices

TTL_US = 900 * C.US
SLICE_MS = 600_000


def fuse_telemetry(events: DataFrame, telemetry: DataFrame, ttl_us: int = TTL_US, n: int | None = None,
                   fields: list[str] = C.BROWSER_FEATURES) -> DataFrame:
    """Newest telemetry of the request's session, no older than ``ttl_us``; otherwise 16 NULLs.

    Both sides are laid on one time line per (session, time bucket) and the
    last snapshot seen is carried forward.  A bucket is one TTL wide and a
    snapshot is also placed in the next bucket, so nothing older is needed and
    a session of any length is split in time.  Requests without a session get
    a salt of their own instead of sharing one NULL group.  ``fields`` are the browser features to bring; whether there
    is telemetry is told without any.
    """
    salt = F.concat(F.lit("~"), F.pmod(F.xxhash64("event_id"), F.lit(4096)).cast("string"))
    own = F.floor(F.col("ts_us") / F.lit(ttl_us)).cast("long")
    rows = events.select(
        "tenant_id", F.coalesce("session_id", salt).alias("sess"), own.alias("bucket"), "ts_us",
        F.lit(1).alias("side"), F.struct(*events.columns).alias("row"),
        F.lit(None).cast("bigint").alias("seen_us"), *[F.lit(None).cast("double").alias(c) for c in fields])
    snaps = telemetry.where(F.col("session_id").isNotNull()).select(
        "tenant_id", F.col("session_id").alias("sess"),
        F.explode(F.array(own, own + 1)).alias("bucket"), "ts_us",
        F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
        F.col("ts_us").alias("seen_us"), *fields)
    line = W.partitionBy("gk", "tenant_id", "sess", "bucket").orderBy("ts_us", "side").rowsBetween(W.unboundedPreceding, 0)
    snap = F.struct("seen_us", *fields)
    seen = F.last(F.when(F.col("side") == 0, snap), True).over(line)
    both = dealt(keyed(rows.unionByName(snaps), ["tenant_id", "sess"]), ["tenant_id", "sess"], n).withColumn("_seen", seen).where(F.col("side") == 1)
    fresh = F.col("ts_us") - F.col("_seen.seen_us") <= ttl_us
    return both.select(
        "row.*", *[F.when(fresh, F.col(f"_seen.{c}")).alias(c) for c in fields],
        F.coalesce(fresh, F.lit(False)).cast("int").alias("browser_telemetry_present"))


# --- raw interaction rows: (session_id, seq, ts_ms, kind, x, y) -----------------

def browser_counts(actions: DataFrame) -> DataFrame:
    names = [("mousemove", "mouse_move_count"), ("keydown", "keystroke_count"), ("paste", "paste_events"),
             ("click", "click_count"), ("scroll", "scroll_events")]
    return actions.groupBy("session_id").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in names],
        F.count_if(F.col("kind").isin("focus", "blur")).alias("focus_blur_count"))


def _slice() -> "F.Column":
    return F.floor(F.col("ts_ms") / F.lit(SLICE_MS))


def mouse_path_entropy(actions: DataFrame) -> DataFrame:
    """Entropy of travel directions in sixteenths of a turn."""
    order = ["ts_ms", "seq"]
    moves = previous_in_slices(actions.where(F.col("kind") == "mousemove"), ["session_id"], _slice(), order, ["x", "y"])
    dx, dy = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")
    moves = moves.withColumns({"dx": dx, "dy": dy}).where((F.col("dx") != 0) | (F.col("dy") != 0))
    direction = F.floor((F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")) + F.lit(math.pi))
                        / F.lit(math.pi / 8))
    used = moves.groupBy("session_id", direction.alias("direction")).agg(F.count(F.lit(1)).alias("n"))
    total = used.groupBy("session_id").agg(
        F.sum("n").alias("all_n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("w"))
    h = F.log2(F.col("all_n").cast("double")) - F.col("w") / F.col("all_n")
    return total.select("session_id", X.half_up(h, 2).alias("mouse_path_entropy"))


def keystroke_interval_stats(actions: DataFrame) -> DataFrame:
    """Mean and population deviation of key gaps under five seconds; NULL when there are none."""
    order = ["ts_ms", "seq"]
    keys = previous_in_slices(actions.where(F.col("kind") == "keydown"), ["session_id"], _slice(), order, ["ts_ms"])
    keys = keys.withColumn("gap", F.col("ts_ms") - F.col("prev.ts_ms")).where(F.col("gap") < 5000)
    stats = keys.groupBy("session_id").agg(
        F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"))
    sessions = actions.select("session_id").distinct()
    return sessions.join(stats, "session_id", "left").select(
        "session_id", X.half_up(F.col("mean"), 1).alias("keystroke_interval_mean"),
        X.half_up(F.col("std"), 1).alias("keystroke_interval_std"))


def session_timings(actions: DataFrame) -> DataFrame:
    """Time to first click, form fill time (first key or paste to the last submit) and dwell."""
    t = F.col("ts_ms")
    g = actions.groupBy("session_id").agg(
        F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"),
        F.min(F.when(F.col("kind") == "click", t)).alias("click"),
        F.min(F.when(F.col("kind").isin("keydown", "paste"), t)).alias("touch"),
        F.max(F.when(F.col("kind") == "submit", t)).alias("submit"))
    return g.select(
        "session_id", (F.col("click") - F.col("t0")).alias("time_to_first_click_ms"),
        F.when(F.col("submit") >= F.col("touch"), F.col("submit") - F.col("touch")).alias("form_fill_ms"),
        (F.col("t1") - F.col("t0")).alias("page_dwell_ms"))


# --- vectors and checks -----------------------------------------------------------

def feature_vector() -> "F.Column":
    """47 doubles in fixed order: a missing request feature is 0, a missing browser feature NaN."""
    browser = set(C.BROWSER_FEATURES)
    return F.array(*[
        F.coalesce(F.col(f).cast("double"), F.lit(float("nan") if f in browser else 0.0)) for f in C.FEATURES])


def features_json() -> "F.Column":
    return F.to_json(F.struct(*C.FEATURES), {"ignoreNullFields": "false"})


FEATURES_DDL = ", ".join(f"{f} double" for f in C.FEATURES)


def parse_features(df: DataFrame, column: str = "features_json") -> DataFrame:
    """JSON text to typed features; NULL or broken text counts as an empty object."""
    parsed = F.from_json(F.coalesce(F.col(column), F.lit("{}")), FEATURES_DDL, {"mode": "PERMISSIVE"})
    return df.withColumn("f", parsed).select(*df.columns, "f.*")


def validate_features(df: DataFrame, column: str = "features_json") -> DataFrame:
    """Contract check per row: unknown keys, missing request keys, zeroed browser keys without telemetry."""
    m = F.from_json(F.col(column), "map<string,string>")
    keys = F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    known, server = F.array(*map(F.lit, C.FEATURES)), F.array(*map(F.lit, C.SERVER_FEATURES))
    absent = F.try_element_at(m, F.lit("browser_telemetry_present")).cast("double") == 0
    zeroed = F.when(absent, F.filter(
        F.array(*map(F.lit, C.BROWSER_FEATURES)),
        lambda k: F.coalesce(F.try_element_at(m, k).try_cast("double") == 0, F.lit(False))))
    return df.select(
        "event_id", F.array_join(F.array_sort(F.array_except(keys, known)), ",").alias("unknown_keys"),
        F.array_join(F.array_except(server, keys), ",").alias("missing_server_keys"),
        (~F.array_contains(keys, "browser_telemetry_present")).alias("missing_presence_flag"),
        F.coalesce(F.array_join(zeroed, ","), F.lit("")).alias("zeroed_browser_keys"))
