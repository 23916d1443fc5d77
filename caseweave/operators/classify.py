"""Rule classification, technique assignment and evidence.  Projections only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import expr as X


def _rule_parts() -> dict[str, tuple[str, Column, Column, list[str]]]:
    """rule -> (class, fires, confidence, evidence features), in tie-break order."""
    c = F.col
    no_js = F.coalesce(c("browser_telemetry_present"), F.lit(1)) == 0
    r10, r60, paths, p404 = c("req_rate_10s"), c("req_rate_60s"), c("unique_paths_60s"), c("p404_ratio_60s")
    users, fails_ip, fails_user = c("distinct_users_tried_60s"), c("auth_fail_ip_60s"), c("auth_fail_user_60s")
    sensitive = c("sensitive_path_hit") == 1
    tool = (c("ua_known_tool") == 1) | (c("ua_missing") == 1)
    on_register = X.strip_query(c("url_path")).startswith("/register")

    def bonus(cond: Column, points: float) -> Column:
        return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))

    def top(limit: float, value: Column) -> Column:
        return F.least(F.lit(limit), value)

    return {
        "flood": ("flood", (r10 >= 40) | (r60 >= 250), top(0.99, 0.75 + r10 / 400.0),
                  ["req_rate_10s", "req_rate_60s", "payload_bytes", "browser_telemetry_present"]),
        "credential_stuffing": (
            "credential_stuffing", (users >= 3) & (fails_ip >= 3),
            top(0.96, 0.62 + users * 0.05 + bonus(no_js, 0.12)),
            ["distinct_users_tried_60s", "auth_fail_ip_60s", "browser_telemetry_present", "asn_is_hosting"]),
        "brute_force": (
            "brute_force", (fails_user >= 4) & (users <= 2), top(0.97, 0.60 + fails_user * 0.05 + bonus(no_js, 0.10)),
            ["auth_fail_user_60s", "auth_fail_ip_60s", "browser_telemetry_present", "interarrival_std_ms"]),
        "dir_scan": ("dir_scan", (p404 >= 0.5) & (paths >= 6), top(0.97, 0.65 + p404 * 0.25),
                     ["p404_ratio_60s", "unique_paths_60s", "path_entropy", "sensitive_path_hit"]),
        "slow_recon": (
            "slow_recon", sensitive & (r60 <= 12) & no_js,
            top(0.95, F.lit(0.70) + bonus(c("asn_is_hosting") == 1, 0.12) + bonus(tool, 0.06)
                + bonus(F.coalesce(c("http_status") == 200, F.lit(False)), 0.08)),
            ["sensitive_path_hit", "browser_telemetry_present", "req_rate_60s", "asn_is_hosting"]),
        "scraper": ("scraper", no_js & (r60 >= 15) & (paths >= 8) & (p404 < 0.3), top(0.88, 0.5 + r60 / 120.0),
                    ["req_rate_60s", "unique_paths_60s", "browser_telemetry_present", "interarrival_std_ms"]),
        "register_abuse": (
            "credential_stuffing", on_register & no_js & (r60 >= 5), top(0.90, 0.60 + r60 / 60.0),
            ["req_rate_60s", "browser_telemetry_present", "asn_is_hosting", "interarrival_std_ms"]),
    }


RULES = ["flood", "credential_stuffing", "brute_force", "dir_scan", "slow_recon", "scraper", "register_abuse"]


def rule_hit(name: str) -> Column:
    """Struct (class, confidence) where the rule fires, NULL elsewhere."""
    cls, fires, conf, _ = _rule_parts()[name]
    return F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(cls).alias("rule_class"), conf.alias("confidence")))


def classify_rules(df: DataFrame) -> DataFrame:
    """Add ``pred_class``, ``pred_confidence`` and the winning ``rule``.

    The most confident rule wins, the earlier one on ties; no rule means normal.
    """
    parts = _rule_parts()
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(parts[r][1], F.lit(False)),
               F.struct(parts[r][2].cast("double").alias("conf"), F.lit(-i).alias("neg"),
                        F.lit(parts[r][0]).alias("cls"), F.lit(r).alias("rule")))
        for i, r in enumerate(RULES)]))
    out = df.withColumn("_hit", F.array_max(hits))
    return out.withColumns({
        "pred_class": F.coalesce("_hit.cls", F.lit("normal")),
        "pred_confidence": F.when(F.col("_hit").isNull(), 0.95).otherwise(
            X.half_up(F.least(F.lit(0.99), F.col("_hit.conf")), 2)),
        "rule": F.col("_hit.rule")}).drop("_hit")


def classify_with_model(df: DataFrame) -> DataFrame:
    """Combine rules with model columns ``model_class`` and ``model_confidence``.

    A fired rule always decides the class; agreement takes the larger
    confidence.  The model decides only where no rule fired.
    """
    ruled = F.col("rule").isNotNull()
    agree = F.col("model_class") == F.col("pred_class")
    conf = (F.when(ruled & agree, F.greatest("pred_confidence", X.half_up(F.least(F.lit(0.99), F.col("model_confidence")), 2)))
            .when(ruled, F.col("pred_confidence"))
            # (least and greatest skip NULLs, hence the explicit branches)
            .otherwise(F.coalesce(X.half_up(F.col("model_confidence"), 2), F.col("pred_confidence"))))
    cls = F.when(ruled, F.col("pred_class")).otherwise(F.coalesce("model_class", "pred_class"))
    return df.withColumns({"final_class": cls, "final_confidence": conf})


def decide_with_model(df: DataFrame) -> DataFrame:
    """``pred_class`` and ``pred_confidence`` from rules and model columns together; what follows uses these."""
    out = classify_with_model(df).drop("pred_class", "pred_confidence")
    return out.withColumnRenamed("final_class", "pred_class").withColumnRenamed("final_confidence", "pred_confidence")


def technique_on_event() -> Column:
    """Technique seen at request time: the path and the login outcome say more than the class."""
    path = X.strip_query(F.col("url_path"))
    by_class = F.lit(None).cast("string")
    for cls, tech in C.CLASS_TECHNIQUE.items():
        by_class = F.when(F.col("pred_class") == cls, tech).otherwise(by_class)
    return (F.when(F.col("pred_class") == "normal", F.lit(None))
            .when(F.col("auth_success_after_fails") == 1, "T1078")
            .when(path.startswith("/register"), "T1136")
            .when((F.col("sensitive_path_hit") == 1) & (F.col("http_status") == 200), "T1190")
            .otherwise(by_class))


def technique_overrides() -> Column:
    """Technique recomputed from stored features: first matching override, else the class map."""
    out = None
    for feature, op, value, status, tech in C.TECHNIQUE_OVERRIDES:
        cond = (F.col(feature) == value) if op == "=" else (F.col(feature) > value)
        if status is not None:
            cond = cond & (F.col("http_status") == status)
        out = F.when(cond, tech) if out is None else out.when(cond, tech)
    for cls, tech in C.CLASS_TECHNIQUE.items():
        out = out.when(F.col("pred_class") == cls, tech)
    return out


def technique_resolve(df: DataFrame) -> DataFrame:
    """The technique stored on the event beats the recomputed one; names come from the fixed table."""
    out = df.withColumn("technique_id", F.coalesce(F.col("attack_technique"), technique_overrides()))
    name, tactic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for tech, (n, t) in C.TECHNIQUES.items():
        name = F.when(F.col("technique_id") == tech, n).otherwise(name)
        tactic = F.when(F.col("technique_id") == tech, t).otherwise(tactic)
    return out.withColumns({"technique": name, "tactic": tactic})


def tactic_rank(tactic: Column) -> Column:
    out = F.lit(99)
    for i, t in enumerate(C.TACTIC_ORDER):
        out = F.when(tactic == t, i).otherwise(out)
    return out


def _plain(x: float) -> str:
    return f"{x:g}"


def _deviation(feature: str) -> Column:
    low, high = C.BASELINES.get(feature, (0.0, 1.0))
    v = F.col(feature).cast("double")
    times = lambda q: F.bround(q, 0).cast("bigint").cast("string")
    out = F.when(v.isNull(), "absent")
    if high > 0:
        out = out.when(v > high, F.concat(times(v / F.lit(float(high))), F.lit("x above baseline")))
    else:
        out = out.when(v > high, "present")
    out = out.when((v < low) & (v > 0), F.concat(times(F.lit(float(low)) / v), F.lit("x below baseline")))
    return out.when(v < low, "absent").otherwise("within baseline")


MODEL_EVIDENCE = ["browser_telemetry_present", "auth_fail_ip_60s", "req_rate_60s", "asn_is_hosting"]


def evidence(by_model: bool = False) -> Column:
    """Array of (feature, value, baseline, deviation, note) for the winning rule, or for the model where it decided (``by_model``)."""
    def item(feature: str) -> Column:
        low, high = C.BASELINES.get(feature, (0.0, 1.0))
        span = _plain(low) if low == high else f"{_plain(low)}-{_plain(high)}"
        return F.struct(
            F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value"),
            F.lit(span).alias("baseline"), _deviation(feature).alias("deviation"),
            F.lit(C.NOTES.get(feature, "")).alias("note"))

    parts = _rule_parts()
    out = None
    for r in RULES:
        value = F.array(*[item(f) for f in parts[r][3]])
        out = F.when(F.col("rule") == r, value) if out is None else out.when(F.col("rule") == r, value)
    if by_model:
        out = out.when(F.col("model_class").isNotNull(), F.array(*map(item, MODEL_EVIDENCE)))
    return out.otherwise(F.array(item("browser_telemetry_present"), item("req_rate_60s")))
