"""Row-level column expressions.  All built-in, all inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .. import constants as C


def half_up(x: Column, places: int) -> Column:
    """Round with a tiny nudge, so decimal ties go up whatever the last binary digit says."""
    return F.round(x + F.lit(1e-9), places)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_us(us: Column) -> Column:
    return iso(F.timestamp_micros(us))


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def starts_any(path: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def subnet24(ip: Column) -> Column:
    """/24 network of a dotted IPv4 address; NULL when an octet is out of range."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    valid = ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    return F.when(valid, F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def sensitive_path(path: Column) -> Column:
    """Exact sensitive path (trailing slashes ignored on both sides) or a sensitive prefix."""
    exact = [p.rstrip("/") for p in C.SENSITIVE_PATHS]
    base = F.regexp_replace(strip_query(path), "/+$", "")
    return (base.isin(exact) | starts_any(path, C.SENSITIVE_PREFIXES)).cast("int")


def known_tool(ua: Column) -> Column:
    low = F.lower(ua)
    hit = F.lit(False)
    for token in C.TOOL_AGENTS:
        hit = hit | low.contains(token)
    return F.coalesce(hit, F.lit(False)).cast("int")


def text_entropy(s: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a string; 0 for empty or NULL."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    weight = lambda k: k * F.log2(k)

    def step(acc: Column, c: Column) -> Column:
        run = F.when(acc["c"] == c, acc["run"] + 1.0).otherwise(F.lit(1.0))
        gain = F.when(run > 1.0, weight(run) - weight(run - 1.0)).otherwise(F.lit(0.0))
        return F.struct(c.alias("c"), run.alias("run"), (acc["w"] + gain).alias("w"))

    # equal characters are neighbours after sorting: add up count*log2(count) along the runs
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("w"))
    total = F.aggregate(chars, start, step, lambda acc: acc["w"])
    n = F.length(s).cast("double")
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.log2(n) - total / n)


def asset_for_path(path: Column) -> Column:
    """Longest matching route; the table is a constant, so a CASE needs no join."""
    base = strip_query(F.coalesce(path, F.lit("/")))
    out = None
    for prefix, asset in sorted(C.ASSET_ROUTES, key=lambda r: -len(r[0])):
        cond = base.startswith(prefix)
        out = F.when(cond, asset) if out is None else out.when(cond, asset)
    return out.otherwise(C.DEFAULT_ASSET)


def path_cve_ordinal(path: Column, rows=C.PATH_CVES) -> Column:
    """Position of the vulnerability entry: exact path first, else the first prefix in table order."""
    base = strip_query(path)
    out = None
    for exact in (True, False):
        for i, row in enumerate(rows):
            cond = (base == row[0]) if exact else base.startswith(row[0])
            out = F.when(cond, i) if out is None else out.when(cond, i)
    return out.cast("int")


def sensitive_prefix(path: Column) -> Column:
    return starts_any(strip_query(path), C.SENSITIVE_NO_CVE)


def user_hash(account: Column) -> Column:
    return F.concat(F.lit("u_"), F.substring(F.sha2(F.lower(account), 256), 1, 6))


# --- risk -------------------------------------------------------------------

def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def risk_term_columns(confidence, criticality, exploitability, assets, users, depth, last_us, as_of_us) -> dict:
    """The six raw terms, each in 0..1, keyed by term name."""
    step = F.lit(1.0)
    for k, v in C.CHAIN_STEPS.items():
        step = F.when(depth == k, F.lit(v)).otherwise(step)
    age_h = F.greatest(F.lit(0.0), (as_of_us - last_us).cast("double") / F.lit(float(C.HOUR_US)))
    return {
        "model_confidence": clamp(confidence),
        "asset_criticality": clamp(criticality),
        "exploitability": clamp(exploitability),
        "blast_radius": clamp(F.log1p((assets + users).cast("double")) / F.lit(math.log1p(C.BLAST_SATURATION))),
        "kill_chain_depth": step,
        "recency": clamp(F.exp(-age_h / F.lit(C.RECENCY_TAU_H))),
    }


def weighted_risk(terms: dict, weights: dict | None = None) -> Column:
    """100 * sum(raw * weight), one decimal place."""
    weights = weights or C.DEFAULT_WEIGHTS
    total = F.lit(0.0)
    for t in C.RISK_TERMS:
        w = weights[t]
        total = total + F.lit(100.0) * terms[t] * (w if isinstance(w, Column) else F.lit(float(w)))
    return half_up(total, 1)


def risk_breakdown(terms: dict, weights: dict | None = None) -> Column:
    weights = weights or C.DEFAULT_WEIGHTS
    return F.array(*[
        F.struct(
            F.lit(t).alias("term"), half_up(terms[t], 3).alias("raw"),
            F.lit(float(weights[t])).alias("weight"),
            half_up(F.lit(100.0 * weights[t]) * terms[t], 1).alias("points"))
        for t in C.RISK_TERMS])


def priority_band(risk: Column) -> Column:
    out = None
    for floor, band in C.BAND_FLOORS:
        out = F.when(risk >= floor, band) if out is None else out.when(risk >= floor, band)
    return out.otherwise("P4")


def md5_number(x: Column) -> Column:
    """A hash that other engines have too: the first eight hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
