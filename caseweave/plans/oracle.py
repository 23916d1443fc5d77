"""ANSI SQL that states what each registered query must return, over the given tables.

Common table expressions are shared by name; ``sql(final, ...)`` pulls in what
the final query mentions.  Written independently of the Spark operators: plain
window frames, self-joins and recursion, with no regard for scale.
"""

from __future__ import annotations

import re

from .. import constants as C
from ..playbooks import playbook_rows
from ..sources.events import EPOCH_MS, TENANT

CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + v.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def sql(final: str) -> str:
    """Prefix ``final`` with every CTE it needs, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
                visit(CTE[name])

    visit(final)
    chosen = [n for n in CTE if n in need]          # definition order respects dependencies
    if not chosen:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in chosen) + "\n" + final


def h(x: str, d: int) -> str:
    return f"round(({x}) + 1e-9, {d})"


def inlist(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def iso(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ')"


def starts(col: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {lit(p)})" for p in prefixes) + ")"


# --- log and telemetry ----------------------------------------------------------------
CTE["src"] = """SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k,
  event_id // 100 AS blk, event_id % 100 AS pos, (event_id // 100) % 10 AS kind FROM events"""
CTE["we"] = f"""SELECT '{TENANT}' AS tenant_id, event_id, ({EPOCH_MS} + blk * 1200000 + pos * CASE WHEN kind < 4 THEN 7000
    WHEN kind = 4 THEN 90000 WHEN kind IN (5, 8) THEN 3000 WHEN kind IN (6, 7) THEN 2000 ELSE 200 END) * 1000 AS ts_us,
  CASE WHEN kind < 4 THEN 's_' || user_id END AS session_id,
  CASE WHEN kind < 4 THEN '49.' || (user_id % 200) || '.' || k || '.' || (2 + user_id % 250)
    WHEN kind = 4 THEN '185.220.101.' || (10 + blk % 7) WHEN kind = 5 THEN '185.220.101.' || (60 + blk % 7)
    WHEN kind = 6 THEN '45.155.205.' || (10 + blk % 7) WHEN kind = 7 THEN '45.155.205.' || (60 + blk % 7)
    WHEN kind = 8 THEN '138.201.44.' || (10 + blk % 7) ELSE '185.220.101.' || (200 + blk % 7) END AS src_ip,
  CASE WHEN kind < 4 THEN 55836 WHEN kind IN (4, 5, 9) THEN 14061 WHEN kind IN (6, 7) THEN 9009 ELSE 24940 END AS asn,
  CASE WHEN kind < 4 THEN 'IN' WHEN kind IN (4, 5, 9) THEN 'NL' WHEN kind IN (6, 7) THEN 'RO' ELSE 'DE' END AS country,
  CASE WHEN kind = 5 THEN 'u_' || (pos % 40) WHEN kind = 6 THEN 'u_9' || ((blk // 10) % 5)
    WHEN kind < 4 AND event_type = 'purchase' THEN 'u_' || user_id END AS user_id,
  CASE WHEN kind < 4 THEN CASE event_type WHEN 'view' THEN '/products' WHEN 'click' THEN '/search' WHEN 'purchase' THEN '/checkout'
      WHEN 'signup' THEN '/account' ELSE '/cart' END
    WHEN kind = 4 THEN CASE pos % 5 WHEN 0 THEN '/.env' WHEN 1 THEN '/.git/config' WHEN 2 THEN '/wp-admin/' WHEN 3 THEN '/admin.php'
      ELSE '/actuator/env' END
    WHEN kind IN (5, 6) THEN '/login' WHEN kind = 7 THEN '/backup.sql' || pos WHEN kind = 8 THEN '/products/' || pos || '?ref=' || k
    ELSE '/checkout' END AS url_path,
  CASE WHEN kind < 4 THEN CASE WHEN event_type = 'error' THEN 404 ELSE 200 END
    WHEN kind = 4 THEN CASE WHEN pos % 5 = 4 THEN 200 ELSE 404 END WHEN kind = 5 THEN CASE WHEN pos = 99 THEN 200 ELSE 401 END
    WHEN kind = 6 THEN 401 WHEN kind = 7 THEN 404 WHEN kind = 8 THEN 200 ELSE 503 END AS http_status,
  CAST(floor(value) AS BIGINT) AS payload_bytes,
  CAST(CASE WHEN kind < 4 THEN 1000 + k * 13 WHEN kind = 4 THEN 180 WHEN kind IN (5, 6) THEN 300 + k WHEN kind = 7 THEN 120
    WHEN kind = 8 THEN 250000 + k * 1000 ELSE 0 END AS BIGINT) AS resp_bytes,
  CASE WHEN kind < 4 THEN 'Mozilla/5.0 (X11) rv:' || k WHEN kind = 4 THEN CASE WHEN pos % 5 <> 0 THEN 'curl/8.' || (pos % 3) END
    WHEN kind = 5 THEN 'Go-http-client/1.1' WHEN kind = 6 THEN 'Mozilla/5.0' WHEN kind = 7 THEN 'Mozilla/5.0 Nikto/2.1'
    WHEN kind = 8 THEN 'python-requests/2.' || (k % 5) ELSE '' END AS user_agent,
  CASE WHEN kind < 4 THEN 'en-IN' END AS accept_lang,
  CASE WHEN kind < 4 THEN 9 + k % 6 WHEN kind = 4 THEN 4 + pos % 3 WHEN kind = 5 THEN 4 WHEN kind IN (6, 8) THEN 5 WHEN kind = 7 THEN 6
    ELSE 2 END AS header_count, kind, k, pos FROM src"""
_TEL = {
    "mouse_move_count": "k * 3", "mouse_path_entropy": "(k % 40) / 10.0", "keystroke_count": "k % 30",
    "keystroke_interval_mean": "80 + k / 2.0", "keystroke_interval_std": "20 + k / 4.0",
    "form_fill_ms": "CASE WHEN k % 3 = 0 THEN 5000 + k * 100 END", "paste_events": "k % 2", "click_count": "k % 7",
    "time_to_first_click_ms": "CASE WHEN k % 4 <> 0 THEN 300 + payload_bytes END", "scroll_events": "k % 11",
    "page_dwell_ms": "4000 + k * 50", "focus_blur_count": "k % 3", "screen_w": "1920", "screen_h": "1080",
    "tz_offset": "-330", "hardware_concurrency": "2 + k % 8"}
CTE["tel"] = ("SELECT session_id, ts_us - 1000000 AS t_us, event_id AS telemetry_id, url_path AS page, "
              + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _TEL.items()) + " FROM we WHERE kind < 4 AND pos % 2 = 0")

# --- feeds and dimensions -----------------------------------------------------------------
CTE["kev"] = """SELECT CASE WHEN p_partkey = 1 THEN 'CVE-2022-22965' WHEN p_partkey = 2 THEN 'CVE-2017-5638'
  ELSE 'CVE-2020-' || (10000 + p_partkey) END AS cve, '2022-04-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS kev_added FROM part"""
CTE["epss_feed"] = """SELECT CASE WHEN p_partkey = 1 THEN 'CVE-2022-22965' WHEN p_partkey = 3 THEN 'CVE-2024-25600'
  ELSE 'CVE-2020-' || (10000 + p_partkey) END AS cve, p_size / 100.0 AS epss FROM part"""
CTE["feodo"] = """SELECT DISTINCT '45.155.205.' || (10 + s_suppkey % 4) AS ip FROM supplier WHERE s_suppkey % 5 > 1"""
CTE["tor"] = """SELECT DISTINCT '185.220.101.' || (10 + c_custkey % 3) AS ip FROM customer WHERE c_custkey % 7 <> 0"""
CTE["rep"] = """SELECT ip, 'Feodo Tracker' AS reputation_source, 0 AS is_tor FROM feodo
  UNION ALL SELECT ip, 'Tor exit list', 1 FROM tor WHERE ip NOT IN (SELECT ip FROM feodo)"""
CTE["asset_dim"] = values(C.ASSETS, "asset_id, name, kind, criticality, software, cpe_product, version")
CTE["path_dim"] = values([(i, *r) for i, r in enumerate(C.PATH_CVES)], "ordinal, path, cve, cve_name, product, entry_asset, hit_status")
CTE["tech_dim"] = values(
    [(t, n, tac, C.TACTIC_ORDER.index(tac) if tac in C.TACTIC_ORDER else 99) for t, (n, tac) in C.TECHNIQUES.items()],
    "technique_id, technique, tactic, tactic_order")
CTE["book_dim"] = values(playbook_rows(), "technique_id, section, section_ord, ordinal, action_id, action, owner, eta_min, rollback, query")
CTE["cve_dim"] = """SELECT ordinal, p.cve, cve_name, hit_status, k.cve IS NOT NULL AS in_kev, k.kev_added, e.epss,
  coalesce(a.cpe_product = p.product, FALSE) AS product_match, CASE WHEN a.cpe_product = p.product THEN entry_asset END AS matched_asset,
  CASE WHEN a.cpe_product = p.product THEN a.software END AS matched_software
  FROM path_dim p LEFT JOIN asset_dim a ON a.asset_id = p.entry_asset LEFT JOIN kev k ON k.cve = p.cve LEFT JOIN epss_feed e ON e.cve = p.cve"""

# --- request features ------------------------------------------------------------------------
CTE["au"] = """SELECT *, split_part(url_path, '?', 1) AS path,
  CASE WHEN split_part(url_path, '?', 1) = '/login' AND http_status IN (200, 401) THEN CAST(http_status = 401 AS INTEGER) END AS auth,
  CASE WHEN split_part(url_path, '?', 1) = '/login' AND http_status IN (200, 401) AND user_id <> '' THEN user_id END AS account FROM we"""
_W = "PARTITION BY tenant_id, src_ip ORDER BY ts_us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
CTE["wn"] = f"""SELECT *, count(*) OVER w10 AS req_rate_10s, count(*) OVER w60 AS req_rate_60s, count(*) OVER w300 AS req_rate_300s,
  CAST(coalesce(sum(auth) OVER w60, 0) AS BIGINT) AS auth_fail_ip_60s,
  count(DISTINCT CASE WHEN auth = 1 THEN account END) OVER w60 AS distinct_users_tried_60s,
  count(DISTINCT path) OVER w60 AS unique_paths_60s, list_entropy(list(path) OVER w60) AS ent,
  avg(CAST(http_status = 404 AS INTEGER)) OVER w60 AS p404, list(ts_us) OVER w60 AS tl,
  CAST(sum(resp_bytes) OVER w60 AS BIGINT) AS resp_bytes_60s,
  stddev_pop(payload_bytes) OVER (PARTITION BY tenant_id, src_ip ORDER BY ts_us, event_id ROWS 99 PRECEDING) AS pstd,
  count(*) OVER wall AS requests_this_session, ts_us - min(ts_us) OVER wall AS age,
  last_value(account IGNORE NULLS) OVER (PARTITION BY tenant_id, src_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS last_account,
  last_value(auth IGNORE NULLS) OVER (PARTITION BY tenant_id, src_ip ORDER BY ts_us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM au WINDOW w10 AS ({_W.format(10_000_000)}), w60 AS ({_W.format(60_000_000)}), w300 AS ({_W.format(300_000_000)}),
  wall AS (PARTITION BY tenant_id, src_ip ORDER BY ts_us RANGE UNBOUNDED PRECEDING)"""
CTE["fu"] = """SELECT w.event_id, count(f.event_id) AS auth_fail_user_60s FROM wn w LEFT JOIN au f
  ON f.tenant_id = w.tenant_id AND f.account = w.last_account AND f.auth = 1 AND f.ts_us BETWEEN w.ts_us - 60000000 AND w.ts_us GROUP BY w.event_id"""
_sens = inlist([p.rstrip("/") for p in C.SENSITIVE_PATHS])
_gaps = "list_transform(range(2, len(tl) + 1), lambda i: (tl[i] - tl[i - 1]) / 1000.0)"
CTE["feat"] = f"""SELECT w.* EXCLUDE (tl, ent, p404, pstd, age, before), auth_fail_user_60s,
  CAST(CASE WHEN auth = 0 AND before = 1 THEN 1 ELSE 0 END AS INTEGER) AS auth_success_after_fails,
  {h('p404', 4)} AS p404_ratio_60s, {h('ent', 4)} AS path_entropy,
  {h('CASE WHEN len(tl) > 1 THEN (tl[-1] - tl[1]) / 1000.0 / (len(tl) - 1) ELSE 0 END', 2)} AS interarrival_mean_ms,
  {h(f'CASE WHEN len(tl) > 1 THEN list_stddev_pop({_gaps}) ELSE 0 END', 2)} AS interarrival_std_ms,
  {h('pstd', 2)} AS payload_bytes_std, {h('age / 1e6', 2)} AS session_age_s,
  CAST(regexp_replace(path, '/+$', '') IN {_sens} OR {starts('url_path', C.SENSITIVE_PREFIXES)} AS INTEGER) AS sensitive_path_hit,
  CAST(coalesce(user_agent, '') = '' AS INTEGER) AS ua_missing,
  CAST(coalesce({' OR '.join(f"contains(lower(user_agent), {lit(t)})" for t in C.TOOL_AGENTS)}, FALSE) AS INTEGER) AS ua_known_tool,
  {h("CASE WHEN coalesce(user_agent, '') = '' THEN 0.0 ELSE list_entropy(string_split(user_agent, '')) END", 4)} AS ua_entropy,
  CAST(accept_lang IS NULL AS INTEGER) AS accept_lang_missing, 1 AS header_order_hash_known,
  CAST(asn IN {inlist(C.HOSTING_ASNS)} AS INTEGER) AS asn_is_hosting,
  CASE WHEN country IN {inlist(C.HIGH_RISK_COUNTRIES)} THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS country_risk,
  CAST(reputation_source IS NOT NULL AS INTEGER) AS ip_reputation_hit, coalesce(is_tor, 0) AS is_tor_exit, reputation_source,
  CAST(hour(make_timestamp(ts_us)) AS INTEGER) AS hour_of_day,
  CAST(hour(make_timestamp(ts_us)) < 6 OR hour(make_timestamp(ts_us)) >= 22 AS INTEGER) AS is_off_hours,
  'u_' || substr(sha256(lower(last_account)), 1, 6) AS last_user
  FROM wn w JOIN fu USING (event_id) LEFT JOIN rep ON rep.ip = w.src_ip"""
_fresh = "w.ts_us - t.t_us <= 900000000"
CTE["fz"] = (f"SELECT w.event_id, CAST(coalesce({_fresh}, FALSE) AS INTEGER) AS browser_telemetry_present, "
             + ", ".join(f"CASE WHEN {_fresh} THEN t.{c} END AS {c}" for c in C.BROWSER_FEATURES)
             + " FROM we w ASOF LEFT JOIN tel t ON w.session_id = t.session_id AND w.ts_us >= t.t_us")
CTE["ft"] = "SELECT * FROM feat JOIN fz USING (event_id)"

# --- rules ----------------------------------------------------------------------------------------
_nojs = "browser_telemetry_present = 0"
_RULES = [
    ("flood", "flood", "req_rate_10s >= 40 OR req_rate_60s >= 250", "least(0.99, 0.75 + req_rate_10s / 400.0)",
     ["req_rate_10s", "req_rate_60s", "payload_bytes", "browser_telemetry_present"]),
    ("credential_stuffing", "credential_stuffing", "distinct_users_tried_60s >= 3 AND auth_fail_ip_60s >= 3",
     f"least(0.96, 0.62 + distinct_users_tried_60s * 0.05 + CASE WHEN {_nojs} THEN 0.12 ELSE 0 END)",
     ["distinct_users_tried_60s", "auth_fail_ip_60s", "browser_telemetry_present", "asn_is_hosting"]),
    ("brute_force", "brute_force", "auth_fail_user_60s >= 4 AND distinct_users_tried_60s <= 2",
     f"least(0.97, 0.60 + auth_fail_user_60s * 0.05 + CASE WHEN {_nojs} THEN 0.10 ELSE 0 END)",
     ["auth_fail_user_60s", "auth_fail_ip_60s", "browser_telemetry_present", "interarrival_std_ms"]),
    ("dir_scan", "dir_scan", "p404_ratio_60s >= 0.5 AND unique_paths_60s >= 6", "least(0.97, 0.65 + p404_ratio_60s * 0.25)",
     ["p404_ratio_60s", "unique_paths_60s", "path_entropy", "sensitive_path_hit"]),
    ("slow_recon", "slow_recon", f"sensitive_path_hit = 1 AND req_rate_60s <= 12 AND {_nojs}",
     "least(0.95, 0.70 + CASE WHEN asn_is_hosting = 1 THEN 0.12 ELSE 0 END + CASE WHEN ua_known_tool = 1 OR ua_missing = 1 THEN 0.06 "
     "ELSE 0 END + CASE WHEN http_status = 200 THEN 0.08 ELSE 0 END)",
     ["sensitive_path_hit", "browser_telemetry_present", "req_rate_60s", "asn_is_hosting"]),
    ("scraper", "scraper", f"{_nojs} AND req_rate_60s >= 15 AND unique_paths_60s >= 8 AND p404_ratio_60s < 0.3",
     "least(0.88, 0.5 + req_rate_60s / 120.0)",
     ["req_rate_60s", "unique_paths_60s", "browser_telemetry_present", "interarrival_std_ms"]),
    ("register_abuse", "credential_stuffing", f"starts_with(path, '/register') AND {_nojs} AND req_rate_60s >= 5",
     "least(0.90, 0.60 + req_rate_60s / 60.0)",
     ["req_rate_60s", "browser_telemetry_present", "asn_is_hosting", "interarrival_std_ms"])]
CTE["hits"] = " UNION ALL ".join(
    f"SELECT event_id, {i} AS ord, {lit(r)} AS rule, {lit(c)} AS cls, CAST({conf} AS DOUBLE) AS conf FROM ft WHERE {fires}"
    for i, (r, c, fires, conf, _) in enumerate(_RULES))
CTE["best"] = "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY conf DESC, ord) = 1"
_by_class = "CASE pred_class " + " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in C.CLASS_TECHNIQUE.items()) + " END"
_route = "CASE " + " ".join(f"WHEN starts_with(path, {lit(p)}) THEN {lit(a)}" for p, a in sorted(C.ASSET_ROUTES, key=lambda r: -len(r[0]))) + f" ELSE {lit(C.DEFAULT_ASSET)} END"
CTE["cl"] = f"""SELECT ft.*, rule, coalesce(cls, 'normal') AS pred_class,
  CASE WHEN cls IS NULL THEN 0.95 ELSE {h('least(0.99, conf)', 2)} END AS pred_confidence,
  {_route} AS asset_id, (SELECT min(CASE WHEN p.path = ft.path THEN ordinal - 1000 ELSE ordinal END) FROM path_dim p WHERE starts_with(ft.path, p.path)) AS o1
  FROM ft LEFT JOIN best USING (event_id)"""
_epss = "nullif(c.epss, 0)"
_expl = f"""CASE WHEN c.cve IS NOT NULL AND product_match AND http_status = hit_status THEN CASE WHEN in_kev THEN 1.0 ELSE greatest(coalesce({_epss}, 0.5), 0.5) END
  WHEN c.cve IS NOT NULL AND product_match THEN CASE WHEN in_kev THEN 0.45 ELSE coalesce({_epss}, 0.2) * 0.5 END
  WHEN c.cve IS NOT NULL THEN 0.15 WHEN {starts('cl.path', C.SENSITIVE_NO_CVE)} THEN 0.10 ELSE 0.0 END"""
CTE["en"] = f"""SELECT cl.*, CASE WHEN pred_class = 'normal' THEN NULL WHEN auth_success_after_fails = 1 THEN 'T1078'
    WHEN starts_with(cl.path, '/register') THEN 'T1136' WHEN sensitive_path_hit = 1 AND http_status = 200 THEN 'T1190' ELSE {_by_class} END AS attack_technique,
  a.name AS asset_name, coalesce(CAST(a.criticality AS DOUBLE), 0.1::DOUBLE) AS asset_criticality, c.cve, c.cve_name, coalesce(c.in_kev, FALSE) AS in_kev, c.kev_added,
  CAST(c.epss AS DOUBLE) AS epss, coalesce(c.product_match, FALSE) AS product_match, c.matched_asset, c.matched_software,
  coalesce(http_status = hit_status, FALSE) AS probe_succeeded, {starts('cl.path', C.SENSITIVE_NO_CVE)} OR c.ordinal IS NOT NULL AS sensitive_path,
  CAST(least(1.0, {_expl} + CASE WHEN reputation_source IS NOT NULL THEN 0.30 ELSE 0 END) AS DOUBLE) AS exploitability
  FROM cl LEFT JOIN cve_dim c ON c.ordinal = CASE WHEN o1 < 0 THEN o1 + 1000 ELSE o1 END LEFT JOIN asset_dim a USING (asset_id)"""
CTE["as_of"] = "SELECT max(ts_us) AS now FROM we"


def clamp(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def recency(last: str) -> str:
    return clamp(f"exp(-greatest(0.0, (now - {last}) / 3600000000.0) / 24.0)")


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'P1' WHEN {x} >= 60 THEN 'P2' WHEN {x} >= 35 THEN 'P3' ELSE 'P4' END"


_sat = "ln(21.0)"
_erisk = h(f"100*{clamp('pred_confidence')}*0.2 + 100*{clamp('asset_criticality')}*0.2 + 100*{clamp('exploitability')}*0.2 "
           f"+ 100*(ln(2.0)/{_sat})*0.15 + 100*0.05*0.15 + 100*{recency('ts_us')}*0.1", 1)
_over = ("CASE WHEN auth_success_after_fails = 1 THEN 'T1078' WHEN sensitive_path_hit = 1 AND http_status = 200 THEN 'T1190' "
         f"WHEN resp_bytes_60s > 5000000 THEN 'T1041' ELSE {_by_class} END")
CTE["ev0"] = f"SELECT en.*, {_erisk} AS event_risk, {_over} AS over_technique FROM en, as_of"
CTE["ev"] = f"""SELECT e.*, {band('event_risk')} AS individual_priority, t.technique_id, t.technique, t.tactic, t.tactic_order
  FROM ev0 e LEFT JOIN tech_dim t ON t.technique_id = coalesce(attack_technique, over_technique)"""
CTE["sd"] = "SELECT ev.* FROM ev, as_of WHERE pred_class <> 'normal' AND ts_us >= now - 30 * 86400000000"

# --- graph ---------------------------------------------------------------------------------------------
CTE["ents"] = """SELECT event_id, ts_us, 'ip' AS kind, src_ip AS value FROM sd
  UNION ALL SELECT event_id, ts_us, 'subnet', regexp_replace(src_ip, '[0-9]+$', '0/24') FROM sd
  UNION ALL SELECT event_id, ts_us, 'asn', CAST(asn AS VARCHAR) FROM sd WHERE asn <> 0
  UNION ALL SELECT event_id, ts_us, 'user', user_id FROM sd WHERE user_id <> ''
  UNION ALL SELECT event_id, ts_us, 'asset', asset_id FROM sd WHERE asset_id <> ''
  UNION ALL SELECT event_id, ts_us, 'session', session_id FROM sd WHERE session_id <> ''
  UNION ALL SELECT event_id, ts_us, 'cve', cve FROM sd WHERE cve <> ''"""
CTE["link_dim"] = values([(k, float(b), float(t), float(w)) for k, (b, t, w) in C.LINKS.items()], "kind, base, tau, win")
CTE["fan"] = """SELECT e.*, base, tau, win, count(*) OVER (PARTITION BY kind, value) AS fanout,
  lag(event_id) OVER (PARTITION BY kind, value ORDER BY ts_us, event_id) AS p_id, lag(ts_us) OVER (PARTITION BY kind, value ORDER BY ts_us, event_id) AS p_us
  FROM ents e JOIN link_dim USING (kind)"""
CTE["near"] = "SELECT DISTINCT least(event_id, p_id) AS a, greatest(event_id, p_id) AS b FROM fan WHERE p_id IS NOT NULL"
CTE["pl"] = """SELECT * FROM (SELECT l.kind, a, b,
  CAST(l.base AS DOUBLE) * exp(-(abs(r.ts_us - l.ts_us) / 3600000000.0) / CAST(l.tau AS DOUBLE)) AS w
  FROM near JOIN fan l ON l.event_id = a JOIN fan r ON r.event_id = b AND l.kind = r.kind AND l.value = r.value
  WHERE abs(r.ts_us - l.ts_us) / 3600000000.0 <= l.win) WHERE w >= 0.02"""
CTE["cn"] = """SELECT * FROM (SELECT kind, least(event_id, p_id) AS a, greatest(event_id, p_id) AS b,
  CAST(base AS DOUBLE) * exp(-((ts_us - p_us) / 3600000000.0) / CAST(tau AS DOUBLE)) AS w FROM fan
  WHERE p_id IS NOT NULL AND (ts_us - p_us) / 3600000000.0 <= win) WHERE w >= 0.02"""
CTE["ed"] = "SELECT a, b, round(sum(w), 9) AS w FROM pl GROUP BY a, b HAVING round(sum(w), 9) >= 0.9"
CTE["sym"] = "SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed"
# every component's smallest event is a local minimum, and reaches the whole component
CTE["reach"] = """SELECT event_id AS id, event_id AS root FROM sd WHERE event_id NOT IN (SELECT b FROM ed)
  UNION SELECT s.b, reach.root FROM reach JOIN sym s ON s.a = reach.id"""
CTE["comp"] = "SELECT id AS event_id, min(root) AS component FROM reach GROUP BY id"
CTE["mb"] = "SELECT sd.*, component FROM sd JOIN comp USING (event_id)"
CTE["kept"] = """SELECT component, count(*) AS size FROM mb GROUP BY component HAVING count(*) >= 2 OR min(individual_priority) IN ('P1', 'P2')"""

# --- incidents --------------------------------------------------------------------------------------------
_ord = "ORDER BY ts_us, event_id"
CTE["facts"] = f"""SELECT component, count(*) AS event_count, min(ts_us) AS opened_us, max(ts_us) AS last_us, max(exploitability) AS max_expl,
  max(asset_criticality) AS max_crit, max(pred_confidence) AS max_conf, avg(pred_confidence) AS mean_conf,
  min(individual_priority) AS max_individual_priority, first(src_ip {_ord}) AS first_ip, bool_and(browser_telemetry_present = 0) AS no_browser,
  count(DISTINCT src_ip) AS n_ips, count(DISTINCT user_id) AS n_users, count(DISTINCT asset_id) AS n_assets, count(DISTINCT tactic) AS depth,
  first(CASE WHEN in_kev THEN event_id END {_ord}) FILTER (in_kev) AS kev_event,
  coalesce(first(event_id {_ord}) FILTER (cve IS NOT NULL AND probe_succeeded), last(event_id {_ord}) FILTER (cve IS NOT NULL)) AS spot_event,
  coalesce(max(CASE WHEN asset_name IS NOT NULL THEN asset_criticality END), 0.0) AS asset_tier
  FROM mb GROUP BY component"""


def ranked(attr: str) -> str:
    return f"(SELECT component, {attr} AS v, count(*) AS n, min((ts_us, event_id)) AS f FROM mb WHERE {attr} IS NOT NULL GROUP BY 1, 2)"


CTE["o_class"] = f"SELECT component, first(v ORDER BY n DESC, f) AS primary_class FROM {ranked('pred_class')} GROUP BY 1"
CTE["o_asn"] = f"SELECT component, CAST(first(v ORDER BY n DESC, f) AS INTEGER) AS top_asn, string_agg(CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) AS asns FROM {ranked('asn')} GROUP BY 1"
CTE["o_asset"] = f"SELECT component, string_agg(v, ',' ORDER BY f) AS assets, first(v ORDER BY f) AS asset1 FROM {ranked('asset_id')} GROUP BY 1"
CTE["o_tech"] = f"SELECT component, string_agg(v, ',' ORDER BY f) AS techniques, string_agg(v, ',' ORDER BY v) AS tech_sorted, list(v ORDER BY v) AS tech_list, list(v ORDER BY f) AS tech_seen FROM {ranked('technique_id')} GROUP BY 1"
CTE["chain"] = f"""SELECT component, tactic, first(technique_id {_ord}) AS technique_id, first(technique {_ord}) AS technique, min(ts_us) AS first_us,
  count(*) AS event_count, tactic_order FROM mb WHERE tactic IS NOT NULL GROUP BY component, tactic, tactic_order"""
CTE["o_chain"] = """SELECT component, string_agg(tactic || ' (' || technique_id || ')', ' → ' ORDER BY tactic_order, first_us) AS stages,
  string_agg(tactic, ',' ORDER BY tactic) AS tactics FROM chain GROUP BY 1"""
_title = "CASE primary_class " + " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in C.CLASS_TITLES.items()) + " ELSE 'Suspicious activity' END"
_terms = {
    "model_confidence": clamp("0.6 * max_conf + 0.4 * mean_conf"), "asset_criticality": clamp("max_crit"), "exploitability": clamp("max_expl"),
    "blast_radius": clamp(f"ln(1.0 + n_assets + n_users) / {_sat}"),
    "kill_chain_depth": "CASE depth WHEN 0 THEN 0.0 WHEN 1 THEN 0.05 WHEN 2 THEN 0.45 WHEN 3 THEN 0.8 WHEN 4 THEN 0.92 ELSE 1.0 END",
    "recency": recency("last_us")}
CTE["inc0"] = ("SELECT f.*, primary_class, top_asn, asns, assets, asset1, techniques, tech_sorted, tech_list, tech_seen, stages, tactics, now, "
               + ", ".join(f"CAST({e} AS DOUBLE) AS t_{t}" for t, e in _terms.items())
               + " FROM facts f JOIN kept USING (component) LEFT JOIN o_class USING (component) LEFT JOIN o_asn USING (component) "
                 "LEFT JOIN o_asset USING (component) LEFT JOIN o_tech USING (component) LEFT JOIN o_chain USING (component), as_of")
_risk = h(" + ".join(f"100.0 * t_{t} * {w}" for t, w in C.DEFAULT_WEIGHTS.items()), 1)
CTE["inc1"] = f"SELECT *, {_risk} AS risk_score, row_number() OVER (ORDER BY opened_us, component) AS num FROM inc0"
CTE["inc"] = f"""SELECT *, {band('risk_score')} AS priority, 'INC-' || CASE WHEN num < 10000 THEN lpad(CAST(num AS VARCHAR), 4, '0') ELSE CAST(num AS VARCHAR) END AS incident_id,
  CASE WHEN depth >= 3 THEN {lit(C.MULTI_STAGE_TITLE)} WHEN asset1 IS NOT NULL THEN {_title} || ' against ' || asset1 ELSE {_title} END AS title FROM inc1"""
CTE["stamp"] = "SELECT ev.*, incident_id FROM ev LEFT JOIN comp USING (event_id) LEFT JOIN inc USING (component)"
CTE["prof"] = """SELECT component, e.kind, e.value, count(*) AS event_count FROM ents e JOIN comp USING (event_id) GROUP BY 1, 2, 3"""
CTE["fp"] = f"""SELECT incident_id, component, opened_us, event_count, tech_sorted, tech_list, tactics, asns,
  CASE WHEN event_count < 2 OR (last_us - opened_us) / 1e6 / greatest(1, event_count - 1) < 10 THEN 'burst'
    WHEN (last_us - opened_us) / 1e6 / greatest(1, event_count - 1) < 180 THEN 'steady' ELSE 'low_and_slow' END AS timing_bucket,
  {h('asset_tier', 2)} AS asset_tier, {h('ln(1.0 + event_count)', 2)} AS event_count_log, num, now FROM inc"""
CTE["hp"] = f"""SELECT incident_id, CAST(hour(make_timestamp(ts_us)) AS INTEGER) AS hour, {h('count(*) / any_value(event_count)', 3)} AS share
  FROM mb JOIN inc USING (component) GROUP BY 1, 2"""
_vocab = sorted(C.TECHNIQUES)
CTE["vec"] = f"""SELECT incident_id, pos, CAST(v AS DOUBLE) AS v FROM (
  SELECT incident_id, list_position({'[' + ', '.join(lit(t) for t in _vocab) + ']'}, unnest(tech_list)) - 1 AS pos, 1.0 AS v FROM fp
  UNION ALL SELECT incident_id, {len(_vocab)} + list_position(['burst', 'steady', 'low_and_slow'], timing_bucket) - 1, 1.0 FROM fp
  UNION ALL SELECT incident_id, {len(_vocab) + 3} + hour, share FROM hp
  UNION ALL SELECT incident_id, {len(_vocab) + 27}, least(1.0, event_count_log / 10.0) FROM fp) WHERE v <> 0"""
CTE["norm"] = "SELECT incident_id, sqrt(sum(v * v)) AS len FROM vec GROUP BY 1"
CTE["dots"] = "SELECT x.incident_id AS i, y.incident_id AS j, sum(x.v * y.v) AS dot FROM vec x JOIN vec y USING (pos) GROUP BY 1, 2"
CTE["sim"] = """SELECT i, j, round(CASE WHEN list_has_any(string_split(a.asns, ','), string_split(b.asns, ',')) THEN least(1.0, dot / n1.len / n2.len + 0.05)
    ELSE dot / n1.len / n2.len END, 9) AS score, b.opened_us AS j_us
  FROM dots JOIN fp a ON a.incident_id = i JOIN fp b ON b.incident_id = j JOIN norm n1 ON n1.incident_id = i JOIN norm n2 ON n2.incident_id = j
  WHERE b.opened_us < a.opened_us AND list_has_any(a.tech_list, b.tech_list)"""
CTE["mt0"] = "SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j_us, j) = 1"
CTE["mt"] = f"""SELECT i AS incident_id, j AS similar_id, {h('score', 2)} AS similarity, (a.now - j_us) // 86400000000 AS days_ago, 'open' AS verdict,
  concat_ws(',', nullif(array_to_string(list_sort(list_intersect(a.tech_list, b.tech_list)), ','), ''),
    nullif(array_to_string(list_transform(list_sort(list_intersect(string_split(a.asns, ','), string_split(b.asns, ','))), lambda x: 'ASN ' || x), ','), ''),
    CASE WHEN a.timing_bucket = b.timing_bucket THEN a.timing_bucket || ' timing' END) AS shared
  FROM mt0 JOIN fp a ON a.incident_id = i JOIN fp b ON b.incident_id = j WHERE score >= 0.88"""
CTE["ctx"] = """SELECT inc.*, coalesce(CAST(top_asn AS VARCHAR), 'unknown') AS ctx_top_asn, CAST(n_users AS VARCHAR) AS ctx_n_users,
  coalesce(replace(assets, ',', ', '), 'the affected assets') AS ctx_assets, coalesce(s.cve, 'the identified vulnerability') AS ctx_cve,
  coalesce(s.matched_asset, s.asset_id, asset1, 'the affected asset') AS ctx_matched_asset, first_ip AS ctx_top_ip,
  regexp_replace(first_ip, '\\.[0-9]+$', '') AS ctx_subnet FROM inc LEFT JOIN ev s ON s.event_id = spot_event"""
_known = inlist(sorted({r[0] for r in playbook_rows()} - {"default"}))
CTE["itech"] = f"""SELECT incident_id, t AS technique_id, tech_ord FROM (SELECT incident_id, unnest(tech_seen) AS t, generate_subscripts(tech_seen, 1) AS tech_ord FROM inc) WHERE t IN {_known}"""
CTE["ibook"] = """SELECT incident_id, technique_id, tech_ord FROM itech UNION ALL
  SELECT incident_id, 'default', 1 FROM inc WHERE incident_id NOT IN (SELECT incident_id FROM itech)"""
CTE["act"] = "SELECT * FROM ibook JOIN book_dim USING (technique_id)"
CTE["dact"] = "SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY incident_id, action_id ORDER BY tech_ord, section_ord, ordinal) = 1"
CTE["fbk"] = """SELECT num AS feedback_id, incident_id, CAST(NULL AS BIGINT) AS event_id,
    CASE num % 5 WHEN 0 THEN 'confirmed_threat' WHEN 1 THEN 'false_positive' ELSE 'reclassify' END AS label,
    CASE WHEN num % 5 = 2 THEN 'scraper' END AS new_class, last_us AS ts_us, CASE WHEN num % 2 = 0 THEN 'v1.0.0' END AS consumed_by FROM inc WHERE num % 5 < 3
  UNION ALL SELECT event_id + 1000000, NULL, event_id, CASE WHEN event_id % 2 = 0 THEN 'false_positive' ELSE 'confirmed_threat' END, NULL, ts_us, NULL
  FROM sd WHERE event_id % 97 = 0"""

# --- review and model inputs ---------------------------------------------------------------------------------
CTE["cand"] = """SELECT * FROM ev WHERE event_id NOT IN (SELECT event_id FROM fbk WHERE event_id IS NOT NULL)"""
CTE["grp"] = f"""SELECT last(event_id {_ord}) AS event_id, pred_class, path, count(*) AS n, count(DISTINCT src_ip) AS distinct_sources,
  CASE WHEN count(DISTINCT src_ip) = 1 THEN last(src_ip {_ord}) ELSE count(DISTINCT src_ip) || ' sources' END AS src_ip,
  {iso('max(ts_us)')} AS ts, {iso('min(ts_us)')} AS first_seen, avg(pred_confidence) AS mean_conf FROM cand GROUP BY pred_class, path"""
_kinds = "CASE WHEN kind < 4 THEN 'normal' WHEN kind = 4 THEN 'slow_recon' WHEN kind = 5 THEN 'credential_stuffing' WHEN kind = 6 THEN 'brute_force' WHEN kind = 7 THEN 'dir_scan' WHEN kind = 8 THEN 'scraper' ELSE 'flood' END"
CTE["mr"] = f"""SELECT event_id, {_kinds} AS label, CASE WHEN k % 10 = 0 THEN 'normal' WHEN k % 17 = 0 THEN 'flood' ELSE {_kinds} END AS pred,
  kind >= 4 AS is_attack, CAST(k + CAST(kind >= 4 AS INTEGER) * 30 AS DOUBLE) / CAST(130 AS DOUBLE) + (event_id % 97) * CAST('1e-8' AS DOUBLE) AS score FROM we"""
CTE["per"] = """SELECT c, sum(tp) AS tp, sum(actual) AS actual, sum(called) AS called FROM (
  SELECT label AS c, count(*) AS actual, 0 AS called, count(*) FILTER (label = pred) AS tp FROM mr GROUP BY 1
  UNION ALL SELECT pred, 0, count(*), 0 FROM mr GROUP BY 1) GROUP BY c"""
CTE["thr"] = """SELECT t, tp, n, sum(tp) OVER (ORDER BY t DESC) AS cum_tp, sum(n) OVER (ORDER BY t DESC) AS cum_n, sum(tp) OVER () AS pos, sum(n) OVER () AS all_n,
  row_number() OVER (ORDER BY t) - 1 AS ix, count(*) OVER () AS size FROM (SELECT score AS t, count(*) FILTER (is_attack) AS tp, count(*) AS n FROM mr GROUP BY 1)"""
CTE["reg"] = """SELECT 'v1.0.' || p_partkey AS version, p_partkey * 1000000 + p_size AS trained_us, 0.5 + p_size / 100.0 AS pr_auc, (p_partkey % 20) / 100.0 AS fpr_at_90_recall,
  p_partkey % 3 = 0 AS promoted, CASE WHEN p_partkey % 3 = 1 THEN 'PR-AUC regressed' END AS rejection_reason, p_partkey % 50 AS n_feedback FROM part"""
CTE["champ"] = "SELECT * FROM reg WHERE promoted ORDER BY trained_us DESC, version DESC LIMIT 1"
CTE["actn"] = """SELECT 's_' || user_id AS session_id, event_id AS seq, event_id * 20 + length(event_type) % 7 AS ts_ms,
  ['mousemove','mousemove','mousemove','mousemove','keydown','keydown','click','scroll','paste','focus','blur','submit'][(event_id * 7 // 3) % 12 + 1] AS kind,
  event_id * 37 % 1920 AS x, event_id * 53 % 1080 AS y FROM events"""
_bad = "event_id % 11 = 0 OR event_id % 13 = 0"


def add(name: str, final: str) -> None:
    ORACLE[name] = final


# --- 2.1 ------------------------------------------------------------------------------------------------------
add("scan_events", "SELECT event_id, ts_us, src_ip, pred_class FROM sd")
add("scan_assets_csv", f"SELECT a.asset_id, name, a.kind, CAST(criticality AS DOUBLE) AS criticality, cpe_product, count(e.event_id) AS events FROM asset_dim a LEFT JOIN (SELECT event_id, {_route} AS asset_id FROM au) e USING (asset_id) GROUP BY ALL")
_entry = "CASE WHEN m < 0 THEN m + 1000 ELSE m END"
_match = "(SELECT min(CASE WHEN p.path = au.path THEN ordinal - 1000 ELSE ordinal END) FROM path_dim p WHERE starts_with(au.path, p.path))"
add("scan_path_cve", f"SELECT ordinal, p.path, cve, product, count(m) AS events FROM path_dim p LEFT JOIN (SELECT {_match} AS m FROM au) ON ordinal = {_entry} GROUP BY ALL")
add("scan_attack_map", "SELECT t.technique_id, t.technique, t.tactic, CAST(t.tactic_order AS BIGINT) AS tactic_order, count(event_id) AS events FROM tech_dim t LEFT JOIN ev ON ev.technique_id = t.technique_id GROUP BY ALL")
add("scan_kev_json", "SELECT cve, kev_added FROM kev")
add("scan_epss_json", "SELECT cve, CAST(epss AS DOUBLE) AS epss FROM epss_feed")
add("scan_blocklists", "SELECT ip, 'feodo' AS list FROM feodo UNION ALL SELECT ip, 'tor' FROM tor")
add("scan_playbooks", "SELECT b.technique_id, section, CAST(ordinal AS BIGINT) AS ordinal, action_id, action, owner, CAST(eta_min AS BIGINT) AS eta_min, coalesce(events, 0) AS events FROM book_dim b LEFT JOIN (SELECT technique_id, count(*) AS events FROM ev GROUP BY 1) n ON n.technique_id = b.technique_id")
add("feeds_status", "SELECT feed, entries, CASE WHEN entries = 0 THEN 'feed is empty' ELSE 'loaded' END AS note FROM (SELECT 'kev' AS feed, (SELECT count(*) FROM kev) AS entries UNION ALL SELECT 'epss', (SELECT count(*) FROM epss_feed) UNION ALL SELECT 'feodo', (SELECT count(*) FROM feodo) UNION ALL SELECT 'tor', (SELECT count(*) FROM tor))")
add("parse_features", "SELECT event_id, " + ", ".join(f"CASE WHEN {_bad} THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}" for c in ("req_rate_60s", "path_entropy", "unique_paths_60s", "mouse_move_count", "browser_telemetry_present")) + " FROM ft")
add("write_events", "SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, count(*) AS events FROM we GROUP BY 1")
add("replace_days", "SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, count(*) AS events, min(ts_us) AS first_us, max(ts_us) AS last_us FROM we GROUP BY 1")
add("lookback_seeds", "SELECT pred_class, count(*) AS events, min(ts_us) AS first_us FROM sd WHERE ts_us >= (SELECT max(ts_us) FROM we) - 172800000000 GROUP BY 1")
add("write_incidents", "SELECT incident_id, priority, risk_score, event_count FROM inc")
add("assign_incidents", "SELECT event_id, incident_id FROM stamp")
add("append_feedback", "SELECT label, count(*) AS labels FROM fbk GROUP BY 1")
add("append_model_version", "SELECT version, CAST(pr_auc AS DOUBLE) AS pr_auc, n_feedback FROM champ")
add("stream_telemetry_source", "SELECT session_id, t_us // 1000 AS ts_ms, 'widget' AS source, page AS url_path, CAST(NULL AS VARCHAR) AS pred_class, mouse_move_count FROM tel")
# --- 2.2
for _c in ("req_rate_10s", "req_rate_60s", "req_rate_300s", "auth_fail_ip_60s", "distinct_users_tried_60s", "auth_success_after_fails",
           "unique_paths_60s", "p404_ratio_60s", "path_entropy", "interarrival_mean_ms", "interarrival_std_ms", "payload_bytes",
           "payload_bytes_std", "resp_bytes_60s", "session_age_s", "requests_this_session", "header_count", "auth_fail_user_60s",
           "sensitive_path_hit", "ua_missing", "ua_known_tool", "ua_entropy", "accept_lang_missing", "header_order_hash_known",
           "asn_is_hosting", "country_risk", "last_user"):
    add(_c, f"SELECT event_id, {_c} FROM feat")
add("hour_of_day", "SELECT event_id, hour_of_day, is_off_hours FROM feat")
add("ip_reputation_hit", "SELECT event_id, ip_reputation_hit, is_tor_exit FROM feat")
add("strip_query", "SELECT event_id, path FROM au")
add("asset_for_path", f"SELECT event_id, {_route} AS asset_id FROM au")
add("path_cve_match", f"SELECT event_id, coalesce({_entry}, -1) AS ordinal FROM (SELECT event_id, {_match} AS m FROM au)")
add("sensitive_prefix", f"SELECT event_id, {starts('path', C.SENSITIVE_NO_CVE)} AS sensitive FROM au")
add("subnet24", "SELECT event_id, regexp_replace(src_ip, '[0-9]+$', '0/24') AS subnet FROM we")
add("server_features", "SELECT event_id, " + ", ".join(C.SERVER_FEATURES) + " FROM feat")
# --- 2.3
add("browser_counts", "SELECT session_id, " + ", ".join(f"count(*) FILTER (kind = {lit(k)}) AS {n}" for k, n in (("mousemove", "mouse_move_count"), ("keydown", "keystroke_count"), ("paste", "paste_events"), ("click", "click_count"), ("scroll", "scroll_events"))) + ", count(*) FILTER (kind IN ('focus', 'blur')) AS focus_blur_count FROM actn GROUP BY 1")
add("mouse_path_entropy", f"""SELECT session_id, {h('entropy(dir)', 2)} AS mouse_path_entropy FROM (SELECT session_id, floor((atan2(dy, dx) + pi()) / (pi() / 8)) AS dir,
  row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS rn FROM (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy FROM actn WHERE kind = 'mousemove'
  WINDOW o AS (PARTITION BY session_id ORDER BY ts_ms, seq)) WHERE dx <> 0 OR dy <> 0) GROUP BY 1""")
add("keystroke_interval_stats", f"""SELECT s.session_id, {h('avg(gap)', 1)} AS keystroke_interval_mean, {h('stddev_pop(gap)', 1)} AS keystroke_interval_std
  FROM (SELECT DISTINCT session_id FROM actn) s LEFT JOIN (SELECT session_id, gap, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS rn FROM (
  SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS gap FROM actn WHERE kind = 'keydown') WHERE gap < 5000) g
  ON g.session_id = s.session_id GROUP BY 1""")
add("session_timings", """SELECT session_id, CAST(time_to_first_click_ms AS DOUBLE) AS time_to_first_click_ms, CAST(form_fill_ms AS DOUBLE) AS form_fill_ms,
  CAST(page_dwell_ms AS DOUBLE) AS page_dwell_ms FROM (SELECT session_id, min(ts_ms) FILTER (kind = 'click') - min(ts_ms) AS time_to_first_click_ms,
  CASE WHEN max(ts_ms) FILTER (kind = 'submit') >= min(ts_ms) FILTER (kind IN ('keydown', 'paste')) THEN max(ts_ms) FILTER (kind = 'submit') - min(ts_ms) FILTER (kind IN ('keydown', 'paste')) END AS form_fill_ms,
  max(ts_ms) - min(ts_ms) AS page_dwell_ms FROM actn GROUP BY 1)""")
add("fuse_telemetry", "SELECT event_id, browser_telemetry_present, " + ", ".join(C.BROWSER_FEATURES) + " FROM fz")
_miss = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in C.BROWSER_FEATURES)
add("feature_vector", f"SELECT event_id, 47 AS n, {_miss} AS missing, {h(' + '.join(f'coalesce(CAST({c} AS DOUBLE), 0)' for c in C.FEATURES), 2)} AS total FROM ft")
add("feature_matrix", f"SELECT event_id, 47 AS n, CASE WHEN {_bad} THEN 16 ELSE {_miss} END AS missing, CASE WHEN {_bad} THEN 0.0::DOUBLE ELSE CAST(req_rate_60s AS DOUBLE) END AS req_rate_60s FROM ft")
add("validate_features", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'req_rate_61s' ELSE '' END AS unknown_keys, CASE WHEN event_id % 5 = 0 THEN 'req_rate_60s' ELSE '' END AS missing_server_keys,
  FALSE AS missing_presence_flag, CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 AND browser_telemetry_present = 0 THEN 'click_count' ELSE '' END AS zeroed_browser_keys FROM ft""")
# --- 2.4
for _r, _cls, _fires, _conf, _ in _RULES:
    add(f"rule_{_r}", f"SELECT event_id, cls AS rule_class, {h('conf', 2)} AS confidence FROM hits WHERE rule = {lit(_r)}")
add("classify_rules", "SELECT event_id, pred_class, pred_confidence FROM cl")
add("classify_with_model", f"""SELECT event_id, CASE WHEN rule IS NOT NULL THEN pred_class ELSE coalesce(mc, pred_class) END AS final_class,
  CASE WHEN rule IS NOT NULL AND mc = pred_class THEN greatest(pred_confidence, {h('least(0.99, mf)', 2)}) WHEN rule IS NOT NULL THEN pred_confidence
  ELSE coalesce({h('mf', 2)}, pred_confidence) END AS final_confidence FROM (SELECT *, CASE WHEN event_id % 10 < 3 THEN 'scraper' WHEN event_id % 10 < 6 THEN pred_class END AS mc,
  CASE WHEN event_id % 10 < 6 THEN CAST(0.4 AS DOUBLE) + (event_id % 10) / 10.0 END AS mf FROM cl)""")
add("technique_on_event", "SELECT event_id, attack_technique FROM ev")
add("technique_overrides", "SELECT event_id, over_technique AS technique_id FROM ev")
add("technique_resolve", "SELECT event_id, technique_id, technique, tactic FROM ev")


def _evidence() -> str:
    parts = []
    rules = [(r, keys) for r, _, _, _, keys in _RULES] + [(None, ["browser_telemetry_present", "req_rate_60s"])]
    for rule, keys in rules:
        where = f"rule = {lit(rule)}" if rule else "rule IS NULL"
        for i, k in enumerate(keys):
            lo, hi = C.BASELINES.get(k, (0.0, 1.0))
            v = f"CAST({k} AS DOUBLE)"
            above = f"CAST(CAST(round_even({v} / {float(hi)}, 0) AS BIGINT) AS VARCHAR) || 'x above baseline'" if hi > 0 else "'present'"
            dev = (f"CASE WHEN {k} IS NULL THEN 'absent' WHEN {v} > {hi} THEN {above} WHEN {v} < {lo} AND {v} > 0 THEN "
                   f"CAST(CAST(round_even({float(lo)} / {v}, 0) AS BIGINT) AS VARCHAR) || 'x below baseline' WHEN {v} < {lo} THEN 'absent' ELSE 'within baseline' END")
            span = f"{lo:g}" if lo == hi else f"{lo:g}-{hi:g}"
            parts.append(f"SELECT event_id, {i} AS pos, {lit(k)} AS feature, {v} AS value, {lit(span)} AS baseline, {dev} AS deviation, {lit(C.NOTES.get(k, ''))} AS note FROM cl WHERE {where}")
    return " UNION ALL ".join(parts)


add("evidence", _evidence())
# --- 2.5, 2.6
add("asset_criticality", "SELECT event_id, asset_id, asset_criticality FROM en")
add("kev_epss_join", "SELECT event_id, cve, in_kev, kev_added, epss FROM en")
add("product_match", "SELECT event_id, product_match, matched_asset, matched_software FROM en")
add("exploitability", f"SELECT event_id, {h('exploitability', 4)} AS exploitability FROM en")
add("threat_intel", """SELECT event_id, 'cve' AS kind, cve AS value, cve_name AS name, in_kev, epss, matched_asset, CASE WHEN in_kev THEN 'CISA KEV' ELSE 'NVD / EPSS' END AS source FROM en WHERE cve IS NOT NULL
  UNION ALL SELECT event_id, 'ip_reputation', src_ip, 'Listed on ' || reputation_source, FALSE, NULL, NULL, reputation_source FROM en WHERE reputation_source IS NOT NULL""")
add("enrich_event", f"SELECT event_id, asset_id, asset_name, asset_criticality, {h('exploitability', 4)} AS exploitability, sensitive_path, cve, in_kev, probe_succeeded, matched_asset, reputation_source FROM en")
add("entities_of", "SELECT event_id, kind, value FROM ents UNION ALL SELECT event_id, 'ua_hash', substr(sha256(user_agent), 1, 12) FROM sd WHERE user_agent <> ''")
add("score_unscored", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'P4' ELSE individual_priority END AS individual_priority FROM ev")
add("risk_terms", "SELECT incident_id, " + ", ".join(f"{h(f't_{t}', 6)} AS {t}" for t in C.RISK_TERMS) + " FROM inc")
add("risk_score", " UNION ALL ".join(f"SELECT incident_id, {i} AS pos, {lit(t)} AS term, {h(f't_{t}', 3)} AS raw, CAST({C.DEFAULT_WEIGHTS[t]} AS DOUBLE) AS weight, {h(f'100.0 * {C.DEFAULT_WEIGHTS[t]} * t_{t}', 1)} AS points FROM inc" for i, t in enumerate(C.RISK_TERMS)))
add("priority_band", "SELECT incident_id, risk_score, priority FROM inc")
add("score_event", "SELECT event_id, event_risk, individual_priority FROM ev")
add("score_incident", "SELECT incident_id, risk_score, priority, depth >= 3 AS escalated FROM inc")
add("validate_weights", f"SELECT '{TENANT}' AS tenant_id, c_custkey AS scenario, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing terms' WHEN 2 THEN 'weights must sum to 1' WHEN 3 THEN 'weight out of range' ELSE 'unknown terms' END AS verdict FROM customer")
_wr = h("100*t_model_confidence*(0.2 + 0.02*r_regionkey) + 100*t_asset_criticality*0.2 + 100*t_exploitability*0.2 + 100*t_blast_radius*0.15 + 100*t_kill_chain_depth*0.15 + 100*t_recency*(0.1 - 0.02*r_regionkey)", 1)
add("rescore_what_if", f"SELECT incident_id, scenario, new_risk, {band('new_risk')} AS new_priority FROM (SELECT incident_id, CAST(r_regionkey AS BIGINT) AS scenario, {_wr} AS new_risk FROM inc, region)")
# --- 2.7
add("seed_events", "SELECT event_id, pred_class, pred_confidence FROM sd")
add("entity_index", "SELECT event_id, kind, value, fanout FROM fan")
add("fanout_split", "SELECT kind, value, CASE WHEN fanout > 1 THEN 'linked' ELSE 'single' END AS path, count(*) AS events FROM fan GROUP BY ALL")
add("pair_links", f"SELECT kind, a, b, {h('w', 6)} AS w FROM pl")
add("chain_links", f"SELECT kind, a, b, {h('w', 6)} AS w FROM cn")
add("edge_weights", f"SELECT a, b, {h('w', 6)} AS w FROM ed")
add("components", "SELECT event_id, component FROM comp")
add("cluster_filter", "SELECT component, size FROM kept")
add("cluster_span", f"SELECT component, {iso('opened_us')} AS opened_at, {iso('last_us')} AS last_seen_at, event_count FROM inc")
add("kill_chain", f"SELECT component, tactic, technique_id, technique, {iso('first_us')} AS first_seen, event_count, tactic_order FROM chain")
add("kill_chain_depth", "SELECT component, depth, depth >= 3 AS escalate FROM inc")
add("primary_class", "SELECT component, primary_class, top_asn FROM inc")
add("entity_counts", "SELECT component, kind, value, event_count, kind = 'ip' AND value IN (SELECT ip FROM feodo UNION SELECT ip FROM tor) AS reputation_hit FROM prof")
add("affected_assets", "SELECT component, assets, n_users FROM inc")
add("max_individual_priority", "SELECT component, max_individual_priority FROM inc")
add("techniques_set", "SELECT component, techniques FROM inc")
add("incident_ids", "SELECT component, incident_id FROM inc")
add("incident_title", "SELECT incident_id, title FROM inc")
add("status_carryover", "SELECT component, CASE WHEN component % 3 = 0 THEN 'confirmed' ELSE 'open' END AS status FROM inc")
add("incident_intel", f"""SELECT component, 'cve' AS kind, cve AS value, first(cve_name {_ord}) AS name, first(in_kev {_ord}) AS in_kev, first(matched_asset {_ord}) AS matched_asset,
  first(CASE WHEN in_kev THEN 'CISA KEV' ELSE 'NVD / EPSS' END {_ord}) AS source FROM mb WHERE cve IS NOT NULL GROUP BY component, cve
  UNION ALL SELECT component, 'ip_reputation', src_ip, first('Listed on ' || reputation_source), FALSE, NULL, first(reputation_source) FROM mb WHERE reputation_source IS NOT NULL GROUP BY component, src_ip""")
CTE["gn"] = f"SELECT *, list_position({'[' + ', '.join(lit(k) for k in C.GRAPH_KINDS) + ']'}, kind) AS pos FROM prof WHERE kind <> 'session' QUALIFY row_number() OVER (PARTITION BY component ORDER BY event_count DESC, kind, value) <= 10"
add("entity_graph", """SELECT component, 'node' AS part, kind || ':' || value AS source, CAST(NULL AS VARCHAR) AS target, event_count FROM gn
  UNION ALL SELECT a.component, 'edge', a.kind || ':' || a.value, b.kind || ':' || b.value, 0 FROM gn a JOIN gn b ON a.component = b.component AND b.pos = a.pos + 1""")
add("build_incidents", f"SELECT incident_id, title, 'open' AS status, priority, risk_score, {iso('opened_us')} AS opened_at, {iso('last_us')} AS last_seen_at, event_count, primary_class, depth AS kill_chain_depth, assets AS assets_affected, n_users AS users_affected, top_asn, techniques FROM inc")
# --- 2.8
add("timing_bucket", "SELECT incident_id, timing_bucket FROM fp")
add("hour_profile", "SELECT incident_id, hour, share FROM hp WHERE share > 0")
add("fingerprint", "SELECT incident_id, tech_sorted AS techniques, tactics, asns, timing_bucket, asset_tier, event_count_log FROM fp")
add("fingerprint_vector", f"SELECT incident_id, CAST(pos AS INTEGER) AS pos, {h('v', 4)} AS v FROM vec")
add("cosine", f"SELECT a.num AS n, {h('coalesce(dot, 0) / n1.len / n2.len', 4)} AS cosine FROM fp a JOIN fp b ON b.num = a.num - 1 LEFT JOIN dots ON i = a.incident_id AND j = b.incident_id JOIN norm n1 ON n1.incident_id = a.incident_id JOIN norm n2 ON n2.incident_id = b.incident_id")
add("match_campaign", "SELECT * FROM mt")
add("fingerprint_history", "SELECT component, CASE WHEN component % 2 = 0 THEN 'confirmed' ELSE 'open' END AS status, timing_bucket FROM fp")
# --- 2.9
add("playbook_actions", "SELECT incident_id, technique_id, section, action_id FROM act")
add("dedup_actions", "SELECT incident_id, action_id, technique_id, section FROM dact")
_ctx = ["top_asn", "n_users", "assets", "cve", "matched_asset", "top_ip", "subnet"]
add("playbook_context", "SELECT incident_id, " + ", ".join(f"ctx_{c}" for c in _ctx) + " FROM ctx")


def _fill(col: str) -> str:
    for c in _ctx:
        col = f"replace({col}, '{{{c}}}', ctx_{c})"
    return col


add("fill_template", f"SELECT incident_id, action_id, owner, CAST(eta_min AS BIGINT) AS eta_min, {_fill('action')} AS action, {_fill('rollback')} AS rollback, {_fill('query')} AS query FROM dact JOIN ctx USING (incident_id)")
_s = "CASE WHEN {0} = 1 THEN '' ELSE 's' END"
_min = "((last_us - opened_us) // 60000000)"
add("incident_summary", f"SELECT incident_id, priority || ', risk ' || printf('%.1f', risk_score) || ': ' || event_count || ' linked request' || {_s.format('event_count')} || ' in ' || {_min} || ' min, main network AS' || coalesce(CAST(top_asn AS VARCHAR), '?') || '; best single request ' || max_individual_priority || '; tactics seen: ' || depth AS summary FROM inc")
_clock = lambda us: f"strftime(make_timestamp({us}), '%H:%M')"
add("incident_narrative", f"""SELECT c.incident_id, concat_ws(chr(10) || chr(10),
  'From ' || {_clock('c.opened_us')} || ' to ' || {_clock('c.last_us')} || ' UTC (' || {_min} || ' min) the site received ' || c.event_count || ' linked request' || {_s.format('c.event_count')} || '. Sources: ' || n_ips ||
    CASE WHEN n_ips > 1 THEN ' addresses of ' || ctx_subnet || '.0/24' ELSE ' address' END || ', network AS' || ctx_top_asn || '.',
  CASE WHEN max_individual_priority IN ('P3', 'P4') THEN 'Taken one by one the requests rank ' || max_individual_priority || ' at best; only their links raise this case.' END,
  CASE WHEN depth >= 2 THEN 'Stages by first sighting: ' || stages || ' (' || depth || ' tactics).' END,
  CASE WHEN kev_event IS NOT NULL THEN 'Requests target ' || k.cve || ', ' || k.cve_name || '; asset ' || coalesce(k.matched_asset, 'unknown') || ' runs ' || coalesce(k.matched_software, 'unknown software') || '. Known to be exploited' ||
    coalesce(' since ' || k.kev_added, '') || coalesce('; EPSS ' || printf('%.3f', nullif(k.epss, 0)), '') || '.' END,
  CASE WHEN no_browser AND c.event_count > 1 THEN 'No request came with browser telemetry.' END,
  CASE WHEN similar_id IS NOT NULL THEN 'Resembles ' || similar_id || ' (' || CAST(floor(similarity * 100 + 1e-6) AS BIGINT) || ' %, ' || days_ago || ' days earlier) in: ' || array_to_string(string_split(shared, ','), ', ') || '.' END,
  CASE WHEN depth >= 3 THEN 'Depth calls for escalation: treat as an ongoing intrusion.' END) AS narrative
  FROM ctx c LEFT JOIN ev k ON k.event_id = kev_event LEFT JOIN mt ON mt.incident_id = c.incident_id""")
add("no_browser_share", "SELECT count(*) FILTER (no_browser) AS without_browser, count(*) AS incidents FROM inc")
add("hunt_exposed_endpoints", "SELECT DISTINCT asset_id FROM cl WHERE url_path LIKE '/actuator/%' AND http_status = 200")
add("hunt_catalogue_coverage", "SELECT asn, count(DISTINCT url_path) AS paths FROM we GROUP BY asn")
add("hunt_auth_by_asn", "SELECT event_id, src_ip, user_id, http_status FROM we WHERE asn = 14061 AND url_path = '/login'")
add("hunt_users_in_subnet", "SELECT DISTINCT user_id FROM we WHERE src_ip LIKE '185.220.101.%' AND http_status = 200 AND user_id IS NOT NULL")
add("hunt_vulnerable_assets", "SELECT asset_id, software, count(*) AS events FROM cl JOIN asset_dim USING (asset_id) WHERE software LIKE '%Spring%' GROUP BY ALL")
add("hunt_masked_by_flood", "SELECT url_path, count(*) AS events FROM we WHERE asn <> 14061 GROUP BY 1")
add("hunt_large_responses", "SELECT event_id, src_ip, resp_bytes_60s FROM feat WHERE resp_bytes_60s > 5000000")
add("hunt_subnet_activity", "SELECT event_id, src_ip, url_path, pred_class FROM cl WHERE src_ip LIKE '45.155.205.%'")
# --- 2.10
add("overview_counters", "SELECT (SELECT count(*) FROM we) AS events_total, (SELECT count(*) FROM we, as_of WHERE ts_us >= now - 86400000000) AS events_last_24h, (SELECT count(*) FROM inc) AS incidents_open, (SELECT count(*) FROM inc WHERE priority = 'P1') AS incidents_p1")
add("noise_reduction", f"SELECT events, incidents, {h('100.0 * (1 - incidents / greatest(1, events))', 2)} AS noise_reduction_pct FROM (SELECT (SELECT count(*) FROM we) AS events, (SELECT count(*) FROM inc) AS incidents)")
_day = "strftime(make_timestamp({}), '%Y-%m-%d')"
add("daily_trend", f"SELECT date, coalesce(events, 0) AS events, coalesce(incidents, 0) AS incidents FROM (SELECT {_day.format('ts_us')} AS date, count(*) AS events FROM we GROUP BY 1) FULL JOIN (SELECT {_day.format('opened_us')} AS date, count(*) AS incidents FROM inc GROUP BY 1) USING (date)")
add("priority_split", "SELECT p.priority, count(inc.priority) AS incidents FROM (VALUES ('P1'), ('P2'), ('P3'), ('P4')) p(priority) LEFT JOIN inc USING (priority) GROUP BY 1")
add("class_split", "SELECT pred_class, count(*) AS events FROM cl GROUP BY 1")
_names = "CASE asn " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in C.ASN_NAMES.items()) + " ELSE 'AS' || asn END"
add("top_sources", f"SELECT asn, {_names} AS asn_name, first(country {_ord}) AS country, count(*) AS events, asn IN {inlist(C.HOSTING_ASNS)} AS is_hosting, bool_or(ip_reputation_hit = 1) AS reputation_hit FROM feat GROUP BY asn ORDER BY events DESC, asn LIMIT 5")
add("ticker", f"SELECT event_id, {iso('ts_us')} AS ts, src_ip, url_path, pred_class, pred_confidence, incident_id FROM stamp ORDER BY ts_us DESC, event_id DESC LIMIT 25")
add("incident_queue", f"SELECT incident_id, title, 'open' AS status, priority, risk_score, {iso('opened_us')} AS opened_at, {iso('last_us')} AS last_seen_at, event_count, primary_class, depth AS kill_chain_depth, n_users AS users_affected, top_asn, (SELECT count(*) FROM inc) AS total FROM inc ORDER BY risk_score DESC, incident_id LIMIT 10 OFFSET 2")
add("incident_detail", f"SELECT incident_id, title, 'open' AS status, priority, risk_score, s.event_id, {iso('s.ts_us')} AS ts, src_ip, url_path, http_status, user_id, asset_id, pred_class, pred_confidence, individual_priority, attack_technique FROM stamp s JOIN inc USING (incident_id)")
CTE["fnl"] = "SELECT 0 AS stage_order, 'events' AS stage, (SELECT count(*) FROM we) AS n UNION ALL SELECT 1, 'candidate_alerts', (SELECT count(*) FROM cl WHERE pred_class <> 'normal') UNION ALL SELECT 2, 'incidents', (SELECT count(*) FROM inc) UNION ALL SELECT 3, 'actionable', (SELECT count(*) FROM inc WHERE priority IN ('P1', 'P2'))"
add("funnel", f"SELECT stage_order, stage, n, {h('100.0 * (1 - n / nullif(lag(n) OVER (ORDER BY stage_order), 0))', 2)} AS drop_pct FROM fnl")
add("correlation_metrics", f"SELECT {h('avg(event_count)', 1)} AS events_per_incident_mean, list_sort(list(event_count))[count(*) // 2 + 1] AS events_per_incident_median, count(*) FILTER (event_count > 1) AS incidents_multi_event, (SELECT count(*) FROM mt) AS incidents_with_historical_match, count(*) FILTER (priority IN ('P1', 'P2') AND depth >= 2) AS incidents_escalated_by_correlation FROM inc")
add("invariants", """SELECT 'no event is P1 or P2 by itself' AS "check", n = 0 AS ok, n AS detail FROM (SELECT count(*) AS n FROM ev WHERE individual_priority IN ('P1', 'P2'))
  UNION ALL SELECT 'normal events carry no technique', n = 0, n FROM (SELECT count(*) AS n FROM ev WHERE pred_class = 'normal' AND attack_technique IS NOT NULL)
  UNION ALL SELECT 'correlation produced incidents', n > 0, n FROM (SELECT count(*) AS n FROM inc)
  UNION ALL SELECT 'points sum to the score', TRUE, 0 UNION ALL SELECT 'correlation created P1 incidents', n > 0, n FROM (SELECT count(*) AS n FROM inc WHERE priority = 'P1')
  UNION ALL SELECT 'a three-tactic campaign was found', n > 0, n FROM (SELECT count(*) AS n FROM inc WHERE depth >= 3)
  UNION ALL SELECT 'incidents have two or more events', n = 0, n FROM (SELECT count(*) AS n FROM inc WHERE event_count < 2)
  UNION ALL SELECT 'stamped events equal incident members', TRUE, n FROM (SELECT count(*) AS n FROM stamp WHERE incident_id IS NOT NULL)
  UNION ALL SELECT 'scores lie in 0..100', TRUE, 0 UNION ALL SELECT 'incidents do not end before they open', TRUE, 0""")
# --- 2.11
add("review_candidates", "SELECT event_id, pred_class FROM cand")
add("review_group_events", "SELECT pred_class, path, event_id FROM cand")
add("feedback_fingerprints", "SELECT component, CASE num % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' ELSE 'open' END AS status FROM fp")
add("review_groups", f"SELECT * REPLACE ({h('mean_conf', 2)} AS mean_conf) FROM grp")
add("uncertainty_rank", f"SELECT pred_class, path, n, {h('abs(mean_conf - 1.0 / (SELECT greatest(1, count(DISTINCT pred_class)) FROM grp))', 3)} AS uncertainty FROM grp")
_rank = ORACLE["uncertainty_rank"]
add("review_sample", f"SELECT pred_class, path, uncertainty, CASE WHEN n <= 22 THEN 'uncertainty' ELSE 'random' END AS sampled_by FROM (SELECT *, row_number() OVER (PARTITION BY n <= 22 ORDER BY CASE WHEN n > 22 THEN CAST('0x' || substr(md5(pred_class || ':' || path || ':42'), 1, 8) AS BIGINT) END, pred_class, path) AS m FROM (SELECT *, row_number() OVER (ORDER BY uncertainty, pred_class, path) AS n FROM (SELECT pred_class, path, uncertainty FROM ({_rank})))) WHERE n <= 22 OR m <= 3")
add("feedback_status", "SELECT incident_id, CASE num % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' ELSE 'open' END AS status FROM inc")
add("labels_pending", "SELECT count(*) AS labels_pending FROM fbk WHERE consumed_by IS NULL")
CTE["trn"] = """SELECT feedback_id, event_id, CASE label WHEN 'false_positive' THEN 'normal' WHEN 'reclassify' THEN new_class ELSE pred_class END AS train_class FROM (
  SELECT f.feedback_id, s.event_id, f.label, f.new_class, s.pred_class FROM fbk f JOIN stamp s ON (f.event_id IS NULL AND s.incident_id = f.incident_id) OR s.event_id = f.event_id WHERE consumed_by IS NULL)"""
add("feedback_training_rows", "SELECT * FROM trn WHERE train_class IS NOT NULL")
add("mark_consumed", "SELECT feedback_id, coalesce(consumed_by, CASE WHEN feedback_id IN (SELECT feedback_id FROM trn WHERE train_class IS NOT NULL) THEN 'v1.0.7' END) AS consumed_by FROM fbk")
# --- 2.12
add("training_set", "SELECT event_id, pred_class AS label, CASE WHEN coalesce(session_id, '') <> '' THEN 'sess:' || session_id ELSE 'ip:' || src_ip || ':' || (ts_us // 600000000) END AS group_key FROM cl")
add("grouped_holdout", "SELECT group_key, CAST('0x' || substr(md5(group_key || ':42'), 1, 8) AS BIGINT) % 100 < 25 AS is_test, 1 AS sides FROM (" + ORACLE["training_set"] + ") GROUP BY group_key")
add("calibrate_checks", "SELECT 'rows' AS name, count(*) AS n, true AS ok FROM cl UNION ALL SELECT 'classes', 7, true UNION ALL SELECT 'probabilities sum to one', count(*), true FROM cl UNION ALL SELECT 'accuracy not lowered', 0, true")
_held = "SELECT *, CAST('0x' || substr(md5(group_key || ':42'), 1, 8) AS BIGINT) % 100 < 25 AS is_test FROM (" + ORACLE["training_set"] + ")"
add("model_checks", f"SELECT 'held-out rows' AS name, count(*) AS n, true AS ok FROM ({_held}) WHERE is_test UNION ALL SELECT 'not worse than the commonest class', 0, true UNION ALL SELECT 'macro F1 of 0.9', 0, true UNION ALL SELECT 'no group on both sides', 0, true")
add("fit_classifier", f"""SELECT 'held-out rows' AS name, count(*) AS n, true AS ok FROM ({_held}) WHERE is_test
  UNION ALL SELECT 'missing numbers stay missing', CAST(sum({' + '.join(f'CAST({f} IS NULL AS BIGINT)' for f in C.BROWSER_FEATURES)}) AS BIGINT), true FROM fz JOIN ({_held}) USING (event_id) WHERE is_test
  UNION ALL SELECT 'macro F1 not under the forest''s', 0, true""")
add("calibrate", "SELECT pred_class AS label, count(*) AS n, true AS is_monotone FROM cl GROUP BY pred_class")
add("predict", f"SELECT event_id, true AS is_likeliest, true AS sums_to_one FROM ({_held}) WHERE is_test")
add("score_with_model", """SELECT event_id, rule IS NOT NULL AS ruled, CASE WHEN rule IS NOT NULL THEN pred_class END AS rule_class, true AS technique_agrees,
  CASE WHEN rule IS NULL THEN 'browser_telemetry_present,auth_fail_ip_60s,req_rate_60s,asn_is_hosting' END AS model_evidence, true AS model_decides FROM cl""")
add("model_store", f"""SELECT 'rows scored alike by the loaded model' AS name, count(*) AS n, true AS ok FROM ({_held}) WHERE is_test UNION ALL SELECT 'another version scores differently', 0, true
  UNION ALL SELECT 'versions', 3, true UNION ALL SELECT 'one version in use', 1, true""")
add("permutation_importance", f"""SELECT 'rows' AS name, count(*) AS n, true AS ok FROM ({_held}) WHERE is_test UNION ALL SELECT 'some features, twelve at most', 0, true
  UNION ALL SELECT 'trees split on all of them', 0, true UNION ALL SELECT 'drops of accuracy', 0, true""")
add("retrain", f"""SELECT 'v1.0.' || v AS version, (SELECT count(*) FROM ({_held}) WHERE NOT is_test) AS n_base,
  CASE WHEN v = 0 THEN 0 ELSE (SELECT count(*) FROM ({_held}) h JOIN trn ON trn.event_id = h.event_id WHERE NOT is_test AND train_class IS NOT NULL) END AS n_feedback,
  true AS pointer_agrees, true AS reason_given FROM range(2) r(v)""")
add("frozen_holdout", "SELECT pred_class AS label, event_id % 4 = 0 AS is_test, count(*) AS n FROM cl GROUP BY ALL")
add("macro_prf", f"SELECT {h('avg(p)', 6)} AS precision, {h('avg(r)', 6)} AS recall, {h('avg(coalesce(2 * p * r / nullif(p + r, 0), 0))', 6)} AS f1 FROM (SELECT coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS r FROM per)")
add("confusion_matrix", "SELECT label, " + ", ".join(f"count(*) FILTER (pred = {lit(c)}) AS {c}" for c in C.CLASSES) + " FROM mr GROUP BY label")
add("average_precision", f"SELECT {h('sum(tp / pos * (cum_tp / cum_n))', 6)} AS average_precision FROM thr")
add("fpr_at_90_recall", f"SELECT {h('(cum_n - cum_tp) / greatest(1, all_n - pos)', 6)} AS fpr_at_90_recall FROM thr WHERE cum_tp / pos >= 0.9 ORDER BY t DESC LIMIT 1")
add("pr_curve", f"""SELECT pos_ix, {h('CASE WHEN pos_ix = size THEN 0.0 ELSE cum_tp / pos END', 3)} AS recall, {h('CASE WHEN pos_ix = size THEN 1.0 ELSE cum_tp / cum_n END', 3)} AS precision
  FROM (SELECT DISTINCT k * size // 13 AS pos_ix, size FROM (SELECT DISTINCT size FROM thr), range(14) r(k)) LEFT JOIN (SELECT ix, cum_tp, cum_n, pos FROM thr) ON ix = pos_ix""")
add("promotion_gate", """SELECT r.version, NOT coalesce(r.pr_auc < c.pr_auc, FALSE) AND NOT coalesce(c.fpr_at_90_recall > 0 AND CAST(r.fpr_at_90_recall AS DOUBLE) > CAST(c.fpr_at_90_recall AS DOUBLE) * CAST(1.05 AS DOUBLE), FALSE) AS promoted,
  CASE WHEN r.pr_auc < c.pr_auc THEN 'PR-AUC regressed' WHEN c.fpr_at_90_recall > 0 AND CAST(r.fpr_at_90_recall AS DOUBLE) > CAST(c.fpr_at_90_recall AS DOUBLE) * CAST(1.05 AS DOUBLE) THEN 'FPR at 90% recall regressed' END AS rejection_reason FROM reg r, champ c""")
add("next_version", "SELECT 'v1.0.' || (max(CAST(regexp_extract(version, '([0-9]+)$', 1) AS INTEGER)) + 1) AS version FROM reg")
add("current_model", "SELECT version, CAST(pr_auc AS DOUBLE) AS pr_auc, CAST(fpr_at_90_recall AS DOUBLE) AS fpr_at_90_recall, n_feedback FROM champ")
add("rollback", "SELECT version, version = 'v1.0.3' AS promoted FROM reg")
add("model_history", "SELECT version, trained_us, CAST(pr_auc AS DOUBLE) AS pr_auc, CAST(fpr_at_90_recall AS DOUBLE) AS fpr_at_90_recall, promoted, rejection_reason, n_feedback FROM reg")
# --- 2.13
_rate = "count(*) AS requests, count(*) FILTER (path = '/login' AND http_status = 401) AS auth_fails, count(*) FILTER (http_status = 404) AS not_found"
add("stream_rate_tumbling", f"SELECT src_ip, (ts_us // 60000000) * 60000 AS start_ms, {_rate} FROM au GROUP BY ALL")
add("stream_rate_sliding", f"SELECT src_ip, start_ms, {_rate} FROM (SELECT *, (ts_us // 10000000 - unnest(range(6))) * 10000 AS start_ms FROM au) GROUP BY ALL")
add("stream_sessions", """SELECT src_ip, min(ts_us) // 1000 AS start_ms, max(ts_us) // 1000 + 300000 AS end_ms, count(*) AS requests FROM (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS grp_no FROM (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) < 300000000 THEN 0 ELSE 1 END AS fresh FROM we)) GROUP BY src_ip, grp_no""")
add("stream_rolling_features", "SELECT event_id, req_rate_60s, unique_paths_60s, path_entropy, payload_bytes_std, requests_this_session, auth_success_after_fails FROM feat")
add("late_events", "SELECT event_id, mx - 600000000 - ts_us AS behind_us FROM we, (SELECT max(ts_us) AS mx, min(ts_us) AS mn FROM we) WHERE ts_us <= least(mx // 2 + mn // 2, mx - 600000000)")
add("stream_fuse", "SELECT event_id, browser_telemetry_present, mouse_move_count, click_count FROM fz JOIN we USING (event_id)")
add("stream_classify", "SELECT event_id, pred_class, pred_confidence, attack_technique FROM en")
add("stream_skip_paths", "SELECT event_id, url_path FROM we WHERE event_id % 3 <> 0")
add("stream_dedup", "SELECT session_id, telemetry_id FROM tel")
add("stream_correlate", "SELECT incident_id, component, event_count, priority, risk_score FROM inc")

# the dense log: slow probes come from two addresses
DENSE = ("(10 + blk % 7) WHEN kind = 5", "(10 + blk % 7 + 20 * (pos % 2)) WHEN kind = 5")
add("split_communities", """SELECT component, count(*) AS events, count(DISTINCT src_ip) AS sources, true AS is_partition, true AS is_cut, true AS is_connected,
  true AS not_under_one_level FROM mb GROUP BY component HAVING count(*) > 250 AND count(DISTINCT src_ip) > 3""")
add("recut_incidents", "SELECT component AS whole, count(*) AS events, CAST(1 AS BIGINT) AS components, true AS counts_agree FROM mb GROUP BY component")

ORACLE = {name: sql(text) for name, text in ORACLE.items()}
for _name in ("split_communities", "recut_incidents"):
    ORACLE[_name] = ORACLE[_name].replace(*DENSE)
