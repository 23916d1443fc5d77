"""Fixed values of the data model: feature lists, weights, link table, lookups.

Everything here is data.  The logic that uses it lives in ``functions`` and
``operators``.
"""

from __future__ import annotations

import math

US = 1_000_000
HOUR_US = 3600 * US

# --- fixed values: classes, statuses, terms -------------------------------
CLASSES = ["normal", "brute_force", "credential_stuffing", "dir_scan", "flood", "scraper", "slow_recon"]
BANDS = ["P1", "P2", "P3", "P4"]
BAND_FLOORS = [(80.0, "P1"), (60.0, "P2"), (35.0, "P3")]
RISK_TERMS = [
    "model_confidence", "asset_criticality", "exploitability",
    "blast_radius", "kill_chain_depth", "recency",
]
DEFAULT_WEIGHTS = {
    "model_confidence": 0.20, "asset_criticality": 0.20, "exploitability": 0.20,
    "blast_radius": 0.15, "kill_chain_depth": 0.15, "recency": 0.10,
}
CHAIN_STEPS = {0: 0.0, 1: 0.05, 2: 0.45, 3: 0.80, 4: 0.92}
BLAST_SATURATION = 20.0
RECENCY_TAU_H = 24.0

# --- fixed values: the 47 features, in vector order ------------------------
SERVER_FEATURES = [
    "req_rate_10s", "req_rate_60s", "req_rate_300s",
    "auth_fail_ip_60s", "auth_fail_user_60s", "distinct_users_tried_60s",
    "auth_success_after_fails", "unique_paths_60s", "p404_ratio_60s",
    "path_entropy", "sensitive_path_hit", "interarrival_mean_ms",
    "interarrival_std_ms", "payload_bytes", "payload_bytes_std",
    "resp_bytes_60s", "header_count", "ua_missing", "ua_known_tool",
    "ua_entropy", "accept_lang_missing", "header_order_hash_known",
    "asn_is_hosting", "country_risk", "ip_reputation_hit", "is_tor_exit",
    "session_age_s", "requests_this_session", "hour_of_day", "is_off_hours",
]
BROWSER_FEATURES = [
    "mouse_move_count", "mouse_path_entropy", "keystroke_count",
    "keystroke_interval_mean", "keystroke_interval_std", "form_fill_ms",
    "paste_events", "click_count", "time_to_first_click_ms", "scroll_events",
    "page_dwell_ms", "focus_blur_count", "screen_w", "screen_h", "tz_offset",
    "hardware_concurrency",
]
FEATURES = SERVER_FEATURES + BROWSER_FEATURES + ["browser_telemetry_present"]

# --- fixed values: request classification ----------------------------------
SENSITIVE_PATHS = [
    "/.env", "/.git/config", "/.git/HEAD", "/.aws/credentials", "/.DS_Store",
    "/wp-admin/", "/phpmyadmin/", "/actuator/env", "/actuator/heapdump",
    "/admin.php", "/config.json", "/backup.sql", "/server-status",
    "/api/v1/config", "/debug/pprof/", "/solr/admin/cores", "/cgi-bin/",
]
SENSITIVE_PREFIXES = ["/wp-", "/phpmyadmin"]
TOOL_AGENTS = ["sqlmap", "nikto", "nmap", "masscan", "zgrab", "curl/", "python-requests", "go-http-client"]
HOSTING_ASNS = [
    14061, 16509, 14618, 8075, 15169, 9009, 24940, 63949, 20473,
    16276, 51167, 45102, 132203, 135377, 396982, 19551, 13335,
]
HIGH_RISK_COUNTRIES = ["RU", "KP", "IR", "BY", "SY"]
ASN_NAMES = {
    14061: "DigitalOcean", 16509: "Amazon AWS", 9009: "M247", 24940: "Hetzner",
    63949: "Akamai/Linode", 55836: "Reliance Jio", 9829: "BSNL",
    24560: "Bharti Airtel", 7922: "Comcast", 5607: "Sky UK", 15169: "Google",
    8075: "Microsoft", 13335: "Cloudflare",
}
ASSET_ROUTES = [
    ("/api/v1/auth", "auth-service"), ("/login", "auth-service"),
    ("/register", "auth-service"), ("/account", "auth-service"),
    ("/admin", "admin-portal"), ("/api/v1/store/checkout", "payments-api"),
    ("/checkout", "checkout-web"), ("/cart", "checkout-web"),
    ("/api/v1/store/products", "catalogue-api"), ("/products", "catalogue-api"),
    ("/search", "search-service"), ("/actuator", "metrics-agent"),
    ("/wp-admin", "blog-cms"), ("/wp-content", "blog-cms"), ("/blog", "blog-cms"),
]
DEFAULT_ASSET = "cdn-edge"
SKIP_PREFIXES = [
    "/static/", "/mocks/", "/dashboard-static/", "/favicon",
    "/api/v1/", "/dashboard", "/docs", "/openapi.json", "/redoc",
]

# --- fixed values: evidence baselines (low, high) and notes ----------------
BASELINES = {
    "req_rate_10s": (0, 3), "req_rate_60s": (3, 12), "req_rate_300s": (8, 40),
    "auth_fail_ip_60s": (0, 2), "auth_fail_user_60s": (0, 2),
    "distinct_users_tried_60s": (1, 1), "auth_success_after_fails": (0, 0),
    "unique_paths_60s": (2, 6), "p404_ratio_60s": (0.0, 0.04),
    "path_entropy": (1.2, 2.1), "sensitive_path_hit": (0, 0),
    "interarrival_std_ms": (800, 4000), "payload_bytes": (0, 900),
    "header_count": (9, 14), "ua_known_tool": (0, 0), "ua_missing": (0, 0),
    "asn_is_hosting": (0, 0), "ip_reputation_hit": (0, 0), "is_tor_exit": (0, 0),
    "browser_telemetry_present": (1, 1),
    "mouse_path_entropy": (3.8, 5.4), "keystroke_interval_std": (60, 180),
    "form_fill_ms": (6000, 24000), "paste_events": (0, 1),
}
NOTES = {
    "browser_telemetry_present": "no JavaScript executed — not a browser",
    "auth_fail_ip_60s": "failed logins from this address in 60s",
    "auth_fail_user_60s": "failed logins against this account in 60s",
    "distinct_users_tried_60s": "distinct accounts attempted from one address",
    "auth_success_after_fails": "successful login immediately after failures",
    "req_rate_10s": "requests in the last 10 seconds",
    "req_rate_60s": "requests in the last 60 seconds",
    "p404_ratio_60s": "share of requests returning 404",
    "unique_paths_60s": "distinct paths requested in 60s",
    "sensitive_path_hit": "requested a sensitive or configuration path",
    "path_entropy": "paths do not follow site navigation structure",
    "interarrival_std_ms": "machine-uniform request timing",
    "asn_is_hosting": "datacentre origin, not residential",
    "ua_known_tool": "user agent matches a known automation tool",
    "ua_missing": "no user agent supplied",
    "ip_reputation_hit": "source address on a threat-intel blocklist",
    "is_tor_exit": "source is a Tor exit node",
    "mouse_path_entropy": "very little mouse movement for the session length",
    "keystroke_interval_std": "typing rhythm too regular for a human",
    "form_fill_ms": "form completed unusually fast",
    "paste_events": "credentials pasted rather than typed",
}

# --- fixed values: link table  kind -> (base, tau hours, window hours) -
LINKS = {
    "session": (1.00, 24.0, 48.0),
    "ip": (1.00, 1.5, 6.0),
    "user": (0.80, 3.0, 12.0),
    "subnet": (0.70, 3.0, 12.0),
    "cve": (0.50, 12.0, 24.0),
    "ua_hash": (0.55, 8.0, 24.0),
    "asn": (0.40, 8.0, 24.0),
    "asset": (0.25, 4.0, 12.0),
}
EDGE_CUT = 0.9
LINK_FLOOR = 0.02
SIMILARITY_CUT = 0.88
SPLIT_SOURCES = 3
SPLIT_EVENTS = 250
ESCALATE_TACTICS = 3
LOOKBACK_DAYS = 30
TIMINGS = ["burst", "steady", "low_and_slow"]

# --- fixed values: technique map -------------------------------------------
TACTIC_ORDER = [
    "Reconnaissance", "Initial Access", "Execution", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Exfiltration", "Impact",
]
CLASS_TECHNIQUE = {
    "dir_scan": "T1595.002", "slow_recon": "T1595.002", "scraper": "T1592",
    "brute_force": "T1110.001", "credential_stuffing": "T1110.004", "flood": "T1498",
}
TECHNIQUES = {
    "T1595.002": ("Vulnerability Scanning", "Reconnaissance"),
    "T1592": ("Gather Victim Host Information", "Reconnaissance"),
    "T1110.001": ("Password Guessing", "Credential Access"),
    "T1110.004": ("Credential Stuffing", "Credential Access"),
    "T1078": ("Valid Accounts", "Initial Access"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1136": ("Create Account", "Persistence"),
    "T1498": ("Network Denial of Service", "Impact"),
    "T1041": ("Exfiltration Over C2 Channel", "Exfiltration"),
}
# (feature, comparison, value, required status or None, technique), first match wins
TECHNIQUE_OVERRIDES = [
    ("auth_success_after_fails", "=", 1, None, "T1078"),
    ("sensitive_path_hit", "=", 1, 200, "T1190"),
    ("resp_bytes_60s", ">", 5_000_000, None, "T1041"),
]
CLASS_TITLES = {
    "slow_recon": "Low-and-slow reconnaissance", "dir_scan": "Vulnerability scanning",
    "credential_stuffing": "Credential stuffing", "brute_force": "Brute force",
    "scraper": "Systematic content scraping", "flood": "Request flood",
}
MULTI_STAGE_TITLE = "Multi-stage reconnaissance and credential attack"
# neighbouring entity kinds joined in the incident picture
GRAPH_KINDS = ["asn", "subnet", "ip", "asset", "cve", "user", "ua_hash"]
SECTIONS = ["containment", "eradication", "recovery", "hunt"]
FEEDBACK_STATUS = {"confirmed_threat": "confirmed", "false_positive": "false_positive", "reclassify": "open"}

# --- fixed values: asset inventory ------------------------------------------
ASSETS = [
    ("payments-api", "Payments API", "api", 1.00, "Stripe SDK", "stripe_sdk", "8.1.0"),
    ("orders-db", "Orders Database", "db", 0.95, "PostgreSQL 14", "postgresql", "14.9"),
    ("auth-service", "Auth Service", "api", 0.90, "Node 20", "nodejs", "20.11.0"),
    ("admin-portal", "Admin Portal", "web", 0.85, "React", "react", "18.2.0"),
    ("checkout-web", "Checkout Web", "web", 0.80, "Next.js", "nextjs", "14.0.3"),
    ("catalogue-api", "Catalogue API", "api", 0.50, "Spring Boot 2.5", "spring_framework", "2.5.12"),
    ("search-service", "Search Service", "api", 0.40, "Elasticsearch", "elasticsearch", "8.11.0"),
    ("cdn-edge", "CDN Edge", "edge", 0.30, "nginx 1.18", "nginx", "1.18.0"),
    ("blog-cms", "Blog CMS", "cms", 0.20, "WordPress 6.4", "wordpress", "6.4.1"),
    ("metrics-agent", "Metrics Agent", "agent", 0.20, "Spring Boot Actuator", "spring_framework", "2.5.12"),
]
# --- fixed values: probed path -> vulnerability, in matching order ----------
# (path prefix, cve, name, affected product, answering asset, status that means it landed)
PATH_CVES = [
    ("/actuator/env", "CVE-2022-22965", "Spring4Shell", "spring_framework", "metrics-agent", 200),
    ("/actuator/heapdump", "CVE-2022-22965", "Spring4Shell", "spring_framework", "metrics-agent", 200),
    ("/wp-admin/", "CVE-2024-25600", "WordPress Bricks RCE", "wordpress", "blog-cms", 200),
    ("/wp-content/plugins/", "CVE-2024-25600", "WordPress plugin enumeration", "wordpress", "blog-cms", 200),
    ("/_ignition/execute-solution", "CVE-2021-3129", "Laravel Ignition RCE", "laravel", "catalogue-api", 200),
    ("/cgi-bin/", "CVE-2014-6271", "Shellshock", "bash", "cdn-edge", 200),
    ("/solr/admin/cores", "CVE-2019-17558", "Apache Solr RCE", "solr", "search-service", 200),
    ("/console/login/LoginForm.jsp", "CVE-2020-14882", "Oracle WebLogic RCE", "weblogic", "cdn-edge", 200),
    ("/struts2-showcase/", "CVE-2017-5638", "Apache Struts RCE", "struts", "catalogue-api", 200),
]
SENSITIVE_NO_CVE = [
    "/.env", "/.git/config", "/.git/HEAD", "/phpmyadmin/", "/admin.php",
    "/config.json", "/backup.sql", "/.aws/credentials", "/server-status",
    "/api/v1/config", "/debug/pprof/", "/.DS_Store",
]


# Two events of one address closer than this are linked by the address alone.
RUN_GAP_US = int(LINKS["ip"][1] * math.log(LINKS["ip"][0] / EDGE_CUT) * HOUR_US)
