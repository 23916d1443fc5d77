"""The thirty request features, computed for a whole log in one shuffle by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions import expr as X
from .sweep import Distinct, Total, bucketed, dealt, entropy_from_weight, keyed, sweep

BUCKET_US = 900 * C.US
HALO_US = 300 * C.US
PAYLOAD_ROWS = 100
KEYS = ["tenant_id", "src_ip"]
OLD = "seen_before"          # optional flag: the row only fills trailing windows, it is no request to score
#: What rules and techniques read of the requests before one, and its own columns that they or their readers need.
DECISIVE = frozenset(["req_rate_10s", "req_rate_60s", "auth_fail_ip_60s", "distinct_users_tried_60s", "auth_success_after_fails",
                      "unique_paths_60s", "p404_ratio_60s", "resp_bytes_60s", "last_account"])
OWN = [*KEYS, "event_id", "ts_us", "session_id", "url_path", "http_status"]
#: Features that need counts, first sight and sizes of all earlier requests; the others look back on logins only.
LIFELONG = frozenset(["payload_bytes_std", "session_age_s", "requests_this_session"])


def auth_columns(events: DataFrame) -> DataFrame:
    """Login attempts: ``auth`` 1 = failed, 0 = succeeded, NULL = not a login; the account tried."""
    login = (X.strip_query(F.col("url_path")) == "/login") & F.col("http_status").isin(200, 401)
    return events.withColumns({
        "auth": F.when(login, (F.col("http_status") == 401).cast("int")),
        "account": F.when(login & (F.col("user_id") != ""), F.col("user_id"))})


def _thin_rows(events: DataFrame) -> DataFrame:
    ev = auth_columns(events).withColumns({
        "path": X.strip_query(F.col("url_path")),
        "fail_account": F.when(F.col("auth") == 1, F.col("account")),
        "is_404": (F.col("http_status") == 404).cast("int")})
    thin = KEYS + ["event_id", "ts_us", "path", "auth", "account", "fail_account", "is_404", "payload_bytes", "resp_bytes"]
    carry = [c for c in events.columns if c not in (*KEYS, "event_id", "ts_us", "payload_bytes", "resp_bytes", OLD)]
    if OLD not in events.columns:
        return keyed(bucketed(ev, F.col("ts_us"), BUCKET_US, HALO_US, carry, thin), KEYS)
    rows = bucketed(ev, F.col("ts_us"), BUCKET_US, HALO_US, carry, thin + [OLD])
    return keyed(rows.withColumn("core", F.col("core") & ~F.col(OLD)).drop(OLD), KEYS)


def history_rows(events: DataFrame, by_bucket: bool = True) -> DataFrame:
    """Mergeable facts of each (address, bucket), or of each address.

    Counts, first sight, last account and last login outcome come from a
    map-side-combined aggregate; the last 99 payload sizes from a row-number
    limit that Spark applies before the shuffle.
    """
    ev = auth_columns(events)
    if by_bucket:
        ev = ev.withColumn("bucket", F.floor(F.col("ts_us") / F.lit(BUCKET_US)).cast("long"))
    if OLD in events.columns:
        ev = ev.where(~F.col(OLD))
    by = KEYS + ["bucket"] * by_bucket
    at = F.struct("ts_us", "event_id")
    facts = ev.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"),
        F.max_by("account", F.when(F.col("account").isNotNull(), at)).alias("acct"),
        F.max_by("auth", F.when(F.col("auth").isNotNull(), at)).alias("outcome"),
        *([] if by_bucket else [F.max("ts_us").alias("last_us")]))
    recent = (ev.select(*by, "ts_us", "event_id", "payload_bytes")
              .withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts_us"), F.desc("event_id"))))
              .where(F.col("rn") < PAYLOAD_ROWS)
              .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rn", "payload_bytes"))).alias("tail")))
    return facts.join(recent, by, "left")


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per address from its earlier row and its newer one (``history_rows`` without buckets)."""
    o, n = ({c: F.col(f"{side}.{c}") for c in old.columns} for side in ("o", "n"))
    both = F.concat(F.coalesce(n["tail"], F.array()), F.coalesce(o["tail"], F.array()))
    same = [o[k].eqNullSafe(n[k]) for k in KEYS]
    return old.alias("o").join(new.alias("n"), same[0] & same[1], "full").select(
        *[F.coalesce(n[k], o[k]).alias(k) for k in KEYS],
        (F.coalesce(o["n"], F.lit(0)) + F.coalesce(n["n"], F.lit(0))).alias("n"), F.coalesce(o["first_us"], n["first_us"]).alias("first_us"),
        F.coalesce(n["acct"], o["acct"]).alias("acct"), F.coalesce(n["outcome"], o["outcome"]).alias("outcome"),
        F.coalesce(n["last_us"], o["last_us"]).alias("last_us"), F.slice(both, 1, PAYLOAD_ROWS - 1).alias("tail"))


def _login_history(events: DataFrame) -> DataFrame:
    """``_history`` for the last account and login outcome alone: addresses without a login have none and are left out."""
    by = KEYS + ["bucket"]
    ev = auth_columns(events)
    ev = ev.join(ev.where(F.col("auth").isNotNull()).select(*KEYS).distinct(), KEYS, "left_semi")
    at = F.struct("ts_us", "event_id")
    h = ev.withColumn("bucket", F.floor(F.col("ts_us") / F.lit(BUCKET_US)).cast("long")).groupBy(*by).agg(
        F.max_by("account", F.when(F.col("account").isNotNull(), at)).alias("acct"),
        F.max_by("auth", F.when(F.col("auth").isNotNull(), at)).alias("outcome"))
    past = W.partitionBy(*KEYS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    h = h.withColumns({"past_acct": F.last("acct", True).over(past), "past_outcome": F.last("outcome", True).over(past)})
    return keyed(h, KEYS).select("gk", *by, "past_acct", "past_outcome")


def _history(events: DataFrame, prior: DataFrame | None) -> DataFrame:
    """What each (address, bucket) inherits from earlier buckets: one small row per non-empty bucket.

    ``prior`` holds history rows of earlier runs, with buckets below any of this one's.
    """
    by = KEYS + ["bucket"]
    h = history_rows(events)
    if prior is not None:
        h = h.unionByName(prior)
    past = W.partitionBy(*KEYS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # 99 earlier buckets always hold the last 99 requests: each has at least one
    near = W.partitionBy(*KEYS).orderBy(F.desc("bucket")).rowsBetween(1, PAYLOAD_ROWS - 1)
    h = h.withColumns({
        "past_n": F.coalesce(F.sum("n").over(past), F.lit(0)), "past_first_us": F.min("first_us").over(past),
        "past_acct": F.last("acct", True).over(past), "past_outcome": F.last("outcome", True).over(past),
        # newest first, because the frame runs backwards in time
        "past_sizes": F.slice(F.transform(F.flatten(F.collect_list("tail").over(near)), lambda r: r["payload_bytes"]),
                              1, PAYLOAD_ROWS - 1)})
    return keyed(h, KEYS).select("gk", *by, "past_n", "past_first_us", "past_acct", "past_outcome", "past_sizes")


def _prefix_total(sizes: Column, k: Column, squared: bool) -> Column:
    part = F.slice(sizes, F.lit(1), F.greatest(k, F.lit(0)))
    return F.aggregate(part, F.lit(0).cast("long"), lambda acc, v: acc + (v * v if squared else v))


def _population_std(n: Column, s1: Column, s2: Column) -> Column:
    """Population deviation from exact integer moments: sqrt(n*S2 - S1^2)/n."""
    dec = "decimal(19,0)"
    num = (n.cast(dec) * s2.cast(dec) - s1.cast(dec) * s1.cast(dec)).cast("double")
    return F.when(n > 1, F.sqrt(num) / n.cast("double")).otherwise(F.lit(0.0))


def rolling_features(events: DataFrame, prior: DataFrame | None = None, n: int | None = None,
                     only: frozenset | None = None) -> DataFrame:
    """All history-dependent features of a request, plus its own columns.

    Adds the ``*_60s`` family, the session counters and ``last_account``.  ``n`` partitions, where given (``sweep.parts``).
    ``only`` names the features to add, where not all are asked for: no mark is laid and no history kept for the others.
    """
    def asked(*names: str) -> bool:
        return only is None or not only.isdisjoint(names)

    rows = dealt(_thin_rows(events), KEYS, n)
    by = ["gk", *KEYS, "bucket"]
    seq = W.partitionBy(*by).orderBy("ts_us", "event_id")
    so_far = seq.rowsBetween(W.unboundedPreceding, 0)
    before = seq.rowsBetween(W.unboundedPreceding, -1)
    core = F.col("core")
    gap_in = F.col("ts_us") - F.lag("ts_us").over(seq)
    gap_out = F.lead("ts_us").over(seq) - F.col("ts_us")
    size = F.when(core, F.col("payload_bytes")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({
        "gap_in": F.when(gap_in <= 60 * C.US, gap_in),
        "gap_out": F.when(gap_out <= 60 * C.US, gap_out),
        "age_us": F.col("ts_us") - F.min(F.when(core, F.col("ts_us"))).over(so_far),
        "rank": F.sum(core.cast("int")).over(so_far),
        "size_s1": F.sum(size).over(so_far), "size_s2": F.sum(size * size).over(so_far),
        "acct_here": F.last(F.when(core, F.col("account")), True).over(so_far),
        "outcome_here": F.last(F.when(core, F.col("auth")), True).over(before)})
    rows = rows.withColumns({
        "lag_s1": F.lag("size_s1", PAYLOAD_ROWS, 0).over(seq), "lag_s2": F.lag("size_s2", PAYLOAD_ROWS, 0).over(seq)})
    one = F.lit(1)
    gaps_of, paths_of = ("interarrival_mean_ms", "interarrival_std_ms"), ("unique_paths_60s", "path_entropy")
    totals = [t for t, names in [
        (Total("req_rate_10s", one, 10), ["req_rate_10s"]),
        (Total("req_rate_60s", one, 60), ["req_rate_60s", "p404_ratio_60s", "path_entropy", *gaps_of]),
        (Total("req_rate_300s", one, 300), ["req_rate_300s"]),
        (Total("auth_fail_ip_60s", F.col("auth"), 60), ["auth_fail_ip_60s"]), (Total("n_404", F.col("is_404"), 60), ["p404_ratio_60s"]),
        (Total("resp_bytes_60s", F.col("resp_bytes"), 60), ["resp_bytes_60s"]),
        # a gap is inside the window while its earlier request is: it arrives with the later one
        (Total("gap_sum", F.col("gap_in"), 60, F.col("gap_out")), gaps_of),
        (Total("gap_sq", F.col("gap_in") * F.col("gap_in"), 60, F.col("gap_out") * F.col("gap_out")), gaps_of)] if asked(*names)]
    distincts = [d for d, names in [
        (Distinct("unique_paths_60s", F.col("path"), 60, entropy="path_entropy" if asked("path_entropy") else None), paths_of),
        (Distinct("distinct_users_tried_60s", F.col("fail_account"), 60), ["distinct_users_tried_60s"])] if asked(*names)]
    swept = sweep(rows, KEYS, totals, distincts,
                  [Total("here_n", one, 0)] if asked("requests_this_session") else [])
    whole = prior is not None or asked(*LIFELONG)
    h = swept.join(_history(events, prior) if whole else _login_history(events), by, "left")
    n60 = F.col("req_rate_60s")
    gaps = n60 - 1
    rank = F.col("rank")
    short = rank < PAYLOAD_ROWS
    need = F.lit(PAYLOAD_ROWS) - rank
    past = F.coalesce(F.col("past_n"), F.lit(0))
    size_n = F.least(F.lit(PAYLOAD_ROWS), past + rank)

    def size_total(col: str, squared: bool) -> Column:
        return F.col(f"size_{col}") - F.when(short, F.lit(0)).otherwise(F.col(f"lag_{col}")) + F.when(
            short, _prefix_total(F.col("past_sizes"), need, squared)).otherwise(F.lit(0))

    last_account = F.coalesce("acct_here", "past_acct")
    previous = F.coalesce("outcome_here", "past_outcome")
    gap_ms = F.col("gap_sum") / F.lit(1000.0)
    added = {
        "last_account": last_account,
        "req_rate_10s": F.col("req_rate_10s"), "req_rate_60s": n60, "req_rate_300s": F.col("req_rate_300s"),
        "auth_fail_ip_60s": F.col("auth_fail_ip_60s"), "distinct_users_tried_60s": F.col("distinct_users_tried_60s"),
        "auth_success_after_fails": F.when((F.col("auth") == 0) & (previous == 1), 1).otherwise(0),
        "unique_paths_60s": F.col("unique_paths_60s"),
        "p404_ratio_60s": X.half_up(F.col("n_404") / n60, 4),
        "path_entropy": X.half_up(entropy_from_weight(n60, F.col("_path_entropy_w")), 4),
        "interarrival_mean_ms": X.half_up(F.when(gaps > 0, gap_ms / gaps).otherwise(0.0), 2),
        "interarrival_std_ms": X.half_up(F.when(gaps > 0, _gap_std(gaps)).otherwise(0.0), 2),
        "payload_bytes_std": X.half_up(_population_std(size_n, size_total("s1", False), size_total("s2", True)), 2),
        "resp_bytes_60s": F.col("resp_bytes_60s"),
        "session_age_s": X.half_up((F.col("ts_us") - F.coalesce("past_first_us", F.col("ts_us") - F.col("age_us"))) / F.lit(1e6), 2),
        "requests_this_session": past + F.col("here_n")}
    return h.select(*KEYS, "event_id", "ts_us", "row.*", "payload_bytes", "resp_bytes", "auth", "account",
                    *[c.alias(name) for name, c in added.items() if asked(name)])


def _gap_std(gaps: Column) -> Column:
    """Population deviation of the gaps, in ms, from exact microsecond integers."""
    dec = "decimal(19,0)"
    num = (gaps.cast(dec) * F.col("gap_sq").cast(dec) - F.col("gap_sum").cast(dec) * F.col("gap_sum").cast(dec))
    return F.sqrt(num.cast("double")) / gaps.cast("double") / F.lit(1000.0)


def account_failures(rows: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """Failed logins, from any address, on the account each request's address last tried.

    Requests are regrouped by that account; requests without one are spread
    evenly by a salt instead of meeting in one NULL group.
    """
    salt = F.concat(F.lit("~"), F.pmod(F.xxhash64("event_id"), F.lit(4096)).cast("string"))
    probes = rows.withColumns({
        "acct_key": F.coalesce(F.col("last_account"), salt), "failed": F.lit(0),
        "bucket": F.floor(F.col("ts_us") / F.lit(BUCKET_US)).cast("long"), "core": F.lit(True)})
    probes = keyed(probes, ["tenant_id", "acct_key"]).select("gk", "tenant_id", "acct_key", "bucket", "core", "ts_us", "failed",
                           F.struct(*rows.columns).alias("row"))
    fails = auth_columns(events).where((F.col("auth") == 1) & F.col("account").isNotNull()).select(
        "tenant_id", F.col("account").alias("acct_key"), "ts_us", F.lit(1).alias("failed"))
    halo = F.explode(F.array(F.lit(0), F.lit(1)))
    fails = fails.withColumn("ahead", halo).withColumn(
        "bucket", F.floor(F.col("ts_us") / F.lit(BUCKET_US)).cast("long") + F.col("ahead"))
    # a failure matters to the next bucket only if it is within a minute of its start
    fails = fails.where((F.col("ahead") == 0) | (F.col("bucket") * BUCKET_US - F.col("ts_us") <= 60 * C.US))
    fails = keyed(fails, ["tenant_id", "acct_key"]).select(
        "gk", "tenant_id", "acct_key", "bucket", F.lit(False).alias("core"), "ts_us", "failed",
        F.lit(None).cast(probes.schema["row"].dataType).alias("row"))
    both = dealt(probes.unionByName(fails), ["tenant_id", "acct_key"], n)
    out = sweep(both, ["tenant_id", "acct_key"], [Total("auth_fail_user_60s", F.col("failed"), 60)])
    return out.select("row.*", "auth_fail_user_60s")


def server_features(events: DataFrame, reputation: DataFrame, prior: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """All thirty request features for every event, with the event's own columns.

    ``reputation`` is (ip, reputation_source, is_tor).  It is joined without a
    hint: the planner broadcasts it only while it is small.
    """
    rows = account_failures(rolling_features(events, prior, n), events, n)
    rep = reputation.withColumnRenamed("ip", "src_ip")
    rows = rows.join(rep, "src_ip", "left")
    return rows.withColumns({
        **_decisive_facts(), **_other_facts(), **_late_facts(),
        "last_user": X.user_hash(F.col("last_account"))}).drop("is_tor")


def _decisive_facts() -> dict[str, Column]:
    """Features of the request alone that rules and techniques read."""
    ua = F.col("user_agent")
    return {
        "sensitive_path_hit": X.sensitive_path(F.col("url_path")),
        "ua_missing": (F.coalesce(ua, F.lit("")) == "").cast("int"),
        "ua_known_tool": X.known_tool(ua),
        "asn_is_hosting": F.coalesce(F.col("asn").isin(C.HOSTING_ASNS), F.lit(False)).cast("int")}


def _other_facts() -> dict[str, Column]:
    """Features of the request alone that only the model reads."""
    return {
        "ua_entropy": X.half_up(X.text_entropy(F.col("user_agent")), 4),
        "accept_lang_missing": (F.coalesce("accept_lang", F.lit("")) == "").cast("int"),
        "country_risk": F.when(F.col("country").isin(C.HIGH_RISK_COUNTRIES), 0.8).otherwise(0.1)}


def _late_facts() -> dict[str, Column]:
    """Features of the time and of the address's reputation."""
    hour = F.hour(F.timestamp_micros("ts_us"))
    return {
        "header_order_hash_known": F.lit(1),
        "ip_reputation_hit": F.col("reputation_source").isNotNull().cast("int"),
        "is_tor_exit": F.coalesce("is_tor", F.lit(0)),
        "hour_of_day": hour, "is_off_hours": ((hour < 6) | (hour >= 22)).cast("int")}


def decisive_features(events: DataFrame, n: int | None = None) -> DataFrame:
    """The features of ``server_features`` that rules and techniques read, for every event, with the columns ``OWN``.

    The others are never computed, so less is ordered, carried through the shuffles and looked back on.
    """
    ev = events.select(*OWN, "user_id", "asn", "user_agent", "payload_bytes", "resp_bytes")
    facts = list(_decisive_facts())
    rows = rolling_features(ev.withColumns(_decisive_facts()).drop("asn", "user_agent"), n=n, only=DECISIVE)
    return account_failures(rows.select(*OWN, *facts, *sorted(DECISIVE)), ev, n).drop("last_account")


def model_features(events: DataFrame, reputation: DataFrame, n: int | None = None) -> DataFrame:
    """The thirty features of ``server_features`` for every event, with the columns ``OWN``.

    What a feature needs of agent, country and language is computed before the shuffles, which carry numbers instead of texts.
    """
    facts = _decisive_facts() | _other_facts()
    ev = events.select(*OWN, "user_id", "asn", "user_agent", "country", "accept_lang", "header_count", "payload_bytes", "resp_bytes")
    rows = rolling_features(ev.withColumns(facts).drop("asn", "user_agent", "country", "accept_lang"), n=n)
    late = _late_facts()
    kept = [f for f in C.SERVER_FEATURES if f not in late and f != "auth_fail_user_60s"]
    rows = account_failures(rows.select(*OWN, "last_account", *kept), ev, n).drop("last_account")
    rows = rows.join(reputation.withColumnRenamed("ip", "src_ip"), "src_ip", "left")
    return rows.withColumns(late).drop("reputation_source", "is_tor")
