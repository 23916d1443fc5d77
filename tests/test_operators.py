"""Worked examples, and operators against brute force on small inputs."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from caseweave import constants as C
from caseweave.functions import expr as X
from caseweave.operators import campaigns, classify, communities, enrich, features, fusion, graph, incidents, model, review, sweep
from caseweave import session
from caseweave.session import cut  # noqa: E402
from caseweave.plans import pipeline as P
from caseweave.plans.oracle import ORACLE
from caseweave.plans.queries import QUERIES
from caseweave.sources import events as E, feeds as feeds_mod
from caseweave.sources.feeds import Feeds
from caseweave.streaming import live, replay

EVENT_DDL = ("tenant_id string, event_id bigint, ts_us bigint, session_id string, src_ip string, asn int, country string, user_id string, "
             "url_path string, http_status int, payload_bytes bigint, resp_bytes bigint, user_agent string, accept_lang string, header_count int")


def make(spark, rows):
    base = dict(tenant_id="t", session_id=None, src_ip="203.0.113.9", asn=64500, country="NL", user_id=None, url_path="/", http_status=200,
                payload_bytes=0, resp_bytes=0, user_agent="ua", accept_lang="en", header_count=5)
    cols = [c.split()[0] for c in EVENT_DDL.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[c] for c in cols) for r in rows], EVENT_DDL)


def feeds(spark, bad_ips=()):
    empty = spark.createDataFrame([], "ip string")
    kev = spark.createDataFrame([("CVE-2022-22965", "2022-04-04")], "cve string, kev_added string")
    epss = spark.createDataFrame([("CVE-2022-22965", 0.9)], "cve string, epss double")
    return Feeds(kev, epss, spark.createDataFrame([(i,) for i in bad_ips], "ip string"), empty)


# --- enrichment -------------------------------------------------------------------------------

def test_probe_cases(spark):
    ev = make(spark, [
        dict(event_id=1, ts_us=0, url_path="/actuator/env", http_status=200, asn=14061), dict(event_id=2, ts_us=1, url_path="/actuator/env?x=1", http_status=404),
        dict(event_id=3, ts_us=2, url_path="/products", asn=55836), dict(event_id=4, ts_us=3, url_path="/.env", src_ip="198.51.100.7"),
        dict(event_id=5, ts_us=4, url_path="/cgi-bin/x", http_status=404)])
    got = {r.event_id: r for r in enrich.enrich(ev, feeds(spark, ["198.51.100.7"])).collect()}
    assert got[1].exploitability == 1.0 and got[1].matched_asset == "metrics-agent" and got[1].in_kev
    assert got[2].exploitability == 0.45 and got[2].cve == "CVE-2022-22965"
    assert got[3].exploitability == 0.0 and got[3].cve is None
    assert got[4].exploitability == pytest.approx(0.40) and got[4].reputation_source == "Feodo Tracker"
    assert got[5].exploitability == 0.15 and got[5].matched_asset is None


def test_feed_parsing(spark, tmp_path):
    (tmp_path / "kev.json").write_text('{"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2020-01-01"}, {"cveID": "CVE-2", "dateAdded": "2021-01-01"}]}')
    (tmp_path / "epss.json").write_text('{"CVE-1": 0.5}')
    (tmp_path / "ips.txt").write_text("# note\n\n 1.2.3.4 \n1.2.3.4\n5.6.7.8\n")
    assert feeds_mod.read_kev(spark, str(tmp_path / "kev.json")).count() == 2
    assert feeds_mod.read_epss(spark, str(tmp_path / "epss.json")).collect()[0].epss == 0.5
    assert sorted(r.ip for r in feeds_mod.read_blocklist(spark, str(tmp_path / "ips.txt")).collect()) == ["1.2.3.4", "5.6.7.8"]


def test_expressions(spark):
    df = spark.createDataFrame([("1.2.3.4", "/debug/pprof/"), ("1.2.3.400", "/api/v1/store/checkout?a=1"), (None, "/wp-x")], "ip string, p string")
    got = df.select(X.subnet24(F.col("ip")), X.sensitive_path(F.col("p")), X.asset_for_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("1.2.3.0/24", 1, "cdn-edge"), (None, 0, "payments-api"), (None, 1, "cdn-edge")]


# --- trailing features against brute force -------------------------------------------------------

def brute(rows):
    out = {}
    for r in rows:
        mine = sorted((q for q in rows if q["src_ip"] == r["src_ip"] and q["ts_us"] <= r["ts_us"]), key=lambda q: (q["ts_us"], q["event_id"]))
        win = lambda s: [q for q in mine if q["ts_us"] >= r["ts_us"] - s * C.US]
        w60 = win(60)
        paths = [q["url_path"].split("?")[0] for q in w60]
        share = [paths.count(p) / len(paths) for p in set(paths)]
        gaps = [(b["ts_us"] - a["ts_us"]) / 1000 for a, b in zip(w60, w60[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0
        upto = [q for q in mine if (q["ts_us"], q["event_id"]) <= (r["ts_us"], r["event_id"])]
        last = [q["payload_bytes"] for q in upto][-100:]
        pm = sum(last) / len(last)
        out[r["event_id"]] = (
            len(win(10)), len(w60), len(win(300)), len(set(paths)), -sum(s * math.log2(s) for s in share),
            len({q["user_id"] for q in w60 if q["http_status"] == 401}),
            math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0,
            math.sqrt(sum((v - pm) ** 2 for v in last) / len(last)), len(mine))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_features_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, clock = [], {}
    for i in range(700):
        ip = "10.0.0.1" if rnd.random() < 0.6 else f"10.0.0.{rnd.randint(2, 5)}"      # one hot address
        step = rnd.choice([0.2, 1, 5, 30, 59.999999, 60, 60.000001, 300, 2000])       # window and bucket edges
        clock[ip] = clock.get(ip, 1_700_000_000_000_000) + int(step * C.US)
        login = rnd.random() < 0.4
        rows.append(dict(event_id=i, ts_us=clock[ip], src_ip=ip, url_path="/login" if login else f"/p{rnd.randint(1, 4)}?q={i}",
                         http_status=rnd.choice([200, 401, 401]) if login else rnd.choice([200, 404]),
                         user_id=f"u{rnd.randint(1, 4)}" if login else None, payload_bytes=rnd.randint(0, 2000)))
    got = features.rolling_features(make(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for g in got:
        mine = (g.req_rate_10s, g.req_rate_60s, g.req_rate_300s, g.unique_paths_60s, g.path_entropy, g.distinct_users_tried_60s,
                g.interarrival_std_ms, g.payload_bytes_std, g.requests_this_session)
        assert mine == pytest.approx(want[g.event_id], abs=0.0051), g


def test_success_without_failures_is_no_intrusion(spark):
    ev = make(spark, [dict(event_id=1, ts_us=0, url_path="/login", user_id="a"), dict(event_id=2, ts_us=5, url_path="/login", http_status=401, user_id="a"),
                      dict(event_id=3, ts_us=9, url_path="/login", user_id="a"), dict(event_id=4, ts_us=12, url_path="/login", user_id="a")])
    flags = {r.event_id: r.auth_success_after_fails for r in features.rolling_features(ev).collect()}
    assert flags == {1: 0, 2: 0, 3: 1, 4: 0}


def test_absent_sensor_is_null_not_zero(spark):
    ev = make(spark, [dict(event_id=1, ts_us=1_000 * C.US, session_id="s1"), dict(event_id=2, ts_us=1_901 * C.US, session_id="s1"), dict(event_id=3, ts_us=5, session_id=None)])
    tel = spark.createDataFrame([("t", "s1", 1_000 * C.US) + (0.0,) * 16], "tenant_id string, session_id string, ts_us bigint, " + ", ".join(f"{c} double" for c in C.BROWSER_FEATURES))
    got = {r.event_id: r for r in fusion.fuse_telemetry(ev, tel).collect()}
    assert got[1].browser_telemetry_present == 1 and got[1].click_count == 0.0
    for i in (2, 3):
        assert got[i].browser_telemetry_present == 0 and all(got[i][c] is None for c in C.BROWSER_FEATURES)


# --- graph ----------------------------------------------------------------------------------------

def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
def test_components_equal_union_find(spark, kind):
    rnd = random.Random(5)
    ids = rnd.sample(range(10_000), 400)
    if kind == "random":
        edges = [tuple(rnd.sample(ids, 2)) for _ in range(260)]
    elif kind == "chain":
        edges = list(zip(ids, ids[1:]))
    else:
        edges = [(ids[0], i) for i in ids[1:300]] + list(zip(ids[300:], ids[301:]))
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in graph.components(df).collect()}
    want = union_find({n for e in edges for n in e}, edges)
    assert got == want


def seeds_of(spark, rows):
    ev = make(spark, rows).withColumns({"asset_id": F.lit(None).cast("string"), "cve": F.lit(None).cast("string")})
    return ev


def brute_components(rows):
    """The definition, without runs or slices: neighbours in time of any entity, summed over all they share."""
    weight, shares = {}, lambda k, a, b: [p for n, p in kinds(a, b) if n == k][0]
    kinds = lambda a, b: [("ip", a["src_ip"] == b["src_ip"]), ("subnet", a["src_ip"].rsplit(".", 1)[0] == b["src_ip"].rsplit(".", 1)[0]),
                          ("user", bool(a.get("user_id")) and a.get("user_id") == b.get("user_id")), ("asn", True)]
    line = sorted(rows, key=lambda r: (r["ts_us"], r["event_id"]))
    for i, a in enumerate(line):
        near = [next((b for b in line[i + 1:] if shares(k, a, b)), None) for k in ("ip", "subnet", "user", "asn")]
        for b in (b for b in near if b is not None):
            gap = abs(a["ts_us"] - b["ts_us"]) / C.HOUR_US
            w = 0.0
            for k, same in kinds(a, b):
                base, tau, window = C.LINKS[k]
                x = base * math.exp(-gap / tau)
                if same and gap <= window and x >= C.LINK_FLOOR:
                    w += x
            if round(w, 9) >= C.EDGE_CUT:
                weight[(a["event_id"], b["event_id"])] = w
    return union_find([r["event_id"] for r in rows], weight)


def test_run_components_equal_the_definition(spark):
    rnd = random.Random(11)
    t, rows = 1_700_000_000 * C.US, []
    for i in range(220):
        t += int(rnd.choice([20, 400, 569, 1500, 4000]) * C.US)
        rows.append(dict(event_id=1000 - i, ts_us=t, src_ip=f"10.0.{rnd.randint(0, 2)}.{rnd.randint(1, 3)}", user_id=rnd.choice([None, "a", "b", "c"])))
    ev = seeds_of(spark, rows)
    runs = graph.run_map(ev)
    got = {r.event_id: r.component for r in graph.on_runs(ev, graph.run_components(ev, runs).drop("run_id")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("n", [2, 399, 400, 401])
def test_one_rule_links_entities_of_any_size(spark, n):
    ev = seeds_of(spark, [dict(event_id=i, ts_us=i * 60 * C.US, asn=0) for i in range(n)])
    index = cut(graph.entity_index(graph.entities_of(graph.with_values(ev), keep=["vals"]), keep=["vals"]))
    pairs = graph.neighbour_pairs(index)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i + 1) for i in range(n - 1)}
    assert graph.chain_links(index).where("kind = 'ip'").count() == n - 1
    shared = {r.kind for r in graph.pair_links(pairs).select("kind").distinct().collect()}
    assert {"ip", "subnet"} <= shared and graph.edge_weights(pairs).count() == n - 1


def test_flood_of_one_address_is_one_node(spark):
    ev = seeds_of(spark, [dict(event_id=i, ts_us=i * 200_000) for i in range(5000)])
    runs = graph.run_map(ev)
    assert runs.select("run_id").distinct().collect() == [(0,)]
    assert graph.run_components(ev, runs).select("component").distinct().count() == 1


def test_dense_component_is_recut_in_the_flow_and_small_ones_are_not(spark, folder):
    whole = P.incident_table(spark, folder)
    assert communities.oversized(P.seeds(spark, folder), P.membership(spark, folder)).count() == 0
    assert P.correlate(P.seeds(spark, folder)).exceptAll(P.membership(spark, folder)).isEmpty()
    cut_up = P.incident_table(spark, folder, dense=True).select("component", "event_count").collect()
    assert whole.where("event_count = 259").count() == 1 and all(r["event_count"] < 259 for r in cut_up)
    parts = P.member_events(spark, folder, dense=True).groupBy("component").count().collect()
    assert sum(r["count"] for r in parts) == P.seeds(spark, folder, dense=True).count()
    assert len(parts) > whole.count()


def test_levels_join_cliques_of_cliques(spark):
    """Four triangles, two and two tied more closely: level by level, and never a community without inner links."""
    tri = lambda k: [(3 * k, 3 * k + 1, 10.0), (3 * k + 1, 3 * k + 2, 10.0), (3 * k, 3 * k + 2, 10.0)]
    links = [e for k in range(4) for e in tri(k)] + [(0, 3, 4.0), (1, 4, 4.0), (6, 9, 4.0), (7, 10, 4.0), (2, 8, 0.1)]
    edges = spark.createDataFrame([(0, u, v, w) for a, b, w in links for u, v in ((a, b), (b, a))], "component long, u long, v long, w double")
    strength = communities._strength(edges)
    found = communities.levels(edges)
    q = [communities.modularity(edges, strength, x).first()["q"] for x in found]
    assert q == sorted(q)
    final = {r["node"]: r["community"] for r in found[-1].collect()}
    assert all(len({final[3 * k + i] for i in range(3)}) == 1 for k in range(4)) and final[0] != final[6]
    torn = spark.createDataFrame([(0, n, 0) for n in range(12) if n not in (3, 4, 5)] + [(0, n, 1) for n in (3, 4, 5)], "component long, node long, community long")
    apart = {r["node"]: r["community"] for r in communities.connected(edges.where("w <> 0.1"), torn).collect()}
    assert apart[0] == 0 and apart[3] == 3 and apart[6] == apart[9] == 6


# --- scoring, campaigns, review -------------------------------------------------------------------

def test_breakdown_sums_to_score(spark):
    df = spark.createDataFrame([(0.9, 0.9, 1.0, 1, 4, 3)], "c double, a double, e double, na bigint, nu bigint, d bigint")
    terms = X.risk_term_columns(F.col("c"), F.col("a"), F.col("e"), F.col("na"), F.col("nu"), F.col("d"), F.lit(0), F.lit(0))
    r = df.select(X.weighted_risk(terms).alias("risk"), X.risk_breakdown(terms).alias("b")).first()
    assert abs(sum(t.points for t in r.b) - r.risk) < 0.2
    assert [t.term for t in r.b] == C.RISK_TERMS


def test_best_match_equals_brute_force(spark):
    rnd = random.Random(3)
    techs, rows = sorted(C.TECHNIQUES), []
    for i in range(120):
        prof = [0.0] * 24
        for hh in rnd.sample(range(8), rnd.randint(1, 3)):
            prof[hh] = round(rnd.random(), 3)
        rows.append(("t", f"INC-{i:04d}", i // 2 * 10, sorted(rnd.sample(techs[:4], rnd.randint(1, 3))), rnd.choice(C.TIMINGS), prof,
                     round(rnd.random() * 6, 2), sorted(rnd.sample(["1", "2", "3"], rnd.randint(0, 2)))))
    ddl = "tenant_id string, incident_id string, opened_us bigint, techniques array<string>, timing_bucket string, hour_profile array<double>, event_count_log double, asns array<string>"
    df = spark.createDataFrame(rows, ddl)
    got = {r.target: (r.match, round(r.score, 6)) for r in campaigns.best_matches(df, df).collect()}
    want = {}
    for _, i, o, t, tb, hp, ecl, asn in rows:
        best = (0.0, None)
        for _, j, oj, tj, tbj, hpj, eclj, asnj in rows:
            if oj >= o or not set(t) & set(tj):
                continue
            vec = lambda tt, b, hh, e: [float(x in tt) for x in techs] + [float(b == x) for x in C.TIMINGS] + hh + [min(1.0, e / 10)]
            a, b = vec(t, tb, hp, ecl), vec(tj, tbj, hpj, eclj)
            s = sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a)) / math.sqrt(sum(q * q for q in b))
            s = round(min(1.0, s + 0.05) if set(asn) & set(asnj) else s, 9)
            if s > best[0]:
                best = (s, j)
        if best[0] >= C.SIMILARITY_CUT:
            want[i] = (best[1], round(best[0], 6))
    assert got == want


def test_incident_numbers_follow_opening_order(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([("t", i, rnd.randint(0, 10**10)) for i in range(300)], "tenant_id string, component bigint, opened_us bigint")
    got = incidents.numbered(df).orderBy("opened_us", "component").select("incident_id").collect()
    assert [r.incident_id for r in got] == [f"INC-{i:04d}" for i in range(1, 301)]


def test_consumed_only_when_promoted(spark):
    fb = spark.createDataFrame([(1, None), (2, "v0")], "feedback_id bigint, consumed_by string")
    used = spark.createDataFrame([(1,)], "feedback_id bigint")
    stamp = lambda ok: {r.feedback_id: r.consumed_by for r in review.mark_consumed(fb, used, "v1", ok).collect()}
    assert stamp(True) == {1: "v1", 2: "v0"} and stamp(False) == {1: None, 2: "v0"}


def test_rules_beat_the_model(spark):
    df = spark.createDataFrame([("flood", 0.8, "flood", "normal", 0.99), ("normal", 0.95, None, "scraper", 0.7), ("flood", 0.8, "flood", "flood", 0.9)],
                               "pred_class string, pred_confidence double, rule string, model_class string, model_confidence double")
    got = [(r.final_class, r.final_confidence) for r in classify.classify_with_model(df).collect()]
    assert got == [("flood", 0.8), ("scraper", 0.7), ("flood", 0.9)]


def test_groups_never_straddle_the_split(spark, folder):
    rows = model.grouped_holdout(model.training_set(P.scored_events(spark, folder)))
    assert rows.groupBy("group_key").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0


# --- streaming ----------------------------------------------------------------------------------------

def test_stream_in_slices_equals_batch(spark, folder):
    from caseweave.sources.events import web_events
    ev = web_events(spark, folder)
    batch = features.rolling_features(ev)
    stream = replay.in_slices(ev, live.rolling_features).select(*batch.columns)
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()


def test_shuffled_and_late_rows(spark, folder):
    """Rows shuffled within the delay change nothing; late ones are kept apart, and what a batch reads does not grow."""
    import os
    from caseweave.sources.events import web_events
    ev = web_events(spark, folder)
    late = (F.col("event_id") % 50 == 7) & (F.col("event_id") < 400)
    last = ev.agg(F.max("ts_us")).first()[0]
    shuffled = F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(480)) * 1_000_000
    state, sizes = replay.scratch(spark, "state-test"), []

    def start(stream, folder, out):
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/late/" not in d)
        sizes.append((size, len(os.listdir(f"{folder}/recent")) if os.path.isdir(f"{folder}/recent") else 0))
        return live.rolling_features(stream, folder, out)

    stream = replay.in_slices(ev, start, 4, F.when(late, F.lit(last + 480_000_000)).otherwise(shuffled), state)
    batch = features.rolling_features(ev.where(~late))
    stream = stream.select(*batch.columns)
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()
    gone = live.AddressState(state, 0).late_rows(spark).collect()
    assert sorted(r["event_id"] for r in gone) == list(range(7, 400, 50)) and all(r["mark_us"] >= r["ts_us"] for r in gone)
    assert all(n <= 2 for _, n in sizes) and max(s for s, _ in sizes[3:]) < 1.6 * max(s for s, _ in sizes[1:3])


def test_idle_addresses_are_forgotten(spark, folder):
    from caseweave.sources.events import web_events
    ev = web_events(spark, folder).where("kind = 4 or kind = 9")
    state = replay.scratch(spark, "ttl-test")
    replay.in_slices(ev, lambda st, f, o: live.rolling_features(st, f, o, ttl="1 hour"), folder=state).count()
    assert spark.read.parquet(f"{state}/life/version=3").isEmpty()                      # the last slice is far in the future
    assert spark.read.parquet(f"{state}/life/version=2").count() > 0


def test_components_by_batches_equal_one_run(spark, folder):
    """Six batches by event time give the components of the whole; a batch that is made twice changes nothing."""
    seeds = P.seeds(spark, folder)
    state = live.LinkState(replay.scratch(spark, "links-test"))
    low, high = seeds.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (high - low) // 6 + 1
    for k in range(6):
        part = seeds.where(F.col("ts_us").between(low + k * width, low + (k + 1) * width - 1))
        for _ in range(2 if k == 3 else 1):
            state.step(part, k)
    got = state.members(spark, 5).select("event_id", "component")
    runs = P.membership(spark, folder)
    want = graph.on_runs(seeds.select("tenant_id", "event_id", "ts_us", "src_ip"), runs.drop("run_id")).select("event_id", "component")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


# --- the stored log ---------------------------------------------------------------------------

def test_lookback_reads_only_its_days(spark):
    """The lookback is a filter on the folders of days: earlier ones are not listed, and the rows are those of the time filter."""
    folder = "/root/testdata/sf0.01"
    rows, whole = P.seeds(spark, folder, days=1), P.scored_events(spark, folder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ts_us" in plan[plan.index("PushedFilters"):]
    from_us = P.as_of(spark, folder) - 86_400_000_000
    want = whole.where((F.col("pred_class") != "normal") & (F.col("ts_us") >= from_us))
    assert rows.count() == want.count() < P.seeds(spark, folder).count()
    assert whole.where("day <> to_date(timestamp_micros(ts_us))").isEmpty()


def test_days_are_replaced_and_compacted(spark):
    day = 86_400_000_000
    path = replay.scratch(spark, "log")
    first = make(spark, [dict(event_id=d * 10 + i, ts_us=d * day + i) for d in range(4) for i in range(5)])
    for k in range(5):
        E.write_events(first.where(F.col("event_id") % 5 == k), path)
    E.replace_days(make(spark, [dict(event_id=900 + i, ts_us=2 * day + i) for i in range(2)]), path)
    E.replace_days(first.where("FALSE"), path)
    E.compact_days(spark, path, "1970-01-01", "1970-01-02")
    log = E.read_events(spark, path)
    files = {r["day"].day: r["n"] for r in log.select("day", F.input_file_name().alias("file")).distinct().groupBy("day").agg(F.count("file").alias("n")).collect()}
    assert sorted(r.event_id for r in log.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 30, 31, 32, 33, 34, 900, 901]
    assert files == {1: 1, 2: 1, 3: 1, 4: 5}
    assert E.read_events(spark, path, "1970-01-04").count() == 5


def test_events_before_the_lookback_are_not_stamped(spark):
    """The lookback may start inside a slot of an address: an event before it is no member, though its slot is."""
    ev = make(spark, [dict(event_id=1, ts_us=1_000_000), dict(event_id=2, ts_us=3_000_000), dict(event_id=3, ts_us=4_000_000)]).withColumn("pred_class", F.lit("dir_scan"))
    late = ev.where("ts_us >= 2000000")
    runs = graph.run_map(late).withColumn("component", F.col("run_id"))
    found = spark.createDataFrame([("t", 2, "INC-0001")], "tenant_id string, component bigint, incident_id string")
    got = {r.event_id: r.incident_id for r in incidents.assign_incidents(ev, runs, found, 2_000_000).collect()}
    assert got == {1: None, 2: "INC-0001", 3: "INC-0001"}


def test_replay_of_a_log_longer_than_400_days_loses_nothing(spark):
    """A later file read first must not put an early row behind the watermark."""
    day = 86_400_000_000
    rows = spark.createDataFrame([(i, at * day) for i, at in enumerate([20_900, 20_000, 20_450, 20_000])], "telemetry_id bigint, ts_us bigint").withColumn("ts", F.timestamp_micros("ts_us"))
    path = replay.scratch(spark, "replay")
    for i in range(4):
        rows.where(F.col("telemetry_id") == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = replay.drain(live.dedup(stream, ["telemetry_id"], replay.whole_log(rows)))
    assert sorted(r.telemetry_id for r in out.collect()) == [0, 1, 2, 3]
    far = replay.with_sentinel(rows.withColumns({"src_ip": F.lit(""), "event_id": F.col("telemetry_id"), "session_id": F.lit("")})).agg(F.max("ts_us")).first()[0]
    assert far - 20_900 * day > 2 * 900 * day


def test_passes_over_the_log_take_more_partitions_where_it_is_longer(spark):
    """A task's share of the log does not grow with it, and the partitions change no row."""
    ev = make(spark, [dict(event_id=i, ts_us=i * 500_000, src_ip=f"203.0.113.{i % 5}", session_id=f"s{i % 3}", url_path="/login", http_status=401, user_id=f"u{i % 4}") for i in range(400)])
    n = sweep.parts(40 * sweep.TASK_ROWS, spark)
    assert n == 40 and sweep.parts(400 * sweep.TASK_ROWS, spark) == 400
    dealt = features.rolling_features(ev, n=n)
    assert dealt.rdd.getNumPartitions() == n
    few, many = (P.score_log(ev, E.telemetry(spark, "/root/testdata/sf0.001"), feeds(spark), 200_000_000, n=k) for k in (None, n))
    key = lambda df: sorted(map(str, df.select(*sorted(few.columns)).collect()))
    assert key(few) == key(many)


def test_feedback_trains_only_on_events_of_the_lookback(spark):
    """A label of an incident reaches its members, not the events before the lookback in the slot of a member."""
    ev = make(spark, [dict(event_id=1, ts_us=1_000_000), dict(event_id=2, ts_us=3_000_000), dict(event_id=3, ts_us=4_000_000)]).withColumn("pred_class", F.lit("dir_scan"))
    runs = graph.run_map(ev.where("ts_us >= 2000000")).withColumn("component", F.col("run_id"))
    found = spark.createDataFrame([("t", 2, "INC-0001")], "tenant_id string, component bigint, incident_id string")
    label = spark.createDataFrame([(7, "INC-0001", None, "false_positive", None, None)],
                                  "feedback_id bigint, incident_id string, event_id bigint, label string, new_class string, consumed_by string")
    got = review.feedback_training_rows(label, incidents.assign_incidents(ev, runs, found, 2_000_000))
    assert sorted((r.event_id, r.train_class) for r in got.collect()) == [(2, "normal"), (3, "normal")]


@pytest.mark.parametrize("name", ["threat_intel", "top_sources"])
def test_queries_on_enrichment_alone_do_not_score_the_log(spark, tmp_path, name):
    for table in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{table}", tmp_path / table)
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() > 0
    assert "scored" not in {k[3] for k in session._stages if k[1] == str(tmp_path)}


def test_scoring_the_lookback_equals_scoring_the_whole_log(spark):
    """History, trailing windows, failed logins and telemetry reach over the start, wherever it lies."""
    folder = "/root/testdata/sf0.01"
    log, tel, lists = P.event_log(spark, folder), E.telemetry(spark, folder), Feeds.from_tables(spark, folder)
    now = P.latest_us(log)
    whole = P.scored_events(spark, folder)
    for start in (now - 9 * 3_600_000_000 - 123_456_789, now - 20 * 3_600_000_000):
        got = E.with_day(P.score_since(log, tel, lists, start, now)).select(*whole.columns)
        want = whole.where(F.col("ts_us") >= start)
        assert 0 < want.count() == got.count() < whole.count()
        assert got.exceptAll(want).isEmpty()


def test_incidents_of_a_long_log_score_its_lookback_only(spark, tmp_path):
    """Seeds of a log of 40 days are those of the whole scored log, which is not built for them."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name in os.listdir("/root/testdata/sf0.001"):
        if not name.startswith("events"):
            os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    copies = events.crossJoin(spark.range(5).select((F.col("id") * 72_000).alias("shift")))
    copies.withColumn("event_id", F.col("event_id") + F.col("shift")).drop("shift").write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    got = P.seeds(spark, folder)
    built = {k[3] for k in session._stages if k[1] == folder}
    assert "recent" in built and "scored" not in built
    whole = E.scan_events(P.scored_events(spark, folder), P.lookback_start(spark, folder)).select(*got.columns)
    assert 0 < got.count() == whole.count()
    assert got.exceptAll(whole).isEmpty()


def test_decided_events_equal_those_of_the_whole_scoring(spark):
    """Accounts and login outcomes come from hours before, across a pause, from other addresses; some addresses never log in."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        login = rng.random() < 0.4
        rows.append(dict(
            event_id=i, ts_us=rng.choice([0, 5_000, 5_840, 40_000]) * 1_000_000 + rng.randrange(120) * 1_000_000, src_ip=rng.choice(["a", "b", "c", "d", None]),
            session_id=rng.choice([None, "s1", "s2"]), user_id=rng.choice([None, "", "u1", "u2", "u3", "u4"]), http_status=rng.choice([200, 401, 404]),
            url_path=rng.choice(["/login?x=1", "/login"] if login else ["/.env", "/register/1", "/p", "/q", "/.git/config", "/debug/pprof/", "/x1", "/x2"]),
            resp_bytes=rng.choice([10, 4_000_000]), user_agent=rng.choice([None, "", "curl/8", "ua"]), asn=rng.choice([14061, 1]), country=None))
    rows = [dict(r, url_path="/home") if r["src_ip"] == "d" else r for r in rows]
    log = make(spark, rows)
    tel = log.where("session_id = 's1' AND event_id % 7 = 0").select(
        "tenant_id", "session_id", "ts_us", "event_id", *[F.lit(1.0).alias(c) for c in C.BROWSER_FEATURES])
    whole = P.score_log(log, tel, feeds(spark), 50_000_000_000)
    for n in (None, 3):
        got = P.decide(log, tel, n)
        assert set(got.columns) < set(whole.columns) and got.count() == len(rows)
        assert got.exceptAll(whole.select(*got.columns)).isEmpty()
    seen = got.agg(F.sum("auth_success_after_fails"), F.count_distinct("rule"), F.count_distinct("technique_id"), F.sum("browser_telemetry_present")).first()
    assert min(seen) >= 2


@pytest.mark.parametrize("name", ["technique_resolve", "technique_overrides", "training_set", "score_unscored"])
def test_queries_on_decisions_alone_do_not_score_the_log(spark, db, tmp_path, name):
    for table in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{table}", tmp_path / table)
    got = QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(got.columns)
    want = db.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert not {k for k in session._stages if k[1] == str(tmp_path)}
