"""Registered queries equal their SQL; ``tools/check.py`` runs all of them."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseweave.operators import model
from caseweave.plans import pipeline as P
from caseweave.plans.oracle import ORACLE
from caseweave.plans.queries import QUERIES

NAMES = [
    "scan_kev_json", "scan_blocklists", "replace_days", "lookback_seeds", "parse_features", "write_incidents", "assign_incidents", "stream_telemetry_source",
    "path_entropy", "payload_bytes_std", "auth_fail_user_60s", "server_features", "keystroke_interval_stats", "mouse_path_entropy",
    "fuse_telemetry", "feature_vector", "validate_features", "classify_rules", "classify_with_model", "technique_resolve", "evidence",
    "enrich_event", "threat_intel", "score_event", "risk_terms", "validate_weights", "rescore_what_if", "fanout_split", "pair_links", "chain_links",
    "edge_weights", "components", "kill_chain", "entity_graph", "incident_intel", "build_incidents", "fingerprint_vector",
    "match_campaign", "playbook_context", "fill_template", "incident_narrative", "daily_trend", "funnel", "correlation_metrics",
    "invariants", "review_groups", "feedback_training_rows", "mark_consumed", "macro_prf", "average_precision", "pr_curve",
    "promotion_gate", "grouped_holdout", "review_sample", "calibrate_checks", "stream_rate_sliding", "stream_sessions", "stream_dedup",
    "split_communities", "recut_incidents", "append_model_version", "score_with_model", "stream_correlate", "late_events", "stream_rolling_features",
]


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if pd.isna(v) else (round(float(v), 6) if isinstance(v, float) else v)
    return cols, sorted((tuple(clean(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, db, name):
    got = rows(entry.queries()[name](spark, folder).toPandas())
    want = rows(db.execute(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert [tuple(map(str, r)) for r in got[1]] == [tuple(map(str, r)) for r in want[1]]


def test_retrain_counts_equal_sql_where_the_log_is_longer_than_the_lookback(spark, folder, tmp_path):
    """Events that come again 30 days later, up to the middle of a slow scan: the lookback starts inside the scan's slot (training left out)."""
    con, d = duckdb.connect(), str(tmp_path)
    for t in ("customer", "supplier", "part"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    ev = spark.read.parquet(f"{folder}/events.parquet")
    again = ev.where("event_id < 453").withColumn("event_id", F.col("event_id") + 216_000)
    ev.unionByName(again).write.parquet(f"{d}/events.parquet")
    for t in ("customer", "supplier", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    human = QUERIES["feedback_training_rows"](spark, d)
    assert rows(human.toPandas()) == rows(con.execute(ORACLE["feedback_training_rows"]).df())
    train = model.grouped_holdout(model.training_set(P.scored_events(spark, d))).where("not is_test")
    want = con.execute(f"SELECT n_base, n_feedback FROM ({ORACLE['retrain']}) WHERE version = 'v1.0.1'").fetchall()
    assert [(train.count(), train.join(human, "event_id").count())] == want


def test_every_query_has_sql_or_is_known_not_to():
    without = set(QUERIES) - set(ORACLE)
    assert without == set()
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
