"""The main flow, with its two materialised tables: scored events and incident membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..operators import classify, communities, enrich, features, fusion, graph, incidents, model, sweep
from ..session import cut, stage
from ..sources import events as E
from ..sources.feeds import Feeds


def latest_us(events: DataFrame) -> int:
    """The log's own "now": one number, from one aggregate."""
    return events.agg(F.max("ts_us")).first()[0]


def _on(scorer: tuple, rows: DataFrame) -> tuple:
    fitted, maps = scorer
    return fitted, rows, maps


def score_log(events: DataFrame, telemetry: DataFrame, feeds: Feeds, as_of_us: int,
              weights: dict | None = None, prior: DataFrame | None = None, scorer: tuple | None = None,
              n: int | None = None) -> DataFrame:
    """Requests to features, class, technique, evidence, enrichment and event priority.

    ``scorer`` is a stored model with its calibration maps (``ModelStore.load``): it decides where no rule fires.
    ``n`` partitions for the passes over all requests (``sweep.parts``).
    """
    rows = features.server_features(events, feeds.reputation(), prior, n)
    rows = fusion.fuse_telemetry(rows, telemetry, n=n)
    rows = classify.classify_rules(rows)
    if scorer is not None:
        rows = classify.decide_with_model(model.predict(*_on(scorer, model.model_inputs(rows))).drop("features", "proba"))
    rows = rows.withColumn("attack_technique", classify.technique_on_event())
    rows = enrich.enrich(rows, feeds)
    rows = enrich.score_event(rows, F.lit(as_of_us), weights)
    return classify.technique_resolve(rows)


def decide(events: DataFrame, telemetry: DataFrame, n: int | None = None) -> DataFrame:
    """Requests with the class, rule and technique that ``score_log`` gives them, by the features alone that these read."""
    rows = fusion.fuse_telemetry(features.decisive_features(events, n), telemetry, n=n, fields=[])
    rows = classify.classify_rules(rows)
    return classify.technique_resolve(rows.withColumn("attack_technique", classify.technique_on_event()))


def decided_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Every event of the log, decided, for a query that reads them once: neither log nor rows are stored on the way."""
    ev = E.web_events(spark, sf_dir, dense)
    return decide(ev, E.telemetry(spark, sf_dir), sweep.parts(ev.count(), spark))


def labelled_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Every event of the log as training reads it: (event_id, group_key, label, features, is_test), as from ``scored_events``.

    Neither the log nor the scored rows are stored on the way, and nothing is computed that no feature or rule reads.
    """
    # were the tenant a constant, windows would leave it out of their keys and shuffle again, into the session's partitions
    tenant = F.coalesce(F.when(F.col("event_id").isNotNull(), E.TENANT), F.lit(E.TENANT))
    ev = E.web_events(spark, sf_dir, dense).withColumn("tenant_id", tenant)
    n = sweep.parts(ev.count(), spark)
    rows = features.model_features(ev, Feeds.from_tables(spark, sf_dir).reputation(), n)
    rows = classify.classify_rules(fusion.fuse_telemetry(rows, E.telemetry(spark, sf_dir), n=n))
    return model.model_inputs(model.grouped_holdout(model.training_set(rows))).select("event_id", "group_key", "label", "features", "is_test")


def event_log(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The stored event log, a folder per UTC day."""
    return stage(spark, _name("log", dense), sf_dir, lambda: E.with_day(E.web_events(spark, sf_dir, dense)), by="day")


def scored_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    def build() -> DataFrame:
        ev = event_log(spark, sf_dir, dense)
        return E.with_day(score_log(ev, E.telemetry(spark, sf_dir), Feeds.from_tables(spark, sf_dir), latest_us(ev),
                                      n=sweep.parts(ev.count(), spark)))
    return stage(spark, _name("scored", dense), sf_dir, build, by="day")


def score_since(log: DataFrame, telemetry: DataFrame, feeds: Feeds, start_us: int, as_of_us: int) -> DataFrame:
    """The rows that ``score_log`` gives for the requests from a time on.

    All earlier requests count, as the history of the addresses that still send: one mergeable row each.  Those just
    before the start also fill the trailing windows, and older telemetry than its time to live is never met.
    """
    ready, before = E.since(log, start_us), log.where(F.col("ts_us") < start_us)
    still = ready.select(*features.KEYS).distinct()
    life = features.history_rows(before.join(still, features.KEYS, "left_semi"), by_bucket=False)
    prior = life.drop("last_us").withColumn("bucket", F.lit(-1 << 40))                      # earlier than any real time bucket
    near = E.since(log, start_us - features.HALO_US).withColumn(features.OLD, F.col("ts_us") < start_us)
    recent = telemetry.where(F.col("ts_us") >= start_us - fusion.TTL_US)
    return score_log(near, recent, feeds, as_of_us, prior=prior, n=sweep.parts(near.count(), log.sparkSession))


def recent_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Scored events of the lookback, from the start of its first day on: what incidents are built from.

    Where the log is longer than the lookback, only these days are scored, on top of the history of all earlier ones.
    """
    log, day = event_log(spark, sf_dir, dense), 24 * C.HOUR_US
    first, last = log.agg(F.min("ts_us"), F.max("ts_us")).first()
    start = 0 if last is None else lookback_start(spark, sf_dir) // day * day
    if last is None or first >= start:
        return scored_events(spark, sf_dir, dense)
    return stage(spark, _name("recent", dense), sf_dir, lambda: E.with_day(
        score_since(log, E.telemetry(spark, sf_dir), Feeds.from_tables(spark, sf_dir), start, last)), by="day")


def seeds(spark: SparkSession, sf_dir: str, dense: bool = False, days: int = C.LOOKBACK_DAYS) -> DataFrame:
    """Non-normal events of the last ``days`` days; earlier days of the log are not scored for them."""
    rows = recent_events if days <= C.LOOKBACK_DAYS else scored_events
    return E.scan_events(rows(spark, sf_dir, dense), lookback_start(spark, sf_dir, days))


def lookback_start(spark: SparkSession, sf_dir: str, days: int = C.LOOKBACK_DAYS) -> int:
    return as_of(spark, sf_dir) - days * 24 * C.HOUR_US


def as_of(spark: SparkSession, sf_dir: str) -> int:
    return latest_us(event_log(spark, sf_dir))


def correlate(events: DataFrame, recut: bool = True) -> DataFrame:
    """(address, slot, run_id, component) of seed events: links, components and, by default, the re-cut of oversized ones."""
    found = graph.run_components(events, cut(graph.run_map(events)))
    return communities.recut(events, found) if recut else found


def _name(name: str, dense: bool) -> str:
    return f"{name}_dense" if dense else name


def membership(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """(address, slot, run_id, component).

    In the dense log oversized components are re-cut.  The plain log is left as it is, so that SQL, which cannot state
    communities, can state every row that the queries over it return.
    """
    def build() -> DataFrame:
        ev = seeds(spark, sf_dir, dense)
        return correlate(ev, recut=dense)
    return stage(spark, _name("membership", dense), sf_dir, build)


def member_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return incidents.members(seeds(spark, sf_dir, dense), membership(spark, sf_dir, dense))


def incident_table(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    def build() -> DataFrame:
        return incidents.build_incidents(member_events(spark, sf_dir, dense), as_of(spark, sf_dir))
    return stage(spark, _name("incidents", dense), sf_dir, build)


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, "profile", sf_dir, lambda: incidents.incident_profile(member_events(spark, sf_dir)))
