"""The same computations on a live stream.

Event time everywhere: a stream must carry ``ts`` with a watermark.  Rates and
sessions are built-in windowed aggregates.  Exact per-request trailing features
run the batch operators on the rows that the watermark has passed and their recent past, kept as bounded versions in a
shared folder; correlation merges the links of a batch into the components stored before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from .. import constants as C
from ..functions import expr as X
from ..operators import features, graph
from ..plans.pipeline import score_log
from ..session import cut, drop_folder
from ..sources.feeds import Feeds

def _rates() -> list:
    return [F.count(F.lit(1)).alias("requests"),
            F.count_if((X.strip_query(F.col("url_path")) == "/login") & (F.col("http_status") == 401)).alias("auth_fails"),
            F.count_if(F.col("http_status") == 404).alias("not_found")]


def rate_windows(stream: DataFrame, watermark: str = "10 minutes", length: str = "60 seconds",
                 slide: str | None = None) -> DataFrame:
    """Request, failed-login and 404 counts per address and tumbling or sliding window.

    Partial aggregation runs before the shuffle, so a hot address sends one row
    per task and window.
    """
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (stream.withWatermark("ts", watermark).groupBy(win.alias("win"), "tenant_id", "src_ip").agg(*_rates())
            .select("tenant_id", "src_ip", F.unix_millis("win.start").alias("start_ms"), "requests", "auth_fails", "not_found"))


def activity_sessions(stream: DataFrame, watermark: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Activity sessions per address: start, end of the last gap, requests."""
    return (stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "tenant_id", "src_ip")
            .agg(F.count(F.lit(1)).alias("requests"))
            .select("tenant_id", "src_ip", F.unix_millis("s.start").alias("start_ms"), F.unix_millis("s.end").alias("end_ms"),
                    "requests"))


def skip_paths(stream: DataFrame) -> DataFrame:
    """Drop console and static traffic.  Apply after counting, as those requests do count."""
    return stream.where(~X.starts_any(F.col("url_path"), C.SKIP_PREFIXES))


def dedup(stream: DataFrame, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Drop exact redeliveries that arrive within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def fuse(requests: DataFrame, telemetry: DataFrame, watermark: str = "10 minutes", ttl_s: int = 900) -> DataFrame:
    """Requests with the newest telemetry of their session in the last ``ttl_s`` seconds, else NULLs.

    Left outer interval join (state on both sides is bounded by the watermark
    and the interval), then the newest candidate per request.  Requests without a
    session can meet none: they pass straight by and keep no state.
    """
    r = requests.where(F.col("session_id").isNotNull()).withWatermark("ts", watermark)
    nothing = [F.lit(None).cast("double").alias(c) for c in C.BROWSER_FEATURES]
    alone = requests.where(F.col("session_id").isNull()).select("tenant_id", "event_id", "session_id", *nothing, F.lit(0).alias("browser_telemetry_present"))
    t = telemetry.select(F.col("session_id").alias("t_session"), F.col("ts").alias("t_ts"), *C.BROWSER_FEATURES
                         ).withWatermark("t_ts", watermark)
    near = F.expr(f"session_id = t_session AND t_ts <= ts AND t_ts >= ts - INTERVAL {ttl_s} SECONDS")
    j = r.join(t, near, "left_outer")
    newest = F.max_by(F.struct("t_ts", *C.BROWSER_FEATURES), F.col("t_ts")).alias("b")
    out = j.groupBy(F.window("ts", "1 second"), "tenant_id", "event_id", "session_id").agg(newest)
    return out.select("tenant_id", "event_id", "session_id", *[F.col(f"b.{c}").alias(c) for c in C.BROWSER_FEATURES],
                      F.col("b.t_ts").isNotNull().cast("int").alias("browser_telemetry_present")).unionByName(alone)


class AddressState:
    """Bounded state of a stream of requests, in a shared folder: one version per micro-batch, made from the one before.

    ``waiting``: rows the watermark has not passed.  They are released in event-time order, so rows may arrive shuffled
    within ``delay_us``.  ``recent``: released rows of the last five minutes, which trailing windows still reach.
    ``life``: one mergeable row per address, forgotten ``ttl_us`` after its last request.  ``clock``: the watermark.
    A row at or behind the watermark (or without a time) is late: it is kept in the table ``late`` and counts nowhere else.

    A version is read by its successor alone, so what a batch reads follows the delay, the rate and the number of
    addresses, not the age of the stream.  A retried batch makes its version again; the last two are kept.
    """

    PARTS = ("waiting", "recent", "life", "clock")

    def __init__(self, folder: str, delay_us: int, ttl_us: int | None = None):
        self.folder, self.delay_us, self.ttl_us = folder, delay_us, ttl_us

    def _path(self, part: str, version: int) -> str:
        return f"{self.folder}/{part}/version={version}"

    def _read(self, spark: SparkSession, part: str, version: int, schema=None) -> DataFrame | None:
        if version < 0:
            return None
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(self._path(part, version))

    def _write(self, df: DataFrame, part: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(part, version))
        return df.sparkSession.read.schema(df.schema).parquet(self._path(part, version))

    def step(self, batch: DataFrame, version: int, work) -> None:
        """``work(rows, prior, now_us)`` gets the released rows with the recent ones (flag ``OLD``) and the history of their addresses."""
        spark = batch.sparkSession
        clock = self._read(spark, "clock", version - 1)
        mark = clock.first()["mark_us"] if clock is not None else None
        high = batch.agg(F.max("ts_us")).first()[0]
        now = max((x for x in (mark, None if high is None else high - self.delay_us) if x is not None), default=None)
        late = F.col("ts_us").isNull() if mark is None else F.col("ts_us").isNull() | (F.col("ts_us") <= mark)
        (batch.where(late).withColumn("mark_us", F.lit(mark).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/late/batch={version}"))
        rows = batch.where(~late)
        before = self._read(spark, "waiting", version - 1, T.StructType(batch.schema.fields + [T.StructField("open", T.BooleanType())]))
        if before is not None:
            rows = rows.unionByName(before.where("open").drop("open"))
        # one pass deals the rows to those released and those still waiting
        passed = F.lit(False) if now is None else F.col("ts_us") <= now
        rows.withColumn("open", ~passed).write.mode("overwrite").partitionBy("open").parquet(self._path("waiting", version))
        known = T.StructType(batch.schema.fields + [T.StructField("open", T.BooleanType())])
        ready = self._read(spark, "waiting", version, known).where(~F.col("open")).drop("open")
        recent, life = self._read(spark, "recent", version - 1, batch.schema), self._read(spark, "life", version - 1)
        start = ready.agg(F.min("ts_us")).first()[0]
        seen, prior = ready.withColumn(features.OLD, F.lit(False)), None
        if recent is not None and start is not None:
            seen = seen.unionByName(recent.where(F.col("ts_us") >= start - features.HALO_US).withColumn(features.OLD, F.lit(True)))
            # earlier than any real time bucket
            prior = life.join(ready.select(*features.KEYS).distinct(), features.KEYS, "left_semi").drop("last_us").withColumn("bucket", F.lit(-1 << 40))
        work(seen, prior, now)
        own = features.history_rows(ready, by_bucket=False)
        life = own if life is None else features.merge_history(life, own)
        if self.ttl_us is not None and now is not None:
            life = life.where(F.col("last_us") >= now - self.ttl_us)
        self._write(life, "life", version)
        reach = ready if recent is None else ready.unionByName(recent)
        self._write(reach.where(F.col("ts_us") > (now or 0) - features.HALO_US), "recent", version)
        self._write(spark.range(1).select(F.lit(now).cast("long").alias("mark_us")), "clock", version)
        for part in self.PARTS:
            if version >= 2:
                drop_folder(spark, self._path(part, version - 2))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """All late rows so far, with the watermark each of them missed."""
        return spark.read.parquet(f"{self.folder}/late")


def _micros(text: str) -> int:
    amount, unit = text.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")] * C.US


def _each_batch(stream: DataFrame, folder: str, out: str, work, delay: str, ttl: str | None) -> DataStreamWriter:
    state = AddressState(folder, _micros(delay), _micros(ttl) if ttl else None)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state.step(batch, batch_id, lambda rows, prior, now: work(rows, prior, now).write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    return stream.writeStream.foreachBatch(on_batch)


def rolling_features(stream: DataFrame, folder: str, out: str, delay: str = "10 minutes", ttl: str | None = None) -> DataStreamWriter:
    """Exact trailing features per request, once the watermark (``delay`` behind the newest row) has passed it.

    The batch sweep runs over the released rows and their recent past: all work stays in the JVM, and a hot address is
    split by time as in batch.
    """
    return _each_batch(stream, folder, out, lambda rows, prior, now: features.rolling_features(rows, prior), delay, ttl)


def classify_stream(stream: DataFrame, telemetry: DataFrame, feeds: Feeds, folder: str, out: str, delay: str = "10 minutes", ttl: str | None = None) -> DataStreamWriter:
    """The whole request flow per micro-batch: features, fusion, rules, technique, enrichment, priority.

    Skipped paths are counted by the features and dropped afterwards.
    """
    return _each_batch(stream, folder, out, lambda rows, prior, now: skip_paths(score_log(rows, telemetry, feeds, now or 0, prior=prior)), delay, ttl)


class LinkState:
    """Connected components kept up to date by micro-batches of seed events that arrive in event-time order, as ``AddressState`` releases them.

    ``tail``: the last event of every entity still inside the longest link window.  A new event can only be linked to it
    or to other new events, so a batch builds no link twice and reads no older event.  ``log``: events with the label
    they got on arrival, appended and never rewritten.  ``roots``: labels that were merged later, with the component
    they belong to now; a batch touches only those of components it links.  A component is named by its smallest event,
    as in the batch flow.  Tail and roots are versions: a retried batch makes its own again.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, part: str, version: int) -> str:
        return f"{self.folder}/{part}/version={version}"

    def _roots(self, spark: SparkSession, version: int) -> DataFrame | None:
        return spark.read.parquet(self._path("roots", version)) if version >= 0 else None

    def step(self, batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        runs = cut(graph.run_map(batch))
        ents = graph.entities_of(graph.with_values(graph.on_runs(batch, runs)), keep=["run_id", "vals"])
        roots, node = self._roots(spark, version - 1), F.col("run_id")
        tail = None
        if roots is not None:
            tail = spark.read.parquet(self._path("tail", version - 1))
            tail = tail.join(roots, tail["run_id"] == roots["label"], "left").withColumn("run_id", F.coalesce("root", "run_id")).select(*ents.columns)
        both = cut(ents if tail is None else ents.unionByName(tail))
        pairs = graph.neighbour_pairs(graph.entity_index(both, keep=["run_id", "vals"]), across="run_id")
        edges = graph.edge_weights(pairs).select(F.col("a_run_id").alias("u"), F.col("b_run_id").alias("v"))
        found = cut(graph.components(edges))
        labels = cut(runs.select("run_id").distinct().join(found, node == found["node"], "left").select("run_id", F.coalesce("component", "run_id").alias("label")))
        named = graph.on_runs(batch, runs).join(labels, "run_id").drop("run_id")
        named.write.mode("overwrite").parquet(f"{self.folder}/log/batch={version}")
        # labels of before that this batch merged, and those that had been merged into them
        moved = found.where("node <> component").join(labels.select(F.col("run_id").alias("node")), "node", "left_anti").select(
            F.col("node").alias("label"), F.col("component").alias("root"))
        if roots is not None:
            again = moved.select(F.col("label").alias("_at"), F.col("root").alias("_to"))
            moved = roots.join(again, roots["root"] == again["_at"], "left").select("label", F.coalesce("_to", "root").alias("root")).unionByName(moved)
        moved.write.mode("overwrite").parquet(self._path("roots", version))
        newest = both.groupBy(*graph.ENTITY).agg(F.max(F.struct("ts_us", "event_id", "run_id", "vals")).alias("m"))
        newest = newest.select(*graph.ENTITY, "m.*").join(labels, "run_id", "left").withColumn("run_id", F.coalesce("label", "run_id")).drop("label")
        reach = batch.agg(F.max("ts_us").alias("now"))
        longest = max(w for _, _, w in C.LINKS.values()) * C.HOUR_US
        kept = newest.join(F.broadcast(reach)).where(F.col("now").isNull() | (F.col("ts_us") >= F.col("now") - F.lit(int(longest)))).select(*ents.columns)
        kept.write.mode("overwrite").parquet(self._path("tail", version))
        for part in ("tail", "roots"):
            if version >= 2:
                drop_folder(spark, self._path(part, version - 2))

    def members(self, spark: SparkSession, version: int) -> DataFrame:
        """All events with their component after a version."""
        log, roots = spark.read.parquet(f"{self.folder}/log").drop("batch"), self._roots(spark, version)
        return log.join(roots, "label", "left").withColumn("component", F.coalesce("root", "label")).drop("label", "root")


def correlate_stream(stream: DataFrame, folder: str, rebuild, interval: str | None = None) -> DataStreamWriter:
    """Components of a stream of seed events, batch by batch; ``rebuild(members, batch_id)`` makes the incidents of each."""
    state = LinkState(folder)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state.step(batch, batch_id)
        rebuild(state.members(batch.sparkSession, batch_id), batch_id)

    writer = stream.writeStream.foreachBatch(on_batch)
    return writer.trigger(processingTime=interval) if interval else writer
