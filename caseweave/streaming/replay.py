"""Run a streaming operator over stored rows to completion, for tests and the query registry."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_root

SENTINEL_IP = "255.255.255.255"
# files of a replay may be read in any order, so its watermark is at least this and longer than the log (``whole_log``)
WHOLE_DAYS = 400
WHOLE_LOG = f"{WHOLE_DAYS} days"


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def whole_log(rows: DataFrame) -> str:
    """A watermark longer than the log, whatever its length."""
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    return f"{max(WHOLE_DAYS, ((high or 0) - (low or 0)) // 86_400_000_000 + 2)} days"


def with_sentinel(rows: DataFrame) -> DataFrame:
    """Add one row two watermarks after the end, so that the last windows close."""
    end = rows.agg(F.max("ts_us").alias("e"), F.min("ts_us").alias("s"))
    days = F.greatest(F.lit(WHOLE_DAYS), F.expr("(e - s) div 86400000000 + 2"))
    far = F.col("e") + 2 * days * 86_400_000_000
    special = {"ts_us": far, "ts": F.timestamp_micros(far), "src_ip": F.lit(SENTINEL_IP),
               "event_id": F.lit(-1).cast("long"), "session_id": F.lit("sentinel")}
    extra = end.select(*[special.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(extra)


def as_stream(rows: DataFrame, files_per_trigger: int = 4) -> DataFrame:
    """Write the rows as files and read them back as a stream of several micro-batches."""
    spark = rows.sparkSession
    path = scratch(spark, "replay")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_slices(rows: DataFrame, start, slices: int = 3, arrival=None, folder: str | None = None, out: str | None = None) -> DataFrame:
    """Feed the rows in the order of ``arrival`` (event time by default), one slice per run of ``start(stream, folder, out)``.

    Every run continues from the same checkpoint, as a restarted stream does.  A last slice with one row far in the
    future lets the watermark pass all others.  Returns the output.
    """
    spark = rows.sparkSession
    source, state, made, offsets = (scratch(spark, n) for n in ("slices", "state", "out", "offsets"))
    out = out or made
    at = F.col("ts_us") if arrival is None else arrival
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = (high - low) // slices + 1
    parts = [rows.where(at.between(low + k * width, low + (k + 1) * width - 1)) for k in range(slices)]
    parts.append(with_sentinel(rows).where(F.col("src_ip") == SENTINEL_IP))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        start(stream, folder or state, out).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of the input and return what was written.

    A replay is small: it keeps no more state partitions than there are cores.
    """
    spark = stream.sparkSession
    out = scratch(spark, "drained")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), spark.sparkContext.defaultParallelism))
    try:
        query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
                 .option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(out)
