"""Helpers shared by the corpus operators: tables, joins and running sums that hold under hot keys."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A key with more than 1/HOT of the rows is hot, so there are fewer than HOT of them at any size.
HOT = 500
#: Rows at least that an ordered running sum holds before it is cut into more buckets.
BUCKET_ROWS = 1_000
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "caseweave.zip")     # read by the driver alone
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose function may use this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def consecutive(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values, rows) of consecutive rows that have the same whole numbers in the columns ``by``."""
    last, held = None, []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:]):
            values = tuple(int(c[a]) for c in cols)
            if values != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = values
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, _UPPER, _LOWER)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def id_text(c: str = "doc_id") -> Column:
    return F.col(c).cast("string")


def fold(c: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_text(c)) % parts


def hash_order(c: str = "doc_id") -> Column:
    """A shuffled, reproducible order of ids that other engines can repeat: md5 of the id as text."""
    return F.md5(F.coalesce(id_text(c), F.lit("null")))


def hash_bucket(key: Column, buckets: Column | int) -> Column:
    """Bucket of an md5 text, rising with its order."""
    first = F.conv(F.substring(key, 1, 7), 16, 10).cast("long")
    return F.shiftright(first * (F.lit(buckets) if isinstance(buckets, int) else buckets), 28).cast("int")


def buckets_for(rows: int) -> int:
    """Buckets for an ordered running sum: as many as there are rows in each, so neither step has more than the root of all."""
    return max(1, -(-rows // max(BUCKET_ROWS, math.isqrt(rows))))


def join_hot(big: DataFrame, small: DataFrame, key: str, count: str, total: int, salt: Column) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique ``key``; ``count``: rows of ``big`` that have it), safe under hot keys.

    Keys with more than 1/HOT of the ``total`` rows are fewer than HOT by construction and are broadcast.  The rest is
    joined by shuffle, in which rows of hot or null keys are spread by ``salt`` and match nothing.
    """
    limit = max(total // HOT, 1)
    cols = [c for c in small.columns if c not in (key, count)]
    packed = small.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(count).alias("_n"), F.struct(F.col(count).alias("_c"), *cols).alias("_s"))
    hot = F.broadcast(packed.where(F.col("_n") > limit).select(F.col("_k").alias("_hk"), F.col("_s").alias("_hs")))
    rest = packed.where(F.col("_n") <= limit).select(F.col("_k").alias("_rk"), F.xxhash64("_k").alias("_rh"), F.col("_s").alias("_rs"))
    tagged = big.join(hot, F.col(key) == F.col("_hk"), "left")
    cold = F.col("_hk").isNull() & F.col(key).isNotNull()
    tagged = tagged.withColumn("_ck", F.when(cold, F.col(key))).withColumn(
        "_ch", F.when(cold, F.xxhash64(key)).otherwise(F.xxhash64(salt, F.lit("salt"))))
    out = tagged.join(rest, (F.col("_ch") == F.col("_rh")) & (F.col("_ck") == F.col("_rk")), "left")
    s = F.coalesce("_hs", "_rs")
    return out.select(*big.columns, s["_c"].alias(count), *[s[c].alias(c) for c in cols])


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same group that come before, in the order of (bucket, *order).

    ``bucket`` rises with the order and holds a bounded number of rows.  Only the sums of the buckets are ordered per
    group; rows meet rows of their own bucket alone, so a group of any size is dealt to many tasks.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(offsets, keys).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .select(*df.columns, name))
