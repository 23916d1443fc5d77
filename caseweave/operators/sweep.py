"""Trailing-window statistics by event-time sweep.

A RANGE frame re-reads its whole frame for every row, so a source that sends
thousands of requests a second costs rows x frame.  Here every request becomes
one arrival and one expiry per window length; running sums over those signed
rows give the same trailing counts in one ordered pass.

A busy key is also split in time: rows are grouped by (key, time bucket), and a
bucket receives a thin copy of the rows of the previous one that are still
inside the longest window.  No task holds one key's whole history.

Groups are led by a 64-bit hash of their key (``gk``): sorts then compare one
long instead of long strings with equal beginnings.  The key itself stays in
every grouping, so equal hashes do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import constants as C


@dataclass(frozen=True)
class Total:
    """Sum of an integer column over the trailing ``seconds``.

    ``leave`` is what an expiry takes away, where that differs from what its
    own arrival added.
    """
    name: str
    value: Column
    seconds: int
    leave: Column | None = None


@dataclass(frozen=True)
class Distinct:
    """Distinct count (and entropy in bits, on request) of a column over the trailing ``seconds``."""
    name: str
    value: Column
    seconds: int
    entropy: str | None = None


ENTROPY_SCALE = 1_000_000_000.0


def _weight(count: Column) -> Column:
    """count * log2(count) as a scaled integer, so that running differences telescope exactly."""
    c = count.cast("double")
    return F.when(count > 1, F.round(c * F.log2(c) * ENTROPY_SCALE)).otherwise(F.lit(0.0)).cast("long")


#: Requests whose windows a task orders; several sorts of a task hold their marks at once.
TASK_ROWS = 50_000


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the group hash over ``keys`` and ``bucket``."""
    return df.withColumn("gk", F.xxhash64(*keys, "bucket"))


def parts(size: int, spark: SparkSession) -> int:
    """Partitions for ``size`` requests: they grow with the input, so that a task does not."""
    return max(-(-size // TASK_ROWS), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """Groups in ``n`` partitions; without a number the session's setting holds."""
    return df if n is None else df.repartition(n, "gk", *keys, "bucket")


def bucketed(df: DataFrame, ts_us: Column, width_us: int, halo_us: int, carry: list[str], thin: list[str]) -> DataFrame:
    """Put each row in its time bucket, and a thin copy in the next one if it can still matter there.

    ``thin`` columns survive in the copy; ``carry`` columns exist only in the
    row's own bucket (``core``).
    """
    own = F.floor(ts_us / F.lit(width_us)).cast("long")
    near_end = (own + 1) * F.lit(width_us) - ts_us <= F.lit(halo_us)
    places = F.when(near_end, F.array(F.struct(own.alias("bucket"), F.lit(True).alias("core")),
                                      F.struct((own + 1).alias("bucket"), F.lit(False).alias("core")))
                    ).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("core"))))
    out = df.withColumn("_place", F.explode(places))
    return out.select(
        F.col("_place.bucket").alias("bucket"), F.col("_place.core").alias("core"), *thin,
        F.when(F.col("_place.core"), F.struct(*carry)).alias("row"))


def sweep(rows: DataFrame, keys: list[str], totals: list[Total], distincts: list[Distinct] = (),
          running: list[Total] = ()) -> DataFrame:
    """Add trailing totals, distinct counts and in-bucket running totals to bucketed rows.

    ``rows`` has ``gk``, ``keys``, ``bucket``, ``core``, ``ts_us`` and whatever the
    value expressions use.  Returns core rows with one column per measure.
    All windows share the clustering (keys, bucket): one shuffle.
    """
    by = ["gk", *keys, "bucket"]
    # value columns first, so that everything after works on plain columns
    zero = F.lit(0).cast("long")
    values = {}
    for m in totals:
        values[f"_v_{m.name}"] = F.coalesce(m.value.cast("long"), zero)
        if m.leave is not None:
            values[f"_l_{m.name}"] = F.coalesce(m.leave.cast("long"), zero)
    for m in running:
        values[f"_v_{m.name}"] = F.when(F.col("core"), F.coalesce(m.value.cast("long"), zero)).otherwise(zero)
    for m in distincts:
        values[f"_x_{m.name}"] = m.value
    staged = rows.withColumns(values)

    def signed(df: DataFrame, seconds: list[int], base_sign: bool) -> DataFrame:
        """Explode arrivals into arrival + one expiry per window length."""
        marks = F.array(F.struct(F.lit(0).alias("w"), F.col("ts_us").alias("t"), F.lit(1).alias("sgn")), *[
            F.struct(F.lit(s).alias("w"), (F.col("ts_us") + s * C.US + 1).alias("t"), F.lit(-1).alias("sgn"))
            for s in seconds])
        if not base_sign:
            marks = F.when(F.col("w") == 0, marks).otherwise(F.array(F.struct("w", "t", "sgn")))
        kept = [c for c in df.columns if c not in ("w", "t", "sgn", "row")]
        out = df.withColumn("_m", F.explode(marks))
        # only the arrival carries the request's own columns
        row = [F.when(F.col("_m.w") == 0, F.col("row")).alias("row")] if "row" in df.columns else []
        return out.select(*kept, *row, "_m.w", "_m.t", "_m.sgn")

    first = sorted({m.seconds for m in distincts})
    out = signed(staged, first, True)
    sums = {}
    for m in distincts:
        here = F.col("w").isin(0, m.seconds) & F.col(f"_x_{m.name}").isNotNull()
        step = F.when(here, F.col("sgn")).otherwise(0)
        order = W.partitionBy(*by, f"_x_{m.name}").orderBy("t", F.desc("sgn")).rowsBetween(W.unboundedPreceding, 0)
        sums[m.name] = f"_d_{m.name}"
        if m.entropy:
            sums[f"_{m.entropy}_w"] = f"_g_{m.name}"
        out = out.withColumn(f"_n_{m.name}", F.sum(step).over(order))
    deltas = {}
    for m in distincts:
        here = F.col("w").isin(0, m.seconds) & F.col(f"_x_{m.name}").isNotNull()
        n = F.col(f"_n_{m.name}")
        before = n - F.col("sgn")
        deltas[f"_d_{m.name}"] = F.when(here & (before == 0), 1).when(here & (n == 0), -1).otherwise(0)
        if m.entropy:
            deltas[f"_g_{m.name}"] = F.when(here, _weight(n) - _weight(before)).otherwise(zero)
    if deltas:
        out = out.withColumns(deltas)
    # distinct deltas belong to their own mark; later expiries must not repeat them
    rest = sorted({m.seconds for m in totals} - set(first))
    if rest:
        out = signed(out.withColumn("_own", F.col("w")), rest, False)
        if sums:
            out = out.withColumns({
                c: F.when(F.col("w") == F.col("_own"), F.col(c)).otherwise(zero) for c in sums.values()})
    trailing = W.partitionBy(*by).orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    measures = {}
    for m in totals:
        gone = F.col(f"_v_{m.name}" if m.leave is None else f"_l_{m.name}")
        step = F.when(F.col("w") == 0, F.col(f"_v_{m.name}")).when(F.col("w") == m.seconds, -gone).otherwise(0)
        measures[m.name] = F.sum(step).over(trailing)
    for m in running:
        measures[m.name] = F.sum(F.when(F.col("w") == 0, F.col(f"_v_{m.name}")).otherwise(0)).over(trailing)
    for name, col in sums.items():
        measures[name] = F.sum(col).over(trailing)
    out = out.withColumns(measures)
    out = out.where((F.col("w") == 0) & F.col("core"))
    temp = [c for c in out.columns if c.startswith(("_v_", "_l_", "_x_", "_n_", "_d_", "_g_", "_own"))]
    return out.drop("w", "t", "sgn", *temp)


def entropy_from_weight(total: Column, weight: Column) -> Column:
    """H = log2(N) - sum(c*log2 c)/N, from the integer weight kept by the sweep."""
    n = total.cast("double")
    return F.when(total > 0, F.log2(n) - weight.cast("double") / F.lit(ENTROPY_SCALE) / n).otherwise(F.lit(0.0))


def previous_in_slices(df: DataFrame, keys: list[str], slot: Column, order: list[str], carry: list[str]) -> DataFrame:
    """Add ``prev``: the columns ``carry`` of the preceding row of the key, whatever slice it is in.

    Rows are windowed per (key, slice); across slices only each slice's last
    row travels, so a key with a third of all rows is spread over its slices.
    """
    group = ["gk", *keys, "slot"]
    rows = df.withColumn("slot", slot.cast("long")).withColumn("gk", F.xxhash64(*keys, "slot"))
    at = F.struct(*order, *[c for c in carry if c not in order])
    ends = rows.groupBy(*group).agg(F.max(at).alias("last"))
    ends = ends.select(*group, F.lag("last").over(W.partitionBy(*keys).orderBy("slot")).alias("before"))
    inside = F.lag(at).over(W.partitionBy(*group).orderBy(*order))
    rows = rows.withColumn("_in", inside).join(ends, group)
    return rows.withColumn("prev", F.coalesce("_in", "before")).drop("_in", "before", "gk", "slot")
