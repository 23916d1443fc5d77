"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, entered up to ``EPOCHS`` times.  A document's virtual finish
time is the number of words that its source has sent when the document ends, divided by the source's target.  All
documents of all sources are range-sorted by that time and the sequence is truncated where the total budget is spent,
so every source is served in proportion to its target at every moment.

Targets: the budget (``BUDGET`` times all words) is shared by weight; a source stops at EPOCHS times its own size, and
the excess is shared again by weight until no source is above.  That is one water level, found in closed form.

Null texts and texts without words have size 0 and are never taken.  The null source is a source, last in order.  A null
doc_id is shuffled as the text 'null'; repeated rows are separate documents.  Extra columns are ignored; an empty table
gives no rows.  Only the table of sources, one row each, is ordered in one place; no source's documents are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut
from .common import WORD, buckets_for, free, hash_bucket, hash_order, running_sum, table

# fixed values: weights of the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)                  # share of all words that the mix holds, as a fraction
EPOCHS = 2
#: Documents at least per part of the global sequence.
RANGE_ROWS = 50_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source, source_size, target) for (source, source_size): src numbers the sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = sizes.withColumn("src", F.row_number().over(order))
    w = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("src") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * EPOCHS).withColumn("level", F.col("cap") / F.col("weight"))
    # sources that are full below a level, and the weight that still shares above it
    rising = Window.orderBy("level", "src")
    w = (w.withColumn("full", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("sharing", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("budget", F.sum("source_size").over(whole) * BUDGET[0] / BUDGET[1]))
    w = w.withColumn("water", (F.col("budget") - F.col("full")) / F.col("sharing"))
    water = F.min(F.when(F.col("water") <= F.col("level"), F.struct(F.col("level"), F.col("src"), F.col("water")))).over(whole)["water"]
    return w.select("src", "source", "source_size", F.least(F.col("weight") * F.coalesce(water, F.lit(float("inf"))), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, *keep) for docs (doc_id, text, source, *keep)."""
    base = cut(docs.select(*keep, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                           hash_order().alias("key")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut(source_targets(sizes))
    total = base.count()
    parts = buckets_for(total)
    queued = base.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, base.source.eqNullSafe(sources.source)).drop(sources.source)
    queued = queued.withColumn("bucket", hash_bucket(F.col("key"), parts))
    queued = running_sum(queued, ["src"], "bucket", ["key", "doc_id", "size"], "size", "sent")
    finish = lambda n: (F.col("sent") + F.col("size") + F.col("source_size") * n) / F.col("target")
    queued = cut(queued.select(*keep, "doc_id", "source", "size", "source_size", "target", "src", *[finish(n).alias(f"v{n}") for n in range(EPOCHS)]))

    # one global sequence: range-sorted parts, whose sums tell in which of them the budget ends
    entries = queued.where("size > 0").select("src", "size", F.explode(F.array(*[f"v{n}" for n in range(EPOCHS)])).alias("v"))
    entries = cut(entries.repartitionByRange(max(2, total // max(RANGE_ROWS, math.isqrt(total))), "v", "src").withColumn("part", F.spark_partition_id()))
    budget = (sizes.agg(F.sum("source_size")).first()[0] or 0) * BUDGET[0] // BUDGET[1]
    last, spent = None, 0
    for row in entries.groupBy("part").agg(F.sum("size").alias("n"), F.max(F.struct("v", "src")).alias("end")).orderBy("part").collect():
        if spent + row["n"] > budget:
            upto = Window.partitionBy("part").orderBy("v", "src").rowsBetween(Window.unboundedPreceding, 0)
            fits = entries.where(F.col("part") == row["part"]).withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= budget - spent)
            end = fits.agg(F.max(F.struct("v", "src")).alias("end")).first()["end"]
            last = end or last
            break
        spent, last = spent + row["n"], row["end"]
    if last is None:
        copies = F.lit(0)
    else:
        before = lambda v: (F.col(v) < F.lit(last["v"])) | ((F.col(v) == F.lit(last["v"])) & (F.col("src") <= F.lit(last["src"])))
        copies = sum((F.when(before(f"v{n}"), 1).otherwise(0) for n in range(EPOCHS)), F.lit(0))
        copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *keep)


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them."""
    columns = docs.columns
    print_, id_, same, copies, alike, nth = free(docs, "_print", "_id", "_pr", "_copies", "_alike", "_nth")
    marked = docs.withColumn(print_, F.xxhash64(*columns))
    # rows that are alike in all columns are one row with the sum of their copies
    needed = marked.select("doc_id", "text", "source", F.col(print_).alias("_print"))
    picks = mix(needed, ["_print"]).groupBy(F.col("doc_id").alias(id_), F.col("_print").alias(same)).agg(
        F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).alias(alike)).where(F.col(copies) > 0)
    joined = marked.join(cut(picks), marked["doc_id"].eqNullSafe(F.col(id_)) & (F.col(print_) == F.col(same)))
    once = joined.where(F.col(alike) == 1).unionByName(joined.where(F.col(alike) > 1).dropDuplicates(["doc_id", print_]))
    return once.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM base GROUP BY source),
weighed AS (
  SELECT *, source_size * 2 AS cap, (CASE (src - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
    (sum(source_size) OVER () * 3)::DOUBLE / 2 AS budget FROM sizes),
rising AS (
  SELECT *, cap / weight AS level, coalesce(sum(cap) OVER w, 0)::DOUBLE AS full_,
    sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM weighed WINDOW w AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT arg_min((budget - full_) / sharing, level) AS water FROM rising WHERE (budget - full_) / sharing <= level),
targets AS (
  SELECT source, src, source_size, least(weight * coalesce(water, 'inf'::DOUBLE), cap::DOUBLE) AS target FROM rising, water),
queued AS (
  SELECT b.doc_id, b.size, t.src, t.source_size, t.target,
    sum(b.size) OVER (PARTITION BY t.src ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, src, size, copy, (sent + copy * source_size)::DOUBLE / target AS v FROM queued, (VALUES (0), (1)) c(copy) WHERE size > 0),
served AS (
  SELECT doc_id, src, size, sum(size) OVER (ORDER BY v, src ROWS UNBOUNDED PRECEDING) AS spent FROM entries),
takes AS (
  SELECT doc_id, src, sum(size)::BIGINT AS taken FROM served WHERE spent <= (SELECT (sum(source_size) * 3)::BIGINT // 2 FROM sizes) GROUP BY doc_id, src)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN takes t ON q.doc_id = t.doc_id AND q.src = t.src
"""
