"""Sharding by balanced label propagation.

Documents that share a link (here: equal texts) should lie in one shard, and the shards' bytes should be near equal.

* Documents start in a shard picked by hash.  Copies of one text that lie in one shard are held as one block (link,
  shard, bytes): they are interchangeable, so a text with a third of all rows is at most as many rows as there are shards.
* Every link of at least two documents goes through the same rounds, larger ones (by powers of 16) before smaller
  ones.  A round compares the blocks of a link with one another and lets it ask for the shard where most of its
  documents are and its need has room; where none of its own shards has, for one drawn in proportion to room.  Its need is all of it, or one document
  where no shard could take all.  A shard's quota is its capacity less what has settled there; it admits what asks in hash
  order.  The outcome is joined back to the blocks: a link that is admitted settles whole, one that no shard can take settles
  as many documents as fit and asks on with the rest, so that it fills one shard after the other.  Each round is a written table.
* Capacity is the mean, and up to ``SLACK`` more where unlinked documents are less than that part of a shard.
* Rounds end: what asks first in its shard is always admitted, and room never grows.  Where one document is larger than
  any room left, it goes to the widest shard all the same; as capacities sum to no less than all bytes, that befalls fewer documents
  than there are shards, and each puts a shard above its capacity by less than its own size.
* Documents without a link have no neighbours; they fill the rest up, the largest first, each size class dealt by
  running sums over what the class before has left open, so that the last class levels the shards.

Sizes are the UTF-8 bytes of the text plus 8.  Null texts have 8, the crc of no bytes (0), and no link.  Empty texts are
equal texts.  Null doc_ids and repeated rows are placed like any row.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut
from .common import BUCKET_ROWS, buckets_for, hash_bucket, hash_order, join_hot, running_sum, table

SHARDS = 24
#: Part of a shard by which capacity may exceed the mean where unlinked documents are too few to level the shards.
SLACK = 0.005
#: Size classes of unlinked documents, as parts of a shard's capacity.
CLASSES = (16, 128, 1024)
#: Different values of a draw.
LOTS = 1 << 40


def _loads(df: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for r in df.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():        # one row per shard
        out[r["shard"]] = int(r["b"])
    return out


def _array(values: list) -> "F.Column":
    return F.array(*[F.lit(v) for v in values])


def propagate(blocks: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Blocks (link, shard, bytes) at rest of blocks (link, shard, bytes, unit): unit is the size of the link's largest document."""
    link = Window.partitionBy("link")                       # at most one row per shard
    blocks = blocks.withColumn("rest", F.sum("bytes").over(link)).withColumn("first", F.min("shard").over(link) == F.col("shard"))
    blocks = cut(blocks.withColumn("step", F.length(F.hex("rest"))))
    steps = blocks.where("first").groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()     # a row per power of 16
    room, settled, turn = [capacity] * shards, [], 0
    for step, left in sorted(((r["step"], r["n"]) for r in steps), reverse=True):
        waiting = blocks.where(F.col("step") == step)
        while left:
            done = cut(_round(waiting, room, turn, buckets_for(left)))
            settled.append(done.where(F.col("first") & (F.col("took") > 0)).select("link", F.col("target").alias("shard"), F.col("took").alias("bytes")))
            waiting = done.where("took < rest").withColumn("rest", F.col("rest") - F.col("took")).drop("target", "took")
            came = done.where("first").groupBy("target").agg(
                F.sum("took").alias("took"), F.count(F.when(F.col("took") < F.col("rest"), 1)).alias("left")).collect()   # one row per shard
            for r in came:
                room[r["target"]] -= int(r["took"])
            left, turn = sum(r["left"] for r in came), turn + 1
    if not settled:
        return blocks.select("link", "shard", "bytes")
    return functools.reduce(DataFrame.unionByName, settled)


def _round(waiting: DataFrame, room: list[int], turn: int, buckets: int) -> DataFrame:
    """Adds to blocks (link, shard, bytes, unit, rest) the shard their link asks for and what it takes there of the ``rest``."""
    most, widest = max(room), room.index(max(room))
    rooms = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(x).cast("long").alias("room")) for k, x in enumerate(room)])
    # all of the link, or a document of it where no shard has room for all
    need = F.when(F.col("rest") <= most, F.col("rest")).otherwise(F.col("unit"))
    fits = F.element_at(rooms, F.col("shard") + 1)["room"] >= need
    pull = F.max(F.when(fits, F.struct("bytes", F.xxhash64("link", "shard").alias("lot"), "shard"))).alias("pull")
    asks = waiting.groupBy("link").agg(pull, F.first("rest").alias("rest"), F.first("unit").alias("unit"))
    # the least of exponential waiting times with the rooms as rates is a draw in proportion to room
    lot = lambda s: (F.pmod(F.xxhash64("link", F.lit(turn), s["shard"]), F.lit(LOTS)) + 1) / (LOTS + 1)
    drawn = F.array_max(F.transform(rooms, lambda s: F.when((s["room"] >= need) & (s["room"] > 0), F.struct(F.log(lot(s)) / s["room"], s["shard"].alias("shard")))))
    target = F.coalesce(F.col("pull.shard"), drawn["shard"], F.lit(widest)).cast("int")
    asks = asks.select("link", "rest", "unit", target.alias("target"), F.md5("link").alias("h")).withColumn("b", hash_bucket(F.col("h"), buckets))
    asks = running_sum(asks, ["target"], "b", ["h"], "rest", "ahead")
    left = F.greatest(F.element_at(rooms, F.col("target") + 1)["room"] - F.col("ahead"), F.lit(0))
    part = F.least(F.col("rest"), F.floor(left / F.col("unit")) * F.col("unit"))
    forced = (F.col("unit") > most) & (F.col("ahead") == 0)
    took = (F.when(forced, F.least("rest", "unit")).when(F.col("rest") > most, part)
            .when(left >= F.col("rest"), F.col("rest")).otherwise(F.lit(0)).cast("long"))
    return waiting.join(asks.select("link", "target", took.alias("took")), "link")


def _deal(start: "F.Column", size: "F.Column", bounds: "F.Column") -> "F.Column":
    """Index of the interval (rising upper ``bounds``) that holds the middle of a document; the last one takes what is beyond."""
    below = F.size(F.filter(bounds, lambda b: b <= start + size / 2))
    return F.least(below, F.size(bounds) - 1)


def shard_by_links(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` to nodes (doc_id, size, link, ...): links together as far as capacity lets, bytes near equal."""
    nodes = cut(nodes.withColumn("key", hash_order()))
    total, count = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return nodes.withColumn("shard", F.lit(None).cast("int")).drop("key")
    capacity = -(-total // shards)
    first = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    dealt = nodes.where(F.col("link").isNotNull()).groupBy("link", first.alias("shard")).agg(
        F.sum("size").alias("bytes"), F.max("size").alias("unit"), F.count(F.lit(1)).alias("n"))
    link = Window.partitionBy("link")                       # at most one row per shard
    dealt = cut(dealt.withColumn("copies", F.sum("n").over(link)).withColumn("unit", F.max("unit").over(link)).where("copies > 1"))
    unlinked = total - (dealt.agg(F.sum("bytes")).first()[0] or 0)
    limit = math.ceil(capacity * SLACK)
    top = capacity + max(0, limit - unlinked // shards)
    blocks = propagate(dealt.select("link", "shard", "bytes", "unit"), shards, top)

    upto = Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.withColumn("end", F.sum("bytes").over(upto)).groupBy("link").agg(
        F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    copies = dealt.groupBy("link").agg(F.first("copies").alias("copies"))
    placed = cut(join_hot(nodes, cut(ends.join(copies, "link")), "link", "copies", count, F.xxhash64("key", "size")))

    whole = placed.where(F.size("ends") == 1).withColumn("shard", F.col("ends")[0]["shard"])
    split = placed.where(F.size("ends") > 1).withColumn("bucket", hash_bucket(F.col("key"), F.ceil(F.col("copies") / BUCKET_ROWS)))
    split = running_sum(split, ["link"], "bucket", ["key", "doc_id"], "size", "start")
    split = split.withColumn("shard", F.element_at("ends", _deal(F.col("start"), F.col("size"), F.col("ends")["end"]) + 1)["shard"])
    linked = whole.select(*nodes.columns, "shard").unionByName(split.select(*nodes.columns, "shard"))

    single = placed.where(F.col("ends").isNull())
    size_class = sum((F.when(F.col("size") <= capacity / c, 1).otherwise(0) for c in CLASSES), F.lit(0))
    single = single.withColumn("class", size_class).withColumn("bucket", hash_bucket(F.col("key"), buckets_for(count)))
    single = cut(running_sum(single, ["class"], "bucket", ["key", "doc_id", "size"], "size", "start"))
    load = _loads(blocks, shards)
    found = single.groupBy("class").agg(F.sum("size").alias("b"), F.max("size").alias("most")).collect()
    totals, most = {r["class"]: int(r["b"]) for r in found}, {r["class"]: r["most"] for r in found}
    filled = None
    for c in sorted(totals):
        level = (sum(load) + sum(n for k, n in totals.items() if k >= c)) / shards
        room = [max(0.0, level - x) for x in load]
        # documents of this class go where the largest of them fits, as far as there are such shards
        room = [x if x >= most[c] else 0.0 for x in room] if max(room) >= most[c] else room
        scale, bounds, end = totals[c] / (sum(room) or 1.0), [], 0.0
        for x in room:
            end += x * scale
            bounds.append(end)
        part = single.where(F.col("class") == c).withColumn("shard", _deal(F.col("start"), F.col("size"), _array(bounds)))
        load = [a + b for a, b in zip(load, _loads(part.select("shard", F.col("size").alias("bytes")), shards))]
        part = part.select(*nodes.columns, "shard")
        filled = part if filled is None else filled.unionByName(part)
    out = linked if filled is None else linked.unionByName(filled)
    return out.drop("key")


def number_slots(df: DataFrame, count: int) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each shard, without gaps."""
    keyed = df.withColumn("_key", hash_order()).withColumn("_one", F.lit(1).cast("long"))
    keyed = keyed.withColumn("_b", hash_bucket(F.col("_key"), buckets_for(count)))
    return running_sum(keyed, ["shard"], "_b", ["_key", "doc_id", "size"], "_one", "slot").drop("_key", "_one", "_b")


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, link) of documents (doc_id, text)."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.sha2("text", 256).alias("link"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes, copies of a text together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = cut(shard_by_links(nodes_of(docs)))
    return number_slots(placed, placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "link")
