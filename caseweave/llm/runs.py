"""Runs of a text: maximal stretches of words that repeat with a period, found tile by tile and stitched in Spark.

A run is a stretch of consecutive words with smallest period q, at least max(12, 2q) words long, that no neighbouring
word extends.  Periods are taken by octaves [B, 2B).  For an octave a document is exploded into tiles of 8B words that
overlap by 4B, so that any piece of a run that is too short to show in a tile lies whole in the next one:

* A document of up to ``TILE_WORDS`` words is one tile of every octave and is solved where it is read.  The tiles of a
  longer one are dealt to tasks of their own; octaves whose tiles would be shorter than ``TILE_WORDS`` share theirs.
* A tile is solved by boundary Z-functions.  Boundaries stand every B/2 words; a run of the octave holds a whole step
  between two of them together with its copy one period on.  For all boundaries and periods at once, steps are compared
  by hash, equal ones are chained, and the Z-values at both ends of a chain (how many further words are equal one period
  on, forwards and backwards) give the fragment to the word.
* Fragments are shuffled by (document, period).  Two that overlap by a period or more are one stretch; of equal
  stretches the smallest period counts, as the others are its multiples.

Only documents that have fragments send their text along to be collapsed.

Null texts and texts without words have no words and no runs.  Null ids are kept as they are; rows that repeat an id are
told apart by their text, and equal rows give equal results each.  Ties are part of the result (all runs are returned).
Extra columns are ignored; an empty table gives no rows.  A tile of the longest octave is as long as its document, so a
task needs about 80 bytes for each word of the longest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut
from .common import SPACE, id_text, join_hot, map_arrow, table
from .textwork import Words, chunks, mix

MIN_LENGTH = 12
TILE_WORDS = 1 << 14
#: Comparisons of boundaries and periods made at a time.
CELLS = 1 << 22
#: Step hashes are kept for powers of this, to extend chains.
RADIX = 16


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of 2 * step words from those of step words."""
    return mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])


def _advance(h: np.ndarray, step: int, at: np.ndarray, period: np.ndarray, sign: int, limit: int) -> np.ndarray:
    """Moves positions by ``step`` words as long as these equal the words one period on, ``limit`` times at most."""
    active = np.arange(len(at))
    for _ in range(limit):
        i = at[active] - (step if sign < 0 else 0)
        ok = (i >= 0) & (i + period[active] < len(h))
        active, i = active[ok], i[ok]
        active = active[h[i] == h[i + period[active]]]
        if not len(active):
            break
        at[active] += sign * step
    return at


def fragments(t: np.ndarray, ends: np.ndarray, lowest: int = 1, below: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) in ``t`` of the stretches of its tiles, for periods from ``lowest`` to ``below`` (powers of two).

    ``t`` holds tiles of falling length, each followed by a value that occurs once; ``ends`` are the places after these.
    """
    lengths = np.diff(np.concatenate([[0], ends])) - 1
    octave, h, step = 1, t, 1
    kept, found = {1: t}, []
    while len(lengths) and octave < below and 2 * octave <= lengths[0]:
        n = int(ends[np.searchsorted(-lengths, -2 * octave, side="right") - 1])         # tiles that can hold two periods
        while step < max(1, octave // 2):
            h = _doubled(h, step)
            step *= 2
            if step == RADIX * max(kept):
                kept[step] = h
        if octave >= lowest:
            found.append(_octave(h[:max(n - step + 1, 0)], step, octave, {k: v for k, v in kept.items() if k < step or k == 1}))
        octave *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])                       # multiples of a period fill the same stretch
    return start[first], end[first], period[first]


def _octave(h: np.ndarray, step: int, octave: int, kept: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    padded = np.concatenate([h, np.zeros(2 * octave, np.uint64)])
    bounds = -(-len(h) // step) if len(h) else 0
    if not bounds:
        return (np.zeros(0, np.int64),) * 3
    shifted = np.lib.stride_tricks.as_strided(padded[octave:], (bounds, octave), (step * 8, 8), writeable=False)
    own = h[::step]
    rows, hits = max(1, CELLS // octave), []
    for r in range(0, bounds, rows):
        at = np.flatnonzero(shifted[r:r + rows] == own[r:r + rows, None])
        hits.append((at % octave + octave) * bounds + at // octave + r)                 # by period, then boundary
    key = np.sort(np.concatenate(hits))
    opens = np.ones(len(key), bool)
    opens[1:] = key[1:] != key[:-1] + 1
    period, first = np.divmod(key, bounds)
    opens[1:] |= period[1:] != period[:-1]
    closes = np.append(opens[1:], True)[:len(key)]
    q, x, y = period[opens], first[opens] * step, (first[closes] + 1) * step
    for size in sorted(kept, reverse=True):
        limit = -(-step // size) if size == max(kept) else RADIX
        x = _advance(kept[size], size, x, q, -1, limit)
        y = _advance(kept[size], size, y, q, 1, limit)
    long_ = y - x + q >= np.maximum(2 * q, MIN_LENGTH)
    return x[long_], (y + q)[long_], q[long_]


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of tiles in falling length, each followed by a value of its own; the places after these; their order."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order] + 1)
    t = np.empty(int(ends[-1]) if len(parts) else 0, np.uint64)
    for k, (i, e) in enumerate(zip(order, ends)):
        t[e - 1 - sizes[i]:e - 1] = parts[i]
        t[e - 1] = mix(np.array([k], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0]
    return t, ends, order


def _solve(parts: list[np.ndarray], lowest: int = 1, below: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, start, end, period) of the fragments of the given tiles."""
    t, ends, order = _flat(parts)
    start, end, period = fragments(t, ends, lowest, below)
    at = np.searchsorted(ends, start, side="right")
    begin = np.concatenate([[0], ends])[at]
    return order[at] if len(parts) else at, start - begin, end - begin, period


def tiles(n: int, tile_words: int = 0) -> list[tuple[int, int, int, int]]:
    """(lowest period, periods below, first word, last word) of the tiles of a document of n words."""
    tile_words = max(tile_words or TILE_WORDS, 4 * MIN_LENGTH)
    out, low, high = [], 1, 1 << max(1, (tile_words // 4).bit_length() - 1)
    while 2 * low <= n:
        size = max(tile_words, 4 * high)                                                # high is twice the last octave
        out += [(low, high, a, min(a + size, n)) for a in range(0, max(1, n - size // 2), size // 2)]
        low, high = high, 2 * high
    return out


_PLACED = ["key", "start", "end", "period", "lowest", "below", "offset", "words", "n_words", "text", "collapsed"]
_KINDS = ("key binary, start long, end long, period long, lowest long, below long, offset long, words binary, n_words long, "
          "text binary, collapsed binary")


def _placed(keep: list[pa.Array], keep_names: list[str], types: list[pa.DataType], n: int, **columns) -> pa.RecordBatch:
    schema = {"key": pa.binary(), "words": pa.binary(), "text": pa.binary(), "collapsed": pa.binary()}
    arrays = [pa.array(columns[c], schema.get(c, pa.int64())) if c in columns else pa.nulls(n, schema.get(c, pa.int64())) for c in _PLACED]
    return pa.RecordBatch.from_arrays([*arrays, *(keep or [pa.nulls(n, t) for t in types])], [*_PLACED, *keep_names])


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period."""
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return b" ".join([w for w, c in zip(words, np.cumsum(cover)) if not c])


def collapse_runs(docs: DataFrame, keep: list[str], digest: bool = False, tile_words: int = 0) -> DataFrame:
    """(*keep, n_words, runs, collapsed) of docs (text, *keep).

    ``runs`` are (start, length, period) by start and period, numbered in words from 0.  ``collapsed`` is the text without
    the words that a run has after its first period, joined by one space, or the SHA-256 of its UTF-8 bytes.
    """
    tile_words = tile_words or TILE_WORDS
    columns = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("text").cast("binary").alias("_text"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("_ids") if keep else F.lit("").alias("_ids"), *columns)
    names = [f"_keep{i}" for i in range(len(keep))]
    finish = (lambda b: hashlib.sha256(b).hexdigest().encode()) if digest else (lambda b: b)

    def read(batches):
        for batch in batches:
            ids = batch.column("_ids").to_pylist()
            types = [batch.column(c).type for c in names]
            for at, texts in chunks(batch.column("_text")):
                w = Words(texts)
                h, n_words = w.hashes(), np.diff(w.first)
                key = [hashlib.blake2b(t, digest_size=16, key=i[:64].encode()).digest() for t, i in zip(texts, ids[at:at + len(texts)])]
                long_ = n_words > tile_words
                short = np.flatnonzero(~long_ & (n_words >= MIN_LENGTH))
                tile, start, end, period = _solve([h[w.first[i]:w.first[i + 1]] for i in short])
                doc = short[tile]
                if len(doc):
                    yield _placed([], names, types, len(doc), key=[key[i] for i in doc], start=start, end=end, period=period)
                for i in np.flatnonzero(long_):
                    numbers = np.unique(h[w.first[i]:w.first[i + 1]], return_inverse=True)[1].astype(np.uint32)
                    for lowest, below, a, b in tiles(len(numbers), tile_words):
                        yield _placed([], names, types, 1, key=[key[i]], lowest=[lowest], below=[below], offset=[a], words=[numbers[a:b].tobytes()])
                whole = long_.copy()
                whole[doc] = True
                yield _placed([batch.column(c).slice(at, len(texts)) for c in names], names, types, len(texts), key=key, n_words=n_words,
                              text=[t if x else None for t, x in zip(texts, whole)],
                              collapsed=[None if x else finish(b" ".join(t.split())) for t, x in zip(texts, whole)])

    kinds = ", ".join([_KINDS, *(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)])
    placed = cut(map_arrow(rows, read, kinds))

    def solve(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = mix(np.frombuffer(r["words"], np.uint32).astype(np.uint64) + np.uint64(1))
                _, start, end, period = _solve([words], r["lowest"], r["below"])
                if len(start):
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(start), pa.binary()), pa.array(start + r["offset"]), pa.array(end + r["offset"]), pa.array(period)],
                                                     ["key", "start", "end", "period"])

    dealt = placed.where(F.col("words").isNotNull()).select("key", "lowest", "below", "offset", "words").repartition("key", "lowest", "offset")
    parts = placed.where(F.col("period").isNotNull()).select("key", "start", "end", "period").unionByName(
        map_arrow(dealt, solve, "key binary, start long, end long, period long"))
    runs = stitch(parts)
    texts = placed.where(F.col("text").isNotNull()).select("key", "n_words", "text", *names)
    joined = join_hot(texts, cut(runs), "key", "copies", texts.count(), F.monotonically_increasing_id())

    def collapse(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = part.column("runs").to_pylist()
                out = [finish(_collapse(t.split(), [(r["start"], r["length"], r["period"]) for r in runs or []])) for t, runs in zip(part.column("text").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([part.column("n_words"), part.column("runs"), pa.array(out, pa.binary()), *(part.column(c) for c in names)],
                                                 ["n_words", "runs", "collapsed", *names])

    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    done = map_arrow(joined.select("n_words", "runs", "text", *names), collapse,
                     ", ".join([f"n_words long, runs {run_type}, collapsed binary", *(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)]))
    plain = placed.where(F.col("collapsed").isNotNull()).select("n_words", F.lit(None).cast(run_type).alias("runs"), "collapsed", *names)
    empty = F.array().cast(run_type)
    return done.unionByName(plain).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", F.coalesce("runs", empty).alias("runs"),
                                          F.col("collapsed").cast("string").alias("collapsed"))


def stitch(parts: DataFrame) -> DataFrame:
    """(key, copies, runs) of fragments (key, start, end, period); copies: how often the same fragments were found."""
    same = parts.groupBy("key", "period", "start", "end").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    joint = same.withColumn("_new", F.when(F.col("start") + F.col("period") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(before))
    whole = joint.groupBy("key", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    least = whole.groupBy("key", "start", "end").agg(F.min("period").alias("period"), F.max("copies").alias("copies"))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    return least.groupBy("key").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(run)).alias("runs"))


def with_period(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which the words of every document whose crc32(doc_id) divides by ten repeat from some word on."""
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    h = F.crc32(id_text())
    g = F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text: Column = F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), cycle), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every whole document, as digests."""
    docs = with_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = collapse_runs(docs, ["doc_id"], digest=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period"),
                      F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
                      F.col("collapsed").alias("collapsed_sha256"), "n_words")
