"""Phrase collocations from an FM-index per shard of texts, over word ids.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and these into words at blanks.  A candidate is
a phrase of 2 to 5 words inside a piece that occurs at least ``MIN_COUNT`` times in its language.  It is scored by its worst
cut into two parts, floor(1000 * a * n / (l * r)), and dropped where a longer candidate that contains it is as frequent.

1. A task gathers the texts of a language to a shard of about ``SHARD_BYTES`` and indexes it: the word ids with a 0 between
   pieces, and the Burrows-Wheeler transforms of this sequence and of its reverse, both in the order of the first
   four words, which is all that phrases of up to five words need.  The index is a file in the shared folder.
2. Level by level, a shard gets the frequent phrases of k words that it holds, with their intervals, and
   extends them by one word.  The symbols of the reverse transform inside a phrase's interval are its right extensions
   and their counts; an extension's interval in the forward order follows from how many symbols are smaller, the one in
   the reverse order by last-to-first steps.  One step of the forward transform leads from an
   extension to its last k words, which must be a frequent phrase too: it is this phrase's left extension.
3. A phrase of k + 1 words leaves the shard under the numbers of its first and its last k words.  Counts are summed across
   shards and frequent phrases numbered in one shuffle, and go back to just those shards that hold them.  Words are
   not filtered: nearly all places of a large corpus belong to frequent ones.
4. A phrase lies inside a longer one that is as frequent exactly if an extension by one word is.  Parts of a frequent phrase
   are frequent, so cuts are joins with the same table.

Null texts have no words; a null lang is ``und``.  Empty and very long texts are taken whole; a piece that is longer than a shard is
one.  Repeated rows count each.  Ties in score and count go to the smaller phrase in UTF-8 order.  Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import Rounds, checkpoint_root, cut, drop_folder
from .common import consecutive, map_arrow, table
from .textwork import CHUNK, LOWER, Words
from .warc import open_folder

MIN_COUNT = 100
LONGEST = 5
TOP = 2_000
#: Text of a language that makes a shard, and text of all languages a task reads.
SHARD_BYTES = 10 << 20
TASK_BYTES = 32 << 20
#: Bits of a word id or place, where three of them are sorted as one number.
BITS = 21

_PIECE_END = np.zeros(256, bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _PIECE_END.copy()
_GAP[[0x20, 0x09]] = True
_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


# --- index of a shard ---------------------------------------------------------------------

def slices_at_pieces(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end where a piece ends."""
    a = 0
    while a < len(data):
        end = _ENDS.search(data, min(a + size, len(data)))
        b = end.end() if end else len(data)
        yield data[a:b]
        a = b


def sequence(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word ids from 1 on with a 0 before, between and after pieces; the word of each id."""
    data, hashes, starts, ends, piece, at, pieces = b"\n".join(texts).translate(LOWER), [], [], [], [], 0, 0
    for part in slices_at_pieces(data):
        w = Words([part], _GAP)
        closed = np.cumsum(_PIECE_END[w.buf])
        hashes.append(w.hashes())
        starts.append(w.starts + at)
        ends.append(w.ends + at)
        piece.append(closed[w.starts] + pieces)
        at += len(part)
        pieces += int(closed[-1]) + 1
    h, starts, ends, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, starts, ends, piece))
    if not len(h):
        return np.zeros(1, np.int64), []
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new)
    place = np.arange(len(h)) + 1 + np.cumsum(np.append(False, piece[1:] != piece[:-1]))
    s = np.zeros(int(place[-1]) + 2, np.int64)
    s[place] = ids
    return s, [data[a:b] for a, b in zip(starts[order[new]].tolist(), ends[order[new]].tolist())]


def split_shards(s: np.ndarray, limit: int = (1 << BITS) - 1) -> Iterator[np.ndarray]:
    """Parts of a sequence of up to ``limit`` places, cut between pieces; a longer piece is a part of its own."""
    zeros, a = np.flatnonzero(s == 0), 0
    while a < len(s) - 1:
        i = np.searchsorted(zeros, a + limit - 1, side="right") - 1
        b = int(zeros[i]) if zeros[i] > a else int(zeros[i + 1])
        yield s[a:b + 1]
        a = b


def grouped(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of (keys, place)."""
    n = len(keys[0])
    if len(keys) == 2 and n and n < 1 << BITS and max(int(k.max()) for k in keys) < 1 << BITS:
        packed = (keys[0].astype(np.uint64) << np.uint64(2 * BITS)) | (keys[1].astype(np.uint64) << np.uint64(BITS)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return np.lexsort(keys[::-1])


def transform(s: np.ndarray) -> np.ndarray:
    """For each place, in the order of the four words that start there, the symbol before it."""
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])[:len(x)]
    order = grouped(s, ahead(s, 1))
    new = np.zeros(len(s), bool)
    new[1:] = (s[order][1:] != s[order][:-1]) | (ahead(s, 1)[order][1:] != ahead(s, 1)[order][:-1])
    pair = np.empty(len(s), np.int64)
    pair[order] = np.cumsum(new)
    return s[grouped(pair, ahead(pair, 2)) - 1].astype(np.int32)


class Index:
    """Both transforms of a shard; a phrase is an interval of n places from lo on in the forward and from rlo on in the reverse order."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray):
        self.forward, self.reverse = forward, reverse
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(forward))])            # of the interval of each word
        # places of the reverse transform by symbol: a place's rank among its symbol's is its place in the interval of the symbol
        self._by_symbol = np.sort(reverse.astype(np.int64) * len(reverse) + np.arange(len(reverse)))

    @classmethod
    def build(cls, s: np.ndarray) -> "Index":
        return cls(transform(s), transform(s[::-1]))

    def dump(self) -> bytes:
        parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (self.forward, self.reverse)]
        return b"".join([len(self.forward).to_bytes(8, "little"), len(parts[0]).to_bytes(8, "little"), *parts])

    @classmethod
    def load(cls, data: bytes) -> "Index":
        places, size = (int.from_bytes(data[i:i + 8], "little") for i in (0, 8))
        back = lambda b: np.frombuffer(pa.decompress(b, 4 * places, codec="zstd", asbytes=True), np.int32)
        return cls(back(data[16:16 + size]), back(data[16 + size:]))

    def following(self) -> np.ndarray:
        """For each place of the forward order the place of what follows its first word."""
        return grouped(np.zeros(len(self.forward), np.int64), self.forward.astype(np.int64))

    def stepped(self, word: np.ndarray, rlo: np.ndarray) -> np.ndarray:
        """Start in the reverse order of phrases that start at ``rlo`` after one more word on the right: a last-to-first step."""
        return np.searchsorted(self._by_symbol, word * len(self.reverse) + rlo)

    def reverse_starts(self, lo: np.ndarray, words: int, following: np.ndarray) -> np.ndarray:
        """``rlo`` of phrases of so many words: read off at ``lo``, then searched backwards."""
        rlo, at = None, lo
        for _ in range(words):
            word = np.searchsorted(self.starts, at, side="right") - 1
            rlo = self.starts[word] if rlo is None else self.stepped(word, rlo)
            at = following[at]
        return rlo

    def right(self, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, lo, n) of all extensions by one word to the right."""
        phrase, at = spread(rlo, n)
        symbol = self.reverse[at].astype(np.int64)
        order = grouped(phrase, symbol)
        phrase, symbol = phrase[order], symbol[order]
        new = np.ones(len(order), bool)
        new[1:] = (phrase[1:] != phrase[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        before = np.concatenate([[0], np.cumsum(n)])[phrase[first]]                     # symbols of earlier phrases
        word = symbol[first] > 0
        first, count = first[word], count[word]
        # as many places earlier in the interval as there are smaller next symbols
        return phrase[first], symbol[first], lo[phrase[first]] + first - before[word], count


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, place) of all places in intervals of n places from lo on."""
    which = np.repeat(np.arange(len(lo)), n)
    return which, lo[which] + np.arange(len(which)) - np.concatenate([[0], np.cumsum(n)])[which]


# --- Spark ----------------------------------------------------------------------------------

def build_indexes(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the index files of docs (text, lang) and returns the words of each: (lang, word, *PLACE)."""
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        fs, base = open_folder(folder)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def close(lang):
            texts = held.pop(lang)
            del sizes[lang]
            s, words = sequence(texts)
            for part in split_shards(s):
                shard = uuid.uuid4().int >> 65
                own = np.unique(part)[1:]                                               # without the 0
                if not len(own):
                    continue
                dense = np.zeros(len(words) + 1, np.int64)
                dense[own] = np.arange(1, len(own) + 1)
                index = Index.build(dense[part])
                with fs.open_output_stream(f"{base}/{shard:016x}") as out:
                    out.write(index.dump())
                lo = index.starts[1:]
                same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(own), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [same(lang), pa.array([words[i - 1] for i in own.tolist()], pa.binary()).cast(pa.string()), same(shard), pa.array(lo[:-1] << 32 | np.diff(lo))],
                    ["lang", "word", *PLACE])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                b = text.as_py()
                held.setdefault(lang, []).append(b)
                sizes[lang] = sizes.get(lang, 0) + len(b) + 1
                if sizes[lang] >= SHARD_BYTES:
                    yield from close(lang)
                elif sum(sizes.values()) >= 4 * SHARD_BYTES:                            # many languages
                    yield from close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from close(lang)

    # small partitions are read together, so that the number of shards follows the text alone
    gathered = rows.coalesce(max(1, -(-size // TASK_BYTES)))
    return map_arrow(gathered, run, f"lang string, word string, {_PLACE_TYPES}")


#: Where a phrase is: the shard, and the first place and the length of its interval in the forward order (32 bits each).
PLACE = ["shard", "span"]
_PLACE_TYPES = "shard long, span long"


def _places() -> Column:
    return F.col("span").bitwiseAND(F.lit((1 << 32) - 1))


def frequent(found: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """Rows (*key, *PLACE) of keys that have ``min_count`` places in all shards, with their sum ``a`` and a number ``id`` of the key.

    Keys are dealt to 2^16 buckets in one shuffle, summed there, and numbered inside their bucket.
    """
    rows = found.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(1 << 16)).cast("int"))
    rows = rows.repartition("_b").withColumn("a", F.sum(_places()).over(Window.partitionBy("_b", *key))).where(F.col("a") >= min_count)
    rank = F.dense_rank().over(Window.partitionBy("_b").orderBy(*key))
    rows = rows.withColumn("_rank", rank)
    number = F.when(F.col("_rank") < 1 << 16, F.col("_b").cast("long") * (1 << 16) + F.col("_rank"))
    return rows.select(*key, "a", F.coalesce(number, F.raise_error(F.lit("more keys than numbers")).cast("long")).alias("id"), *PLACE)


def extend(held: DataFrame, folder: str, shards: int, words: int) -> DataFrame:
    """(pair, *PLACE): extensions by one word of the phrases of so many words held (id, *PLACE) whose last words are held too.

    ``pair`` has the number of the phrase without its last word in the upper and without its first in the lower half.
    """
    dealt = held.select("id", *PLACE).repartition(shards, "shard").sortWithinPartitions("shard", "span")

    def run(batches):
        fs, base = open_folder(folder)
        for (shard,), rows in consecutive(batches, ["shard"]):
            ids, span = rows.column("id").to_numpy(), rows.column("span").to_numpy()
            lo, n = span >> 32, span & ((1 << 32) - 1)
            with fs.open_input_stream(f"{base}/{shard:016x}") as f:
                index = Index.load(f.read())
            following = index.following()
            phrase, _, lo2, n2 = index.right(lo, index.reverse_starts(lo, words, following), n)
            inner = following[lo2]
            last = np.searchsorted(lo, inner, side="right") - 1                         # intervals of one length do not overlap
            ok = (last >= 0) & (inner < lo[last] + n[last])
            pair = (ids[phrase[ok]].astype(np.uint64) << np.uint64(32) | ids[last[ok]].astype(np.uint64)).view(np.int64)
            same = pa.array([shard]).take(pa.array(np.zeros(len(pair), np.int64)))
            yield from pa.Table.from_arrays([pa.array(pair), same, pa.array(lo2[ok] << 32 | n2[ok])], ["pair", *PLACE]).to_batches(50_000)

    return map_arrow(dealt, run, f"pair long, {_PLACE_TYPES}")


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Exact counts in docs (text, lang), as written tables.

    Phrases (lang, phrase, k, a, inside) of k = 1 to ``longest`` (5 at most) words, joined by a space, that occur ``min_count``
    times; inside: a longer one is as frequent.  Sizes (lang, total) in words.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/phrases-{uuid.uuid4().hex}"
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    rounds = Rounds(spark)                                                              # tables with places; only the last two are kept
    held = rounds.next(build_indexes(docs, folder))
    sizes = cut(held.groupBy("lang").agg(F.sum(_places()).alias("total")))
    shards = max(1, held.select("shard").distinct().count())
    held = rounds.next(frequent(held, ["lang", "word"], 1))
    table_ = cut(held.where(F.col("a") >= min_count).select("id", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last")).distinct())
    out = []
    for k in range(1, longest):
        held = rounds.next(frequent(extend(held, folder, shards, k), ["pair"], min_count))
        part = lambda name, half: table_.select(*[F.col(c).alias(f"{name}_{c}") for c in table_.columns]).withColumnRenamed(f"{name}_id", half)
        level = held.select("id", "a", F.shiftrightunsigned("pair", 32).alias("first"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("rest")).distinct()
        level = cut(level.join(part("p", "first"), "first").join(part("q", "rest"), "rest"))
        whole = level.select(F.explode(F.array(*[F.when(F.col(f"{s}_a") == F.col("a"), F.col(h)) for s, h in (("p", "first"), ("q", "rest"))])).alias("id"))
        inside = whole.where(F.col("id").isNotNull()).distinct().withColumn("inside", F.lit(True))
        out.append(table_.join(inside, "id", "left").select("lang", "phrase", F.lit(k).alias("k"), "a", F.coalesce("inside", F.lit(False)).alias("inside")))
        table_ = cut(level.select("id", "a", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "q_last").alias("phrase"), F.col("q_last").alias("last")))
    out.append(table_.select("lang", "phrase", F.lit(longest).alias("k"), "a", F.lit(False).alias("inside")))
    phrases = cut(reduce(DataFrame.unionByName, out))
    rounds.drop()
    drop_folder(spark, folder)
    return phrases, sizes


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` collocations of each language."""
    phrases, sizes = count_phrases(docs, min_count)
    part = phrases.select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = phrases.where((F.col("k") > 1) & ~F.col("inside")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    count_of = lambda name, to: part.select("lang", F.col("phrase").alias(name), F.col("a").alias(to))
    cuts = cuts.join(count_of("first", "l"), ["lang", "first"]).join(count_of("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    # decimals hold the products; div is exact
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(total AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", F.col("total").alias("n"))).alias("s"))
    rows = worst.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all whole texts."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d
), w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM p
), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS ph
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
), f AS (SELECT lang, k, ph, string_split(ph, ' ') AS ws, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT f.lang, f.ph, f.k, f.a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest
  FROM f, (SELECT unnest(range(1, 5)) AS j) WHERE j < f.k
), s AS (
  SELECT c.lang, c.ph AS phrase, c.a, l.a AS l, r.a AS r, n.n, c.j, CAST(1000 * CAST(c.a AS HUGEINT) * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ph = c.first JOIN f r ON r.lang = c.lang AND r.ph = c.rest JOIN n ON n.lang = c.lang
), worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS part
  FROM f, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = w.lang AND x.part = w.phrase AND 100 * x.a >= 100 * w.a)
), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(phrase AS BLOB)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
