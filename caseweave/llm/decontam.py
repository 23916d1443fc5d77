"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows of ``WINDOW`` consecutive words (all its words, if fewer).  A document is hit
where a window occurs in it as a run of words.

* Tokens are shingles of ``SHINGLE`` consecutive words.  They are ordered by rarity, counted over all documents.
* Every shingle of a window must be in the document, so one is a sufficient prefix: the rarest.  Documents meet a window
  only through its prefix token.
* Bounds: the token's position in the document and in the window fix where the window would begin; it must begin and end
  inside the document (length and position).
* Candidates are verified word by word over the whole window.

The windows are held as an index in every task, while the documents stream by once for the counts and once for the hits
and are never shuffled.  The index is built in blocks of at most ``BLOCK_WORDS`` words of the benchmark; a larger
benchmark takes further blocks in the same way, each over all documents.

Words: runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.  Null texts and empty texts have no words
and no hits; items without words have no windows.  A null item_id is left out of the list of items, though its hits count.
Repeated items count once by their id, repeated documents each.  Extra columns are ignored; an empty benchmark leaves
every document clean, an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_arrow, table
from .textwork import slices

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 2_000_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Index:
    """Windows of a block of items, by the shingle that a document must have."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set] = {}
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(tuple(ids[i:i + window]), set()).add(None if item is None else str(item))
        self.base = len(self.words) + 1
        self.keys: dict[int, np.ndarray] = {}                # per shingle width: the shingles looked for
        self.prefix: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def code(self, ids: tuple[int, ...]) -> int:
        """A shingle's word ids as one exact number, with its width."""
        out = 0
        for x in ids:
            out = out * self.base + x
        return out * (SHINGLE + 1) + len(ids)

    def shingles(self, window: tuple[int, ...]) -> list[int]:
        k = min(SHINGLE, len(window))
        return [self.code(window[i:i + k]) for i in range(len(window) - k + 1)]

    def watch(self, codes) -> None:
        by: dict[int, list[int]] = {}
        for c in codes:
            by.setdefault(c % (SHINGLE + 1), []).append(c)
        self.keys = {k: np.unique(np.array(v, np.int64)) for k, v in by.items()}

    def choose(self, counts: dict[int, int]) -> None:
        """Take each window's rarest shingle as its prefix."""
        for w in self.windows:
            codes = self.shingles(w)
            at = min(range(len(codes)), key=lambda i: (counts.get(codes[i], 0), codes[i]))
            self.prefix.setdefault(codes[at], []).append((w, at))
        self.watch(self.prefix)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(word ids of all texts, 0 for words that no item has; index of each text's first word, one more at the end)."""
        split = [words_of(t) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        return np.fromiter(map(self.words.get, chain.from_iterable(split), repeat(0)), np.int64, first[-1]), first

    def found(self, ids: np.ndarray):
        """(position, code) of every watched shingle; runs over the border of two texts are among them."""
        for k, keys in self.keys.items():
            n = len(ids) - k + 1
            if n < 1:
                continue
            near = ids[:n] > 0
            for j in range(1, k):
                near &= ids[j:n + j] > 0
            at = np.flatnonzero(near)
            if not len(at):
                continue
            code = ids[at]
            for j in range(1, k):
                code = code * self.base + ids[at + j]
            code = code * (SHINGLE + 1) + k
            slot = np.searchsorted(keys, code)
            slot[slot == len(keys)] = 0
            hit = keys[slot] == code
            yield at[hit], code[hit]


    def occurrences(self, texts):
        """(first word of each text, generator of (text, begin word, end word, window) of every verified window)."""
        ids, first = self.ids(texts)

        def hits():
            for at, codes in self.found(ids):
                docs_at = np.searchsorted(first, at, side="right") - 1
                for p, c, d in zip(at.tolist(), codes.tolist(), docs_at.tolist()):
                    for window, offset in self.prefix[c]:
                        begin, end = p - offset, p - offset + len(window)
                        if begin >= first[d] and end <= first[d + 1] and tuple(ids[begin:end].tolist()) == window:
                            yield d, begin, end, window
        return first, hits()


def _count(docs: DataFrame, index: Index) -> dict[int, int]:
    """Number of occurrences of each of the block's shingles in all documents."""
    index.watch({c for w in index.windows for c in index.shingles(w)})

    def run(batches):
        for batch in slices(batches, "text"):
            ids, first = index.ids(batch.column("text").to_pylist())
            doc_end = np.repeat(first[1:], np.diff(first))
            for at, code in index.found(ids):
                at_end = at + code % (SHINGLE + 1)
                codes, n = np.unique(code[at_end <= doc_end[at]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    rows = map_arrow(docs.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in rows.collect()}       # at most one row per shingle of the block


def _blocks(benchmark: DataFrame, block_words: int):
    """Item lists of at most ``block_words`` words (one item at least), read in turn."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield held


def _ready(items: list, docs: DataFrame, window: int) -> Index:
    """Index of a block with its prefixes chosen."""
    index = Index(items, window)
    if index.base ** SHINGLE * (SHINGLE + 1) >= 1 << 63:
        raise ValueError("too many distinct words in a block; lower block_words")
    index.choose(_count(docs, index))
    return index


def _mark(docs: DataFrame, index: Index) -> DataFrame:
    """Adds the block's findings to the columns ``spans`` (begin and end words, flat) and ``items``."""
    cols = docs.columns

    def run(batches):
        for batch in slices(batches, "text"):
            first, hits = index.occurrences(batch.column("text").to_pylist())
            spans, items = [list(x) for x in batch.column("spans").to_pylist()], [set(x) for x in batch.column("items").to_pylist()]
            for d, begin, end, window in hits:
                spans[d] += [begin - int(first[d]), end - int(first[d])]
                items[d] |= index.windows[window]
            spans = [_merged(x) for x in spans]
            out = {"spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
                   "n_words": pa.array(np.diff(first), pa.int64())}
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(c)) for c in cols], cols)

    return map_arrow(docs, run, docs.schema)


def _merged(flat: list[int]) -> list[int]:
    """Union of half-open spans."""
    out: list[int] = []
    for a, b in sorted(zip(flat[0::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _unmarked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")})


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) for docs (doc_id, text): the words hit, as begin and end in turn, and the items they are of."""
    texts = docs.select("doc_id", "text")
    marked = _unmarked(texts)
    blocks = 0
    for items in _blocks(benchmark, block_words):
        marked, blocks = _mark(marked, _ready(items, texts, window)), blocks + 1
    if not blocks:
        marked = _mark(marked, Index([], window))
    return marked.select("doc_id", "n_words", "spans", "items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of any item occurs; blocks sift one after the other."""
    texts = docs.select("text")
    for items in _blocks(benchmark, block_words):
        index = _ready(items, texts, window)

        def run(batches, index=index):
            for batch in slices(batches, "text"):
                hit = np.zeros(batch.num_rows, bool)
                for d, _, _, _ in index.occurrences(batch.column("text").to_pylist())[1]:
                    hit[d] = True
                yield batch.filter(pa.array(~hit))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are inside benchmark windows, and the items they come from."""
    docs = table(spark, sf_dir, "documents")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)       # -begin + end - begin + end ...
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS len
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len FROM wins),
runs AS (
  SELECT doc_id, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS win
  FROM doc_words, lens l, unnest(range(1, len(w) - l.len + 2)) r(i)),
hits AS (SELECT DISTINCT r.doc_id, r.i, r.len, w.item_id FROM runs r JOIN wins w ON r.win = w.win AND r.len = w.len),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + len)) x(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN pos p USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
