"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Documents with equal sets are one representative.  Several
independent trees branch the representatives by minwise tokens: a node's members go to the child named by their minimum
under the node's hash function, so a pair stays together with a chance that is its similarity.  A node of at most
``LEAF`` members is compared exhaustively by sketches; a larger one branches on, down to ``DEPTH`` tokens.  A pair of
similarity s is together in a leaf of some tree with a chance of at least 1 - (1 - s ** DEPTH) ** trees; there are as
many trees as make this ``RECALL`` at the similarity asked for.

Candidates are confirmed on full sets.  As links matter only for what they connect, confirmation has two rounds:

1. in each leaf every member is paired with its most similar predecessor; the confirmed links give components;
2. in each leaf the remaining candidates between different components are confirmed, all of them.  Here the full sets
   of the members that have such candidates come to the leaf and only links leave it, so a large group of texts that are
   nearly similar enough makes no table of pairs.  A pair that an earlier tree held is left to that tree: one whose
   DEPTH tokens are equal, told by a 32-bit hash of these per tree, so a pair is wrongly left with a chance below 1e-8.

Members that DEPTH tokens cannot tell apart are near copies, and a leaf of these may be of any size.  It is dealt into
chunks by hash: in round 1 each chunk pairs its own members (other trees deal other chunks); in round 2 the members that are not in the leaf's
largest component visit all its chunks, so each still meets everyone.

The sketch of a pair at the similarity asked for falls short of the candidates' bound, ``SIGMAS`` standard deviations
lower, with a chance below one in ten thousand.  No partner or candidate is
capped, and no leaf is sampled.

Null, empty and word-free texts have an empty set, link with nothing and are kept.  A null doc_id cannot be linked and is
kept, with a null component.  Repeated rows share their component and are kept if their id is.  Very long texts are read
whole.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import components
from ..session import cut
from .common import free, join_hot, map_arrow, table
from .textwork import LOWER, Words, chunks, mix, windows

RECALL = 0.99999
DEPTH = 4
FIRST = 2                        # tokens by which the root branches at once; it is larger than a leaf in any case
LEAF = 100
SKETCH = 128                     # minwise tokens, of which the sketch keeps one byte each; the first ones are the trees'
SIGMAS = 4


def trees_for(percent: int) -> int:
    """Independent trees that reach RECALL at a similarity; their tokens must be among the sketch's."""
    miss = 1 - (percent / 100) ** DEPTH
    trees = math.ceil(math.log(1 - RECALL) / math.log(miss)) if miss > 0 else 1
    if trees * DEPTH > SKETCH:
        raise ValueError(f"{percent} % needs {trees} trees of {DEPTH} tokens; raise SKETCH or lower DEPTH or RECALL")
    return trees


def least_equal(percent: int) -> float:
    """Equal sketch bytes that make a candidate: bytes of different tokens are equal once in 256."""
    s = percent / 100
    s -= SIGMAS * math.sqrt(s * (1 - s) / SKETCH)
    return SKETCH * (s + (1 - s) / 256)


# --- sets and sketches -----------------------------------------------------------------------

def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, one after the other; number of them per text)."""
    w = Words([t.translate(LOWER) for t in texts])
    h, n = w.hashes(), np.diff(w.first)
    parts = []
    for k in range(width, 0, -1):                           # shorter texts are one shingle of all their words
        at, run = windows(h, w.first, k)
        whole = n[w.doc[at]] >= width if k == width else n[w.doc[at]] == k
        parts.append((w.doc[at[whole]], run[whole]))
    doc, run = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(doc, kind="stable")
    doc, run = doc[order], run[order]
    edge = np.searchsorted(doc, np.arange(w.n_docs + 1))
    for i in np.flatnonzero(np.diff(edge)):
        run[edge[i]:edge[i + 1]].sort()
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return run[fresh], np.bincount(doc[fresh], minlength=w.n_docs)


_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, edges) if len(edges) else values[:0]


def sketch(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, tokens, sketch) of docs (doc_id, text): f1 and f2 identify the set."""
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "f1", "f2", "tokens", "sketch")}
            for _, texts in chunks(batch.column("text")):
                sets, n = shingle_sets(texts, width)
                some = n > 0
                edges = (np.cumsum(n) - n)[some]
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                f1[some], f2[some] = _sums(mix(sets), edges), _sums(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edges)
                x = (sets >> np.uint64(32)).astype(np.uint32)
                least = np.zeros((len(n), SKETCH), np.uint32)
                if len(edges):
                    for k in range(SKETCH):
                        least[some, k] = np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], edges)
                out["n"].append(n), out["f1"].append(f1), out["f2"].append(f2)
                out["tokens"].append(np.ascontiguousarray(least[:, :trees * DEPTH]).view(np.int32))
                out["sketch"].append(((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8))
            if not out["n"]:
                continue
            cat = {k: np.concatenate(v) for k, v in out.items()}
            rows = len(cat["n"])
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (trees * DEPTH)), pa.array(cat["tokens"].ravel()))
            sketches = pa.array([r.tobytes() for r in cat["sketch"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cat["n"].astype(np.int64)), pa.array(cat["f1"].view(np.int64)), pa.array(cat["f2"].view(np.int64)), tokens, sketches],
                                             ["doc_id", "n_shingles", "f1", "f2", "tokens", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, n_shingles long, f1 long, f2 long, tokens array<int>, sketch binary")


# --- trees -----------------------------------------------------------------------------------

def leaves(reps: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """Rows (tree, leaf, rep, members) of leaves with two members at least: those within LEAF, and the larger ones of full depth."""
    levels = range(FIRST, DEPTH + 1)
    path = lambda k: F.xxhash64("tree", F.slice("tokens", F.col("tree") * DEPTH + 1, F.lit(k)))
    rows = reps.select("rep", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("rep", "tree", *[path(k).alias(f"p{k}") for k in levels])
    small = None
    for k in levels:
        node = f"p{k}"
        sizes = rows.groupBy(node).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = cut(rows.join(sizes, node))
        done = met.where(F.col("members") <= LEAF).select("tree", F.col(node).alias("leaf"), "rep", "members")
        small = done if small is None else small.unionByName(done)
        rows = met.where(F.col("members") > LEAF).drop("members", *([node] if k < DEPTH else []))
        if k == DEPTH:
            large = met.where(F.col("members") > LEAF).select("tree", F.col(node).alias("leaf"), "rep", "members")
    return small, large


def with_paths(marks: DataFrame, trees: int) -> DataFrame:
    """Adds ``paths`` to marks (tokens, ...), in place of the tokens: a hash of the full-depth path in each tree."""
    path = lambda t: F.shiftright(F.xxhash64(F.slice("tokens", t * DEPTH + 1, F.lit(DEPTH))), 32).cast("int")
    return marks.withColumn("paths", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), path)).drop("tokens")


def _chunks_of(members: Column) -> Column:
    return F.ceil(members / LEAF).cast("int")


def _own_chunk() -> Column:
    return F.pmod(F.xxhash64("rep", "leaf"), _chunks_of(F.col("members"))).cast("int")


def _groups(batches, columns: list[str]):
    """Runs of equal leaf in sorted batches, as numpy columns; a run may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        leaf = held.column("leaf").to_numpy()
        edge = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
        if not len(edge):
            continue
        yield from _split(held.slice(0, edge[-1]), columns)
        held = held.slice(edge[-1])
    if held is not None:
        yield from _split(held, columns)


def _paths(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(path hashes of all rows, one after the other; where each row's begin, and the end)."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def _split(rows: pa.Table, columns: list[str]):
    leaf = rows.column("leaf").to_numpy()
    edge = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])
    data = {c: rows.column(c).to_pylist() if c == "items" else rows.column(c).to_numpy() for c in columns if c not in ("sketch", "paths")}
    data["sketch"] = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    paths, begin = _paths(rows.column("paths")) if "paths" in columns else (None, None)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            group = {c: v[a:b] for c, v in data.items()}
            if paths is not None:                           # a leaf is of one tree, so its rows have equally many
                group["paths"] = paths[begin[a]:begin[b]].reshape(b - a, -1) if begin[b] > begin[a] else np.zeros((b - a, 0), np.int32)
            yield group


def _alike(sketch: np.ndarray, n: np.ndarray, lo: int, hi: int, percent: int) -> np.ndarray:
    """Candidate matrix of the rows lo..hi against all: sizes that allow the similarity, and sketches near it."""
    same = (sketch[lo:hi, None, :] == sketch[None, :, :]).sum(2, dtype=np.int16)
    close = same >= least_equal(percent)
    a, b = n[lo:hi, None], n[None, :]
    return np.where(close & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)), same, 0)


def sparse_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each member of a leaf with its most similar predecessor: pairs (a, b) of rows (leaf, rep, n_shingles, sketch)."""
    def run(batches):
        for g in _groups(batches, ["rep", "n_shingles", "sketch"]):
            rep, pairs = g["rep"], []
            for lo in range(0, len(rep), 128):
                same = _alike(g["sketch"], g["n_shingles"], lo, min(lo + 128, len(rep)), percent)
                same[np.arange(len(rep))[None, :] >= np.arange(lo, lo + len(same))[:, None]] = 0
                best = same.argmax(1)
                for i in np.flatnonzero(same[np.arange(len(same)), best]):
                    pairs.append((rep[best[i]], rep[lo + i]))
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(_dealt(rows.select("leaf", "rep", "n_shingles", "sketch")), run, "a long, b long")


_PLACE = ["tree", "leaf", "rep", "n_shingles", "component", "home", "sketch", "paths"]


def _cross(g: dict, percent: int):
    """(i, j, equal sketch bytes) of all candidates between components in a leaf, in blocks.

    Visitors (not home) meet only members at home.  A pair that an earlier tree has held together is left to that one."""
    rep, comp, home, mark, paths = g["rep"], g["component"], g["home"].astype(bool), g["sketch"], g["paths"]
    for lo in range(0, len(rep), 128):
        hi = min(lo + 128, len(rep))
        same = _alike(mark, g["n_shingles"], lo, hi, percent)
        i, j = np.nonzero((same > 0) & (comp[lo:hi, None] != comp[None, :]) & (home[lo:hi, None] | home[None, :]) & (rep[lo:hi, None] < rep[None, :]))
        if len(i):
            fresh = ~(paths[lo + i] == paths[j]).any(1)
            yield lo + i[fresh], j[fresh], same[i, j][fresh]


def involved(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of leaves (columns _PLACE) that have a candidate in another component."""
    def run(batches):
        for g in _groups(batches, _PLACE):
            has = np.zeros(len(g["rep"]), bool)
            for i, j, _ in _cross(g, percent):
                has[i] = has[j] = True
            if has.any():
                out = {c: pa.array(g[c][has]) for c in _PLACE if c not in ("sketch", "paths")}
                earlier = g["paths"][has]
                out["paths"] = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(earlier) + 1, dtype=np.int32) * earlier.shape[1]), pa.array(earlier.ravel(), pa.int32()))
                out["sketch"] = pa.array([r.tobytes() for r in g["sketch"][has]], pa.binary())
                yield pa.RecordBatch.from_arrays([out[c] for c in _PLACE], _PLACE)

    rows = _dealt(rows.select(*_PLACE))
    return map_arrow(rows, run, rows.schema)


def cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between components in leaves (columns _PLACE and items, the full set); a pair that links of its leaf already connect is not tested."""
    def run(batches):
        for g in _groups(batches, [*_PLACE, "items"]):
            rep, comp, links, parent = g["rep"].tolist(), g["component"].tolist(), [], {}

            def find(c):
                while c in parent:
                    c = parent[c]
                return c

            for i, j, same in _cross(g, percent):
                for k in np.argsort(-same, kind="stable").tolist():
                    a, b = int(i[k]), int(j[k])
                    x, y = find(comp[a]), find(comp[b])
                    if x != y and _reaches(g["items"][a], g["items"][b], percent):
                        parent[max(x, y)] = min(x, y)
                        links.append((rep[a], rep[b]))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return map_arrow(_dealt(rows.select(*_PLACE, "items")), run, "u long, v long")


def _reaches(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets, given as sorted hashes, reach the similarity."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf").sortWithinPartitions("leaf", "rep")


# --- confirmation ----------------------------------------------------------------------------

def full_sets(needed: DataFrame, docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, items) of the representatives in ``needed`` (column rep): items are the sorted hashes of the whole set."""
    needed = needed.select("rep").distinct().join(reps.select("rep", "f1"), "rep")
    texts = docs.join(needed, docs.doc_id == needed.rep).select("rep", "f1", "text")

    def run(batches):
        for batch in batches:
            for start, texts in chunks(batch.column("text")):
                values, n = shingle_sets(texts, width)
                ends = np.cumsum(n)
                f1 = np.zeros(len(n), np.uint64)
                f1[n > 0] = _sums(mix(values), (ends - n)[n > 0])
                # an id may stand for several texts; the representative's is told by its set
                keep = np.flatnonzero(f1.view(np.int64) == batch.column("f1").slice(start, len(texts)).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("rep").slice(start, len(texts)).to_numpy()[keep]),
                     pa.array([values[ends[i] - n[i]:ends[i]].tobytes() for i in keep], pa.binary())], ["rep", "items"])

    return cut(map_arrow(texts, run, "rep long, items binary").dropDuplicates(["rep"]))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity."""
    def run(batches):
        for batch in batches:
            ok = [_reaches(x, y, percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")], ["u", "v"])

    first, second = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return map_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text)."""
    return _judged(docs, width, percent).drop("key")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``key``, which tells the set of the text; null for rows that are linked with nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trees = trees_for(percent)
    sketched = cut(sketch(docs, width, trees))
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    reps = cut(sketched.where(linkable).groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    small, large = leaves(reps, trees)
    marks = reps.select("rep", "n_shingles", "sketch")

    near = small.select("leaf", "rep").unionByName(large.select(F.xxhash64("leaf", _own_chunk()).alias("leaf"), "rep"))
    pairs = cut(sparse_pairs(near.join(marks, "rep"), percent).distinct())
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    links = cut(confirm(pairs, full_sets(ends, docs, reps, width), percent))
    comp = cut(components(links))

    named = lambda rows: rows.join(comp, rows.rep == comp.node, "left").select(*rows.columns, F.coalesce("component", "rep").alias("component"))
    small, large = cut(named(small)), cut(named(large))
    mixed = lambda rows: rows.groupBy("leaf").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leaf")
    at_home = small.join(mixed(small), "leaf", "left_semi").select("tree", "leaf", "rep", "component", F.lit(True).alias("home"))
    parts = large.groupBy("leaf", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("leaf").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = large.join(largest.select("leaf", F.col("m.main").alias("main")), "leaf")
    everywhere = F.sequence(F.lit(0), _chunks_of(F.col("members")) - 1)
    open_ = open_.withColumn("chunk", F.explode(F.when(F.col("component") == F.col("main"), F.array(_own_chunk())).otherwise(everywhere)))
    visiting = open_.select("tree", F.xxhash64("leaf", "chunk").alias("leaf"), "rep", "component", (F.col("chunk") == _own_chunk()).alias("home"))
    placed = at_home.unionByName(visiting).join(with_paths(reps.select("rep", "n_shingles", "sketch", "tokens"), trees), "rep")
    placed = placed.withColumn("paths", F.slice("paths", F.lit(1), F.col("tree")))         # those of earlier trees
    meeting = cut(involved(placed, percent))
    more = cut(cross_links(meeting.join(full_sets(meeting, docs, reps, width), "rep"), percent))
    if not more.isEmpty():
        comp = cut(components(links.unionByName(more)))

    key = set_key()
    ids = cut(reps.join(comp, reps.rep == comp.node, "left").select(key.alias("key"), "copies", F.coalesce("component", "rep").alias("component")))
    rows = sketched.select("doc_id", "n_shingles", F.when(linkable, key).alias("key"))
    out = join_hot(rows, ids, "key", "copies", sketched.count(), F.xxhash64("doc_id"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def set_key() -> Column:
    return F.concat_ws("/", "f1", "f2", "n_shingles")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one per component, and of rows with equal id and text one.

    Where an id stands on several rows, a row goes by its own text's set: another text under the same id stays.
    """
    gid, gset, aid, text, place = free(docs, "_gid", "_gset", "_aid", "_text", "_place")
    gone = cut(_judged(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(gid), F.col("key").alias(gset)).distinct())
    again = cut(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias(aid)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(aid))
    is_gone, is_again = docs["doc_id"].cast("long") == F.col(gid), docs["doc_id"].cast("long") == F.col(aid)
    if again.isEmpty():
        return docs.join(gone.select(gid), is_gone, "left_anti")
    several = docs.join(again, is_again, "left_semi").withColumn(text, F.sha2("text", 256)).withColumn(place, F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", text])
    # sets of just these rows; a place stands for an id and a text
    places = several.select(F.col(place).alias("p"), F.col("doc_id").cast("long").alias("i"), "text")
    sets = sketch(places.select(F.col("p").alias("doc_id"), "text").dropDuplicates(["doc_id"]), width, 1).select(F.col("doc_id").alias("at"), set_key().alias("set"))
    lost = places.select("p", "i").join(sets, F.col("p") == F.col("at")).join(gone, (F.col("i") == F.col(gid)) & (F.col("set") == F.col(gset))).select("p").distinct()
    kept = several.join(lost.withColumnRenamed("p", aid), F.col(place) == F.col(aid), "left_anti").select(*docs.columns)
    single = docs.join(again, is_again, "left_anti").join(gone.select(gid), is_gone, "left_anti")
    return single.unionByName(kept)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: sets of three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.c, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""
