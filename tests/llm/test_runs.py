"""Periodic runs against brute force: tiles in one task, tiles dealt to others, and the query over a whole table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from caseweave.llm import runs
from caseweave.llm.textwork import mix

DOCS = "doc_id long, text string, key string, text_ string, runs long, _keep0 string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    """Runs by comparing the words of every period; the smallest period of an interval comes first."""
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def collapsed(w, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def some_words(rng, low, high):
    n, k = rng.randint(low, high), rng.choice([1, 2, 2, 3, 5])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    if rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_tiles_of_one_task():
    rng = random.Random(3)
    for _ in range(200):
        docs = [some_words(rng, 12, 150) for _ in range(rng.randint(1, 6))]
        tile, start, end, period = runs._solve([mix(np.array([int(x[1:]) + 1 for x in w], np.uint64)) for w in docs])
        for i, w in enumerate(docs):
            assert sorted((int(s), int(e - s), int(q)) for t, s, e, q in zip(tile, start, end, period) if t == i) == brute(w)


def test_tiles_cover_every_period():
    for n in (48, 49, 100, 1_000, 5_000):
        found = runs.tiles(n, 64)
        for low, high in {(t[0], t[1]) for t in found}:
            spans = sorted(t[2:] for t in found if t[0] == low)
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(b[0] <= a[1] - min(2 * high, a[1]) for a, b in zip(spans, spans[1:]))
        assert max(t[1] for t in found) > n // 2


@pytest.mark.parametrize("tile_words", [64, 0])
def test_dealt_tiles_are_stitched(spark, tile_words):
    rng = random.Random(tile_words)
    texts = [" ".join(some_words(rng, 1, 600)) for _ in range(40)] + ["a " * 1_200, "a b c " * 200 + "x " + "a b c " * 150, " ".join(map(str, range(1_000))) + " y" * 15]
    df = spark.createDataFrame([(i, t, "k", "t", 1, "x") for i, t in enumerate(texts)], DOCS)
    out = {r["doc_id"]: r for r in runs.collapse_runs(df, ["doc_id"], tile_words=tile_words).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        want = brute(w)
        assert [tuple(r) for r in out[i]["runs"]] == want and out[i]["n_words"] == len(w)
        assert out[i]["collapsed"] == collapsed(w, want)


def test_edges(spark):
    rep = "one two three " * 10
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, rep), (None, rep), (None, rep + "four"), (None, None), (4, rep), (4, "plain text"), (5, "éè x " * 12), (6, "z" * 2_000_000), (7, "a a " * 200_000)]
    df = spark.createDataFrame([(*r, "k", "t", 1, "x") for r in rows], DOCS)
    out = runs.collapse_runs(df, ["doc_id", "key"], tile_words=5_000).collect()
    assert out[0].asDict().keys() == {"doc_id", "key", "n_words", "runs", "collapsed"}
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in out)
    full, three = [(0, 30, 3)], len("one two three")
    assert got == sorted([("1", 0, [], 0), ("2", 0, [], 0), ("3", 0, [], 0), ("None", 30, full, three), ("None", 30, full, three), ("None", 31, full, three + 5), ("None", 0, [], 0),
                          ("4", 30, full, three), ("4", 2, [], 10), ("5", 12, [(0, 12, 1)], 4), ("6", 1, [], 2_000_000), ("7", 400_000, [(0, 400_000, 1)], 1)])
    assert runs.collapse_runs(df.limit(0), ["doc_id"]).count() == 0
    assert len({r["collapsed"] for r in runs.collapse_runs(df, [], digest=True).collect()}) == 7


def test_query(spark, folder):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = runs.op11_periodic_runs(spark, folder).collect()
    assert len(out) == len(text) and sum(r["n_runs"] > 0 for r in out) > 10
    for r in out:
        w = words(text[r["doc_id"]])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 500:
            continue
        want = brute(w)
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
