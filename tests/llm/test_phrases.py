"""Phrase mining against plain counting: the index itself, shards, and whole results on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseweave.llm import phrases

DOCS = "text string, lang string, word string, n long, w long, shard string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower)]


def brute(rows, least, top):
    total, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for ws in pieces(text):
            total[lang or "und"] += len(ws)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least}
        ranked = []
        for p, a in often.items():
            if len(p) < 2 or any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def some_text(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(n))


def mined(spark, rows, least, top=2_000):
    df = spark.createDataFrame([(*r, "x", 1, 2, "s") for r in rows], DOCS)
    return sorted(tuple(r) for r in phrases.collocations(df, least, top).collect())


def test_intervals_of_both_directions():
    rng = random.Random(4)
    for wide in (False, True):
        s, words = phrases.sequence([some_text(rng, 400, ["a", "b", "Bb", "c"]).encode() for _ in range(3)])
        if wide:
            phrases.BITS, bits = 4, phrases.BITS                                        # too narrow: sorted by several keys
        try:
            index = phrases.Index.build(s)
            index = phrases.Index.load(index.dump())
            following, known = index.following(), [(i,) for i in range(1, len(words) + 1)]
            lo, n = index.starts[1:-1], np.diff(index.starts[1:])
            for k in range(1, 6):
                grams = Counter(tuple(s[i:i + k].tolist()) for i in range(len(s) - k + 1) if (s[i:i + k] > 0).all())
                assert dict(zip(known, n.tolist())) == grams
                if k == 5:
                    break
                rlo = index.reverse_starts(lo, k, following)
                for g, a, m in zip(known, rlo.tolist(), n.tolist()):                    # the symbols there are the words after it
                    after = sorted(int(s[i + k]) for i in range(len(s) - k + 1) if tuple(s[i:i + k].tolist()) == g)
                    assert sorted(index.reverse[a:a + m].tolist()) == after
                phrase, word, lo2, n = index.right(lo, rlo, n)
                grown = [(*known[p], int(w)) for p, w in zip(phrase, word)]
                # one step on, an extension lies in the interval of its last words
                order = np.argsort(lo)
                last = order[np.searchsorted(lo[order], following[lo2], side="right") - 1]
                assert [known[i] for i in last] == [g[1:] for g in grown]
                known, lo = grown, lo2
        finally:
            if wide:
                phrases.BITS = bits


def test_shards_are_cut_between_pieces():
    s = np.array([0, 1, 2, 0, 3, 0, 4, 5, 6, 7, 8, 0, 9, 0])
    parts = list(phrases.split_shards(s, 5))
    assert [p.tolist() for p in parts] == [[0, 1, 2, 0], [0, 3, 0], [0, 4, 5, 6, 7, 8, 0], [0, 9, 0]]
    assert [p.tolist() for p in phrases.split_shards(s, 100)] == [s.tolist()]
    assert list(phrases.split_shards(np.zeros(1, np.int64))) == []


@pytest.mark.parametrize("shard_bytes", [300, 10 << 20])
def test_counts_of_any_sharding(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    rng = random.Random(8)
    vocabulary = ["the", "of", "The", "new", "york", "é", "x-1", "a'b", " ", "zz"]
    fixed = ["in the New York of zz", "é x-1 a'b zz new york"]
    rows = [(some_text(rng, 40, vocabulary) + rng.choice(fixed) + rng.choice([" ", "."]), rng.choice(["en", "en", "fr", None])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" \t\n.,", None), (fixed[0], "und"), *[(fixed[1], "de")] * 30]
    want = brute(rows, 12, 40)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "fr", "und", "de"}
    assert mined(spark, rows, 12, 40) == want


def test_edges(spark):
    assert mined(spark, [], 1) == [] and mined(spark, [(None, None), ("", "en"), ("...", "en")], 1) == []
    assert mined(spark, [("a", "en")] * 5, 1) == []
    rows = [("a b c d e f " * 3, "en"), ("Z " * 50_000, "fr")]                         # one piece, longer phrases inside longer ones
    assert mined(spark, rows, 2) == brute(rows, 2, 2_000)
