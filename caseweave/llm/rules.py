"""Quality rules: counts of a text, and the divergence of its distributions from language references.

Base rules fail a text of under 20 words, and one with over 30 % of its words in repeated 8-word windows.  A text that
passes is compared with the references of all languages: the histogram of character classes and the histogram of common
words, each by the Jensen-Shannon distance.  The nearest language decides; a text is rejected if a distance is above its
bound and it has enough words for its histogram to mean something.

References: sums over all documents of a language.  A common word is one with at least ``COMMON`` of the words of some
language.  Such a word has that share in at least one batch of any division of the language's texts, so the words that
are common in some batch contain them all; these are then counted exactly over all documents.

Null texts have no words.  Documents without a language help no reference and are judged like others; without any
reference only the base rules decide.  Very long texts are read whole.  Repeated rows are judged each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_arrow, table
from .textwork import LOWER, SPACE, Words, chunks, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RUN = 8
COMMON = 1 / 250
#: Words below which a text's histograms are not judged.
GUARD_WORDS = 50
#: Bounds of the distances (square root of the divergence in bits).
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45

# fixed values
SYMBOLS = b"#*$%&|<>"
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b" \t\r\x0b\x0c", b"\n", b"!", b"|", SYMBOLS.replace(b"|", b"")]
_CLASS = np.full(256, len(CLASSES), np.int64)                # other ASCII
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[0xC0:] = len(CLASSES) + 1                             # the first byte of any other code point
_CLASS[0x80:0xC0] = len(CLASSES) + 2                         # its further bytes, not counted
N_CLASSES = len(CLASSES) + 2
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_NOT_LETTER = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(texts)
    per_byte = lambda flags: np.add.reduceat(flags.astype(np.int64), w.doc_start[:-1])
    at, run = windows(w.hashes(), w.first, RUN)
    doc = w.doc[at]
    order = np.lexsort((run, doc))
    same = (run[order][1:] == run[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(run), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(w.starts) + 1, np.int64)
    begin = at[order][twice]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + RUN, -1)
    inside = np.cumsum(cover)[:-1] > 0
    dup = np.zeros(w.n_docs, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": np.diff(w.first), "word_chars": per_byte(~SPACE[w.buf] & ((w.buf & 0xC0) != 0x80)), "n_symbols": per_byte(_IS_SYMBOL[w.buf]),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(w.doc, inside, w.n_docs).astype(np.int64)}


def char_histograms(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    width = N_CLASSES + 1
    kinds = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    return np.bincount(doc * width + kinds, minlength=len(texts) * width).reshape(-1, width)[:, :N_CLASSES]


def letter_words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Runs of letters in lower case, and their hashes."""
    w = Words([t.translate(LOWER) for t in texts], _NOT_LETTER)
    return w, w.hashes().view(np.int64)


def word_histograms(texts: list[bytes], vocabulary: np.ndarray) -> np.ndarray:
    """Counts of the vocabulary's words, and of all others in the last column."""
    w, h = letter_words(texts)
    width = len(vocabulary) + 1
    slot = np.searchsorted(vocabulary, h)
    if len(vocabulary):
        slot[slot == len(vocabulary)] = 0
        slot = np.where(vocabulary[slot] == h, slot, len(vocabulary))
    return np.bincount(w.doc * width + slot, minlength=w.n_docs * width).reshape(-1, width)


@dataclass
class References:
    langs: list[str] = field(default_factory=list)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chars: np.ndarray = field(default_factory=lambda: np.zeros((0, N_CLASSES)))
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance of each row of counts from one distribution; rows without counts are at distance 0."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(np.broadcast_to(reference, p.shape))) / 2, 0, 1)), 0.0)


def _by_language(langs: list, texts: list[bytes], start: int):
    groups: dict[str, list[bytes]] = {}
    for i, t in enumerate(texts):
        if langs[start + i] is not None and t:
            groups.setdefault(langs[start + i], []).append(t)
    return groups.items()


def references(docs: DataFrame, common: float = COMMON) -> References:
    """Histograms per language of docs (text, lang), over all of them."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def candidates(batches):
        for batch in batches:
            langs, seen = batch.column("lang").to_pylist(), {}
            for start, texts in chunks(batch.column("text")):
                for lang, own in _by_language(langs, texts, start):
                    seen.setdefault(lang, []).append(letter_words(own)[1])
            for lang, parts in seen.items():
                words, n = np.unique(np.concatenate(parts), return_counts=True)
                words = words[n >= common * n.sum()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64())], ["word"])

    found = map_arrow(rows, candidates, "word long").distinct().collect()
    watched = np.sort(np.array([r["word"] for r in found], np.int64))            # at most 1 / common of a batch and language

    def count(batches):
        for batch in batches:
            langs, sums = batch.column("lang").to_pylist(), {}
            for start, texts in chunks(batch.column("text")):
                for lang, own in _by_language(langs, texts, start):
                    got = np.concatenate([char_histograms(own).sum(0), word_histograms(own, watched).sum(0)])
                    sums[lang] = sums.get(lang, 0) + got
            for lang, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(got[at], pa.int64())], ["lang", "at", "n"])

    totals: dict[str, np.ndarray] = {}
    for r in map_arrow(rows, count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["lang"], np.zeros(N_CLASSES + len(watched) + 1))[r["at"]] = r["n"]
    langs = sorted(k for k, v in totals.items() if v[N_CLASSES:].sum() > 0)
    if not langs:
        return References()
    table_ = np.stack([totals[k] for k in langs])
    chars = table_[:, :N_CLASSES] / table_[:, :N_CLASSES].sum(1, keepdims=True)
    words = table_[:, N_CLASSES:] / table_[:, N_CLASSES:].sum(1, keepdims=True)
    keep = (words[:, :-1] >= common).any(0)
    rest = words[:, -1:] + words[:, :-1][:, ~keep].sum(1, keepdims=True)
    return References(langs, watched[keep], chars, np.concatenate([words[:, :-1][:, keep], rest], 1))


def judge(docs: DataFrame, refs: References, keep: list[str]) -> DataFrame:
    """Base counts, char_distance, word_distance and nearest language of docs (text, *keep)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in [*names, "char_distance", "word_distance", "nearest"]}
            for _, texts in chunks(batch.column("text")):
                for k, v in base_counts(texts).items():
                    out[k].append(v)
                if refs.langs:
                    chars, words = char_histograms(texts), word_histograms(texts, refs.vocabulary)
                    c = np.stack([js_distance(chars, r) for r in refs.chars])
                    w = np.stack([js_distance(words, r) for r in refs.words])
                    best = (c + w).argmin(0)
                    i = np.arange(len(texts))
                    out["char_distance"].append(c[best, i]), out["word_distance"].append(w[best, i]), out["nearest"].append(best)
                else:
                    zero = np.zeros(len(texts))
                    out["char_distance"].append(zero), out["word_distance"].append(zero), out["nearest"].append(zero.astype(np.int64) - 1)
            cat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
            nearest = pa.array([refs.langs[int(i)] if i >= 0 else None for i in cat["nearest"]], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(cat[k].astype(np.int64)) for k in names], pa.array(cat["char_distance"].astype(float)), pa.array(cat["word_distance"].astype(float)), nearest,
                 *[batch.column(c) for c in keep]], [*names, "char_distance", "word_distance", "nearest", *keep])

    rows = docs.select("text", *keep)
    kinds = [*[f"{k} long" for k in names], "char_distance double", "word_distance double", "nearest string", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]]
    return map_arrow(rows, run, ", ".join(kinds))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, references(docs), ["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("n_words") >= GUARD_WORDS) & ((F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & ~far).alias("kept"), "char_distance", "word_distance", "nearest")
