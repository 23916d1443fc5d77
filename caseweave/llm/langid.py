"""Language identification by compression.

Per language a zstandard raw-content dictionary is filled with texts of that language.  A text is compressed with every
dictionary; the language whose dictionary makes it smallest is predicted, and the prediction is rejected where the
margin to the second is narrow.

Fit: at most ``DICT_BYTES`` of text per language, up to ``DOC_CHARS`` of each of a bounded, reproducible sample of
``SAMPLE_DOCS`` labelled documents per language (those with the smallest md5 of their id).  Texts are compared in lower
case with everything but letters folded into single spaces, so capitals and symbols say nothing about the language.
Texts are compressed whole, in slices of ``SLICE`` bytes that each see the fresh dictionary; sizes and margin are those of all slices
together, so every part of a text of any length has its say.

Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything where no language was
learned.  Ties go to the language with the most labelled documents, then to the first in code point order.  Repeated rows are predicted each; extra columns are
ignored; an empty table gives no rows.  The number of languages is the number of distinct labels, not of rows.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fold, hash_order, map_arrow, table

SAMPLE_DOCS = 200
DOC_CHARS = 2_000
DICT_BYTES = 120_000
#: Bytes compressed at once.  The window is made for DOC_CHARS beside the dictionary, which is out of sight some 128 KB on.
SLICE = 4_000
LEVEL = 12
MIN_MATCH = 3
#: Predictions whose relative margin is below this are rejected.
MARGIN = 0.01
#: Relative margin at which the score is about 0.73.
SCALE = 0.02
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language from labelled docs (doc_id, text, lang), the most frequent language first."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", F.xxhash64("text").alias("print"))
    known = docs.select("doc_id", "lang", "print", hash_order().alias("key"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "print"))
    first = known.where(F.col("doc_id").isNotNull()).withColumn("n", rank).where(F.col("n") <= SAMPLE_DOCS)
    # SAMPLE_DOCS rows per language, told by id and text; rows alike in both come once
    picked = F.broadcast(first.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("print").alias("p")).distinct())
    texts = docs.join(picked, (docs.doc_id == picked.i) & (docs.lang == picked.l) & (docs["print"] == picked.p)).dropDuplicates(["doc_id", "lang", "print"])
    texts = texts.select("lang", "text", hash_order("text").alias("key"))
    held: dict[str, list[bytes]] = {}
    for row in texts.orderBy("lang", "key").select("lang", "text").toLocalIterator():       # bounded by the sample
        held.setdefault(row["lang"], []).append(normalise(row["text"])[:DOC_CHARS].encode())
    return {lang: b" ".join(held[lang])[:DICT_BYTES] for lang in sorted(held, key=lambda k: (-counts[k], k))}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compressor whose frames hold nothing but the text, seen after the dictionary's content."""
    made = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=DOC_CHARS, min_match=MIN_MATCH, write_content_size=False, write_dict_id=False)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=made)


class Judge:
    """Predictions of one task."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float):
        self.langs, self.margin = list(dictionaries), margin
        self.compressors = [compressor(dictionaries[lang]) for lang in self.langs]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted) of a text."""
        plain = normalise(text) if text else ""
        if not self.langs or not any(map(str.isalpha, plain)):                          # numerals such as 1/2 are words, but no letters
            return "und", 0.0, False
        raw = memoryview(plain.encode())
        slices = [raw[i:i + SLICE] for i in range(0, len(raw), SLICE)]
        sizes = [sum(len(c.compress(part)) for part in slices) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        gap = (rest - sizes[best]) / rest
        return self.langs[best], 1.0 / (1.0 + math.exp(-min(gap / SCALE, 60.0))), gap >= self.margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for docs (doc_id, text)."""
    def run(batches):
        judge = Judge(dictionaries, margin)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            pred, score, accepted = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, whose language is accepted."""
    def run(batches):
        judge = Judge(dictionaries, margin)
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[2] for t in batch.column("text")], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    dictionaries = fit(docs.where(~held))
    out = classify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
