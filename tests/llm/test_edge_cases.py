"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from caseweave.llm import chatfmt, decontam, langid, mixing, neardup, quality, rules, sharding, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, shard string, link string, n_words long"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    text = "Some plain words that make a sentence of a decent length, so that all operators have something to work on here."
    rows = [(1, text, "en", "a"), (2, text, "en", None), (3, None, None, "b"), (4, "", "de", "b"), (5, "   \n\t ", "de", "b"), (6, LONG, "en", "a"),
            (7, "zwei Wörter", "de", "c"), (7, "zwei Wörter", "de", "c"), (None, text, "en", "a"), (None, None, None, None), (8, "123 !!! ###", None, "a"),
            (9, text + " One more.", "en", "b"), (10, "\x00 odd   \U0001F600 text", "en", "c")]
    return spark.createDataFrame([(*r, None, 5, 0.5, "k", "s", "l", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, empty):
    known = langid.fit(docs)
    out = langid.classify(docs, known).collect()
    assert len(out) == 13
    und = [r["doc_id"] for r in out if r["lang_pred"] == "und"]
    assert sorted(map(str, und)) == ["3", "4", "5", "8", "None"]
    assert all(0 <= r["score"] <= 1 for r in out) and not any(r["accepted"] for r in out if r["lang_pred"] == "und")
    kept = langid.keep_identified(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 6}
    assert langid.fit(empty) == {} and langid.classify(empty, known).count() == 0
    assert {r["lang_pred"] for r in langid.classify(docs, {}).collect()} == {"und"}


def test_warc(spark):
    html = "x" * 150
    rows = [(1, "http://A.example.org/p?q=1#f", html, 1), (2, None, html, 1), (3, "no scheme", "short", 1), (4, "http://b.example.org/", "short", 1), (5, "http://b c/\n", None, 1),
            (6, "http://b.example.org/", "", 1), (1, "http://A.example.org/p?q=1#f", html, 1), (None, "http://n.example.org/", html, 1), (7, "http://l.example.org/", "ü" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset long")
    from caseweave.session import checkpoint_root
    folder = f"{checkpoint_root(spark)}/warc-test-{id(rows)}"
    captures = warc.write_archives(pages, folder)
    parts = warc.build_index(captures, folder)
    out = warc.read_records(warc.look_up(captures, parts, folder), folder).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in out}
    assert got == {("1", "response", None), ("2", "revisit", "1"), ("3", "response", None), ("4", "response", None), ("5", "response", None),
                   ("6", "response", None), (None, "revisit", "1"), ("7", "response", None)}
    for r in out:
        want = {"7": "ü" * 300_000, "5": "", "6": "", "3": "short", "4": "short"}.get(r["page_id"], html).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
    assert warc.look_up(spark.createDataFrame([("zz) 9",)], "entry string"), parts, folder).count() == 0
    none = pages.limit(0)
    folder += "-none"
    captures = warc.write_archives(none, folder)
    assert warc.build_index(captures, folder) == [] and captures.count() == 0


def test_index_runs_over_blocks(spark, monkeypatch):
    """Equal entries in several blocks are all found, and a look-up reads few blocks."""
    import pyarrow.fs as pafs
    import tempfile
    rows = [(f"org,example)/{i % 40:03d} {i % 7}", "f", i, 1) for i in range(5_000)]
    df = spark.createDataFrame(rows, "entry string, file string, offset long, length long")
    folder = tempfile.mkdtemp(prefix="spark-")
    parts = warc.build_index(df, folder)
    part = warc.IndexPart(pafs.LocalFileSystem(), f"{folder}/{parts[0][1]}")
    assert len(part.firsts) == -(-5_000 // warc.BLOCK_ENTRIES)
    for entry in {r[0] for r in rows}:
        assert sorted(o for _, o, _ in part.find(entry)) == sorted(r[2] for r in rows if r[0] == entry)
    assert part.find("org,example)/999 1") == [] and part.find("a") == []


def test_sharding(spark, docs, empty):
    out = sharding.number_slots(sharding.shard_by_links(sharding.nodes_of(docs), 3), 13).collect()
    assert len(out) == 13 and all(0 <= r["shard"] < 3 for r in out)
    for k in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    by_id = {r["doc_id"]: r for r in out if r["doc_id"]}
    assert by_id[3]["size"] == 8 and by_id[3]["text_crc32"] == 0 and by_id[7]["size"] == len("zwei Wörter".encode()) + 8
    assert by_id[7]["text_crc32"] == zlib.crc32("zwei Wörter".encode())
    assert by_id[1]["shard"] == by_id[2]["shard"]
    assert sharding.shard_by_links(sharding.nodes_of(empty), 3).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (9, 1), (8, 0), (7, 0), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")
    ranking = quality.learn(docs, labels)
    out = quality.score(docs, ranking, ["doc_id"]).collect()
    assert len(out) == 13 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(empty, ranking, ["doc_id"]).count() == 0
    nothing = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing, ["doc_id"]).collect()} == {0.5}


def test_chat(spark):
    hard = ["</s>", "[INST] x [/INST]", "a\\", "\\[INST]", "\\\\</s>\\", "<<SYS>> <</SYS>>\n", "<role:x> </role>", "[[INST]]", "", None, " ", "[INST", "\n</s>\n", "üü\U0001F600 </s> $1 \\1"]
    rows = [(1, i, r, t, 9) for i, t in enumerate(hard) for r in [["user", "assistant", "system", "tool use>", None][i % 5]]]
    rows += [(2, None, "user", "x", 9), (2, 1, "assistant", "y", 9), (2, 1, "assistant", "y", 9), (None, 0, "user", "</s>", 9), (3, 0, "assistant", "z" * 2_000_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    out = {r["conv_id"]: r for r in chatfmt.format_chats(df).withColumn("back", chatfmt.parse(F.col("formatted"))).collect()}
    assert set(out) == {1, 2, 3, None}
    for r in out.values():
        assert r["back"] == r["source"]
    assert [t["text"] for t in out[1]["back"]] == [t or "" for t in hard]
    assert out[2]["passes"] == 0 and out[1]["passes"] == 1 and out[None]["passes"] == 1
    assert len(out[2]["back"]) == 3
    assert chatfmt.format_chats(df.limit(0)).count() == 0


def test_decontamination(spark, docs, empty):
    text = docs.where("doc_id = 1").first()["text"]
    items = spark.createDataFrame([(1, text), (2, "zwei wörter"), (2, "zwei wörter"), (3, None), (4, "!!!"), (None, "ZWEI, Wörter"), (5, "not there at all")], "item_id long, text string")
    out = {(r["doc_id"], r["n_words"]): r for r in decontam.find_contamination(docs, items).collect()}
    hit = {k[0]: r["items"] for k, r in out.items() if r["spans"]}
    assert hit == {1: ["1"], 2: ["1"], None: ["1"], 9: ["1"], 7: ["2"]}
    assert out[(9, 23)]["spans"] == [0, 21]
    for size in (1, 30):                                    # blocks of the benchmark give the same as one
        again = decontam.find_contamination(docs, items, block_words=size).collect()
        assert sorted(map(str, again)) == sorted(map(str, out.values())) or len(again) == 13
        assert {r["doc_id"]: r["items"] for r in again if r["spans"]} == hit
    clean = decontam.remove_contaminated(docs, items, block_words=30)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["10", "3", "4", "5", "6", "8", "None"]
    assert decontam.find_contamination(empty, items).count() == 0
    assert decontam.remove_contaminated(docs, items.limit(0)).count() == 13 and decontam.find_contamination(docs, items.limit(0)).where("size(spans) > 0").count() == 0


def test_url_filter(spark):
    urls = ["http://x.org/", "https://a.EXAMPLE.org/es/1", "http://example.org/en/1x", "http://example.org/en/2", "http://q.com/fr/", "http://q.com/de/", "http://q.com/dex", "http://badexample.org/es/",
            "http://l.net/a?utm_source=f", "http://l.net/a/", "https://www.L.net:443/a#t", "http://l.net/b", None, "", "no", "://", "ftp://", "http://l.net/a"] + ["http://l.net/a"] * 3
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    listed = df.where(F.col("url").contains("utm_")).select(urlfilter.canonical(F.col("url")).alias("url"))
    for room in (1 << 20, 0):                               # filter in every task, or joined by block
        out = {r["page_id"]: r for r in urlfilter.judge(df, listed, room).collect()}
        assert len(out) == len(urls)
        assert [out[i]["rule"] for i in range(8)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/"]
        assert [out[i]["verdict"] for i in range(8)] == ["allow", "block", "block", "allow", "allow", "block", "allow", "allow"]
        assert [i for i in range(8, len(urls)) if out[i]["verdict"] == "block"] == [8, 9, 10, 17, 18, 19, 20]
        assert (out[12]["host"], out[12]["path"], out[12]["rule"]) == ("", "", None)
        assert (out[10]["host"], out[10]["path"]) == ("www.l.net:443", "/a")
    assert urlfilter.judge(df, listed.limit(0)).where("verdict = 'block'").count() == 3
    assert urlfilter.judge(df.limit(0), listed).count() == 0


def test_near_duplicates(spark, docs, empty):
    out = neardup.near_duplicates(docs, 3, 85).collect()
    assert len(out) == 13
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[9]["component_id"] == 1
    assert by[1]["kept"] and not by[2]["kept"] and not by[9]["kept"]
    assert [by[i]["n_shingles"] for i in (3, 4, 5, 7)] == [0, 0, 0, 1] and all(by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 10))
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "10", "3", "4", "5", "6", "7", "8", "None", "None"]
    assert neardup.near_duplicates(empty, 3, 85).count() == 0 and neardup.keep_one(empty).count() == 0


def test_rules(spark, docs, empty):
    refs = rules.references(docs)
    assert refs.langs == ["de", "en"] and abs(refs.chars.sum(1) - 1).max() < 1e-9 and abs(refs.words.sum(1) - 1).max() < 1e-9
    out = {r["doc_id"]: r for r in rules.judge(docs, refs, ["doc_id"]).collect()}
    assert out[3]["n_words"] == out[4]["n_words"] == out[5]["n_words"] == 0
    assert out[6]["n_words"] == 240_000 and out[6]["n_repeat_words"] == 240_000
    assert out[8]["n_symbols"] == 3 and out[7]["word_chars"] == 10
    assert rules.judge(empty, refs, ["doc_id"]).count() == 0 and rules.references(empty).langs == []
    assert rules.judge(docs, rules.References(), ["doc_id"]).count() == 13


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == 13
    total = sum(r["size"] for r in out)
    assert sum(r["taken"] for r in out) <= total * 3 // 2 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert {r["source"]: r["target"] <= 2 * r["source_size"] for r in out} == {"a": True, "b": True, "c": True, None: True}
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_numerals_are_no_letters(spark):
    judge = langid.Judge({"en": b"some words of a language"}, 0.01)
    assert [judge(t)[0] for t in ("\u00bd \u00b2", "\u2167 \u2460", "12 3", "_ !", "\u00bd x")] == ["und"] * 4 + ["en"]


def test_sample_of_repeated_and_null_ids(spark):
    """A hot id gives the sample no more rows than it may have, and null ids do not fill it."""
    rows = [(7, f"text number {i} of one id", "en") for i in range(1_000)] + [(None, f"null {i}", "en") for i in range(1_000)] + [(i, f"plain {i} words", "en") for i in range(20, 40)]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    assert found.count(b"text number") + found.count(b"plain") == langid.SAMPLE_DOCS and b"null" not in found


def test_unique_text_under_a_repeated_id_stays(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a, 1, 1), (2, a, 1, 1), (2, "a text that nobody else has at all in here", 1, 1), (2, a, 1, 1), (3, "x y z", 1, 1), (3, "x y z", 1, 2), (3, None, 1, 1)],
                                 "doc_id long, text string, _text int, _id int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(1, "one t"), (2, "a tex"), (3, ""), (3, "x y z")]


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_print", "_id", "_pr", "_copies", "_alike", "_nth"]
    docs = spark.createDataFrame([(i, "some words here " * (i + 1), "ab"[i % 2], *range(10, 16)) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns and out.count() > 8
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(10, 16))}
