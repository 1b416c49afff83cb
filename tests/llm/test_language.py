import random
import re
import zlib

import xxhash
import zstandard

from plumbline.llm import language as L

WORDS = {"en": "the and of with that this which ring ening there", "de": "der die und schaft lich keit ung einer nicht", "fr": "le la et une eau eux ment que dans pour"}


def rows(n=120):
    out, rng = [], random.Random(3)
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        words = WORDS[lang].split()
        out.append((i, " ".join(rng.choice(words) for _ in range(60)), lang, "x"))
    return out


def test_learns_only_from_rows_that_are_not_held_out(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score string")
    learn_from = docs.where(~L.held_out())
    assert {r.doc_id for r in learn_from.collect()} == {i for i, *_ in rows() if zlib.crc32(str(i).encode()) % 4 != 2}
    content = L.learn(learn_from, sample_rows=8, dictionary_bytes=2048)
    assert sorted(content) == ["de", "en", "fr"] and all(0 < len(c) <= 2048 for c in content.values())
    got = {r.row_id: r for r in L.identify(docs, content).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang, _ in rows())


def test_odd_rows(spark):
    odd = [(1000, None, None, None), (1001, "", "en", None), (1002, "123 ½ ² .. !", "en", None), (None, "the and of with that this", None, "x"), (1003, "der die und " * 20_000, None, "x"), (1003, "der die und " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, score string")
    content = L.learn(docs)
    got = L.identify(docs, content).where("row_id >= 1000 or row_id is null").collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] * 3 + [("en", False)] + [("de", False)] * 2
    assert all(0 <= r.score <= 1 for r in got)
    assert L.identify(docs.limit(0), content).count() == 0
    kept = L.drop_rejected(docs, content)
    assert kept.schema == docs.schema and kept.count() == 123 and L.drop_rejected(docs.limit(0), content).count() == 0
    assert L.learn(docs.limit(0)) == {} and {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = L.query(spark, at).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    print("held-out accuracy", sum(judged) / len(judged), "rejected", sum(r.rejected for r in got), sorted((round(r.score, 3), truth[r.doc_id], r.lang_pred) for r in got)[:12])
    assert sum(judged) / len(judged) > 0.97
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_whole_texts_teach(spark):
    long = "12 34 " * 2000 + "the ring and there with that other being " * 300
    rows = [(i, long + str(i), "en") for i in range(3)] + [(9, "der die und nicht schaft keit", "de")]
    learnt = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"ring and there" in learnt["en"] and len(learnt["en"]) <= L.DICTIONARY_BYTES
    assert L.filled([b"ab ", b"x" * 50 + b"y" * 50], 43) == b"ab " + b"x" * 20 + b"y" * 20


def brute(rows):
    """(id, text, lang) rows: id, language and score of each by the module's definition, without Spark."""
    plain = lambda text: " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    taught = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and re.search(r"[^\W\d_]", text) and zlib.crc32(str(i).encode()) % 4 != 2:
            at = xxhash.xxh64_intdigest(text.encode(), seed=42)
            taught.setdefault(lang, {})[at - (at >> 63 << 64)] = text
    coders = {}
    for lang, texts in taught.items():
        content = L.filled([plain(texts[h]) + b" " for h in sorted(texts)[: L.SAMPLE_ROWS]], L.DICTIONARY_BYTES)
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=L.LEVEL)
        coders[lang] = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=words, write_content_size=False)
    for i, text, _ in rows:
        kept = plain(text or "")
        if not kept:
            yield i, "und", 0.0
            continue
        sizes = sorted((sum(len(c.compress(kept[a : a + L.CHUNK_BYTES])) for a in range(0, len(kept), L.CHUNK_BYTES)), lang) for lang, c in coders.items())
        yield i, sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.query(spark, at).collect())
    assert got == sorted((i, lang, round(score, 9)) for i, lang, score in brute(rows))
