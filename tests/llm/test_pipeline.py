import random

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import bpe, language, mixing, pii
from tests.llm import test_minhash, test_pii

WORDS = {"en": "the and of with that this which ring ening there being thing other", "de": "der die und schaft lich keit ung einer nicht haben werden", "fr": "le la et une eau eux ment que dans pour avec nous"}


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    rng, rows = random.Random(11), []
    for i in range(160):
        lang = sorted(WORDS)[i % 3]
        words = [rng.choice(WORDS[lang].split()) + rng.choice(["", "er", "x", "o", "i"]) for _ in range(rng.choice([30, 80, 150]))]
        text = " ".join(words)
        if i % 9 == 0:
            text += f" mail me{i}@example.org or +49 30 {1000000 + i} please"
        if i % 10 == 3:
            text = " ".join([*rows[-1][1].split()[:-1], "zz"])
        rows.append((i, text, lang, f"s{min(3, i % 8)}", len(text)))
    rows += [(200, None, "en", "s0", 0), (201, "", "en", None, 0), (202, "12 34", "de", "s1", 5), (203, rows[5][1], "fr", "s1", 1), (204, rows[8][1], None, None, 1)]
    folder = tmp_path_factory.mktemp("tables")
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(folder / "documents.parquet")
    return str(folder), rows


def brute(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judge = language.Classifier(language.learn(docs.where(~language.held_out()))).classify
    rows = [r for r in rows for name, score in [judge(r[1])] if name != language.UNKNOWN and score >= language.MARGIN]
    kept = {i for i, _, _, keep in test_minhash.brute([(r[0], r[1]) for r in rows]) if keep}
    rows = [r for r in rows if r[0] in kept]
    clean = []
    for r, (found, terms) in zip(rows, test_pii.brute([r[1] for r in rows]), strict=True):
        spans = sorted([(a, b, k) for k in pii.KINDS for a, b, _ in found[k]] + [(a, b, "term") for a, b in terms])
        text, done = "", 0
        for a, b, kind in spans:
            if a >= done:
                text += r[1][done:a] + f"[{kind}]"
            done = max(done, b)
        clean.append((r[0], text + r[1][done:], r[3]))
    documents = pd.DataFrame(clean, columns=["doc_id", "text", "source"])
    db = duckdb.connect()
    db.register("documents", documents)
    taken = {i: taken // size for i, size, _, _, taken in db.sql(mixing.ORACLE_SQL).fetchall() if size}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    out = []
    for i, text, _ in clean:
        ids = theirs.encode_ordinary(text)
        out += [(i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), text)] * taken.get(i, 0)
    return sorted(out)


def test_run_matches_brute_force(spark, at):
    folder, rows = at
    got = corpus_pipeline.run(spark, folder)
    want = brute(spark, folder, rows)
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got.collect()) == want
    assert any("[email]" in t for *_, t in want) and len({i for i, *_ in want}) < len(rows)


def test_stages_return_documents(spark, at):
    docs = spark.read.parquet(f"{at[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), at[0]).count() == 0
    assert [r.n_tokens for r in corpus_pipeline.encode(spark, docs.where("doc_id in (200, 201)"), at[0]).collect()] == [0, 0]
