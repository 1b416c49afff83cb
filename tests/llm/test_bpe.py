import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe

TEXTS = [None, "", " ", "Hello  world\n\n  x", "éèß 漢字 🙂🙂 'll I'll", "<|endoftext|>", "a" * 3000, "\u0000 ­ \t\r\n", "naïve 12345 ½ x²"]


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_every_merge_is_found(own):
    assert len(own.ranks) == 50_256 and sum(own._halves(t) is not None for t in list(own.ranks)[:2000]) == sum(len(t) > 1 for t in list(own.ranks)[:2000])


@pytest.mark.parametrize("text", TEXTS[1:])
def test_same_ids_and_exact_round_trip(own, theirs, text):
    ids = own.encode(text)
    assert ids == as_bytes(theirs.encode_ordinary(text))
    assert own.decode(ids) == text.encode()
    assert "".join(own.decode_pieces(ids)) == text
    spans = own.offsets(text, ids)
    assert all(a < b for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text)))


def test_forgetting_does_not_change_ids(own, theirs, monkeypatch):
    monkeypatch.setattr(own.chunks, "room", 2)
    monkeypatch.setattr(own.pieces, "room", 2)
    for text in ("one two three", "four one five", "one two three"):
        assert own.encode(text) == as_bytes(theirs.encode_ordinary(text))


def test_any_mix_of_spaces_marks_and_scripts(own, theirs):
    draw, alphabet = random.Random(1), " \n\t  \x1c\x85\u3000abcé漢12.,'s!🙂  ʰǅªº½²"
    for _ in range(5000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14)))
        ids = own.encode(text)
        assert ids == as_bytes(theirs.encode_ordinary(text)) and own.decode(ids) == text.encode(), repr(text)


def test_a_text_of_two_million_characters(own, theirs):
    text = "".join(random.Random(2).choices([" die", " straße", "\n", "  ", ", 12"], k=500_000))
    assert own.encode(text) == as_bytes(theirs.encode_ordinary(text)) and own.decode(own.encode(text)) == text.encode()


def test_operator_on_odd_rows(spark, theirs):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_decode(docs).collect()
    assert len(got) == len(rows)
    for (i, text, _), row in zip(rows, got, strict=True):
        assert (row.row_id, bytes(row.ids), bytes(row.decoded)) == (i, as_bytes(theirs.encode_ordinary(text or "")), (text or "").encode())
    assert bpe.encode_decode(docs.limit(0)).count() == 0
    spans = {r.row_id: r for r in bpe.token_offsets(docs).collect()}
    assert spans[0].ids == [] and spans[4].ends[-1] == len(TEXTS[4])


def test_query_matches_tiktoken(spark, sf_dir, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
