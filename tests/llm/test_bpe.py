import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import bpe, kernels

PATTERN = regex.compile(P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "  ", "a", " a", "it's  he'll 'tis x'S 've're", "'s't'd''ll a'l", "a  b\n\n c \t\td\n", "l'été—où ½ ²x ٣4 東京都 日本 　x\x1c\x1dy\x85z", "<|endoftext|> \U0001f600\U0001f600 ź", "tab\t x", "\n", "x\n", " \n x", "! 'm", "!'m 's  's"]


def pretokens(texts, limit=1 << 20):
    out = []
    for part in kernels.slices(pa.array(texts, pa.string()), limit):
        start = kernels.pretoken_starts(part).tolist()
        tokens = [part.text[a:b] for a, b in zip(start, start[1:] + [len(part.text)])]
        at = 0
        for i in range(part.rows):
            want = part.bounds[i + 1] - part.bounds[i]
            row = []
            while sum(map(len, row)) < want:
                row.append(tokens[at])
                at += 1
            out.append(row)
    return out


@pytest.mark.parametrize("limit", [1, 20, 1 << 20])
def test_pretokens_of_hard_texts(limit):
    assert pretokens(HARD, limit) == [PATTERN.findall(t) for t in HARD]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst '\n\t é1²!rvelmd'  　東\x1c"), max_size=24), max_size=5))
def test_pretokens_are_those_of_the_pattern(texts):
    assert pretokens(texts) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_are_those_of_ranked_merging(texts):
    ids, n, same = bpe.encode_columns(pa.array(texts, pa.string()), bpe.read_vocabulary())
    assert ids.to_pylist() == [TRUE.encode_ordinary(t) for t in texts]
    assert same.to_pylist() == [True] * len(texts)


def test_every_piece_is_encoded_as_itself():
    c = bpe.codec(bpe.read_vocabulary())
    whole = [p for p in c.pieces if p.decode("utf-8", "ignore").encode() == p]
    assert [np.frombuffer(x, np.int32).tolist() for x in c.encode([p.decode() for p in whole])] == [[c.rank[p]] for p in whole]


def test_encode_and_decode_rows(spark):
    rows = [(1, "The cat's hat."), (1, "The cat's hat."), (2, ""), (3, None), (None, "x y"), (4, "ab " * 40000), (5, "日本 'll")]
    df = docs(spark, rows, ["ids", "N_Tokens", "decoded"])
    got = bpe.decode(bpe.encode(df)).select("doc_id", "text", "ids", "n_tokens", "round_trip", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.n_tokens is None and r.round_trip is None and r.decoded is None
        else:
            assert list(r.ids) == TRUE.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.round_trip and r.decoded == r.text
    assert bpe.encode(df.limit(0)).count() == 0
    assert "lang" in bpe.encode(df).columns


def test_bytes_that_are_not_utf8_are_encoded_as_they_are(spark):
    rows = [(1, b"a\xff b"), (2, b"\xc3("), (3, b"\xed\xa0\x80 the"), (4, "caf\u00e9".encode()[:-1]), (5, None), (6, b"")]
    df = spark.createDataFrame(rows, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("x").alias("a.b"))
    got = bpe.decode(bpe.encode(df)).select("doc_id", F.hex("decoded").alias("h"), "n_tokens", "round_trip", "ids", "`a.b`").collect()
    assert {r.doc_id: r.h and bytes.fromhex(r.h) for r in got} == {i: (b or None) and b for i, b in rows} | {6: ""}
    assert all(r.round_trip for r in got if r.doc_id != 5)
    pieces = bpe.codec(bpe.read_vocabulary()).table
    assert all(b"".join(pieces[i] for i in r.ids) == b for r, (_, b) in zip(sorted(got, key=lambda r: r.doc_id), rows) if b)
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert counts == {r.doc_id: r.n_tokens or 0 for r in got}


def test_ids_outside_the_vocabulary_raise(spark):
    for ids in ("array(-1)", "array(99999999)", "array(1, null)"):
        with pytest.raises(Exception, match="id is"):
            bpe.decode(spark.range(1).selectExpr(f"{ids} AS ids")).collect()
    assert [r.decoded for r in bpe.decode(spark.sql("SELECT * FROM VALUES (array()), (null), (array(64)) AS t(ids)").selectExpr("cast(ids AS array<int>) AS ids")).collect()][:2] == ["", None]


def test_counts_match_the_ids(spark):
    rng = random.Random(3)
    words = ["the", "thereofly", "x", "öäü", "n't", "\n", "zzzzqq", "  ", "1234567"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "none has an id"), (9, None), (10, ""), (-5, "q" * 50000), (1 << 60, "far")]
    df = docs(spark, rows, ["bucket", "chunk", "n_tokens"]).repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_pretokens, r.n_tokens) for r in bpe.token_counts(df).collect()), key=str)
    want = sorted(((i is None, i, len(PATTERN.findall(t or "")), len(TRUE.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert got == want
    assert bpe.token_counts(df.limit(0)).count() == 0
