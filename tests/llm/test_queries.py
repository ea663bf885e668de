import math

import pytest

from tests.llm.test_bpe import PATTERN, TRUE
from tests.llm.test_operators import groups_of
from tests.oracle import connection, same
from tidemark.llm import language, quality, queries, simhash


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    same(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


def test_every_other_query_is_compared_here():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"op1_quality", "op2_bpe", "op4_simhash", "op5_token_counts", "op6_language"}


def test_quality(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    x = quality.with_statistics(docs, lexicon=model.lexicon).select("doc_id", *quality.NAMES).toPandas()
    want = dict(zip(x["doc_id"], model.predict(x[list(quality.NAMES)].to_numpy(float), list(quality.NAMES))))
    got = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        score = want[i] if t else 0.0
        assert math.isclose(got[i].score, score, abs_tol=1e-9) and got[i].keep == (got[i].score >= quality.THRESHOLD)


def test_ids(spark, sf, texts):
    got = {r.doc_id: list(r.ids) for r in queries.op2_bpe(spark, sf).where("round_trip").collect()}
    assert got == {i: TRUE.encode_ordinary(t) for i, t in texts.items()}


def test_near_copies(spark, sf, texts):
    found = {}
    for r in queries.op4_simhash(spark, sf).collect():
        found.setdefault((r.group_id, r.group_size), []).append((r.doc_id, r.keep))
    assert sorted(sorted(i for i, _ in g) for g in found.values()) == groups_of(list(texts.items()), simhash.DISTANCE)
    assert all(len(g) == n and [i for i, keep in g if keep] == [first] == [min(i for i, _ in g)] for (first, n), g in found.items())


def test_token_counts(spark, sf, texts):
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.op5_token_counts(spark, sf).collect()}
    assert got == {i: (len(PATTERN.findall(t)), len(TRUE.encode_ordinary(t))) for i, t in texts.items()}


def test_language(spark, sf, texts):
    tool = language.Compressors(language.train(spark.read.parquet(f"{sf}/documents.parquet")))
    got = {r.doc_id: r.language for r in queries.op6_language(spark, sf).collect()}
    for i, t in texts.items():
        sizes = sorted(zip(tool.sizes(t.encode()).tolist(), tool.languages))
        gap = sizes[1][0] - sizes[0][0]
        assert got[i] == (sizes[0][1] if gap >= language.MARGIN_BYTES and gap >= language.MARGIN * sizes[1][0] else "und")
