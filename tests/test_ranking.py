import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import Store, TableDef
from tidemark.errors import DimensionMismatch, InvalidParameters, NotFinite
from tidemark.functions.text import query_tokens, tokens
from tidemark.operators import fulltext, vector
from tidemark.streaming import changes


def test_tokens(spark):
    texts = ["it's a test.", "key=value;other", "café—bar", "«Rust»,Go", "a、b。c", "東京都", "", None, "  "]
    want = [["it", "s", "a", "test"], ["key", "value", "other"], ["café", "bar"], ["rust", "go"], ["a", "b", "c"], ["東京都"], [], [], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [list(r[0]) for r in df.orderBy("i").select(tokens(F.col("t"))).collect()] == want
    for t, w in zip(texts[:-2], want):
        assert query_tokens(spark, t) == w
    assert query_tokens(spark, "It's_a x²") == ["it", "s", "a", "x²"] and query_tokens(spark, "हिन्दी") == ["हिन", "दी"]


def bm25(texts, query, k1=1.2, b=0.75):
    docs = {i: (t or "").lower().split() for i, t in texts}
    docs = {i: d for i, d in docs.items() if d}
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    out = {}
    for w in query.lower().split():
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(w):
                idf = max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1))
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_search_matches_the_formula(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices("red green blue rust go and the".split(), k=rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    built = fulltext.TextIndex.build(df, ("id",), F.col("t"), str(tmp_path / "p"))
    for q in ("rust", "rust go", "rust rust go", "absent", "", "absent the"):
        want = bm25(texts, q)
        for found in (fulltext.search(df, ("id",), F.col("t"), q), built.search(q)):
            got = [(r.id, r.score) for r in found.collect()]
            assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert [r.id for r in fulltext.search(df, ("id",), F.col("t"), "rust go", 3).collect()] == [i for i, _ in bm25(texts, "rust go")[:3]]
    assert fulltext.search(df.limit(0), ("id",), F.col("t"), "rust").count() == 0
    changed = {3: "rust rust", 60: "the rust", 70: "go", 5: None}
    gone = {3, 5, 7, 60}
    now = [(i, t) for i, t in texts if i not in gone] + list(changed.items())
    rows, keys = spark.createDataFrame(list(changed.items()), "id int, t string"), spark.createDataFrame([(i,) for i in gone | {7}], "id int")
    later = built.updated(rows, keys)
    for index in (later, later.merged()):
        for q in ("rust", "the go"):
            want = bm25(now, q)
            got = [(r.id, r.score) for r in index.search(q).collect()]
            assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_terms_are_counted_without_python_workers(spark, monkeypatch):
    """The workers' memory grew with the rows of a batch and their texts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("red green blue Rust go and the x1 東京都 é".split(), k=n)) for n in (0, 1, 2, 7, 40, 5000)] + [None, "", " .", "go go go", "Red, red; RED!"]
    rows = [(i, j % 3, t) for i, t in enumerate(texts) for j in range(2)] + [(None, 0, "red")]  # keys may repeat, as rows do
    df = spark.createDataFrame(rows, "a int, b int, t string").repartition(3)
    want = Counter()
    for a, b, t in rows:
        terms = re.findall(r"\w+", (t or "").lower())
        want.update((a, b, len(terms), w, n) for w, n in Counter(terms).items())
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/no/python")
    found = fulltext.term_frequencies(df, ("a", "b"), F.col("t"))
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("a", "int"), ("b", "int"), ("dl", "int"), ("term", "string"), ("tf", "bigint"), ("first", "boolean")]
    got = found.collect()
    assert Counter((r.a, r.b, r.dl, r.term, r.tf) for r in got) == want
    firsts = Counter((r.a, r.b) for r in got if r.first)
    assert firsts == Counter((a, b) for a, b, t in rows if re.search(r"\w", t or ""))
    built = fulltext.TextIndex.build(df, ("a", "b"), F.col("t")).unindex(df.where("a = 10"))
    assert {r.a for r in built.search("red").collect()} == {a for a, _, t in rows if a != 10 and "red" in (t or "").split()}


def test_a_table_has_its_index(spark, tmp_path):
    from tidemark.sources.texts import TableTextIndex

    store = Store(spark, str(tmp_path / "s"))
    t = TableDef("t", "id bigint, t string", ("id",))
    with store.begin_write() as tx:
        tx.open_table(t).put([{"id": i, "t": "red " * i} for i in range(4)])
    index = TableTextIndex(store, "t", F.col("t"), segments=2)
    assert {r.id for r in index.search("RED").collect()} == {1, 2, 3}
    for i in range(3):
        with store.begin_write() as tx:
            tx.open_table(t).delete(i)
            tx.open_table(t).put({"id": 10 + i, "t": "blue red"})
        assert index.refresh() == 2 + i
        assert {r.id for r in index.search("red").collect()} == {j for j in (1, 2, 3) if j > i} | {10 + j for j in range(i + 1)}
    store.bulk_load(t, spark.createDataFrame([(1, "red")], t.schema))
    index.refresh()
    assert [r.id for r in index.search("red").collect()] == [1]


def test_a_table_index_needs_no_python_workers(spark, tmp_path, monkeypatch):
    """Neither its build nor what it takes in later."""
    from tidemark.sources.texts import TableTextIndex

    store = Store(spark, str(tmp_path / "s"))
    t = TableDef("t", "id bigint, t string", ("id",))
    texts = {i: "red " * (i % 4) + "blue" for i in range(12)} | {12: None, 13: ""}
    rows = spark.createDataFrame(list(texts.items()), t.schema)
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/no/python")
    store.bulk_load(t, rows)
    index = TableTextIndex(store, "t", F.col("t"), segments=1)
    index.refresh()
    with store.begin_write() as tx:
        w = tx.open_table(t)
        w.delete_batch(rows.where("id % 4 = 1").select("id"))
        w.update_batch(rows.where("id % 4 = 0").withColumn("t", F.concat(F.lit("red red "), "t")))  # that of 12 stays null
    index.refresh()
    now = [(i, "red red " + x if x and i % 4 == 0 else x) for i, x in texts.items() if i % 4 != 1]
    want = bm25(now, "red blue")
    got = [(r.id, r.score) for r in index.search("red blue").collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


@pytest.mark.parametrize("by", ["cosine", "l2", "dot", "cosine_normalized"])
def test_neighbours_are_exact(spark, by):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = 0
    m[11] = m[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(5)
    q = m[12].astype(float)
    want = vector.brute_force(m.astype(float), np.arange(300), q, 10, by)
    got = [(r.id, r.dist) for r in vector.knn(df, q.tolist(), 10, by).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([d for _, d in got], [d for _, d in want])
    assert vector.knn(df, q.tolist(), 0, by).count() == 0


def test_bad_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(DimensionMismatch):
        vector.check_rows(df, 2)
    with pytest.raises(NotFinite):
        vector.check_rows(spark.createDataFrame([(1, [1.0, float("inf")])], "id long, embedding array<float>"), 2)
    with pytest.raises(InvalidParameters):
        vector.knn(df, [1.0], 1, "none")
    with pytest.raises(InvalidParameters):
        vector.knn(df, [1.0], -1)
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vector.normalize(F.col("v"))).collect()
    assert [list(r[0]) for r in v] == [[0.6, 0.8], [0.0, 0.0]]


def test_streams_in_and_out(spark, tmp_path):
    t = TableDef("last", "u long, e string", ("u",))
    s, out = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "u long, e string, n long").write.parquet(str(tmp_path / "in"))
    rows = lambda: spark.readStream.schema("u long, e string, n long").parquet(str(tmp_path / "in"))
    changes.upsert_stream(rows(), s, t, "n", str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.u, r.e) for r in s.table("last").collect()) == [(1, "b"), (2, "c")]
    version = s.latest_version()
    changes.upsert_stream(rows(), s, t, "n", str(tmp_path / "c2")).awaitTermination()  # the same batch number again
    assert s.latest_version() == version

    def copy(df, _):
        with out.begin_write() as tx:
            tx.open_table(t).put(df.where("not __deleted"))

    changes.follow(s, "last", copy, str(tmp_path / "c3")).awaitTermination()
    assert sorted((r.u, r.e) for r in out.table("last").collect()) == [(1, "b"), (2, "c")]
