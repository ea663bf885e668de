import pytest
from pyspark.sql import functions as F

from tidemark import Index, excluded, included
from tidemark.errors import DuplicateKey, IndexTypeMismatch, InvalidBulkLoad, KeyExhausted, KeyNotFound, NullKey
from tidemark.functions import keys as codec
from tidemark.operators import index as ix
from tidemark.operators import mutate, reads

K = ("k",)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i * 2, f"n{i % 3}", float(i)) for i in range(10)], "k long, name string, x double").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_point_reads(table):
    assert rows(reads.get(table, K, 4)) == [(4, "n2", 2.0)] and not rows(reads.get(table, K, 5))
    assert reads.contains(table, K, 4) and not reads.contains(table, K, 5)
    with pytest.raises(NullKey):
        reads.get(table, K, None)


def test_many_keys_keep_order_repeats_and_misses(table):
    assert [(r.pos, r.k, r.x) for r in reads.get_many(table, K, [4, 5, 4, 0]).collect()] == [(0, 4, 2.0), (1, 5, None), (2, 4, 2.0), (3, 0, 0.0)]
    assert [(r.pos, r.k) for r in reads.resolve(table, K, [4, 5, 4, 0]).collect()] == [(0, 4), (2, 4), (3, 0)]
    assert rows(reads.resolve(table, K, [])) == []
    assert len(rows(reads.get_many(table, K, list(range(1000))))) == 1000


@pytest.mark.parametrize(
    "low,high,want",
    [(included(4), excluded(8), [4, 6]), (excluded(4), included(8), [6, 8]), (None, excluded(3), [0, 2]), (included(16), None, [16, 18]), (included(8), included(4), []), (excluded(4), excluded(4), [])],
)
def test_ranges(table, low, high, want):
    assert [r.k for r in reads.key_range(table, K, low, high).collect()] == want
    assert [r.k for r in reads.key_range(table, K, low, high, descending=True).collect()] == want[::-1]


def test_compound_keys(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(3)], "a int, b int")
    got = rows(reads.key_range(df, ("a", "b"), excluded(1, 1), included(3, 0)))
    assert got == [x for x in sorted((a, b) for a in range(4) for b in range(3)) if (1, 1) < x <= (3, 0)]
    assert rows(reads.key_range(df, ("a", "b"), excluded(1), None)) == [(a, b) for a in (2, 3) for b in range(3)]
    assert rows(reads.prefix(df, ("a", "b"), 2)) == [(2, 0), (2, 1), (2, 2)]


def test_ends_and_scan(table):
    assert reads.first(table, K).first().k == 0 and reads.last(table, K).first().k == 18
    assert [r.k for r in reads.scan(table, K, 5, 2).collect()] == [6, 8]
    assert reads.length(table).first().n == 10 and not reads.is_empty(table)


def test_a_range_reaches_the_scan(spark, sf):
    plan = reads.scan_range(spark.read.parquet(f"{sf}/orders.parquet"), ("o_orderkey",), included(5), excluded(9))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThan(o_orderkey,9)" in plan


def test_indexes(table):
    name, x = Index("name", ("name",)), Index("x", ("x",), True)
    assert [r.k for r in ix.get_by_index(table, K, name, "n0").collect()] == [0, 6, 12, 18]
    assert ix.get_unique(table, x, 3.0).first().k == 6
    assert [r.k for r in ix.get_by_key(table, K, x, 3.0).collect()] == [6]
    assert [r.k for r in ix.index_range(table, K, name, included("n1"), None).collect()] == [2, 8, 14, 4, 10, 16]
    for f, args in ((ix.get_unique, (table, name, "n0")), (ix.get_by_index, (table, K, x, 1.0)), (ix.get_by_key, (table, K, x, (1, 2)))):
        with pytest.raises(IndexTypeMismatch):
            f(*args)
    with pytest.raises(DuplicateKey):
        ix.check_unique(table, Index("n", ("name",), True))
    assert rows(ix.violations(table, Index("n", ("name",), True)).orderBy("k0")) == [("n0", 4), ("n1", 3), ("n2", 3)]


def test_changes(spark, table):
    new = spark.createDataFrame([(4, "a", 9.0), (5, "b", 9.0)], table.schema)
    assert {r.k: r.name for r in mutate.put(table, K, new).collect()}[4] == "a"
    assert mutate.put(table, K, new).count() == 11
    with pytest.raises(DuplicateKey):
        mutate.insert_with_keys(table, K, new)
    with pytest.raises(KeyNotFound):
        mutate.update_batch(table, K, new)
    twice = spark.createDataFrame([(4, "a", 9.0, 1), (4, "b", 8.0, 2)], "k long, name string, x double, pos int")
    assert rows(mutate.update_batch(table, K, twice, "pos").where("k = 4")) == [(4, "b", 8.0)]
    gone = spark.createDataFrame([(4,), (4,), (6,)], "k long")
    assert mutate.delete_batch(table, K, gone).count() == 8
    with pytest.raises(KeyNotFound):
        mutate.delete_batch(table, K, spark.createDataFrame([(4,), (5,)], "k long"))
    with pytest.raises(NullKey):
        mutate.put(table, K, spark.createDataFrame([(None, "a", 1.0)], table.schema))


def test_numbering_is_contiguous_in_order(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("v"))
    got, after = mutate.numbered(df, "id", 5, [F.col("v").desc()])
    assert after == 1005 and [(r.id, r.v) for r in got.orderBy("id").collect()] == [(5 + i, 999 - i) for i in range(1000)]
    plain, after = mutate.numbered(df, "id", 1)
    assert after == 1001 and sorted(r.id for r in plain.collect()) == list(range(1, 1001))
    assert mutate.numbered(df.limit(0), "id", 3)[1] == 3


def test_sorted_loads(spark):
    good = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("pos"))
    assert mutate.replace_sorted(good, K, "pos").count() == 500
    for bad in (good.withColumn("k", F.when(F.col("k") == 300, 299).otherwise(F.col("k"))), good.withColumn("k", -F.col("k"))):
        with pytest.raises(InvalidBulkLoad):
            mutate.replace_sorted(bad, K, "pos")
    with pytest.raises(InvalidBulkLoad):
        mutate.replace_unsorted(good.unionByName(good), K)
    with pytest.raises(KeyExhausted):
        mutate.next_after(spark.createDataFrame([((1 << 63) - 1,)], "k long"), "k")


def test_delta_errors_come_in_order(spark, table):
    row = lambda *ks: spark.createDataFrame([(k, "z", 0.0) for k in ks], table.schema)
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    assert sorted(r.k for r in mutate.delta(table, K, row(1, 3), row(4), key(6)).collect()) == [0, 1, 2, 3, 4, 8, 10, 12, 14, 16, 18]
    for error, inserts, updates, deletes in (
        (InvalidBulkLoad, row(1, 1), row(5), key(7)),
        (InvalidBulkLoad, row(1), row(1), key(7)),
        (KeyNotFound, row(2), row(5), key(6)),
        (KeyNotFound, row(2), row(4), key(7)),
        (DuplicateKey, row(2), row(4), key(6)),
    ):
        with pytest.raises(error):
            mutate.delta(table, K, inserts, updates, deletes)


def test_key_bytes_sort_as_values(spark):
    values = [-(1 << 63), -5, -1, 0, 1, 77, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.encode_hex([(F.col("v"), "i64")]).alias("h"))
    assert [r.v for r in df.orderBy("h").collect()] == values
    back = df.select("v", codec.decode_hex(F.col("h"), ["i64"])[0].alias("w"))
    assert all(r.v == r.w for r in back.collect())
    texts = ["", "a", "a\x00", "a\x00b", "ab", "b", "é"]
    pairs = [(t, n) for t in texts for n in (-3, 0, 9)]
    df = spark.createDataFrame(pairs, "t string, n int")
    h = codec.encode_hex([(F.col("t"), "string"), (F.col("n"), "i32")])
    t, n = codec.decode_hex(h, ["string", "i32"])
    got = df.select("t", "n", h.alias("h"), t.alias("t2"), n.alias("n2")).orderBy("h").collect()
    assert [(r.t, r.n) for r in got] == pairs and all((r.t, r.n) == (r.t2, r.n2) for r in got)
    assert df.select(codec.encode_hex([(F.lit("a\x00b"), "string"), (F.lit(1), "u8")])).first()[0] == "6100FF62000101"
    assert codec.wide(1) < codec.wide(2) and codec.wide(-1, True) < codec.wide(0, True)
