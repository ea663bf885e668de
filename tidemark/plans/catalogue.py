"""One query for each operator over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import DuplicateKey, IndexDdlConflict, InvalidCommitVersion, InvalidParameters, TableNotFound, WriteConflict
from tidemark.functions import keys as codec
from tidemark.functions.text import tokens
from tidemark.operators import fulltext, mutate, reads, vector
from tidemark.operators import index as ix
from tidemark.operators.index import CustomIndex, Index
from tidemark.operators.reads import Bound, excluded, included
from tidemark.plans.lineage import shared_folder
from tidemark.sources import transfer
from tidemark.sources.manifest import TableDef
from tidemark.sources.store import Config, Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDERS, CUSTOMER, SUPPLIER, TURNS = ("o_orderkey",), ("c_custkey",), ("s_suppkey",), ("conv_id", "turn")
CUSTOMERS = TableDef("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", CUSTOMER)
SUPPLIERS = TableDef("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", SUPPLIER)
BY_NAME = Index("by_name", ("c_name",), True)
BY_SEGMENT = Index("by_segment", ("c_mktsegment",))
BY_PRICE = Index("by_price", ("o_totalprice",))
BY_STATE = Index("by_state", ("o_orderstatus", "o_orderpriority"))
LISTED = [5, 99999999, 5, 17]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_store(spark: SparkSession, config: Config = Config(auto_gc=False)) -> Store:
    """A store in the folder that the session shares."""
    return Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}", config)


# --- keyed reads ----------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey = 4242")
def pk_get(spark, d):
    return reads.get(table(spark, d, "orders"), ORDERS, 4242)


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey = 17) > 0 AS present, (SELECT count(*) FROM orders WHERE o_orderkey = 99999999) > 0 AS absent")
def pk_contains(spark, d):
    o = table(spark, d, "orders")
    return spark.createDataFrame([(reads.contains(o, ORDERS, 17), reads.contains(o, ORDERS, 99999999))], "present boolean, absent boolean")


_LISTED = "(VALUES (0, 5), (1, 99999999), (2, 5), (3, 17)) AS k(pos, o_orderkey)"


@query(f"SELECT k.pos::BIGINT AS pos, k.o_orderkey::BIGINT AS o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority FROM {_LISTED} LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey")
def pk_get_many(spark, d):
    return reads.get_many(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), ORDERS, LISTED)


@query(f"SELECT k.pos::BIGINT AS pos, o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority FROM {_LISTED} JOIN orders o ON o.o_orderkey = k.o_orderkey")
def pk_resolve(spark, d):
    return reads.resolve(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), ORDERS, LISTED)


@query("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def pk_range_half_open(spark, d):
    return reads.key_range(table(spark, d, "orders"), ORDERS, included(100), excluded(200))


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def pk_range_closed(spark, d):
    return reads.key_range(table(spark, d, "orders"), ORDERS, included(100), included(200))


@query("SELECT * FROM orders WHERE o_orderkey > 1400")
def pk_range_open_above(spark, d):
    return reads.key_range(table(spark, d, "orders"), ORDERS, excluded(1400), None, descending=True)


@query("SELECT * FROM orders WHERE o_orderkey >= 5 AND o_orderkey < 2")
def pk_range_inverted(spark, d):
    return reads.key_range(table(spark, d, "orders"), ORDERS, included(5), excluded(2))


@query("SELECT * FROM conversations WHERE (conv_id > 7 OR conv_id = 7 AND turn > 1) AND (conv_id < 20 OR conv_id = 20 AND turn <= 0)")
def pk_range_compound(spark, d):
    return reads.key_range(table(spark, d, "conversations"), TURNS, excluded(7, 1), included(20, 0))


@query("SELECT * FROM conversations WHERE conv_id = 7")
def pk_prefix(spark, d):
    return reads.prefix(table(spark, d, "conversations"), TURNS, 7)


@query("SELECT * FROM nation")
def pk_iter(spark, d):
    return reads.ordered(table(spark, d, "nation"), ("n_nationkey",))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")
def pk_first(spark, d):
    return reads.first(table(spark, d, "orders"), ORDERS)


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def pk_last(spark, d):
    return reads.last(table(spark, d, "orders"), ORDERS)


@query("SELECT count(*)::BIGINT AS n FROM orders")
def table_len(spark, d):
    return reads.length(table(spark, d, "orders"))


@query("SELECT (SELECT count(*) FROM orders) = 0 AS orders_empty, (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0 AS below_zero_empty")
def table_is_empty(spark, d):
    o = table(spark, d, "orders")
    return spark.createDataFrame([(reads.is_empty(o), reads.is_empty(reads.scan_range(o, ORDERS, None, excluded(0))))], "orders_empty boolean, below_zero_empty boolean")


@query("SELECT * FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 100")
def scan_limit(spark, d):
    return reads.scan(table(spark, d, "orders"), ORDERS, 1000, 100)


@query("SELECT max(o_orderkey) + 1 AS loaded, max(o_orderkey) + 3 AS after_two, 1000000000000::BIGINT AS forced, 1000000000001::BIGINT AS at_last FROM orders")
def next_id(spark, d):
    """The counter of a numbered table after a load, two inserts, a jump and one more insert."""
    s = new_store(spark)
    t = TableDef("numbered", "id bigint, o_custkey bigint", ("id",), True)
    s.bulk_load(t, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"))
    found = [s.begin_read().open_table(t).next_id()]
    with s.begin_write() as tx:
        tx.open_table(t).insert_batch([{"o_custkey": 1}, {"o_custkey": 2}])
        found.append(tx.open_table(t).next_id())
    with s.begin_write() as tx:
        w = tx.open_table(t)
        w.set_next_id(10**12)
        found.append(w.next_id())
        w.insert({"o_custkey": 3})
    found.append(s.begin_read().open_table(t).next_id())
    return spark.createDataFrame([tuple(found)], "loaded long, after_two long, forced long, at_last long")


# --- indexes --------------------------------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def idx_unique_get(spark, d):
    c = table(spark, d, "customer")
    ix.check_unique(c, BY_NAME)
    return ix.get_unique(c, BY_NAME, c.agg(F.max("c_name")).first()[0])


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def idx_nonunique_get(spark, d):
    return ix.get_by_index(table(spark, d, "customer"), CUSTOMER, BY_SEGMENT, "BUILDING")


@query("SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY'")
def idx_by_key(spark, d):
    return ix.get_by_key(table(spark, d, "customer"), CUSTOMER, BY_SEGMENT, "MACHINERY")


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def idx_range(spark, d):
    return ix.index_range(table(spark, d, "orders"), ORDERS, BY_PRICE, included(100000.0), included(110000.0))


@query("SELECT * FROM orders WHERE o_totalprice > 200000 AND o_totalprice < 210000")
def idx_range_excl(spark, d):
    return ix.index_range(table(spark, d, "orders"), ORDERS, BY_PRICE, excluded(200000.0), excluded(210000.0))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def idx_compound(spark, d):
    return ix.get_by_index(table(spark, d, "orders"), ORDERS, BY_STATE, ("F", "1-URGENT"))


@query("SELECT * FROM orders WHERE (o_orderstatus > 'F' OR o_orderstatus = 'F' AND o_orderpriority >= '3-MEDIUM') AND (o_orderstatus < 'O' OR o_orderstatus = 'O' AND o_orderpriority < '2-HIGH')")
def idx_compound_range(spark, d):
    return ix.index_range(table(spark, d, "orders"), ORDERS, BY_STATE, included("F", "3-MEDIUM"), excluded("O", "2-HIGH"))


@query("SELECT p_name AS k0, count(*)::BIGINT AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def idx_define_unique_violation(spark, d):
    return ix.violations(table(spark, d, "part"), Index("by_name", ("p_name",), True))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def idx_custom(spark, d):
    """A user's index over a table of a store, after some of the rows have changed; its check refuses one change."""
    s = new_store(spark)
    c = table(spark, d, "customer")
    s.bulk_load(CUSTOMERS, c)

    def no_nameless(image: DataFrame) -> None:
        if not image.where("c_name = ''").isEmpty():
            raise InvalidParameters("a customer has no name")

    s.define_custom_index("customer", CustomIndex("overdrawn", lambda df: df.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), no_nameless))
    with s.begin_write() as tx:
        w = tx.open_table("customer")
        buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
        w.update_batch(c.where("c_acctbal < 0").join(buyers, "c_custkey", "left_semi").withColumn("c_acctbal", F.lit(0.0)))
        try:
            w.update({**c.where("c_acctbal < 0").first().asDict(), "c_name": ""})
        except InvalidParameters:
            pass
    return s.begin_read().open_table("customer").custom_index("overdrawn")


# --- changes --------------------------------------------------------------------------------------

_SPENT = "(SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey)"


def _spent(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query(
    f"""SELECT c_custkey, c_name, c_nationkey, CASE WHEN s.spent IS NOT NULL THEN s.spent ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer LEFT JOIN {_SPENT} s ON o_custkey = c_custkey
UNION ALL SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier"""
)
def put_upsert(spark, d):
    """Customers that ordered get what they spent; suppliers come in as new ones."""
    c = table(spark, d, "customer")
    changed = c.join(_spent(spark, d), F.col("o_custkey") == F.col("c_custkey")).withColumn("c_acctbal", F.col("spent")).select(*c.columns)
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return mutate.put(c, CUSTOMER, changed.unionByName(new))


@query(
    """WITH l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p, arg_max(o_orderpriority, o_orderkey) AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1)
SELECT c_custkey, c_name, c_nationkey, CASE WHEN l.o_custkey IS NULL THEN c_acctbal ELSE l.p END AS c_acctbal, CASE WHEN l.o_custkey IS NULL THEN c_mktsegment ELSE l.s END AS c_mktsegment
FROM customer LEFT JOIN l ON l.o_custkey = c_custkey"""
)
def update_batch_last_wins(spark, d):
    """Each order sets its customer's balance and segment; the last order counts."""
    c = table(spark, d, "customer")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("c_custkey", "c_name", "c_nationkey", F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"), F.col("o_orderkey").alias("pos"))
    return mutate.update_batch(c, CUSTOMER, rows, "pos")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def delete_batch(spark, d):
    c = table(spark, d, "customer")
    gone = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey"), "c_custkey", "left_semi")
    return mutate.delete_batch(c, CUSTOMER, gone)


@query(
    """SELECT * FROM nation UNION ALL
SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey))::INTEGER, s_name, s_nationkey FROM supplier"""
)
def insert_batch_auto_id(spark, d):
    n = table(spark, d, "nation")
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("n_name"), F.col("s_nationkey").alias("n_regionkey"))
    start = mutate.next_after(n, "n_nationkey")
    new, _ = mutate.numbered(rows, "n_nationkey", start, [F.col("s_suppkey")])
    return n.unionByName(new.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "n_regionkey"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def bulk_replace_unsorted(spark, d):
    s = new_store(spark)
    s.bulk_load(SUPPLIERS, table(spark, d, "supplier").orderBy(F.col("s_acctbal")))
    return s.table("supplier")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def bulk_replace_sorted(spark, d):
    s = new_store(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderkey").alias("pos"))
    s.bulk_load(TableDef("orders", "o_orderkey bigint, o_custkey bigint, o_totalprice double", ORDERS), rows, "pos", assume_sorted=True)
    return s.table("orders")


@query("SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::BIGINT AS id, s_name, s_acctbal FROM supplier")
def bulk_auto_id(spark, d):
    s = new_store(spark)
    rows = table(spark, d, "supplier").select("s_name", "s_acctbal", "s_suppkey")
    s.load_batch().replace_numbered(TableDef("ranked", "id bigint, s_name string, s_acctbal double", ("id",), True), rows, [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()]).commit()
    return s.table("ranked")


def _delta(spark, d):
    s = table(spark, d, "supplier")
    inserts = table(spark, d, "customer").select((F.col("c_custkey") + 1000000000).alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    return s, inserts, s.where("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)), s.where("s_acctbal > 5000").select("s_suppkey")


@query(
    """SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0e0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_acctbal <= 5000
UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal FROM customer"""
)
def bulk_delta(spark, d):
    rows, inserts, updates, deletes = _delta(spark, d)
    s = new_store(spark)
    s.bulk_load(SUPPLIERS, rows)
    s.load_batch().delta(SUPPLIERS, inserts, updates, deletes).commit()
    return s.table("supplier")


@query(
    """WITH b AS (SELECT 'insert' AS bucket, c_custkey AS s_suppkey FROM customer UNION ALL SELECT 'update', o_custkey FROM orders UNION ALL SELECT 'delete', s_suppkey FROM supplier WHERE s_acctbal < 0),
c AS (SELECT bucket, s_suppkey, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS others, s_suppkey IN (SELECT s_suppkey FROM supplier) AS known FROM c)
SELECT bucket, s_suppkey, 'duplicate' AS kind FROM e WHERE n > 1 UNION ALL SELECT bucket, s_suppkey, 'overlap' FROM e WHERE others > 1
UNION ALL SELECT bucket, s_suppkey, 'missing' FROM e WHERE bucket <> 'insert' AND NOT known UNION ALL SELECT bucket, s_suppkey, 'exists' FROM e WHERE bucket = 'insert' AND known"""
)
def bulk_delta_conflicts(spark, d):
    s = table(spark, d, "supplier")
    inserts = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"))
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("s_suppkey"))
    return mutate.delta_conflicts(s, SUPPLIER, inserts, updates, s.where("s_acctbal < 0"))


# --- versions and transactions --------------------------------------------------------------------


def _two_versions(spark, d) -> Store:
    rows, inserts, updates, deletes = _delta(spark, d)
    s = new_store(spark)
    s.bulk_load(SUPPLIERS, rows)
    with s.begin_write() as tx:
        tx.open_table(SUPPLIERS).apply_delta(inserts, updates, deletes)
    return s


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def time_travel(spark, d):
    return _two_versions(spark, d).begin_read(1).open_table("supplier").iter()


@query(SQL["bulk_delta"])
def tx_delta(spark, d):
    return _two_versions(spark, d).begin_read().open_table("supplier").iter()


@query(
    """SELECT c_custkey + 1000000000 AS s_suppkey, 'added' AS change FROM customer
UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'changed' ELSE 'removed' END FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 5000"""
)
def snapshot_diff(spark, d):
    s = _two_versions(spark, d)
    a, b = s.table("supplier", 1), s.table("supplier", 2)
    pair = a.select("s_suppkey", F.struct("s_name", "s_nationkey", "s_acctbal").alias("a")).join(b.select("s_suppkey", F.struct("s_name", "s_nationkey", "s_acctbal").alias("b")), "s_suppkey", "full")
    change = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).when(~F.col("a").eqNullSafe(F.col("b")), F.lit("changed"))
    return pair.select("s_suppkey", change.alias("change")).where("change is not null")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0e0 WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def mw_merge_disjoint(spark, d):
    """Two writers over one base change different customers; both commit."""
    s = new_store(spark, Config(multi_writer=True, auto_gc=False))
    c = table(spark, d, "customer")
    s.bulk_load(CUSTOMERS, c)
    one, two = s.begin_write(), s.begin_write()
    one.open_table("customer").update_batch(c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)))
    two.open_table("customer").update_batch(c.where("c_acctbal >= 0 and c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100))
    one.commit()
    two.commit()
    return s.table("customer")


@query("SELECT 'customer' AS table_name, 2::BIGINT AS by_version, count(*)::BIGINT AS zeros FROM customer WHERE c_acctbal <= 0")
def mw_conflict_keys(spark, d):
    """Of two writers over one base that have a key in common the later one fails, and nothing of it is seen."""
    s = new_store(spark, Config(multi_writer=True, auto_gc=False))
    c = table(spark, d, "customer")
    s.bulk_load(CUSTOMERS, c)
    one, two = s.begin_write(), s.begin_write()
    one.open_table("customer").update_batch(c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)))
    two.open_table("customer").update_batch(c.where("c_acctbal < 100").withColumn("c_acctbal", F.lit(-1.0)))
    one.commit()
    try:
        two.commit()
        failed = (None, None)
    except WriteConflict as e:
        failed = (e.table, e.version)
    zeros = s.table("customer").where("c_acctbal <= 0").agg(F.count("*").alias("zeros"))
    return zeros.select(F.lit(failed[0]).alias("table_name"), F.lit(failed[1]).cast("long").alias("by_version"), "zeros")


@query("SELECT 'supplier' AS failed, 2::BIGINT AS latest, count(*)::BIGINT AS zeros FROM supplier WHERE s_acctbal < 0 OR s_acctbal = 0")
def ssi_read_conflicts(spark, d):
    """A serializable writer that read what another then wrote fails."""
    from tidemark.errors import SerializationFailure

    s = new_store(spark, Config(multi_writer=True, serializable=True, auto_gc=False))
    rows = table(spark, d, "supplier")
    s.bulk_load(SUPPLIERS, rows)
    one, two = s.begin_write(), s.begin_write()
    total = two.open_table("supplier").len()
    two.open_table(TableDef("totals", "id bigint, n bigint", ("id",))).put({"id": 1, "n": total})
    one.open_table("supplier").update_batch(rows.where("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)))
    one.commit()
    try:
        two.commit()
        failed = None
    except SerializationFailure as e:
        failed = e.table
    zeros = s.table("supplier").where("s_acctbal = 0").agg(F.count("*").alias("zeros"))
    return zeros.select(F.lit(failed).alias("failed"), F.lit(s.latest_version()).cast("long").alias("latest"), "zeros")


@query("SELECT unnest(['customer', 'supplier']) AS name")
def table_names(spark, d):
    s = new_store(spark)
    s.load_batch().replace(SUPPLIERS, table(spark, d, "supplier")).replace(CUSTOMERS, table(spark, d, "customer")).commit()
    return spark.createDataFrame([(n,) for n in s.begin_read().table_names()], "name string")


@query("SELECT unnest([2, 4, 5])::BIGINT AS version")
def gc_retained(spark, d):
    """Of versions 0 to 5 the newest two stay, and one that is pinned."""
    s = new_store(spark, Config(retained=2, auto_gc=False))
    pin = None
    for v in range(1, 6):
        s.bulk_load(SUPPLIERS, table(spark, d, "supplier"))
        if v == 2:
            pin = s.pin_version(2)
    s.gc()
    found = s.versions()
    pin.release()
    return spark.createDataFrame([(v,) for v in found], "version long")


@query("SELECT * FROM (VALUES ('store', 'bulk_loads', 1::BIGINT), ('store', 'commits', 1), ('store', 'rollbacks', 1), ('supplier', 'updates', 1)) AS t(scope, name, value)")
def store_metrics(spark, d):
    s = new_store(spark)
    rows = table(spark, d, "supplier")
    s.bulk_load(SUPPLIERS, rows)
    with s.begin_write() as tx:
        tx.open_table("supplier").put(rows)
    s.begin_write().rollback()
    return s.metrics().where("name in ('bulk_loads', 'commits', 'rollbacks', 'updates')")


@query("SELECT 'put' AS op, count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'delete', count(*)::BIGINT FROM supplier WHERE s_acctbal > 5000")
def change_log(spark, d):
    return _two_versions(spark, d).changes(2, "supplier").groupBy("op").agg(F.count("*").alias("n"))


@query(SQL["bulk_delta"])
def snapshot_roundtrip(spark, d):
    s = _two_versions(spark, d)
    to = f"{s.folder.root}-out"
    transfer.export(s, to)
    other = new_store(spark)
    transfer.install(other, to)
    return other.table("supplier")


@query(SQL["bulk_delta"])
def checkpoint_recover(spark, d):
    s = _two_versions(spark, d)
    transfer.checkpoint(s)
    for v in s.versions():
        s.folder.delete(s._name(v))
    again = Store(spark, s.folder.root)
    transfer.recover(again)
    return again.table("supplier")


@query(SQL["bulk_delta"])
def compaction(spark, d):
    s = _two_versions(spark, d)
    s.compact()
    return s.table("supplier")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey IN (SELECT (p * 7919) % 1500 FROM (SELECT unnest(range(0, 100)) AS p))")
def ycsb_read_mix(spark, d):
    """A transaction updates every twentieth order, another reads a hundred at spread keys."""
    s = new_store(spark)
    t = TableDef("orders", "o_orderkey bigint, o_totalprice double", ORDERS)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s.bulk_load(t, o)
    with s.begin_write() as tx:
        tx.open_table(t).update_batch(o.where("o_orderkey % 20 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return s.begin_read().open_table(t).resolve([(p * 7919) % 1500 for p in range(100)]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, round(c_acctbal + coalesce(s.spent, 0), 2) AS balance FROM customer LEFT JOIN " + _SPENT + " s ON o_custkey = c_custkey")
def smallbank_deposits(spark, d):
    """Each order is a deposit; deposits commute, so a transaction adds their sums to the balances."""
    s = new_store(spark)
    t = TableDef("accounts", "c_custkey bigint, balance double", CUSTOMER)
    s.bulk_load(t, table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance")))
    with s.begin_write() as tx:
        w = tx.open_table(t)
        changed = w.df.join(_spent(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        w.update_batch(changed.select("c_custkey", F.round(F.col("balance") + F.col("spent"), 2).alias("balance")))
    return s.table("accounts")


@query("SELECT table_name, n FROM (SELECT 'nation' AS table_name, count(*)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'events', count(*)::BIGINT FROM events)")
def sql_views(spark, d):
    """Tables of a store as views for SQL."""
    s = new_store(spark)
    b = s.load_batch()
    b.replace(TableDef("nation", "n_nationkey int, n_name string, n_regionkey int", ("n_nationkey",)), table(spark, d, "nation"))
    b.replace(TableDef("region", "r_regionkey int, r_name string", ("r_regionkey",)), table(spark, d, "region"))
    b.replace(TableDef("events", "event_id bigint, user_id bigint, event_type string", ("event_id",)), table(spark, d, "events").select("event_id", "user_id", "event_type"))
    b.commit()
    s.create_views("tm_")
    return spark.sql("SELECT 'nation' AS table_name, count(*) AS n FROM tm_nation JOIN tm_region ON n_regionkey = r_regionkey UNION ALL SELECT 'events', count(*) FROM tm_events")


# --- handles of a store ---------------------------------------------------------------------------


def _shop(spark, d, config: Config = Config(auto_gc=False)) -> Store:
    """Customers with a unique and two other indexes, and suppliers."""
    s = new_store(spark, config)
    s.load_batch().replace(CUSTOMERS, table(spark, d, "customer")).replace(SUPPLIERS, table(spark, d, "supplier")).commit()
    with s.begin_write() as tx:
        w = tx.open_table(CUSTOMERS)
        w.define_index("by_name", "c_name", unique=True)
        w.define_index("by_segment", "c_mktsegment")
        w.define_index("by_nation", ("c_nationkey", "c_mktsegment"))
    return s


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(f"{_CUSTOMER} WHERE c_custkey IN (3, 50) UNION ALL {_CUSTOMER} WHERE c_custkey > 100 AND c_custkey <= 120 UNION ALL (SELECT * FROM ({_CUSTOMER}) ORDER BY c_custkey LIMIT 1) UNION ALL (SELECT * FROM ({_CUSTOMER}) ORDER BY c_custkey DESC LIMIT 1)")
def store_reads(spark, d):
    """get, get_many, range, first and last of a reader."""
    r = _shop(spark, d).begin_read().open_table("customer")
    cols = CUSTOMERS.struct.names
    parts = [r.get(3), r.get_many([50, 10**9]).where("c_name is not null").select(*cols), r.range(excluded(100), included(120)), r.first(), r.last()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


@query(f"""SELECT 'unique' AS kind, * FROM ({_CUSTOMER}) WHERE c_name >= (SELECT max(c_name) FROM customer) UNION ALL SELECT 'segment', * FROM ({_CUSTOMER}) WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'compound', * FROM ({_CUSTOMER}) WHERE c_nationkey = 3 AND c_mktsegment >= 'FURNITURE' OR c_nationkey = 4 AND c_mktsegment < 'HOUSEHOLD'""")
def store_index_reads(spark, d):
    """Reads by the indexes of a table of a store, ranges of a unique and of a compound one among them."""
    r = _shop(spark, d).begin_read().open_table("customer")
    top = r.df.agg(F.max("c_name")).first()[0]
    found = {"unique": r.index_range("by_name", included(top)), "segment": r.get_by_index("by_segment", "BUILDING"), "compound": r.index_range("by_nation", included(3, "FURNITURE"), excluded(4, "HOUSEHOLD"))}
    parts = [df.select(F.lit(k).alias("kind"), *CUSTOMERS.struct.names) for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""SELECT 'customer' AS t, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'supplier', (count(*) - count_if(s_acctbal < 0))::BIGINT FROM supplier
UNION ALL SELECT 'moved', count_if(s_acctbal < 0)::BIGINT FROM supplier""")
def open_three_tables(spark, d):
    """One transaction moves rows between three tables."""
    s = _shop(spark, d)
    moved = TableDef("moved", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", SUPPLIER)
    with s.begin_write() as tx:
        c, p, m = tx.open_tables(CUSTOMERS, SUPPLIERS, moved)
        bad = table(spark, d, "supplier").where("s_acctbal < 0")
        m.put(bad)
        p.delete_batch(bad.select("s_suppkey"))
        names = tx.table_names()
    r = s.begin_read()
    return spark.createDataFrame([(n, r.open_table(n).df.count()) for n in names], "t string, n long")


@query("SELECT unnest(['supplier']) AS name, true AS known, false AS again, true AS before")
def delete_table(spark, d):
    s = _shop(spark, d)
    with s.begin_write() as tx:
        known, again = tx.delete_table("customer"), tx.delete_table("nothing")
    before = "customer" in s.begin_read(2).table_names()
    return spark.createDataFrame([(n, known, again, before) for n in s.begin_read().table_names()], "name string, known boolean, again boolean, before boolean")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier) UNION ALL SELECT -5, 'new', 1, 2.5")
def insert_and_delete(spark, d):
    """insert_with_id of a row (a second time it is refused) and delete of another, in one transaction."""
    s = _shop(spark, d)
    row = {"s_suppkey": -5, "s_name": "new", "s_nationkey": 1, "s_acctbal": 2.5}
    with s.begin_write() as tx:
        w = tx.open_table("supplier")
        first = w.first().first().s_suppkey
        w.insert_with_id(row)
        try:
            w.insert_with_id(row)
        except DuplicateKey:
            w.delete(first)
    return s.table("supplier")


@query("SELECT 2 AS refused, 1 AS swapped, c_name FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def unique_swap(spark, d):
    """Two rows can't swap the values of a unique index row by row; with strict_unique off a batch can."""
    s = _shop(spark, d)
    rows = [r.asDict() for r in s.table("customer").orderBy("c_custkey").limit(1).collect() + s.table("customer").orderBy(F.desc("c_custkey")).limit(1).collect()]
    swap = [{**rows[0], "c_name": rows[1]["c_name"]}, {**rows[1], "c_name": rows[0]["c_name"]}]
    refused = 0
    for change in ([swap[0]], swap):
        tx = s.begin_write()
        try:
            tx.open_table("customer").update_batch(change)
        except DuplicateKey:
            refused += 1
        tx.rollback()
    other = s.with_config(strict_unique=False)
    with other.begin_write() as tx:
        tx.open_table("customer").update_batch(swap)
    now = other.begin_read().open_table("customer").get(rows[0]["c_custkey"])
    return now.select(F.lit(refused).alias("refused"), F.lit(1).alias("swapped"), "c_name")


@query("SELECT true AS conflict, 0::BIGINT AS indexes, count(*)::BIGINT AS n FROM supplier WHERE s_acctbal >= 0")
def index_ddl_conflict(spark, d):
    """An index can't be defined on a table that another commit changed meanwhile."""
    s = new_store(spark, Config(multi_writer=True, auto_gc=False))
    rows = table(spark, d, "supplier")
    s.bulk_load(SUPPLIERS, rows)
    one, two = s.begin_write(), s.begin_write()
    two.open_table("supplier").define_index("by_nation", "s_nationkey")
    one.open_table("supplier").delete_batch(rows.where("s_acctbal < 0").select("s_suppkey"))
    one.commit()
    try:
        two.commit()
        conflict = False
    except IndexDdlConflict:
        conflict = True
    indexes = len(s.manifest().tables["supplier"].indexes)
    return s.table("supplier").agg(F.count("*").alias("n")).select(F.lit(conflict).alias("conflict"), F.lit(indexes).cast("long").alias("indexes"), "n")


@query("SELECT 2::BIGINT AS live, true AS refused, false AS soon, true AS later, 0::BIGINT AS after, -9::DOUBLE AS s_acctbal")
def write_intents(spark, d):
    """A live writer's keys refuse another at once, who may wait for it with or without a limit of time."""
    s = new_store(spark, Config(multi_writer=True, auto_gc=False))
    rows = table(spark, d, "supplier")
    s.bulk_load(SUPPLIERS, rows)
    some = [r.asDict() for r in rows.orderBy("s_suppkey").limit(2).collect()]
    one, two = s.begin_write(), s.begin_write()
    one.open_table("supplier").put([{**r, "s_acctbal": -9.0} for r in some])
    live, holder = s.live_writes(), None
    try:
        two.open_table("supplier").put({**some[0], "s_acctbal": 1.0})
    except WriteConflict as e:
        holder = e.holder
    soon = holder.wait(0.01)
    one.commit()
    later = holder.wait()
    two.rollback()
    now = s.begin_read().open_table("supplier").get(some[0]["s_suppkey"]).select("s_acctbal")
    named = {"live": F.lit(live).cast("long"), "refused": F.lit(holder is not None), "soon": F.lit(soon), "later": F.lit(later), "after": F.lit(s.live_writes()).cast("long")}
    return now.select(*[c.alias(n) for n, c in named.items()], "s_acctbal")


@query("SELECT 10::BIGINT AS latest, 3::BIGINT AS refused, s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 1")
def explicit_versions(spark, d):
    """Versions of chosen numbers follow one another; one below the latest is refused, also when it was chosen before that."""
    s = new_store(spark, Config(multi_writer=True, auto_gc=False))
    t = TableDef("marks", "s_suppkey bigint, n int", SUPPLIER)
    one = s.begin_write(5)
    two = s.begin_write(10)
    key = table(spark, d, "supplier").where("s_acctbal > 0").orderBy("s_suppkey").first().s_suppkey
    one.open_table(TableDef("others", "s_suppkey bigint, n int", SUPPLIER)).put({"s_suppkey": 1, "n": 1})
    two.open_table(t).put({"s_suppkey": key, "n": 2})
    two.commit()
    refused = 0
    for act in (one.commit, lambda: s.begin_write(10), lambda: s.begin_write(7)):
        try:
            act()
        except InvalidCommitVersion:
            refused += 1
    return s.table("marks").select(F.lit(s.latest_version()).cast("long").alias("latest"), F.lit(refused).cast("long").alias("refused"), "s_suppkey")


@query("SELECT 4::BIGINT AS hooked, 4::BIGINT AS durable, 0::BIGINT AS pending, 4::BIGINT AS waited, 1::BIGINT AS logged, true AS unknown")
def durability(spark, d):
    """Hooks, the durable version, waiting for it and the log beyond a version; a load of an unknown table without `create` is refused."""
    s = _shop(spark, d)
    seen: list[int] = []
    s.on_durable(seen.append)
    for _ in range(2):
        with s.begin_write() as tx:
            tx.open_table("supplier").put({"s_suppkey": -1, "s_name": "x", "s_nationkey": 0, "s_acctbal": 0.0})
    try:
        s.load_batch().replace(TableDef("nothing", "id bigint", ("id",)), spark.range(1).select("id"), create=False)
        unknown = False
    except TableNotFound:
        unknown = True
    row = (seen[-1], s.durable_version(), s.pending_writes(), s.wait_durable(4), s.read_log(3).count(), unknown)
    return spark.createDataFrame([row], "hooked long, durable long, pending long, waited long, logged long, unknown boolean")


@query("SELECT 'registered' AS name, true AS unknown, 1::BIGINT AS n")
def register_tables(spark, d):
    s = new_store(spark)
    tx = s.begin_write()
    try:
        tx.open_table("registered")
        unknown = False
    except TableNotFound:
        unknown = True
    tx.rollback()
    s.register_table(TableDef("registered", "id bigint, v string", ("id",), True))
    with s.begin_write() as tx:
        tx.open_table("registered").insert({"v": "a"})
    return spark.createDataFrame([(n, unknown, s.begin_read().open_table(n).len()) for n in s.begin_read().table_names()], "name string, unknown boolean, n long")


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def tx_replace(spark, d):
    """All rows of a table are replaced within a transaction."""
    s = _shop(spark, d)
    with s.begin_write() as tx:
        tx.open_table("supplier").replace(table(spark, d, "supplier").where("s_acctbal > 0").withColumn("s_acctbal", F.round(F.col("s_acctbal") * 2, 2)))
    return s.table("supplier")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 42::BIGINT AS version FROM supplier")
def install_at_version(spark, d):
    """A snapshot of some tables becomes a version of a chosen number; from a checkpoint, with what it is read by."""
    s = _shop(spark, d)
    transfer.checkpoint(s)
    m, folder = transfer.open_checkpoint(s)
    other = new_store(spark)
    version = transfer.install(other, folder.root, only={"supplier"}, expect_version=m.version, commit_version=42)
    return other.begin_read(version).open_table("supplier").iter().withColumn("version", F.lit(other.latest_version()).cast("long"))


@query("SELECT true AS refused, upper(hex(encode(r_name))) || '000100' AS framed FROM region")
def key_length_cap(spark, d):
    """A key of more than 64 KiB is refused; a component of a compound key is framed."""
    long = spark.range(1).select(F.repeat(F.lit("x"), 1 << 17).alias("k"))
    try:
        long.select(codec.encode_hex([(F.col("k"), "string")])).collect()
        refused = False
    except Exception as e:
        refused = "KeyTooLong" in str(e)
    framed = codec.encode_hex([(F.col("r_name"), "string"), (F.lit(0), "u8")])
    return table(spark, d, "region").select(F.lit(refused).alias("refused"), framed.alias("framed"))


# --- full text ------------------------------------------------------------------------------------

_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, count(*)::BIGINT AS n_tokens, count(DISTINCT t)::BIGINT AS n_terms FROM (SELECT doc_id, unnest({_T}) AS t FROM documents) GROUP BY doc_id")
def ft_tokenize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"SELECT doc_id, len({_T})::BIGINT AS dl FROM documents WHERE len({_T}) > 0")
def ft_doc_stats(spark, d):
    return fulltext.doc_stats(table(spark, d, "documents"), ("doc_id",), F.col("text"))


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY term")
def ft_doc_freq(spark, d):
    return fulltext.doc_frequencies(table(spark, d, "documents"), ("doc_id",), F.col("text"))


def _bm25_sql(query: str, k1: float = 1.2, b: float = 0.75, tail: str = "", source: str = "documents", id: str = "doc_id") -> str:
    words = ", ".join(f"('{w}')" for w in query.split())
    return f"""WITH t AS (SELECT {id}, {_T} AS w FROM {source}), dl AS (SELECT {id}, len(w) AS dl, w FROM t WHERE len(w) > 0),
s AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS total FROM dl), q AS (SELECT term, count(*)::DOUBLE AS times FROM (VALUES {words}) AS v(term) GROUP BY term),
p AS (SELECT {id}, dl, term, count(*)::DOUBLE AS tf FROM (SELECT {id}, dl, unnest(w) AS term FROM dl) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term)
SELECT {id}, round(sum(times * greatest(0e0, ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0)) * tf * {k1 + 1}e0 / (tf + {k1}e0 * ({1 - b}e0 + {b}e0 * dl * n / total))), 6) AS score
FROM p JOIN f USING (term) JOIN q USING (term), s {tail}"""


def _ranked(sql: str, limit: int) -> str:
    return sql + f" GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {limit}"


def _found(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_bm25_sql("thble ering") + " GROUP BY doc_id")
def ft_search(spark, d):
    return _found(fulltext.search(table(spark, d, "documents"), ("doc_id",), F.col("text"), "thble ering"))


@query(_ranked(_bm25_sql("thble ering nicht"), 20))
def ft_search_limit(spark, d):
    return _found(fulltext.search(table(spark, d, "documents"), ("doc_id",), F.col("text"), "thble ering nicht", 20))


@query(_bm25_sql("thble nicht", 2.0, 0.5) + " GROUP BY doc_id")
def ft_search_params(spark, d):
    return _found(fulltext.search(table(spark, d, "documents"), ("doc_id",), F.col("text"), "thble nicht", bm25=fulltext.Bm25(2.0, 0.5)))


@query(_bm25_sql("thble ering ering nicht") + " GROUP BY doc_id")
def ft_repeat_term(spark, d):
    return _found(fulltext.search(table(spark, d, "documents"), ("doc_id",), F.col("text"), "thble ering ering nicht"))


@query(_bm25_sql("thble ering ering") + " GROUP BY doc_id")
def ft_index_search(spark, d):
    """The same from postings that are held in a table."""
    path = f"{shared_folder(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    built = fulltext.TextIndex.build(table(spark, d, "documents"), ("doc_id",), F.col("text"), path)
    return _found(built.search("thble ering ering"))


@query(f"SELECT r.doc_id, r.score FROM ({_bm25_sql('thble ering')} GROUP BY doc_id) r JOIN documents USING (doc_id) WHERE lang = 'en'")
def ft_search_filtered(spark, d):
    """Scores over all documents, then those in English."""
    docs = table(spark, d, "documents")
    return _found(fulltext.search(docs, ("doc_id",), F.col("text"), "thble ering")).join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")


@query(_bm25_sql("the and of", source="benchmark", id="item_id") + " GROUP BY item_id")
def ft_search_small(spark, d):
    return _found(fulltext.search(table(spark, d, "benchmark"), ("item_id",), F.col("text"), "the and of"))


@query(_bm25_sql("हिन 東京都 thble", source="(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' हिन्दी' WHEN lang = 'fr' THEN text || ' 東京都' ELSE text END AS text FROM documents)").replace("\\p{N}]", "\\p{N}\\x{093F}\\x{0940}]") + " GROUP BY doc_id")
def ft_search_unicode(spark, d):
    """Queries are split as texts are, whatever the script."""
    docs = table(spark, d, "documents")
    more = F.when(F.col("lang") == "de", F.concat("text", F.lit(" हिन्दी"))).when(F.col("lang") == "fr", F.concat("text", F.lit(" 東京都"))).otherwise(F.col("text"))
    return _found(fulltext.search(docs, ("doc_id",), more, "हिन 東京都 THBLE"))


@query(_bm25_sql("thble ering", source="(SELECT doc_id, CASE WHEN lang = 'fr' THEN 'thble ' || text ELSE text END AS text FROM documents WHERE lang <> 'de')") + " GROUP BY doc_id")
def ft_index_update(spark, d):
    """The index of a table of a store follows it: German texts go, French ones get a word more."""
    from tidemark.sources.texts import TableTextIndex

    s = new_store(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    t = TableDef("docs", "doc_id bigint, lang string, text string", ("doc_id",))
    s.bulk_load(t, docs)
    index = TableTextIndex(s, "docs", F.col("text"))
    index.refresh()
    with s.begin_write() as tx:
        w = tx.open_table(t)
        w.delete_batch(docs.where("lang = 'de'").select("doc_id"))
        w.update_batch(docs.where("lang = 'fr'").withColumn("text", F.concat(F.lit("thble "), "text")))
    index.refresh()
    return _found(index.search("thble ering"))


@query(f"SELECT r.doc_id, r.score FROM ({_bm25_sql('thble ering', source="(SELECT * FROM documents WHERE lang <> 'es')")} GROUP BY doc_id) r")
def ft_unindex(spark, d):
    docs = table(spark, d, "documents")
    built = fulltext.TextIndex.build(docs, ("doc_id",), F.col("text"))
    return _found(built.unindex(docs.where("lang = 'es'").select("doc_id")).search("thble ering"))


# --- vectors --------------------------------------------------------------------------------------

_DIST = {
    "cosine": "CASE WHEN list_dot_product(a, a) * list_dot_product(b, b) > 0 THEN 1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) ELSE 1 END",
    "l2": "list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)",
    "dot": "-list_dot_product(a, b)",
    "cosine_normalized": "1 - list_dot_product(a, b)",
}


def _knn_sql(by: str, where: str = "true", k: int = 10) -> str:
    return f"""WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round({_DIST[by]}, 6) + 0e0 AS dist FROM (SELECT vec_id, label, embedding::DOUBLE[] AS a, b FROM embeddings, q) WHERE {where} ORDER BY {_DIST[by]}, vec_id LIMIT {k}"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, list(reads.get(e, ("vec_id",), 7).first().embedding)


def _near(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


def _knn(by: str) -> Query:
    def run(spark, d):
        e, q = _vectors(spark, d)
        return _near(vector.knn(e, q, 10, by, id="vec_id"))

    return run


for _by in _DIST:
    QUERIES[f"vec_knn_{_by}"], SQL[f"vec_knn_{_by}"] = _knn(_by), _knn_sql(_by)


@query(_knn_sql("cosine", "vec_id IN (SELECT n_nationkey FROM nation)"))
def vec_knn_filtered_small(spark, d):
    e, q = _vectors(spark, d)
    return _near(vector.knn(e, q, 10, "cosine", table(spark, d, "nation").select("n_nationkey"), id="vec_id"))


@query(_knn_sql("cosine", "label < 3"))
def vec_knn_filtered_large(spark, d):
    e, q = _vectors(spark, d)
    return _near(vector.knn(e, q, 10, "cosine", e.where("label < 3").select("vec_id"), id="vec_id"))


def _collection(spark, d):
    from tidemark.sources.vectors import VectorCollection

    c = VectorCollection(new_store(spark), "vectors", 64)
    e, q = _vectors(spark, d)
    c.restore(e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("meta"), F.lit(False).alias("tombstoned")))
    return c, q


@query(_knn_sql("cosine", "vec_id <> 7").replace("SELECT vec_id, round", "SELECT vec_id AS id, round"))
def vec_knn_after_delete(spark, d):
    c, q = _collection(spark, d)
    c.delete(7)
    c.delete(7)
    return _near(c.search(q, 10))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 7), z AS (SELECT embedding::DOUBLE[] AS z FROM embeddings WHERE vec_id = 8),
v AS (SELECT vec_id, CASE WHEN vec_id = 7 THEN z ELSE embedding::DOUBLE[] END AS a, b FROM embeddings, q, z) SELECT vec_id AS id, round(""" + _DIST["cosine"] + ", 6) + 0e0 AS dist FROM v ORDER BY " + _DIST["cosine"] + ", vec_id LIMIT 10")
def vec_knn_after_update(spark, d):
    """Vector 7 is hidden and then gets the values of 8, by which it is found again."""
    c, q = _collection(spark, d)
    c.delete(7)
    c.update_embedding(7, list(c.get(8).first().embedding))
    return _near(c.search(q, 10))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, unnest(range(0, len(a)))::BIGINT AS pos, round(unnest(a) / CASE WHEN n > 0 THEN n ELSE 1 END, 6) + 0e0 AS x FROM v""")
def vec_normalize(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(vector.normalize(F.col("embedding"))).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 7) SELECT vec_id, round({_DIST['l2']}, 6) + 0e0 AS dist FROM (SELECT vec_id, embedding::DOUBLE[] AS a, b FROM embeddings, q)")
def vec_distance_many(spark, d):
    e, q = _vectors(spark, d)
    return _near(vector.distances(e, q, "l2", id="vec_id"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite FROM embeddings")
def vec_finite_check(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vector.is_finite(F.col("embedding")).alias("finite"))


@query(_knn_sql("cosine", "label >= 0").replace("SELECT vec_id, round", "SELECT vec_id + 1 AS id, round"))
def vec_bulk_insert(spark, d):
    """A collection that is filled row by row and in bulk, in order of vec_id, searched by id filters that have all its rows."""
    from tidemark.sources.vectors import VectorCollection, ids_from_rows

    c = VectorCollection(new_store(spark), "vectors", 64)
    e, q = _vectors(spark, d)
    rows = [(list(r.embedding), str(r.label)) for r in e.orderBy("vec_id").collect()]  # a small table, as a user would hand rows in
    c.upsert(*rows[0])
    c.bulk_insert(rows[1:])
    return _near(c.search(q, 10, ids_from_rows(c.store.table(c.table.name))))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 6) + 0e0 AS dist FROM (SELECT vec_id, embedding::DOUBLE[] AS a, b FROM embeddings, q)")
def vec_user_metric(spark, d):
    """A metric of the user's: the sum of absolute differences."""
    import numpy as np

    e, q = _vectors(spark, d)
    return _near(vector.distances(e, q, lambda m, v: np.abs(m - v).sum(axis=1), id="vec_id"))


# --- keys -----------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, turn, lpad(upper(hex(conv_id)), 16, '0') || lpad(upper(hex(turn)), 16, '0') AS as_pair, upper(hex(encode(role))) || '0001' || lpad(upper(hex(turn)), 16, '0') AS framed
FROM conversations"""
)
def key_encode(spark, d):
    c = table(spark, d, "conversations")
    pair = codec.encode_hex([(F.col("conv_id"), "u64"), (F.col("turn"), "u64")])
    return c.select("conv_id", "turn", pair.alias("as_pair"), codec.encode_hex([(F.col("role"), "string"), (F.col("turn"), "u64")]).alias("framed"))


@query("SELECT c_name, c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer")
def key_decode(spark, d):
    h = codec.encode_hex([(F.col("c_name"), "string"), (F.col("c_custkey"), "i64"), (F.col("c_nationkey"), "i32")])
    name, key, nation = codec.decode_hex(h, ["string", "i64", "i32"])
    return table(spark, d, "customer").select(name.alias("c_name"), key.alias("c_custkey"), nation.alias("c_nationkey"))


# --- streams --------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    """Events as a file stream, kept as each user's last one."""
    from tidemark.streaming import changes

    s = new_store(spark)
    t = TableDef("last_event", "user_id bigint, event_type string, event_id bigint", ("user_id",))
    cols = ["user_id", "event_type", "event_id"]
    path = f"{s.folder.root}-in"
    table(spark, d, "events").select(*cols).write.parquet(path)
    rows = spark.readStream.schema(T.StructType.fromDDL("user_id bigint, event_type string, event_id bigint")).parquet(path)
    changes.upsert_stream(rows, s, t, "event_id", f"{s.folder.root}-ck").awaitTermination()
    return s.table("last_event")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price range of orders from a store's files, by a secondary index, at a version."""
    s = new_store(spark)
    t = TableDef("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string", ORDERS)
    s.bulk_load(t, table(spark, sf_dir, "orders").select(*t.struct.names))
    with s.begin_write() as tx:
        tx.open_table(t).define_index("by_price", "o_totalprice")
    return s.begin_read().open_table("orders").index_range("by_price", Bound((100000.0,)), Bound((200000.0,), False))
