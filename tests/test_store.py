import gc
import hashlib
import json
import os
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import Config, CustomIndex, Store, TableDef, VectorCollection, excluded, included
from tidemark import errors as E
from tidemark.sources import transfer
from tidemark.sources.folder import Folder

USERS = TableDef("users", "id bigint, email string, age int", ("id",), True)
PAIRS = TableDef("pairs", "k bigint, v string", ("k",))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def multi(store, **more):
    return store.with_config(multi_writer=True, auto_gc=False, **more)


def put(store, *kv):
    with store.begin_write() as tx:
        tx.open_table(PAIRS).put([{"k": k, "v": v} for k, v in kv])
    return store.latest_version()


def image(store, version=None):
    return {r.k: r.v for r in store.table("pairs", version).collect()}


def test_versions_and_time_travel(store):
    assert store.latest_version() == 0 and store.begin_read().table_names() == []
    put(store, (1, "a"), (2, "b"))
    held = store.begin_read()
    put(store, (2, "c"), (3, "d"))
    assert {r.k: r.v for r in held.open_table("pairs").iter().collect()} == {1: "a", 2: "b"}
    assert image(store) == {1: "a", 2: "c", 3: "d"} and image(store, 1) == {1: "a", 2: "b"}
    with pytest.raises(E.VersionNotFound):
        store.begin_read(9)
    with pytest.raises(E.TableNotFound):
        store.begin_read().open_table("none")
    with pytest.raises(E.TypeMismatch):
        store.begin_read().open_table(TableDef("pairs", "k bigint, v bigint", ("k",)))
    assert Store(store.spark, store.folder.root).latest_version() == 2


def test_inserts_number_rows_and_indexes_hold(store):
    with store.begin_write() as tx:
        u = tx.open_table(USERS)
        assert u.insert({"email": "a", "age": 3}) == 1
        assert list(u.insert_batch([{"email": "b", "age": 3}, {"email": "c", "age": 5}])) == [2, 3]
        u.define_index("email", "email", unique=True)
        u.define_index("age", "age")
        u.define_index("age", "age")
        with pytest.raises(E.IndexTypeMismatch):
            u.define_index("age", "age", unique=True)
        with pytest.raises(E.DuplicateKey):
            u.insert_batch([{"email": "d", "age": 1}, {"email": "a", "age": 1}])
        assert u.next_id() == 4 and u.len() == 3
        with pytest.raises(E.DuplicateKey):
            u.update_batch([{"id": 1, "email": "b", "age": 3}, {"id": 2, "email": "a", "age": 3}])  # a swap
        u.put({"id": 10, "email": "x", "age": 7})
        assert u.insert({"email": "y", "age": 8}) == 11
    r = store.begin_read().open_table(USERS)
    assert r.get_unique("email", "b").first().id == 2
    assert [x.id for x in r.get_by_index("age", 3).collect()] == [1, 2]
    assert [x.id for x in r.index_range("age", included(5), excluded(8)).collect()] == [3, 10]
    with pytest.raises(E.IndexNotFound):
        r.get_unique("none", 1)
    with pytest.raises(E.IndexTypeMismatch):
        r.get_by_index("email", "a")


def test_changes_check_keys_and_roll_back(store):
    put(store, (1, "a"), (2, "b"))
    tx = store.begin_write()
    w = tx.open_table("pairs")
    with pytest.raises(E.WriterBusy):
        store.begin_write()
    for call in (lambda: w.update({"k": 9, "v": "x"}), lambda: w.delete(9), lambda: w.delete_batch([1, 9])):
        with pytest.raises(E.KeyNotFound):
            call()
    with pytest.raises(E.DuplicateKey):
        w.insert_with_id({"k": 1, "v": "x"})
    w.update_batch([{"k": 1, "v": "x"}, {"k": 1, "v": "y"}])
    assert w.delete(2) == {"k": 2, "v": "b"} and w.len() == 1 and w.get(1).first().v == "y"
    tx.rollback()
    assert image(store) == {1: "a", 2: "b"} and store.latest_version() == 1
    assert store.begin_write().commit() == 2


def test_a_dropped_writer_is_over(store):
    tx = store.begin_write()
    tx.open_table(PAIRS)
    with pytest.raises(E.WriterBusy):
        store.begin_write()
    del tx
    gc.collect()
    store.begin_write().rollback()


def test_tables_are_dropped_and_opened_once(store):
    put(store, (1, "a"))
    tx = store.begin_write()
    with pytest.raises(E.DuplicateTableOpen):
        tx.open_tables(PAIRS, PAIRS)
    a, b = tx.open_tables(PAIRS, USERS)
    b.insert({"email": "e", "age": 1})
    assert tx.delete_table("pairs") and not tx.delete_table("none")
    assert tx.table_names() == ["users"] and tx.open_table(PAIRS).len() == 0
    tx.commit()
    assert store.begin_read().open_table("pairs").is_empty()


def test_disjoint_writers_merge_and_equal_keys_conflict(store):
    s = multi(store)
    put(s, (1, "a"), (2, "b"), (3, "c"))
    one, two, three = s.begin_write(), s.begin_write(), s.begin_write()
    one.open_table("pairs").put({"k": 1, "v": "x"})
    two.open_table("pairs").put({"k": 2, "v": "y"})
    with pytest.raises(E.WriteConflict) as held:
        three.open_table("pairs").put({"k": 1, "v": "z"})
    assert not held.value.holder.wait(0.01)
    three.open_table("pairs").put(s.spark.createDataFrame([(1, "w")], "k long, v string"))  # found at commit
    one.commit()
    assert held.value.holder.wait(1)
    two.commit()
    with pytest.raises(E.WriteConflict):
        three.commit()
    assert image(s) == {1: "x", 2: "y", 3: "c"}


def test_drops_conflict_with_writes_only(store):
    s = multi(store)
    put(s, (1, "a"))
    a, b, c = s.begin_write(), s.begin_write(), s.begin_write()
    a.delete_table("pairs"), b.delete_table("pairs")
    c.open_table("pairs").put({"k": 5, "v": "x"})
    a.commit(), b.commit()
    with pytest.raises(E.WriteConflict):
        c.commit()


@pytest.mark.parametrize("serializable", [False, True])
def test_write_skew(store, serializable):
    s = multi(store, serializable=serializable)
    put(s, (1, "on"), (2, "on"))
    one, two = s.begin_write(), s.begin_write()
    for tx, mine, other in ((one, 1, 2), (two, 2, 1)):
        w = tx.open_table("pairs")
        assert w.get(other).first().v == "on"
        w.update({"k": mine, "v": "off"})
    one.commit()
    if serializable:
        with pytest.raises(E.SerializationFailure):
            two.commit()
    else:
        two.commit()


def test_index_definition_conflicts_with_a_change(store):
    s = multi(store)
    put(s, (1, "a"))
    one, two = s.begin_write(), s.begin_write()
    one.open_table("pairs").define_index("v", "v")
    two.open_table("pairs").put({"k": 2, "v": "b"})
    two.commit()
    with pytest.raises(E.IndexDdlConflict):
        one.commit()


def test_threads_commit_all(store):
    s = multi(store)
    put(s, *[(k, "0") for k in range(4)])

    def work(k):
        with s.begin_write() as tx:
            tx.open_table("pairs").put({"k": k, "v": str(k)})

    every = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in every], [t.join() for t in every]
    assert image(s) == {k: str(k) for k in range(4)} and s.latest_version() == 5


def test_gc_and_pins(store):
    s = store.with_config(retained=2)
    pin = None
    for i in range(5):
        put(s, (1, str(i)))
        pin = pin or s.pin_version(1)
    assert s.versions() == [1, 4, 5] and image(s, 1) == {1: "0"} and image(s) == {1: "4"}
    pin.release()
    s.gc()
    assert s.versions() == [4, 5] and image(s) == {1: "4"}


def test_explicit_versions(store):
    s = store.with_config(explicit_version=True)
    with pytest.raises(E.ExplicitVersionRequired):
        s.begin_write()
    s.begin_write(7).commit()
    assert s.latest_version() == 7
    with pytest.raises(E.InvalidCommitVersion):
        s.begin_write(7)


def test_bulk_loads(store, spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    store.bulk_load(PAIRS, df)
    assert store.begin_read().open_table("pairs").len() == 100
    assert [r.k for r in store.begin_read().open_table("pairs").range(included(5), excluded(8)).collect()] == [5, 6, 7]
    with pytest.raises(E.InvalidBulkLoad):
        store.load_batch().replace(PAIRS, df.unionByName(df))
    with pytest.raises(E.RowCountMismatch):
        store.load_batch().replace(PAIRS, df, row_count=5)
    batch = store.load_batch()
    batch.replace_numbered(USERS, spark.createDataFrame([("a", 1), ("b", 2)], "email string, age int"), [F.col("email").desc()])
    put(store, (1000, "z"))
    with pytest.raises(E.WriteConflict):
        batch.commit()
    assert store.load_batch().commit() == store.latest_version()
    keys = spark.createDataFrame([(0,)], "k long")
    none = df.limit(0)
    store.load_batch().delta(PAIRS, none, spark.createDataFrame([(1, "new")], df.schema), keys).commit()
    got = image(store)
    assert got[1] == "new" and 0 not in got and len(got) == 100


def test_files_beyond_a_range_are_not_read(store, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.bulk_load(PAIRS, spark.range(4000).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = store.begin_read().open_table("pairs")
    assert len(r.state.files) > 1
    assert len(r.range(included(5), included(6)).inputFiles()) < len(r.iter().inputFiles())


def test_custom_indexes(store):
    put(store, (1, "a"), (2, "bb"))

    def short(df):
        if not df.where(F.length("v") > 5).isEmpty():
            raise ValueError("too long")

    store.define_custom_index("pairs", CustomIndex("long", lambda df: df.where(F.length("v") > 1).select("k"), short))
    with pytest.raises(E.IndexAlreadyExists):
        store.define_custom_index("pairs", CustomIndex("long", lambda df: df))
    assert [r.k for r in store.begin_read().open_table("pairs").custom_index("long").collect()] == [2]
    with pytest.raises(ValueError):
        put(store, (3, "abcdef"))
    assert image(store) == {1: "a", 2: "bb"}


def test_random_changes_match_a_dict(store):
    rng, model = random.Random(5), {}
    s = store.with_config(compact_after=3, auto_gc=True, retained=2)
    for _ in range(6):
        with s.begin_write() as tx:
            w = tx.open_table(PAIRS)
            for _ in range(3):
                k, op = rng.randrange(6), rng.choice("pud")
                if op == "p":
                    w.put({"k": k, "v": str(rng.random())[:6]})
                elif op == "u":
                    row = {"k": k, "v": "u"}
                    if k in model or w.contains(k):
                        w.update(row)
                elif w.contains(k):
                    w.delete(k)
            model = {r.k: r.v for r in w.iter().collect()}
        assert image(s) == model


def test_export_install_and_damage(store, spark, tmp_path):
    put(store, (1, "a"), (2, "b"))
    put(store, (2, "c"))
    to = str(tmp_path / "out")
    assert transfer.export(store, to) == 2
    other = Store(spark, str(tmp_path / "o"))
    with pytest.raises(E.UnknownTable):
        transfer.install(other, to, unknown="error")
    with pytest.raises(E.VersionNotFound):
        transfer.install(other, to, expect_version=9)
    assert other.latest_version() == 0
    transfer.install(other, to)
    assert image(other) == {1: "a", 2: "c"}
    m, folder = transfer.open_snapshot(spark, to)
    with open(folder._p(m.tables["pairs"].files[0].path), "ab") as f:
        f.write(b"x")
    with pytest.raises(E.SnapshotCorrupted):
        transfer.install(other, to)
    assert other.latest_version() == 1
    again = str(tmp_path / "again")
    store.table("pairs").write.parquet(f"{again}/data/pairs")  # as an export that broke off leaves it
    transfer.export(store, again)
    with pytest.raises(E.WriteConflict):
        transfer.export(store, again)
    with pytest.raises(E.InvalidCommitVersion):
        transfer.install(other, again, commit_version=1)
    assert transfer.install(other, again, commit_version=7) == 7 == other.latest_version()


def test_a_changed_value_is_found_where_sizes_are_the_same(store, spark, tmp_path):
    put(store, (1, "a"))
    to = str(tmp_path / "out")
    transfer.export(store, to)
    m, folder = transfer.open_snapshot(spark, to)
    path = folder._p(m.tables["pairs"].files[0].path)
    raw = open(path, "rb").read()
    spark.createDataFrame([(1, "b")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "other"))
    new = next((tmp_path / "other").glob("part-*")).read_bytes()
    shutil.copyfile(next((tmp_path / "other").glob("part-*")), path)
    text = folder.read("snapshot.json").replace(f": {len(raw)}", f": {len(new)}")
    body = json.loads(text)
    body["digest"] = hashlib.sha256((body["body"] + json.dumps([body["sizes"], body["sums"]], sort_keys=True)).encode()).hexdigest()
    with open(folder._p("snapshot.json"), "w") as f:
        json.dump(body, f)
    for crc in tmp_path.rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(E.SnapshotCorrupted):
        transfer.install(Store(spark, str(tmp_path / "o")), to)


def test_a_name_without_a_folder_stays_below_the_root(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "root"))
    before = set(os.listdir("/"))
    assert folder.publish("a.json", "x") and not folder.publish("a.json", "y") and folder.read("a.json") == "x"
    assert set(os.listdir("/")) == before and os.listdir(tmp_path) == ["root"] and os.listdir(tmp_path / "root") == ["a.json"]


def test_publication_is_serial_with_explicit_versions(store):
    s = store.with_config(multi_writer=True)
    put(s, (1, "a"))
    one, two, three = s.begin_write(), s.begin_write(10), s.begin_write(5)
    for tx, k in ((one, 2), (two, 3), (three, 4)):
        tx.open_table(PAIRS).put({"k": k, "v": "x"})
    real = s.versions
    listed = real()
    two.commit()
    s.versions = lambda: listed  # as if `one` had looked before `two` published
    m = s.manifest(1)
    from tidemark.sources.manifest import Manifest

    assert not s.publish(Manifest(2, 1, m.tables))
    s.versions = real
    with pytest.raises(E.InvalidCommitVersion):
        three.commit()
    assert one.commit() == 11 and s.versions() == [0, 1, 10, 11] and image(s) == {1: "a", 2: "x", 3: "x"}


def test_a_claimed_publication_is_finished_by_others(store):
    put(store, (1, "a"))
    put(store, (2, "b"))
    staged = store.folder.stage(store._name(2), store.folder.read(store._name(2)))
    store.folder.delete(store._name(2))
    store.folder.delete(store._head(1))
    store.folder.publish(store._head(1), json.dumps({"version": 2, "manifest": staged}))
    again = Store(store.spark, store.folder.root)
    assert again.latest_version() == 2 and image(again) == {1: "a", 2: "b"}


def test_loads_of_unknown_tables(store, spark):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(E.TableNotFound):
        store.load_batch().replace(PAIRS, rows, create=False)
    with pytest.raises(E.TableNotFound):
        store.load_batch().delta(PAIRS, rows, rows.limit(0), rows.limit(0).select("k"))
    store.bulk_load(PAIRS, rows)
    store.load_batch().replace(PAIRS, rows.withColumn("v", F.lit("b")), create=False).commit()
    assert image(store) == {1: "b"}


def test_checkpoint_and_recovery(store):
    put(store, (1, "a"))
    put(store, (2, "b"))
    assert transfer.checkpoint(store) == 2 and transfer.checkpoints(store) == [2]
    put(store, (3, "c"))
    with open(store.folder._p(store._name(4)), "w") as f:
        f.write('{"version": 4, "ba')  # cut off
    again = Store(store.spark, store.folder.root)
    with pytest.raises(E.LogCorrupted):
        transfer.recover(again)
    assert transfer.recover(again, truncate=True) == 3 and again.folder.names("damaged") == ["000000000004.json"] and image(again) == {1: "a", 2: "b", 3: "c"}
    for v in again.versions():
        again.folder.delete(again._name(v))
    last = Store(store.spark, store.folder.root)
    transfer.recover(last)
    assert image(last) == {1: "a", 2: "b"}


def test_change_log_and_metrics(store):
    put(store, (1, "a"), (2, "b"))
    with store.begin_write() as tx:
        tx.open_table("pairs").delete(1)
    assert sorted((r.op, r.key) for r in store.changes(1).collect()) == [("put", '{"k":1}'), ("put", '{"k":2}')]
    assert [(r.op, r.key, r.row) for r in store.changes(2).collect()] == [("delete", '{"k":1}', None)]
    found = {(r.scope, r.name): r.value for r in store.metrics().collect()}
    assert found[("store", "commits")] == 2 and found[("pairs", "deletes")] == 1


def test_registered_tables_open_by_name(store):
    with store.begin_write() as tx, pytest.raises(E.TableNotFound):
        tx.open_table("pairs")
    store.register_table(PAIRS)
    store.register_table(PAIRS)
    with pytest.raises(E.TypeMismatch):
        store.register_table(TableDef("pairs", "k bigint, v bigint", ("k",)))
    with store.begin_write() as tx:
        tx.open_table("pairs").put({"k": 1, "v": "a"})
    with store.begin_write() as tx:
        tx.open_table("pairs").delete(1)
    assert [(r.version, r.op) for r in store.read_log().orderBy("version").collect()] == [(2, "put"), (3, "delete")] and store.live_writes() == 0


def test_vector_collection(store, spark):
    c = VectorCollection(store, "v", 2)
    assert [c.upsert((1, 0), "a"), *c.bulk_insert([((0, 1), "b"), ((1, 0.5), None)])] == [1, 2, 3]
    assert [r.id for r in c.search((1, 0.05), 2).collect()] == [1, 3]
    ids = spark.createDataFrame([(2,), (3,), (3,)], "id long")
    assert [r.id for r in c.search((1, 0.05), 5, ids).collect()] == [3, 2]
    assert c.search((1, 0), 5, ids.limit(0)).count() == 0
    c.delete(1), c.delete(1)
    assert [r.id for r in c.search((1, 0.05), 1).collect()] == [3]
    c.update_embedding(1, (1, 0.05))
    assert [r.id for r in c.search((1, 0.05), 1).collect()] == [1] and c.get(1).first().meta == "a"
    for error, call in ((E.NodeNotFound, lambda: c.delete(9)), (E.DimensionMismatch, lambda: c.upsert((1,))), (E.NotFinite, lambda: c.search((1, float("nan")), 1)), (E.InvalidParameters, lambda: VectorCollection(store, "w", 0))):
        with pytest.raises(error):
            call()
