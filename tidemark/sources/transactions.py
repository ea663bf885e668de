"""Read and write transactions over a store.

A handle's reads are DataFrames over one version; a writer's see its own changes.  Changes stay a plan
until commit, which writes them as one delta a table and publishes one manifest.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import DuplicateKey, DuplicateTableOpen, IndexAlreadyExists, IndexDdlConflict, IndexNotFound, IndexTypeMismatch
from tidemark.errors import InvalidBulkLoad, InvalidCommitVersion, KeyExhausted, KeyNotFound, SerializationFailure, TableNotFound, TidemarkError, TypeMismatch, WriteConflict
from tidemark.operators import index as ix
from tidemark.operators import mutate, reads
from tidemark.operators.index import CustomIndex, Index
from tidemark.operators.reads import Bound
from tidemark.sources.manifest import Manifest, TableDef, TableState

Rows = DataFrame | Sequence[dict]


class TableReader:
    """One table at one version.  `df` is all of it."""

    def __init__(self, store, name: str, state: TableState, version: int):
        self.store, self.name, self.state, self.version = store, name, state, version
        self.key = tuple(state.key)

    def _count(self, what: str) -> None:
        self.store.table_counters[(self.name, what)] += 1

    def _point(self, keys: Sequence[object]) -> None:
        self._count("reads")

    def _whole(self) -> None:
        self._count("scans")

    def _image(self, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
        return self.store.image(self.state, lower, upper)

    @property
    def df(self) -> DataFrame:
        self._whole()
        return self._image()

    def get(self, key: object) -> DataFrame:
        self._point([key])
        k = Bound(reads.as_key(key))
        return reads.get(self._image(k, k), self.key, key)

    def contains(self, key: object) -> bool:
        self._point([key])
        k = Bound(reads.as_key(key))
        return reads.contains(self._image(k, k), self.key, key)

    def get_many(self, keys: Sequence[object]) -> DataFrame:
        self._point(keys)
        return reads.get_many(self._image(), self.key, keys)

    def resolve(self, keys: Sequence[object]) -> DataFrame:
        self._point(keys)
        return reads.resolve(self._image(), self.key, keys)

    def range(self, lower: Bound | None = None, upper: Bound | None = None, descending: bool = False) -> DataFrame:
        self._whole()
        return reads.key_range(self._image(lower, upper), self.key, lower, upper, descending)

    def prefix(self, *value: object) -> DataFrame:
        self._whole()
        b = Bound(value[:1])
        return reads.prefix(self._image(b, b), self.key, *value)

    def iter(self) -> DataFrame:
        return reads.ordered(self.df, self.key)

    def len(self) -> int:
        self._whole()
        if not self.state.deltas and type(self) is TableReader:
            return sum(f.rows for f in self.state.files)
        return self._image().count()

    def is_empty(self) -> bool:
        self._whole()
        return self._image().isEmpty()

    def first(self) -> DataFrame:
        return reads.first(self.df, self.key)

    def last(self) -> DataFrame:
        return reads.last(self.df, self.key)

    def scan(self, start: object, n: int) -> DataFrame:
        self._whole()
        return reads.scan(self._image(Bound(reads.as_key(start)), None), self.key, start, n)

    def next_id(self) -> int | None:
        return self.state.next_id

    # indexes

    def _index(self, name: str) -> Index:
        for i in self.state.index_list():
            if i.name == name:
                return i
        if name in self.store.custom.get(self.name, {}):
            raise IndexTypeMismatch(f"{name} is a custom index")
        raise IndexNotFound(name)

    def get_unique(self, index: str, value: object) -> DataFrame:
        self._count("index_reads")
        return ix.get_unique(self.df, self._index(index), value)

    def get_by_index(self, index: str, value: object) -> DataFrame:
        self._count("index_reads")
        return ix.get_by_index(self.df, self.key, self._index(index), value)

    def get_by_key(self, index: str, value: object) -> DataFrame:
        self._count("index_reads")
        return ix.get_by_key(self.df, self.key, self._index(index), value)

    def index_range(self, index: str, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
        self._count("index_range_scans")
        return ix.index_range(self.df, self.key, self._index(index), lower, upper)

    def custom_index(self, name: str) -> DataFrame:
        found = self.store.custom.get(self.name, {}).get(name)
        if found is None:
            if name in {i["name"] for i in self.state.indexes}:
                raise IndexTypeMismatch(f"{name} is not a custom index")
            raise IndexNotFound(name)
        return found.build(self.df)


class ReadTx:
    """Sees one version.  Close it, or use it in a with block, so that gc may drop that version."""

    def __init__(self, store, manifest: Manifest):
        self.store, self.manifest = store, manifest
        self._pin = store.pin_version(manifest.version)

    @property
    def version(self) -> int:
        return self.manifest.version

    def table_names(self) -> list[str]:
        return sorted(self.manifest.tables)

    def open_table(self, table: str | TableDef) -> TableReader:
        name = table if isinstance(table, str) else table.name
        if name not in self.manifest.tables:
            raise TableNotFound(name)
        state = self.manifest.tables[name]
        if not isinstance(table, str):
            check_def(table, state)
        return TableReader(self.store, name, state, self.version)

    def close(self) -> None:
        self._pin.release()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def check_def(d: TableDef, state: TableState) -> None:
    shape = lambda s: [(f.name, f.dataType) for f in s]
    if list(d.key) != state.key or d.auto != state.auto or shape(d.struct) != shape(state.struct):
        raise TypeMismatch(d.name)


class TableWriter(TableReader):
    """A table within a write transaction: reads see the changes made so far."""

    def __init__(self, tx: WriteTx, name: str, state: TableState, fresh: bool):
        super().__init__(tx.store, name, state, tx.base.version)
        self.tx, self.fresh = tx, fresh  # fresh: not the table of the base
        self.changes: DataFrame | None = None
        self.defined: list[str] = []
        self.points: list[object] = []
        self.scanned = False

    def _point(self, keys: Sequence[object]) -> None:
        super()._point(keys)
        self.points += keys

    def _whole(self) -> None:
        super()._whole()
        self.scanned = True

    @property
    def _cols(self) -> list[str]:
        return self.state.struct.names

    def _image(self, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
        base = self.store.image(self.state, lower, upper)
        if self.changes is None:
            return base
        live = self.changes.where("not __deleted").select(*self._cols)
        return base.join(self.changes.select(*self.key), list(self.key), "left_anti").select(*self._cols).unionByName(live)

    def frame(self, rows: Rows, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows given as dicts or as a DataFrame, with the table's types."""
        columns = list(columns or self._cols)
        schema = T.StructType([T.StructField(c, self.state.struct[c].dataType) for c in columns])
        if not isinstance(rows, DataFrame):
            return self.store.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
        lacking = [c for c in columns if c not in rows.columns]
        if lacking:
            raise TypeMismatch(f"{self.name} has columns {lacking}")
        return rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])

    def _claim(self, rows: Rows) -> None:
        """Listed keys are claimed at once, so that another live writer of one fails fast."""
        if self.store.config.multi_writer and not isinstance(rows, DataFrame):
            self.tx.claim(self.name, [tuple(r[c] for c in self.key) for r in rows if all(r.get(c) is not None for c in self.key)])

    def _change(self, rows: DataFrame, deleted: bool, what: str) -> None:
        """Take in changes whose keys are distinct."""
        new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(self.state.struct[c].dataType).alias(c) for c in self._cols], F.lit(deleted).alias("__deleted"))
        if not deleted:
            self._check_indexes(new.drop("__deleted"))
        old = self.changes
        self.changes = new if old is None else old.join(new.select(*self.key), list(self.key), "left_anti").select(*new.columns).unionByName(new)
        for custom in self.store.custom.get(self.name, {}).values():
            if custom.validate:
                try:
                    custom.validate(self._image())
                except Exception:
                    self.changes = old
                    raise
        self._count(what)

    def _check_indexes(self, new: DataFrame) -> None:
        """New keys of unique indexes: once among the new rows, and held by no other row as things stand.

        With strict_unique a batch can't take a value that another of its rows gives up.
        """
        for i in self.state.index_list():
            if not i.unique:
                continue
            ix.check_unique(new, i)
            names = [f"__k{n}" for n in range(len(i.on))]
            mine = new.select(*[c.alias(n) for c, n in zip(i.columns, names)], *[F.col(c).alias(f"__p_{c}") for c in self.key])
            rest = self._image()
            if not self.store.config.strict_unique:
                rest = rest.join(new.select(*self.key), list(self.key), "left_anti")
            same = None
            for c, n in zip(i.columns, names):
                same = c.eqNullSafe(F.col(n)) if same is None else same & c.eqNullSafe(F.col(n))
            other = None
            for c in self.key:
                other = (F.col(c) != F.col(f"__p_{c}")) if other is None else other | (F.col(c) != F.col(f"__p_{c}"))
            if not rest.join(mine, same & other, "left_semi").isEmpty():
                raise DuplicateKey(f"index {i.name}")

    # changes

    def _advance(self, rows: DataFrame) -> None:
        if self.state.auto:
            self.state.next_id = max(self.state.next_id or 1, mutate.next_after(rows, self.key[0]))

    def _need_auto(self) -> None:
        if not self.state.auto:
            raise TidemarkError(f"{self.name} doesn't number its rows")

    def insert(self, row: dict) -> int:
        return self.insert_batch([row])[0]

    def insert_batch(self, rows: Rows, order: list[Column] | None = None) -> list[int] | range:
        """Number new rows in input order; the ids.  All or nothing."""
        self._need_auto()
        start = self.state.next_id or 1
        rest = [c for c in self._cols if c not in self.key]
        if isinstance(rows, DataFrame):
            new, after = mutate.numbered(self.frame(rows, rest), self.key[0], start, order)
        else:
            if not len(rows):
                return []
            if start + len(rows) - 1 > mutate.MOST:
                raise KeyExhausted("ids end at 2^63 - 1")
            rows = [{**r, self.key[0]: start + i} for i, r in enumerate(rows)]
            new, after = self.frame(rows), start + len(rows)
            self._claim(rows)
        self._change(new, False, "inserts")
        self.state.next_id = after
        return range(start, after)

    def insert_with_id(self, rows: dict | Rows) -> None:
        """New rows with their keys."""
        rows = [rows] if isinstance(rows, dict) else rows
        new = self.frame(rows)
        self._claim(rows)
        mutate.no_nulls(new, self.key)
        mutate.must_be_distinct(new, self.key)
        mutate.must_be_new(self._image(), self.key, new)
        self._change(new, False, "inserts")
        self._advance(new)

    def put(self, rows: dict | Rows) -> None:
        rows = [rows] if isinstance(rows, dict) else rows
        new = self.frame(rows)
        self._claim(rows)
        mutate.no_nulls(new, self.key)
        mutate.must_be_distinct(new, self.key)
        self._change(new, False, "updates")
        self._advance(new)

    def update(self, row: dict) -> None:
        self.update_batch([row])

    def update_batch(self, rows: Rows, position: str | None = None) -> None:
        """Rows that exist get new values; of several for a key the last counts (of a DataFrame, by `position`)."""
        if isinstance(rows, DataFrame):
            new = self.frame(rows) if position is None else mutate.last_of_each(rows, self.key, position)
        else:
            last = {tuple(r[c] for c in self.key): r for r in rows}
            new = self.frame(list(last.values()))
            self._claim(list(last.values()))
        mutate.must_be_distinct(new, self.key)
        mutate.must_exist(self._image(), self.key, new)
        self._change(new, False, "updates")

    def delete(self, key: object) -> dict:
        """The old row."""
        found = reads.get(self._image(), self.key, key).limit(1).collect()
        if not found:
            raise KeyNotFound(f"no key {key}")
        self.delete_batch([key])
        return found[0].asDict()

    def delete_batch(self, keys: DataFrame | Sequence[object]) -> None:
        if not isinstance(keys, DataFrame):
            keys = [dict(zip(self.key, reads.as_key(k))) for k in keys]
            self._claim(keys)
        gone = self.frame(keys, self.key).distinct()
        mutate.must_exist(self._image(), self.key, gone)
        self._change(gone, True, "deletes")

    def set_next_id(self, n: int) -> None:
        self._need_auto()
        self.state.next_id = n

    def replace(self, rows: Rows, auto_ids: bool = False, position: str | None = None) -> None:
        """All rows go and these come; of several with a key the last counts (of a DataFrame, by `position`)."""
        image = self._image().select(*self.key)
        if auto_ids:
            self._change(image, True, "deletes")
            self.insert_batch(rows)
            return
        if not isinstance(rows, DataFrame):
            rows = list({tuple(r[c] for c in self.key): r for r in rows}.values())
        new = self.frame(rows) if position is None else self.frame(mutate.last_of_each(rows, self.key, position))
        mutate.must_be_distinct(new, self.key, InvalidBulkLoad)
        self._change(image, True, "deletes")
        self._change(new, False, "inserts")
        self._advance(new)

    def apply_delta(self, inserts: Rows = (), updates: Rows = (), deletes: DataFrame | Sequence[object] = ()) -> None:
        """Deletes, then updates, then inserts, which here may be of keys that exist."""
        if isinstance(deletes, DataFrame) or len(deletes):
            self.delete_batch(deletes)
        if isinstance(updates, DataFrame) or len(updates):
            self.update_batch(updates)
        if isinstance(inserts, DataFrame) or len(inserts):
            self.put(inserts)

    def define_index(self, name: str, on: Sequence[str] | str, unique: bool = False) -> None:
        """Declare an index over columns or expressions; a unique one must hold for the rows that there are."""
        new = Index(name, (on,) if isinstance(on, str) else tuple(on), unique)
        if name in self.store.custom.get(self.name, {}):
            raise IndexTypeMismatch(name)
        for old in self.state.index_list():
            if old.name == name:
                if old.unique != unique:
                    raise IndexTypeMismatch(name)
                return
        ix.check_unique(self._image(), new)
        self.state.indexes.append({"name": name, "on": list(new.on), "unique": unique})
        self.defined.append(name)

    def define_custom_index(self, index: CustomIndex) -> None:
        if index.name in {i["name"] for i in self.state.indexes}:
            raise IndexAlreadyExists(index.name)
        self.store.define_custom_index(self.name, index)

    @property
    def dirty(self) -> bool:
        return self.changes is not None or bool(self.defined) or self.fresh


class Holder:
    """A live writer's end, to wait for."""

    def __init__(self) -> None:
        self._done = threading.Event()

    def wait(self, seconds: float | None = None) -> bool:
        return self._done.wait(seconds)

    def end(self) -> None:
        self._done.set()


class WriteTx:
    def __init__(self, store, base: Manifest, version: int | None):
        self.store, self.base, self._version = store, base, version
        self.writers: dict[str, TableWriter] = {}
        self.removed: set[str] = set()
        self.tokens: dict[str, int] = {}
        self.holder = Holder()
        self.claimed: set[tuple] = set()
        self.live = True
        self._pin = store.pin_version(base.version)

    @property
    def version(self) -> int:
        return self._version or self.base.version + 1

    def table_names(self) -> list[str]:
        return sorted(({*self.base.tables} - self.removed) | set(self.writers))

    def open_table(self, table: TableDef | str) -> TableWriter:
        """The table for writing; it is made if there is none and its definition is given."""
        name = table if isinstance(table, str) else table.name
        if name in self.writers:
            w = self.writers[name]
        else:
            known = self.base.tables.get(name) if name not in self.removed else None
            if known is None and isinstance(table, str):
                if name not in self.store.registered:
                    raise TableNotFound(name)
                table = self.store.registered[name]
            state = known.copy() if known else TableState.of(table)
            w = self.writers[name] = TableWriter(self, name, state, known is None)
        if not isinstance(table, str):
            check_def(table, w.state)
        return w

    def open_tables(self, *tables: TableDef | str) -> tuple[TableWriter, ...]:
        """Several tables at once, each a different one."""
        names = [t if isinstance(t, str) else t.name for t in tables]
        for n in names:
            if names.count(n) > 1:
                raise DuplicateTableOpen(n)
        return tuple(self.open_table(t) for t in tables)

    def delete_table(self, name: str) -> bool:
        existed = name in self.table_names()
        self.writers.pop(name, None)
        if name in self.base.tables:
            self.removed.add(name)
        return existed

    def claim(self, table: str, keys: list[tuple]) -> None:
        with self.store.lock:
            for k in keys:
                held = self.store.intents.get((table, k))
                if held is not None and held is not self.holder:
                    self.store.counters["conflicts"] += 1
                    raise WriteConflict(f"{table}: key {k} has a live writer", table, holder=held)
            for k in keys:
                self.store.intents[(table, k)] = self.holder
                self.claimed.add((table, k))

    def _end(self) -> None:
        if self.live:
            self.live = False
            with self.store.lock:
                for k in self.claimed:
                    self.store.intents.pop(k, None)
                if self.store._writer() in (self, None):
                    self.store._writer = lambda: None
            self.holder.end()
            self._pin.release()

    def rollback(self) -> None:
        if self.live:
            self.store.counters["rollbacks"] += 1
        self._end()

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None and self.live:
            self.commit()
        self.rollback()

    def __del__(self):
        self._end()

    # commit

    def commit(self) -> int:
        """Write the deltas, validate against the versions since the base, publish; the new version.

        An attempt that another commit overtakes validates again.  A failure leaves the store as it was.
        """
        if not self.live:
            raise TidemarkError("the transaction is over")
        try:
            began = time.perf_counter()
            dirty = {n: w for n, w in self.writers.items() if w.dirty}
            deltas = {n: self.store.write_delta(w.changes, n) for n, w in dirty.items() if w.changes is not None}
            self.store.timed("write", began)
            checked = self.base.version
            latest = self.base
            while True:
                began = time.perf_counter()
                now = self.store.latest_version()
                if now > checked:
                    if not self.store.config.multi_writer:
                        raise WriteConflict("another process committed", version=now)
                    for v in (v for v in self.store.versions() if checked < v <= now):
                        self._validate(self.store.manifest(v), deltas)
                    checked, latest = now, self.store.manifest(now)
                self.store.timed("validate", began)
                m = self._merged(latest, dirty, deltas)
                began = time.perf_counter()
                if self.store.publish(m):
                    break
            self.store.timed("publish", began)
            self.store.counters["commits"] += 1
        except (WriteConflict, SerializationFailure, IndexDdlConflict):
            self.store.counters["conflicts"] += 1
            raise
        except Exception:
            self.store.counters["failures"] += 1
            raise
        finally:
            self._end()
        if self.store.config.auto_gc:
            self.store.gc()
        return m.version

    def _validate(self, other: Manifest, deltas: dict[str, str]) -> None:
        touched = other.touched()
        gone = {*other.deleted, *other.installed}
        for name in deltas:
            if name in gone:
                raise WriteConflict(f"{name} was replaced or dropped", name, other.version)
            w = self.writers[name]
            if name in other.writes and self._meets(w, w.changes.select(*w.key), other):
                raise WriteConflict(f"{name}: a key was written by version {other.version}", name, other.version)
        for name in self.removed:
            if name in other.writes or name in other.installed:
                raise WriteConflict(f"{name} was written", name, other.version)
        for name, w in self.writers.items():
            if w.fresh and name in other.tables and name not in self.base.tables and name in touched:
                raise WriteConflict(f"{name} was made by version {other.version}", name, other.version)
            if w.defined and name in touched | set(other.indexed):
                raise IndexDdlConflict(f"{name} was changed by version {other.version}")
            if self.store.config.serializable and name in touched:
                if w.scanned or name in gone:
                    if w.scanned or w.points:
                        raise SerializationFailure(f"{name} was read and then written by version {other.version}", name, other.version)
                elif w.points and name in other.writes and self._meets(w, reads.key_rows(self.store.image(w.state), w.key, w.points).select(*w.key), other):
                    raise SerializationFailure(f"{name}: a key that was read was written by version {other.version}", name, other.version)

    def _meets(self, w: TableWriter, keys: DataFrame, other: Manifest) -> bool:
        theirs = self.store.changed_rows(other.version, w.name)
        return theirs is not None and not theirs.select(*w.key).join(keys, list(w.key), "left_semi").isEmpty()

    def _merged(self, latest: Manifest, dirty: dict[str, TableWriter], deltas: dict[str, str]) -> Manifest:
        tables = {n: t for n, t in latest.tables.items() if n not in self.removed or n in latest.installed}
        indexed = []
        for n, w in dirty.items():
            state = (w.state if w.fresh or n not in tables else tables[n]).copy()
            if n in deltas:
                state.deltas.append(deltas[n])
            for i in w.state.indexes:
                if i["name"] in w.defined and i["name"] not in {x["name"] for x in state.indexes}:
                    state.indexes.append(i)
            if w.defined:
                indexed.append(n)
            if state.auto:
                forced = w.state.next_id or 1
                state.next_id = max(forced, tables[n].next_id or 1) if latest is not self.base and n in tables else forced
            if latest is not self.base and n in deltas:
                mine = w.changes.where("not __deleted").drop("__deleted")
                for i in state.index_list():
                    ix.check_unique(self.store.image(state), i, mine)
            if len(state.deltas) >= self.store.config.compact_after:
                state = self.store.compacted(state, n)
            tables[n] = state
        version = self._version or latest.version + 1
        if version <= latest.version:
            raise InvalidCommitVersion(f"{version} is not beyond {latest.version}")
        removed = sorted(n for n in self.removed if n in latest.tables)
        return Manifest(version, latest.version, tables, deltas, removed, [], indexed, {**latest.tokens, **self.tokens})
