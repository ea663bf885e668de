"""Versioned tables: immutable Parquet data, and one small manifest for each version.

A version is published by claiming to be the successor of the one that it is based on, which fails if that
has one; the loser validates again.  So versions form one chain, whatever numbers writers choose.  Readers hold
a manifest, so later versions don't change what they see.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import weakref
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidParameters, TableNotFound, VersionNotFound, WriteConflict, WriterBusy
from tidemark.errors import ExplicitVersionRequired, InvalidCommitVersion
from tidemark.operators.index import CustomIndex
from tidemark.operators.reads import Bound
from tidemark.sources.folder import Folder
from tidemark.sources.manifest import DataFile, Manifest, TableDef, TableState

VERSIONS, HEADS = "versions", "heads"
FILE_BYTES, MOST_FILES = 512 << 20, 1_000_000
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)


@dataclass(frozen=True)
class Config:
    """retained: versions that gc leaves; compact_after: deltas of a table before its files are written anew."""

    retained: int = 10
    auto_gc: bool = True
    multi_writer: bool = False
    serializable: bool = False
    explicit_version: bool = False
    compact_after: int = 8
    strict_unique: bool = True


class Pin:
    """Keeps a version until it is released."""

    def __init__(self, store: Store, version: int):
        self.store, self.version, self._open = store, version, True
        store._refer(version, 1)

    def release(self) -> None:
        if self._open:
            self._open = False
            self.store._refer(self.version, -1)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()

    def __del__(self):
        self.release()


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.folder, self.config = spark, Folder(spark, path), config
        self.lock = threading.RLock()
        self.counters: Counter = Counter()
        self.table_counters: dict[tuple[str, str], int] = Counter()
        self.custom: dict[str, dict[str, CustomIndex]] = {}
        self.intents: dict[tuple, object] = {}
        self.registered: dict[str, TableDef] = {}
        self.durable_hooks: list[Callable[[int], None]] = []
        self._refs: Counter = Counter()
        self._writer: Callable[[], object | None] = lambda: None  # a weak reference: a writer that is dropped is over
        self._cached: dict[int, Manifest] = {}

    # versions

    def versions(self) -> list[int]:
        """All versions that there are, ascending; the empty store's 0 is one until others push it out."""
        found = [int(n[:-5]) for n in self.folder.names(VERSIONS) if n.endswith(".json") and not n.startswith(".")]
        return sorted(found) or [0]

    def latest_version(self) -> int:
        found = self.versions()[-1]
        while (text := self.folder.read(self._head(found))) is not None:
            claim = json.loads(text)  # by a writer that has gone no further yet
            if not self.folder.exists(self._name(self._follow(claim))):
                break  # both are lost, which is for recovery to mend
            found = claim["version"]
        return found

    @staticmethod
    def _head(base: int) -> str:
        return f"{HEADS}/{base:012d}.json"

    def _follow(self, claim: dict) -> int:
        """Finish a publication from its claim on; the version."""
        name = self._name(claim["version"])
        if not self.folder.exists(name):
            self.folder.settle(claim["manifest"], name)
        return claim["version"]

    durable_version = latest_version

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = self.latest_version()
        if version in self._cached:
            return self._cached[version]
        text = self.folder.read(self._name(version))
        if text is None:
            if version == 0 and self.versions() == [0]:
                return Manifest()
            raise VersionNotFound(f"no version {version}")
        self._cached[version] = Manifest.from_json(text)
        return self._cached[version]

    @staticmethod
    def _name(version: int) -> str:
        return f"{VERSIONS}/{version:012d}.json"

    def publish(self, manifest: Manifest) -> bool:
        if manifest.base == 0 and not self.folder.exists(self._name(0)):
            self.folder.publish(self._name(0), Manifest().to_json())
        if manifest.version <= manifest.base:
            raise InvalidCommitVersion(f"{manifest.version} is not beyond {manifest.base}")
        staged = self.folder.stage(self._name(manifest.version), manifest.to_json())
        claim = {"version": manifest.version, "manifest": staged}
        if self.versions()[-1] != manifest.base or not self.folder.publish(self._head(manifest.base), json.dumps(claim)):
            self.folder.delete(staged)
            return False
        if self.versions()[-1] not in (manifest.base, manifest.version):  # the base was collected, and its successor's claim with it
            self.folder.delete(self._head(manifest.base))
            self.folder.delete(staged)
            return False
        self._follow(claim)
        self._cached[manifest.version] = manifest
        for hook in self.durable_hooks:
            hook(manifest.version)
        return True

    def on_durable(self, hook: Callable[[int], None]) -> None:
        self.durable_hooks.append(hook)

    def wait_durable(self, version: int) -> int:
        """Commits are durable when they return."""
        if version > self.latest_version():
            raise VersionNotFound(f"no version {version}")
        return version

    def pending_writes(self) -> int:
        return 0

    def pin_version(self, version: int | None = None) -> Pin:
        version = self.latest_version() if version is None else version
        self.manifest(version)
        return Pin(self, version)

    def _refer(self, version: int, by: int) -> None:
        with self.lock:
            self._refs[version] += by

    def live_writes(self) -> int:
        """The number of keys that live writers have claimed."""
        return len(self.intents)

    # transactions

    def register_table(self, d: TableDef) -> None:
        """Let writers open a table by its name before it exists; another definition of a known one is an error."""
        from tidemark.errors import TypeMismatch
        from tidemark.sources.transactions import check_def

        if self.registered.get(d.name, d) != d:
            raise TypeMismatch(d.name)
        if d.name in (known := self.manifest().tables):
            check_def(d, known[d.name])
        self.registered[d.name] = d

    def begin_read(self, version: int | None = None):
        from tidemark.sources.transactions import ReadTx

        return ReadTx(self, self.manifest(version))

    def begin_write(self, version: int | None = None):
        from tidemark.sources.transactions import WriteTx

        with self.lock:
            base = self.manifest()
            if version is None and self.config.explicit_version:
                raise ExplicitVersionRequired("begin_write needs a version")
            if version is not None and version <= base.version:
                raise InvalidCommitVersion(f"{version} is not beyond {base.version}")
            if not self.config.multi_writer and self._writer() is not None:
                raise WriterBusy("another writer is live")
            tx = WriteTx(self, base, version)
            if not self.config.multi_writer:
                self._writer = weakref.ref(tx)
            return tx

    # data

    def write_data(self, df: DataFrame, table: str, key: Sequence[str], ranged: bool = True) -> list[DataFile]:
        """Write rows, in files of key ranges, and return the files with their bounds."""
        name = f"data/{table}/{uuid.uuid4().hex}"
        if ranged:
            n = self._files_for(df)
            df = df.repartitionByRange(*([n] if n else []), *[F.col(c) for c in key])
        df.sortWithinPartitions(*key).write.parquet(self.folder.path(name))
        return self.described(name, df.schema, key)

    def _files_for(self, df: DataFrame) -> int | None:
        """How many files of about FILE_BYTES the rows take by the planner's estimate, where the session's shuffle partitions are too few."""
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        n = size // FILE_BYTES
        return n if int(self.spark.conf.get("spark.sql.shuffle.partitions")) < n <= MOST_FILES else None

    def described(self, name: str, schema: T.StructType, key: Sequence[str]) -> list[DataFile]:
        """Rows and bounds of each file: from the footers of local ones, else by a scan of the key column."""
        plain = isinstance(schema[key[0]].dataType, _PLAIN)
        if self.folder.local:
            return [self._footer(f"{name}/{n}", key[0], plain) for n in self.folder.names(name) if n.endswith(".parquet")]
        rows = self.spark.read.schema(schema).parquet(self.folder.path(name))
        bounds = (F.min(key[0]), F.max(key[0])) if plain else (F.lit(None), F.lit(None))
        found = rows.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), bounds[0].alias("low"), bounds[1].alias("high")).collect()  # a row for each file
        return sorted((DataFile(f"{name}/{r.f}", r.n, r.low, r.high) for r in found), key=lambda x: x.path)

    def _footer(self, path: str, column: str, plain: bool) -> DataFile:
        import pyarrow.parquet as pq

        m = pq.ParquetFile(self.folder._p(path)).metadata
        at = next(i for i in range(m.num_columns) if m.schema.column(i).path == column) if plain else -1
        found = [m.row_group(g).column(at).statistics for g in range(m.num_row_groups)] if plain else []
        bounded = bool(found) and all(s is not None and s.has_min_max for s in found)
        return DataFile(path, m.num_rows, min(s.min for s in found) if bounded else None, max(s.max for s in found) if bounded else None)

    def write_delta(self, changes: DataFrame, table: str) -> str:
        name = f"data/{table}/{uuid.uuid4().hex}"
        changes.write.parquet(self.folder.path(name))
        return name

    def delta_schema(self, state: TableState) -> T.StructType:
        plain = [T.StructField(f.name, f.dataType) for f in state.struct]
        return T.StructType([*plain, T.StructField("__deleted", T.BooleanType())])

    def image(self, state: TableState, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
        """A table's rows: its files, without the keys that a delta has, and each key's last change.

        Files whose bounds don't meet the range are not listed for the scan at all.
        """
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.struct])
        files = [self.folder.path(f.path) for f in state.files if f.meets(lower, upper)]
        base = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        if not state.deltas:
            return base
        changes = self.merged(state, state.deltas)
        live = changes.where("not __deleted").select(*schema.names)
        return live if not files else base.join(changes.select(*state.key), list(state.key), "left_anti").select(*schema.names).unionByName(live)

    def merged(self, state: TableState, deltas: Sequence[str]) -> DataFrame:
        """The last change of each key over deltas, oldest first."""
        schema = self.delta_schema(state)
        parts = [self.spark.read.schema(schema).parquet(self.folder.path(d)).withColumn("__seq", F.lit(i)) for i, d in enumerate(deltas)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(parts) > 1:
            rest = [c for c in schema.names if c not in state.key]
            out = out.groupBy(*state.key).agg(F.max_by(F.struct(*rest), "__seq").alias("__r")).select(*state.key, *[F.col("__r")[c].alias(c) for c in rest])
        return out.select(*schema.names)

    def compacted(self, state: TableState, table: str) -> TableState:
        out = state.copy()
        if state.deltas:
            out.files, out.deltas = self.write_data(self.image(state), table, state.key), []
        return out

    def changes(self, version: int, table: str | None = None) -> DataFrame:
        """The change log of a version: version, table_name, op, key and row as JSON."""
        m = self.manifest(version)
        out = self.spark.createDataFrame([(version, t, op, None, None) for op, ts in (("drop", m.deleted), ("install", m.installed)) for t in ts if table in (None, t)], "version long, table_name string, op string, key string, row string")
        for t, delta in m.writes.items():
            if table in (None, t):
                state = m.tables[t]
                rows = self.spark.read.schema(self.delta_schema(state)).parquet(self.folder.path(delta))
                op = F.when(F.col("__deleted"), F.lit("delete")).otherwise(F.lit("put"))
                row = F.when(~F.col("__deleted"), F.to_json(F.struct(*state.struct.names)))
                out = out.unionByName(rows.select(F.lit(version).cast("long").alias("version"), F.lit(t).alias("table_name"), op.alias("op"), F.to_json(F.struct(*state.key)).alias("key"), row.alias("row")))
        return out

    def read_log(self, after: int = 0) -> DataFrame:
        """The change log of all retained versions beyond `after`."""
        out = self.spark.createDataFrame([], "version long, table_name string, op string, key string, row string")
        for v in self.versions():
            if v > after:
                out = out.unionByName(self.changes(v))
        return out

    def changed_rows(self, version: int, table: str) -> DataFrame | None:
        """The rows that a version put into or deleted from a table (with __deleted), None if it wrote no rows of it."""
        m = self.manifest(version)
        return self.spark.read.schema(self.delta_schema(m.tables[table])).parquet(self.folder.path(m.writes[table])) if table in m.writes else None

    # upkeep

    def gc(self) -> int:
        """Drop all but the newest versions and those that are referred to, then data that none names; how many went."""
        with self.lock:
            every = self.versions()
            keep = {v for v in every[-max(1, self.config.retained) :]} | {v for v, n in self._refs.items() if n > 0}
            gone = [v for v in every if v not in keep]
            if not gone:
                self.counters["gc_runs"] += 1
                return 0
            dropped = [self.manifest(v) for v in gone]
            for v in gone:
                self.folder.delete(self._name(v))
                self.folder.delete(self._head(v))
                self._cached.pop(v, None)
            named = lambda ms: {p.split("/part-")[0] for m in ms for p in m.paths()}
            for path in named(dropped) - named(self.manifest(v) for v in every if v in keep):
                self.folder.delete(path)
            self.counters["gc_runs"] += 1
            self.counters["versions_collected"] += len(gone)
            return len(gone)

    def bulk_load(self, d: TableDef, rows: DataFrame, position: str | None = None, assume_sorted: bool = False) -> int:
        """Replace one table in a version of its own; see LoadBatch."""
        batch = self.load_batch()
        batch.replace(d, rows, position if assume_sorted else None)
        return batch.commit()

    def load_batch(self):
        from tidemark.sources.loads import LoadBatch

        return LoadBatch(self)

    def compact(self) -> int:
        """A version in which every table's deltas are part of its files."""
        with self.lock:
            base = self.manifest()
            tables = {n: self.compacted(t, n) for n, t in base.tables.items()}
            m = Manifest(base.version + 1, base.version, tables, tokens=dict(base.tokens))
            if not self.publish(m):
                raise WriteConflict("another commit came first", version=m.version)
            return m.version

    def metrics(self) -> DataFrame:
        """scope, name and value of each counter."""
        rows = [("store", k, int(v)) for k, v in sorted(self.counters.items())]
        rows += [(t, k, int(v)) for (t, k), v in sorted(self.table_counters.items())]
        return self.spark.createDataFrame(rows, "scope string, name string, value long")

    def timed(self, name: str, began: float) -> None:
        self.counters[f"{name}_us"] += int((time.perf_counter() - began) * 1e6)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if name not in m.tables:
            raise TableNotFound(name)
        return self.image(m.tables[name])

    def create_views(self, prefix: str = "", version: int | None = None) -> list[str]:
        """A temporary view of each table, for spark.sql."""
        m = self.manifest(version)
        for n, t in m.tables.items():
            self.image(t).createOrReplaceTempView(prefix + n)
        return sorted(prefix + n for n in m.tables)

    def define_custom_index(self, table: str, index: CustomIndex) -> None:
        from tidemark.errors import IndexAlreadyExists

        state = self.manifest().tables.get(table)
        if index.name in self.custom.get(table, {}) or (state and index.name in {i["name"] for i in state.indexes}):
            raise IndexAlreadyExists(index.name)
        self.custom.setdefault(table, {})[index.name] = index

    def with_config(self, **changes) -> Store:
        if not changes:
            raise InvalidParameters("nothing to change")
        return Store(self.spark, self.folder.root, replace(self.config, **changes))
