"""Snapshots as folders of their own: export, install, checkpoint, recover."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import LogCorrupted, RowCountMismatch, SnapshotCorrupted, TypeMismatch, UnknownTable, VersionNotFound, WriteConflict
from tidemark.sources.folder import Folder
from tidemark.sources.manifest import Manifest, TableState
from tidemark.sources.store import HEADS, Store

CHECKPOINTS = "checkpoints"
_MAGIC = "tidemark-snapshot-1"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def content(df: DataFrame) -> str:
    """A sum over all rows, in any order, that a change of any value changes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h or 0}"


def export(store: Store, target: str, version: int | None = None) -> int:
    """Write a version's tables, each as files in order of its key, with a digest over all of them; the version.

    What an export that broke off has left there is written anew.
    """
    with store.pin_version(version) as pin:
        m, there = store.manifest(pin.version), Folder(store.spark, target)
        if there.exists("snapshot.json"):
            raise WriteConflict(f"{target} has a snapshot")
        there.delete("data")
        tables, sums = {}, {}
        for name, state in sorted(m.tables.items()):
            out = state.copy()
            path = f"data/{name}"
            df = store.image(state)
            df.repartitionByRange(*state.key).sortWithinPartitions(*state.key).write.parquet(there.path(path))
            moved = Store(store.spark, target)
            out.files, out.deltas = moved.described(path, df.schema, state.key), []
            tables[name], sums[name] = out, content(moved.image(out))
        sizes = {f.path: there.size(f.path) for t in tables.values() for f in t.files}
        body = Manifest(m.version, m.base, tables).to_json()
        if not there.publish("snapshot.json", json.dumps({"magic": _MAGIC, "body": body, "sizes": sizes, "sums": sums, "digest": _digest(body + json.dumps([sizes, sums], sort_keys=True))})):
            raise WriteConflict(f"{target} has a snapshot")
        return m.version


def open_snapshot(spark, source: str) -> tuple[Manifest, Folder]:
    """The manifest of an exported snapshot, after checks of its digest and of the sizes of its files."""
    m, folder, _ = _opened(spark, source)
    return m, folder


def _opened(spark, source: str) -> tuple[Manifest, Folder, dict[str, str]]:
    folder = Folder(spark, source)
    text = folder.read("snapshot.json")
    if text is None:
        raise SnapshotCorrupted("no snapshot.json")
    try:
        raw = json.loads(text)
        body, sizes, sums = raw["body"], raw["sizes"], raw["sums"]
        fine = raw["magic"] == _MAGIC and raw["digest"] == _digest(body + json.dumps([sizes, sums], sort_keys=True))
    except (ValueError, KeyError, TypeError):
        fine = False
    if not fine:
        raise SnapshotCorrupted("the digest differs")
    for path, n in sizes.items():
        if folder.size(path) != n:
            raise SnapshotCorrupted(f"{path} is cut or missing")
    return Manifest.from_json(body), folder, sums


def install(store: Store, source: str, unknown: str = "keep", extra: str = "keep", expect_version: int | None = None, only: set[str] | None = None, commit_version: int | None = None) -> int:
    """Make a snapshot's tables those of a new version, of the number `commit_version` if given; all of it or nothing.

    Each table's rows are checked against the sum that the snapshot has of them.

    unknown: what to do with a table that the store lacks: keep it, drop it or raise an error.  extra: whether the store's tables
    that the snapshot lacks are kept or dropped.
    """
    snap, there, sums = _opened(store.spark, source)
    if expect_version is not None and snap.version != expect_version:
        raise VersionNotFound(f"the snapshot is of version {snap.version}")
    base = store.manifest()
    tables: dict[str, TableState] = dict(base.tables) if extra == "keep" else {}
    installed = []
    for name, state in snap.tables.items():
        known = base.tables.get(name)
        if only is not None and name not in only:
            continue
        if known is None and unknown == "error":
            raise UnknownTable(name)
        if known is None and unknown == "drop":
            continue
        if known is not None and (known.schema != state.schema or known.key != state.key):
            raise TypeMismatch(name)
        remote = Store(store.spark, there.root)
        new = state.copy()
        try:
            new.files, new.deltas = store.write_data(remote.image(state), name, state.key), []
        except Exception as e:
            raise SnapshotCorrupted(f"{name} can't be read") from e
        if sum(f.rows for f in new.files) != sum(f.rows for f in state.files):
            raise RowCountMismatch(name)
        if content(store.image(new)) != sums[name]:
            raise SnapshotCorrupted(f"the rows of {name} differ")
        tables[name] = new
        installed.append(name)
    m = Manifest(commit_version or base.version + 1, base.version, tables, installed=installed, deleted=sorted(set(base.tables) - set(tables)), tokens=dict(base.tokens))
    if not store.publish(m):
        raise WriteConflict("another commit came first", version=m.version)
    return m.version


def checkpoint(store: Store) -> int:
    """A whole copy of the latest version within the store; older ones go."""
    version = store.latest_version()
    if version not in checkpoints(store):
        export(store, store.folder.path(f"{CHECKPOINTS}/{version:012d}"), version)
    for v in checkpoints(store):
        if v < version:
            store.folder.delete(f"{CHECKPOINTS}/{v:012d}")
    return version


def checkpoints(store: Store) -> list[int]:
    return [int(n) for n in store.folder.names(CHECKPOINTS) if store.folder.exists(f"{CHECKPOINTS}/{n}/snapshot.json")]


def open_checkpoint(store: Store, version: int | None = None) -> tuple[Manifest, Folder]:
    found = checkpoints(store)
    if not found or version is not None and version not in found:
        raise VersionNotFound(f"no checkpoint {version}")
    return open_snapshot(store.spark, store.folder.path(f"{CHECKPOINTS}/{found[-1] if version is None else version:012d}"))


def recover(store: Store, truncate: bool = False) -> int:
    """The version that a store has after a failure; publications that were claimed are finished.

    A version whose manifest can't be read, or names files that are not there, is an error.  With `truncate` such versions at the end
    are moved to `damaged` instead and the one before counts.  If no version is left, the newest checkpoint becomes one.
    """
    store.latest_version()
    for v in reversed(store.versions()):
        store._cached.pop(v, None)
        try:
            m = store.manifest(v)
            if all(store.folder.exists(p) for t in m.tables.values() for p in t.paths()):
                if v or not checkpoints(store):
                    _forget_claims(store, v)
                    return v
                break
        except (ValueError, KeyError, TypeError, VersionNotFound):
            pass
        if not truncate and (v or store.folder.exists(store._name(v))):
            raise LogCorrupted(f"version {v}")
        if store.folder.exists(store._name(v)):
            store.folder.move(store._name(v), f"damaged/{v:012d}.json")
        store._cached.pop(v, None)
    _forget_claims(store, 0)
    if not checkpoints(store):
        return 0
    return install(store, store.folder.path(f"{CHECKPOINTS}/{checkpoints(store)[-1]:012d}"))


def _forget_claims(store: Store, version: int) -> None:
    """Versions beyond this one that had been published are gone, so others may follow it."""
    for name in store.folder.names(HEADS):
        if not name.startswith(".") and int(name.split(".")[0]) >= version:
            store.folder.delete(f"{HEADS}/{name}")


def prune_log(store: Store, through: int) -> int:
    """Forget the change log of versions up to `through`, as far as no retained version's table needs it; how many versions went."""
    gone = [v for v in store.versions()[:-1] if v <= through]
    for v in gone:
        store.folder.delete(store._name(v))
        store._cached.pop(v, None)
    return len(gone)
