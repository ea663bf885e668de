"""Bulk loads: whole tables or large deltas, several tables in one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidemark.errors import InvalidBulkLoad, RowCountMismatch, TableNotFound, WriteConflict, WriterBusy
from tidemark.operators import index as ix
from tidemark.operators import mutate
from tidemark.sources.manifest import Manifest, TableDef, TableState
from tidemark.sources.transactions import check_def


class LoadBatch:
    """Stages loads against the version at which it was opened, and publishes them together.

    Of several loads of a table the last counts.  Indexes keep their definitions and are checked.
    """

    def __init__(self, store):
        self.store, self.base = store, store.manifest()
        self.staged: dict[str, tuple[TableState, str | None]] = {}

    def _state(self, d: TableDef, create: bool = True) -> TableState:
        known = self.base.tables.get(d.name)
        if known is None and not create:
            raise TableNotFound(d.name)
        if known:
            check_def(d, known)
        return known.copy() if known else TableState.of(d)

    def _stage(self, d: TableDef, state: TableState, rows: DataFrame, next_id: int | None) -> None:
        for i in state.index_list():
            ix.check_unique(rows, i)
        for custom in self.store.custom.get(d.name, {}).values():
            if custom.validate:
                custom.validate(rows)
        state.files, state.deltas = self.store.write_data(rows.select(*state.struct.names), d.name, state.key), []
        if state.auto:
            top = max((f.high for f in state.files if f.high is not None), default=0)
            if top >= mutate.MOST:
                mutate.next_after(rows, state.key[0])
            state.next_id = next_id or max(1, top + 1)
        self.staged[d.name] = (state, None)

    def replace(self, d: TableDef, rows: DataFrame, position: str | None = None, row_count: int | None = None, create: bool = True) -> LoadBatch:
        """The table becomes these rows.  With `position`, keys must ascend by it; without, any order will do.

        `row_count` is how many rows there must be.  Without `create`, the table must exist.
        """
        state = self._state(d, create)
        good = mutate.replace_sorted(rows, d.key, position) if position else mutate.replace_unsorted(rows, d.key)
        self._stage(d, state, good, None)
        loaded = sum(f.rows for f in state.files)
        if row_count is not None and loaded != row_count:
            del self.staged[d.name]
            raise RowCountMismatch(f"{d.name}: {loaded} rows instead of {row_count}")
        return self

    def replace_numbered(self, d: TableDef, rows: DataFrame, order: list[Column] | None = None) -> LoadBatch:
        """The table becomes these rows with ids from 1 on."""
        if not d.auto:
            raise InvalidBulkLoad(f"{d.name} doesn't number its rows")
        numbered, after = mutate.numbered(rows, d.key[0], 1, order)
        self._stage(d, self._state(d), numbered, after)
        return self

    def delta(self, d: TableDef, inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> LoadBatch:
        """Change a table that exists; see mutate.delta."""
        state = self._state(d, False)
        image = mutate.delta(self.store.image(state), tuple(state.key), inserts, updates, deletes)
        before = state.next_id
        self._stage(d, state, image, None)
        if state.auto:
            state.next_id = max(before or 1, state.next_id or 1)
        return self

    def commit(self) -> int:
        """One version with all loads; the base's if there are none."""
        if not self.staged:
            return self.base.version
        with self.store.lock:
            if self.store._writer() is not None and not self.store.config.multi_writer:
                raise WriterBusy("a writer is live")
            tables = {**self.base.tables, **{n: s for n, (s, _) in self.staged.items()}}
            m = Manifest(self.base.version + 1, self.base.version, tables, installed=sorted(self.staged), tokens=dict(self.base.tokens))
            if self.store.latest_version() != self.base.version or not self.store.publish(m):  # the base's only successor
                raise WriteConflict("another commit came first", version=m.version)
            self.store.counters["bulk_loads"] += 1
        if self.store.config.auto_gc:
            self.store.gc()
        return m.version
