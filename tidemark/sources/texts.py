"""A text index that follows a table of a store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from tidemark.errors import TableNotFound
from tidemark.operators.fulltext import Bm25, TextIndex
from tidemark.sources.store import Store


class TableTextIndex:
    """Postings of a table at a version, brought up to later ones by the rows that these changed."""

    def __init__(self, store: Store, table: str, text: Column, segments: int = 8):
        self.store, self.table, self.text, self.segments = store, table, text, segments
        self.version, self.index, self._pieces = -1, None, 0

    def _build(self, version: int) -> None:
        state = self.store.manifest(version).tables.get(self.table)
        if state is None:
            raise TableNotFound(self.table)
        path = self.store.folder.path(f"texts/{self.table}/{uuid.uuid4().hex}")
        self.index = TextIndex.build(self.store.image(state), tuple(state.key), self.text, path)
        self.version, self._pieces = version, 1

    def refresh(self, version: int | None = None) -> int:
        """Take in the changes up to a version, the latest one if none is given; the version.

        A version that replaced the table, or that gc has taken, makes a new build; after `segments` changes postings are merged.
        """
        to = self.store.latest_version() if version is None else version
        between = [v for v in self.store.versions() if self.version <= v <= to]
        manifests = [self.store.manifest(v) for v in between[1:]]
        unbroken = self.index is not None and between[:1] == [self.version]
        if not unbroken or any(self.table in (*m.installed, *m.deleted) for m in manifests):
            self._build(to)
            return to
        for m in manifests:
            if (rows := self.store.changed_rows(m.version, self.table)) is not None:
                self.index = self.index.updated(rows.where("not __deleted"), rows)
                self._pieces += 1
        if self._pieces > self.segments:
            self.index, self._pieces = self.index.merged(), 1
        self.version = to
        return to

    def search(self, query: str, limit: int | None = None, bm25: Bm25 = Bm25()) -> DataFrame:
        """The key and score of the rows of the version that was last taken in."""
        if self.index is None:
            self.refresh()
        return self.index.search(query, limit, bm25)
