"""A collection of vectors as a table of a store: (id, embedding, meta, tombstoned)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidParameters, NodeNotFound
from tidemark.functions.distance import Metric, checked, metric
from tidemark.operators import reads, vector
from tidemark.sources.manifest import TableDef
from tidemark.sources.store import Store
from tidemark.sources.transactions import ReadTx, WriteTx

_NEW = "embedding array<float>, meta string"


class VectorCollection:
    """Search is exact, so results don't depend on a graph or its parameters; only the dimension matters."""

    def __init__(self, store: Store, name: str, dim: int, by: str | Metric = "cosine"):
        if dim <= 0:
            raise InvalidParameters("dim must be positive")
        metric(by)
        self.store, self.name, self.dim, self.by = store, name, dim, by
        self.table = TableDef(f"{name}_data", "id bigint, embedding array<float>, meta string, tombstoned boolean", ("id",), auto=True)
        if self.table.name not in store.manifest().tables:
            with store.begin_write() as tx:
                tx.open_table(self.table)

    # changes

    def upsert(self, embedding: Sequence[float], meta: str | None = None) -> int:
        """A new id, always."""
        with self.store.begin_write() as tx:
            return self.upsert_in(tx, embedding, meta)

    def upsert_in(self, tx: WriteTx, embedding: Sequence[float], meta: str | None = None) -> int:
        row = {"embedding": checked(embedding, self.dim).tolist(), "meta": meta, "tombstoned": False}
        return tx.open_table(self.table).insert(row)

    def bulk_insert(self, rows: DataFrame | Sequence[tuple[Sequence[float], str | None]]) -> list[int] | range:
        """ids of many vectors (embedding, meta), in one version."""
        if not isinstance(rows, DataFrame):
            listed = [{"embedding": checked(e, self.dim).tolist(), "meta": m, "tombstoned": False} for e, m in rows]
            with self.store.begin_write() as tx:
                return tx.open_table(self.table).insert_batch(listed)
        vector.check_rows(rows, self.dim)
        with self.store.begin_write() as tx:
            return tx.open_table(self.table).insert_batch(rows.select("embedding", "meta", F.lit(False).alias("tombstoned")))

    def delete(self, id: int) -> None:
        """Hide an id from searches; again is fine, an unknown one is not."""
        with self.store.begin_write() as tx:
            self.delete_in(tx, id)

    def delete_in(self, tx: WriteTx, id: int) -> None:
        w = tx.open_table(self.table)
        w.update({**self._row(w, id), "tombstoned": True})

    def update_embedding(self, id: int, embedding: Sequence[float]) -> None:
        """The id keeps its meta; a hidden one is found again."""
        with self.store.begin_write() as tx:
            self.update_embedding_in(tx, id, embedding)

    def update_embedding_in(self, tx: WriteTx, id: int, embedding: Sequence[float]) -> None:
        w = tx.open_table(self.table)
        w.update({**self._row(w, id), "embedding": checked(embedding, self.dim).tolist(), "tombstoned": False})

    def _row(self, w, id: int) -> dict:
        found = w.get(id).limit(1).collect()
        if not found:
            raise NodeNotFound(str(id))
        return found[0].asDict()

    def restore(self, rows: DataFrame) -> int:
        """The collection becomes these rows (id, embedding, meta, tombstoned), after checks of all."""
        vector.check_rows(rows, self.dim)
        return self.store.bulk_load(self.table, rows.select("id", "embedding", "meta", "tombstoned"))

    # searches

    def search(self, query: Sequence[float], k: int, ids: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """id and dist of the k nearest vectors, at the latest or a given version; with `ids` (a column of them) only of those."""
        with self.store.begin_read(version) as tx:
            return self.search_in(tx, query, k, ids)

    def search_in(self, tx: ReadTx, query: Sequence[float], k: int, ids: DataFrame | None = None) -> DataFrame:
        q = checked(query, self.dim)
        df = tx.open_table(self.table.name).df.where("not tombstoned")
        return vector.knn(df, q.tolist(), k, self.by, ids)

    def get(self, id: int) -> DataFrame:
        return reads.get(self.store.table(self.table.name), ("id",), id)


def ids_from(store: Store, values: Sequence[int]) -> DataFrame:
    """An id filter from a list; repeated ids don't matter."""
    return store.spark.createDataFrame([(int(v),) for v in values], "id long")


def ids_from_rows(rows: DataFrame, id: str = "id") -> DataFrame:
    """An id filter from rows, such as those of an index range."""
    return rows.select(F.col(id).alias("id"))
