"""The versions of a store as a stream, and streams into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.mutate import last_of_each
from tidemark.sources.manifest import TableDef
from tidemark.sources.store import VERSIONS, Store

_MANIFEST = "version long, base long, deleted array<string>, installed array<string>"


def version_stream(store: Store) -> DataFrame:
    """version, base, deleted and installed of each version as it is published."""
    return store.spark.readStream.schema(_MANIFEST).json(store.folder.path(VERSIONS))


def follow(store: Store, table: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call `apply` with the changed rows (and __deleted) of each version that wrote a table, in order of versions.

    Each micro-batch brings the numbers of new versions to the driver, the rows stay where they are.
    """

    def batch(df: DataFrame, _: int) -> None:
        for r in sorted(df.select("version").collect(), key=lambda r: r.version):
            rows = store.changed_rows(r.version, table)
            if rows is not None:
                apply(rows, r.version)

    writer = version_stream(store).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(rows: DataFrame, store: Store, table: TableDef, position: str, checkpoint: str, name: str = "stream", once: bool = True) -> StreamingQuery:
    """Put a stream's rows into a table, a version for each micro-batch; of a key's rows in it the one of the last position.

    The manifest keeps the last batch of each stream name, so a batch that is repeated after a failure changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        if store.manifest().tokens.get(name, -1) >= number:
            return
        with store.begin_write() as tx:
            latest = last_of_each(df.select(*table.struct.names, *([position] if position not in table.struct.names else [])), table.key, position) if position not in table.struct.names else _last(df, table, position)
            tx.open_table(table).put(latest)
            tx.tokens[name] = number

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _last(df: DataFrame, table: TableDef, position: str) -> DataFrame:
    return last_of_each(df.select(*table.struct.names).withColumn("__pos", df[position]), table.key, "__pos")
