"""Contiguous shards of equal size by global prefix sums (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SHARDS = 64


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, start and shard for each row of docs, in order of doc_id.

    Rows are put in order of doc_id, then size, over all partitions.  The totals of the partitions
    give each partition its first byte, a running sum within it gives each row its `start`, and
    the shard is start // target, where target is target_bytes or else the total over `shards`,
    rounded up.  So shards are contiguous, and a shard exceeds the target by less than its last row.

    A null text has 0 bytes; rows of 0 bytes go where the next row starts, or to the last shard after all others.  A null doc_id sorts last.
    Rows that repeat id and size are interchangeable.  Only ids and sizes are moved; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_bytes").asc()]
    ranged = common.cut(spark, sizes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("n")).collect()  # a row for each partition
    first, at = {}, 0
    for part, size in sorted((r.part, r.n) for r in totals):
        first[part] = at
        at += size
    target = target_bytes or max(1, -(-at // shards))
    last = max(at - 1, 0) // target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for b in batches:
            if not b.num_rows:
                continue
            if here is None:
                here = first[b.column(2)[0].as_py()]
            size = b.column(1).to_numpy(zero_copy_only=False)
            end = here + np.cumsum(size)
            start = end - size
            here = int(end[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start, pa.int64()), pa.array(np.minimum(start // target, last), pa.int64())], names=["doc_id", "n_bytes", "start", "shard"])

    return ranged.mapInArrow(run, "doc_id long, n_bytes long, start long, shard long")
