"""Benchmark decontamination by winnowed fingerprints (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

GRAM = 5
WINDOW = 4
BROADCAST_ROWS = 2_000_000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def winnow(h: np.ndarray, row: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept k-grams and their hashes: of each full window the last least hash.

    A window lies within one row.  Two rows that share gram + window - 1 words share a
    whole window, so both keep the same k-gram of it.
    """
    n = len(h) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * _STEP + h[j : j + n]
    grams = kernels.mix(grams)
    m = n - window + 1
    least, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, window):
        g = grams[j : j + m]
        lower = g <= least
        least[lower] = g[lower]
        at[lower] = j
    whole = np.flatnonzero(row[:m] == row[window + gram - 2 : window + gram - 2 + m])
    kept = np.unique(whole + at[whole])
    return kept, grams[kept]


def fingerprints(rows: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """rk, pos (in words from the row's start) and fp of the winnowed fingerprints of rows (rk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in kernels.slices(b.column(1)):
                h, row = kernels.words(part)
                at, fp = winnow(h, row, gram, window)
                owner = row[at]
                pos = at - np.searchsorted(row, owner)
                key = b.column(0).slice(part.first, part.rows).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([key, pa.array(pos, pa.int32()), pa.array(fp.view(np.int64))], names=["rk", "pos", "fp"])

    return rows.select("rk", "text").mapInArrow(run, "rk long, pos int, fp long")


def _row_words(column: pa.Array) -> list[np.ndarray]:
    out = []
    for part in kernels.slices(column):
        h, row = kernels.words(part)
        out += np.split(h, np.searchsorted(row, np.arange(1, part.rows)))
    return out


def shared_spans(doc: np.ndarray, item: np.ndarray, shifts: list[int], least: int) -> list[int]:
    """Lengths of the maximal runs of equal words, of `least` at least, at the given shifts."""
    found = []
    for shift in shifts:
        a, b = max(0, shift), min(len(doc), len(item) + shift)
        if b - a < least:
            continue
        same = np.concatenate([[False], doc[a:b] == item[a - shift : b - shift], [False]])
        change = np.flatnonzero(same[1:] != same[:-1])
        length = change[1::2] - change[::2]
        found += length[length >= least].tolist()
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_spans and longest (in words), for each row of docs and benchmark item that share text.

    Shared is a run of gram + window - 1 words or more, compared in lower case and without other
    signs.  Every such run is found and extended to its full length; shorter ones never count.
    n_spans counts the runs that can't be extended, at any pair of places.

    Null, empty and short texts, and items shorter than such a run, have no result.  Null ids are
    kept.  Repeated rows of either table give repeated results.  Other columns are not looked at.
    """
    return _spans(docs, benchmark, gram, window, broadcast_rows).drop("rk")


def _spans(docs: DataFrame, benchmark: DataFrame, gram: int, window: int, broadcast_rows: int) -> DataFrame:
    spark = docs.sparkSession
    least = gram + window - 1
    rows = docs.select(common.row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
    items = benchmark.select(common.row_key("item_id", "text").alias("irk"), F.col("item_id").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null")
    one = items.dropDuplicates(["irk"])
    marks = fingerprints(one.select(F.col("irk").alias("rk"), F.col("item_text").alias("text")), gram, window)
    marks = common.maybe_broadcast(marks.select(F.col("rk").alias("irk"), F.col("pos").alias("ipos"), "fp"), broadcast_rows)
    hits = fingerprints(rows, gram, window).join(marks, "fp").groupBy("rk", "irk").agg(F.collect_set(F.col("pos") - F.col("ipos")).alias("shifts"))
    hits = common.cut(spark, hits)
    pairs = hits.join(common.maybe_broadcast(items, broadcast_rows, 64 + F.octet_length("item_text")), "irk")
    pairs = rows.join(common.maybe_broadcast(pairs, broadcast_rows, 64 + F.octet_length("item_text") + 8 * F.size("shifts")), "rk")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, count, longest = [], [], []
            every = zip(_row_words(b.column("text")), _row_words(b.column("item_text")), b.column("shifts").to_pylist())
            for i, (doc, item, shifts) in enumerate(every):
                found = shared_spans(doc, item, shifts, least)
                if found:
                    keep.append(i)
                    count.append(len(found))
                    longest.append(max(found))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rk").take(at), b.column("doc_id").take(at), b.column("item_id").take(at), pa.array(count, pa.int64()), pa.array(longest, pa.int64())], names=["rk", "doc_id", "item_id", "n_spans", "longest"])

    pairs = pairs.select("rk", "doc_id", "text", "item_id", "item_text", "shifts")
    kind = dict(items.dtypes)["item_id"]
    return pairs.mapInArrow(extend, f"rk long, doc_id long, item_id {kind}, n_spans long, longest long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that share no run of gram + window - 1 words with an item, with the columns of docs.

    Rows with null or empty text stay, as do repeated rows without such a run.
    """
    rk = common.fresh(docs, "__tm_rk")
    bad = common.cut(docs.sparkSession, _spans(docs, benchmark, gram, window, broadcast_rows).select(F.col("rk").alias(rk)).distinct())
    return docs.withColumn(rk, common.row_key()).join(common.maybe_broadcast(bad, broadcast_rows), rk, "left_anti").drop(rk)
