"""Document fingerprints as invertible Bloom lookup sketches (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

CELLS = 48
GROWTH = 4
LEAST_SHARED = 10
WEIGHT = 1 << 40
_HASHES = 3
_CHECK = np.uint64(0x3C6EF372FE94F82B)
_BATCH = 1 << 24


def with_digests(docs: DataFrame) -> DataFrame:
    """rk, doc_id and the 60-bit digests of the paragraphs of each row.

    Paragraphs are lines with more than white space.  The n-th of equal ones counts as "n:" and its text, so digests are distinct.
    A row's lines are sorted and numbered within the row.
    """
    slim = docs.select(common.row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).alias("l"))
    rows = slim.select("rk", "doc_id", F.inline(F.array(F.struct(F.coalesce("l", F.array().cast("array<string>")).alias("l")))))
    starts = F.filter(F.sequence(F.lit(0), F.size("l")), lambda i: (i < F.size("l")) & ((i == 0) | ~F.get("l", i).eqNullSafe(F.get("l", i - 1))))
    rows = rows.select("rk", "doc_id", "l", F.inline(F.array(F.struct(starts.alias("s")))))
    digest = lambda n, line: F.conv(F.substring(F.md5(F.concat(n.cast("string"), F.lit(":"), line)), 1, 15), 16, 10).cast("long")
    run = lambda at, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get("s", k + 1), F.size("l")) - at), lambda n: digest(n, F.get("l", at)))
    return rows.select("rk", "doc_id", F.flatten(F.transform("s", run)).alias("digests"))


class Sketch:
    """Cells of a count, the xor of the digests and the xor of their checks.

    A digest goes to one cell of each of three equal parts.  Sketches of one size subtract
    cell by cell; what both have cancels out.
    """

    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @staticmethod
    def check_of(d: np.ndarray) -> np.ndarray:
        return (kernels.mix(d ^ _CHECK) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def places(d: np.ndarray, cells: int) -> np.ndarray:
        part = cells // _HASHES
        salt = np.uint64(cells)
        return np.stack([(kernels.mix(d * np.uint64(2 * j + 3) + salt) % np.uint64(part)).astype(np.int64) + j * part for j in range(_HASHES)])

    @classmethod
    def of(cls, d: np.ndarray, cells: int) -> Sketch:
        count, key, check = np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint32)
        if len(d):
            at = cls.places(d, cells).ravel()
            np.add.at(count, at, 1)
            np.bitwise_xor.at(key, at, np.tile(d, _HASHES))
            np.bitwise_xor.at(check, at, np.tile(cls.check_of(d), _HASHES))
        return cls(count, key, check)

    def to_bytes(self) -> bytes:
        return self.count.tobytes() + self.key.tobytes() + self.check.tobytes()

    @classmethod
    def of_rows(cls, d: np.ndarray, row: np.ndarray, rows: int, cells: int) -> list[bytes]:
        """The sketches of many rows: digest d[i] is of row row[i]."""
        count, key, check = np.zeros(rows * cells, np.int32), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint32)
        at = (cls.places(d, cells) + row * cells).ravel()
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, np.tile(d, _HASHES))
        np.bitwise_xor.at(check, at, np.tile(cls.check_of(d), _HASHES))
        parts = zip(count.reshape(rows, cells), key.reshape(rows, cells), check.reshape(rows, cells))
        return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in parts]

    @classmethod
    def from_bytes(cls, raw: bytes) -> Sketch:
        n = len(raw) // 16
        return cls(np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint64, n, 4 * n), np.frombuffer(raw, np.uint32, n, 12 * n))

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests of this side alone and of the other alone; None if cells are left that no single digest explains."""
        count, key, check = self.count.copy(), self.key.copy(), self.check.copy()
        plus, minus = [], []
        while True:
            one = np.flatnonzero(np.abs(count) == 1)
            one = one[self.check_of(key[one]) == check[one]]
            if not len(one):
                break
            d, at = np.unique(key[one], return_index=True)
            sign = count[one][at]
            plus += d[sign > 0].tolist()
            minus += d[sign < 0].tolist()
            if len(plus) + len(minus) > 4 * len(count):
                return None
            where = self.places(d, len(count)).ravel()
            np.subtract.at(count, where, np.tile(sign, _HASHES))
            np.bitwise_xor.at(key, where, np.tile(d, _HASHES))
            np.bitwise_xor.at(check, where, np.tile(self.check_of(d), _HASHES))
        return None if count.any() or key.any() or check.any() else (sorted(plus), sorted(minus))


def with_sketches(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """rk and sketch of each row (rk, digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _BATCH // (16 * cells))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                n = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                d = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                raw = Sketch.of_rows(d, np.repeat(np.arange(len(n)), n), len(n), cells)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["rk", "sketch"])

    return rows.select("rk", "digests").mapInArrow(run, "rk long, sketch binary")


def _peeled(pairs: DataFrame, names: list[str]) -> DataFrame:
    """pairs with `added` and `removed` instead of `sketch` and `before`; both null where peeling failed or there is no `before`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added, removed = [], []
            for now, before in zip(b.column("sketch"), b.column("before")):
                found = None
                if before.is_valid:
                    found = (Sketch.from_bytes(now.as_py()) - Sketch.from_bytes(before.as_py())).peel()
                found = found or (None, None)
                added.append(found[0])
                removed.append(found[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(added, pa.list_(pa.int64())), pa.array(removed, pa.list_(pa.int64()))], names=[*names, "added", "removed"])

    schema = ", ".join(f"{c} long" for c in names) + ", added array<long>, removed array<long>"
    return pairs.select(*names, "sketch", "before").mapInArrow(run, schema)


_LAG = "rk long, n long, own long, shared long, rk0 long, doc0 long, part int, edge int, digest long, doc long"


def _lagged(held: DataFrame) -> DataFrame:
    """For each paragraph of the sorted rows of `held` (digest, absent, doc_id, rk, n): rk, own (its weight), and shared, rk0 and doc0 of the row that has it before.

    The first and last rows of a partition are marked by edge 1 and 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        names = [x.split()[0] for x in _LAG.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in _LAG.split(", ")]
        for b in batches:
            if not b.num_rows:
                continue
            digest, rk, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("digest", "rk", "n"))
            doc = b.column("doc_id")
            own = WEIGHT // n
            before = [pa.nulls(1, pa.int64()) if last is None else pa.array([last[k]], pa.int64()) for k in (0, 1)]
            rk0 = pa.concat_arrays([before[0], b.column("rk").slice(0, len(rk) - 1)])
            doc0 = pa.concat_arrays([before[1], doc.slice(0, len(rk) - 1)])
            same = np.append(last is not None and last[2] == digest[0], digest[1:] == digest[:-1])
            gone = pa.array(~same)
            edge = np.zeros(len(rk), np.int32)
            edge[0] = last is None
            none = pa.scalar(None, pa.int64())
            pick = lambda x: pa.compute.if_else(gone, none, x)
            columns = [b.column("rk"), np.ones(len(rk), np.int64), own, np.where(same, own, 0), pick(rk0), pick(doc0), np.full(len(rk), part, np.int32), edge, digest, doc]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            last = (int(rk[-1]), doc[len(rk) - 1].as_py(), int(digest[-1]))
        if last is not None:
            row = [last[0], 0, 0, 0, None, None, part, 2, last[2], last[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    return held.select("digest", "absent", "doc_id", "rk", "n").mapInArrow(run, _LAG)


def versions(rows: DataFrame, least_shared: int = LEAST_SHARED, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """rk, rk0 and version_of for each of the rows (rk, doc_id, digests; rk once each) that is a later version of another.

    A paragraph that k rows have weighs WEIGHT // k, and belongs to the row before in order of doc_id (null last, then rk) that has it.
    The row to which most of a row's weight belongs (of equals the last in that order) is its earlier version, if that is
    one `least_shared`-th of the whole at least.

    Paragraphs are sorted over all partitions, so those that very many rows have are spread over several; only the ends of partitions
    come to the driver.
    """
    spark = rows.sparkSession
    every = rows.select("rk", "doc_id", F.explode("digests").alias("digest"))
    common_ones = every.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    repeated = common.attach(every, common_ones.withColumn("size", F.col("n")), "digest", "size", hot_rows).withColumn("absent", F.col("doc_id").isNull())
    order = ["digest", "absent", "doc_id", "rk"]
    ranged = repeated.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    found = common.cut(spark, _lagged(ranged))
    ends = sorted(found.where("edge > 0").collect(), key=lambda r: (r.part, r.edge))  # two rows for each partition
    crossed = [(b.rk, 0, 0, b.own, a.rk, a.doc) for a, b in zip(ends, ends[1:]) if a.edge == 2 and b.edge == 1 and a.digest == b.digest]
    slim = found.select("rk", "n", "own", "shared", "rk0", "doc0")
    if crossed:
        slim = slim.unionByName(spark.createDataFrame(crossed, slim.schema))
    by_pair = slim.groupBy("rk", "rk0", "doc0").agg(*[F.sum(c).alias(c) for c in ("n", "own", "shared")])
    best = F.max(F.when(F.col("shared") > 0, F.struct("shared", F.col("doc0").isNull().alias("absent"), "doc0", "rk0"))).alias("best")
    by_row = by_pair.groupBy("rk").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), best).where("best is not null")
    sized = by_row.join(rows.select("rk", F.size("digests").alias("all")), "rk")
    whole = F.col("own") + (F.col("all") - F.col("n")) * F.lit(WEIGHT)
    return sized.where(F.col("best.shared") >= whole / least_shared).select("rk", F.col("best.rk0").alias("rk0"), F.col("best.doc0").alias("version_of"))


def version_changes(docs: DataFrame, cells: int = CELLS, broadcast_rows: int = 500_000, least_shared: int = LEAST_SHARED, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """doc_id, version_of, n_paragraphs, added and removed for each row of docs.

    version_of is the doc_id of the earlier row that shares most of the row's paragraphs, rare ones above all, as `versions` says.
    The difference of the two rows' sketches is peeled to the digests of
    paragraphs that only the later (added) or only the earlier (removed) has.  Pairs whose
    peeling fails get sketches of four times the cells, again and again until all are recovered.

    A row that shares too little with any earlier one has null version_of, added and removed, as has a row without paragraphs (null or empty
    text), which is nobody's version.  Null doc_ids come last in order, and a version_of may then be
    null with added and removed given.  Rows that repeat id and text count as one and have the same result.
    Digests are sorted.  Columns besides doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    held = common.cut(spark, with_digests(docs))
    rows = held.where("size(digests) > 0").dropDuplicates(["rk"])
    pairs = common.cut(spark, versions(rows, least_shared, hot_rows))
    left, out = pairs, None
    while out is None or not left.isEmpty():
        keys = left.select("rk").unionByName(left.select(F.col("rk0").alias("rk"))).distinct()
        sketched = with_sketches(rows.join(common.maybe_broadcast(keys, broadcast_rows), "rk", "left_semi"), cells)
        now = left.join(sketched, "rk").join(sketched.select(F.col("rk").alias("rk0"), F.col("sketch").alias("before")), "rk0")
        tried = common.cut(spark, _peeled(now, ["rk", "rk0", "version_of"]))
        done = tried.where("added is not null").select("rk", "version_of", "added", "removed")
        out = done if out is None else out.unionByName(done)
        left = tried.where("added is null").select("rk", "rk0", "version_of")
        cells *= GROWTH
    result = held.select("rk", "doc_id", F.size("digests").cast("long").alias("n_paragraphs")).join(out, "rk", "left")
    return result.select("doc_id", "version_of", "n_paragraphs", "added", "removed")
