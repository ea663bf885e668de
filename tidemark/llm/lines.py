"""Line dedup by a sharded minimal perfect hash (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

SHARD_LINES = 200_000
SLICE_PROBES = 1_000_000


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bits.

    At each level a key whose place no other key takes keeps it; the rest go on to the next.
    A key's number is the rank of its bit over all levels.  Unknown keys get -1 or any number.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # places of each level; the levels' bits, packed
        self.first = np.cumsum(sizes) - sizes
        whole = np.unpackbits(bits, count=int(sizes.sum()), bitorder="little") if len(bits) else np.zeros(0, np.uint8)
        self.set = whole.astype(bool)
        self.rank = np.cumsum(whole, dtype=np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
            size = max(64, int(len(keys) * load))
            place = cls._place(keys, len(sizes), size)
            times = np.bincount(place, minlength=size)
            levels.append(times == 1)
            sizes.append(size)
            keys = keys[times[place] != 1]
        bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (kernels.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (first, size) in enumerate(zip(self.first.tolist(), self.sizes.tolist())):
            if not len(left):
                break
            at = first + self._place(keys[left], level, size)
            hit = self.set[at]
            out[left[hit]] = self.rank[at[hit]] - 1
            left = left[~hit]
        return out


class LineIndex:
    """For each distinct line hash: 16 bits to know it by, its count up to 255 and, where repeated, its owner."""

    def __init__(self, perfect: PerfectHash, marks: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.perfect, self.marks, self.counts, self.owners = perfect, marks, counts, owners
        self.owner_at = np.cumsum(counts > 1) - 1

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (kernels.mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> LineIndex:
        perfect = PerfectHash.build(keys)
        at = perfect(keys)
        marks, number, owner = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
        marks[at], number[at], owner[at] = cls.mark(keys), np.minimum(counts, 255), owners
        return cls(perfect, marks, number, owner[number > 1])

    def arrays(self) -> list[bytes]:
        return [x.tobytes() for x in (self.perfect.sizes, self.perfect.bits, self.marks, self.counts, self.owners)]

    @classmethod
    def load(cls, arrays: list[bytes]) -> LineIndex:
        kinds = (np.int64, np.uint8, np.uint16, np.uint8, np.int64)
        sizes, bits, marks, counts, owners = (np.frombuffer(a, k) for a, k in zip(arrays, kinds))
        return cls(PerfectHash(sizes, bits), marks, counts, owners)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, 0 for an unknown one, and the owner of each repeated one."""
        at = self.perfect(keys)
        known = at >= 0
        known[known] = self.marks[at[known]] == self.mark(keys[known])
        counts = np.zeros(len(keys), np.uint8)
        counts[known] = self.counts[at[known]]
        owners = np.zeros(len(keys), np.int64)
        many = counts > 1
        owners[many] = self.owners[self.owner_at[at[many]]]
        return counts, owners


INDEX = "shard int, sizes binary, bits binary, marks binary, counts binary, owners binary"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(common.row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n").alias("lines"))


def line_rows(docs: DataFrame, shards: int) -> DataFrame:
    """rk, doc_id, pos, h (the line's hash) and shard of each line that has more than white space.

    The shard is by another hash than h, so lines are told apart by 64 bits and those of the shard's number.
    """
    lines = _keyed(docs).select("rk", "doc_id", F.posexplode("lines").alias("pos", "line")).where("line rlike '\\\\S'")
    h = F.xxhash64("line")
    return lines.select("rk", "doc_id", "pos", h.alias("h"), F.pmod(F.xxhash64(F.lit(1), "line"), F.lit(shards)).cast("int").alias("shard"))


def line_index(lines: DataFrame) -> DataFrame:
    """The shards of the index over all distinct line hashes of line_rows."""
    late = [F.col("late")] if "late" in lines.columns else []
    first = F.min_by("rk", F.struct(*late, F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk")))
    distinct = lines.groupBy("h", "shard").agg(F.count("*").alias("n"), first.alias("owner"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h, n, owner = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "n", "owner"))
        found = LineIndex.build(h.view(np.uint64), n, owner).arrays()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in found)], names=["shard", "sizes", "bits", "marks", "counts", "owners"])

    return distinct.groupBy("shard").applyInArrow(build, INDEX)


def repeated_lines(docs: DataFrame, shard_lines: int = SHARD_LINES, slice_probes: int = SLICE_PROBES, late: DataFrame | None = None) -> DataFrame:
    """rk and pos of each line that another place has first, and whether another row has it (other).

    With `late`, the rks of rows that come after all others, also the first place's rk (owner) and whether the row itself has
    the line before (later).

    Line hashes, 8 bytes for a line, travel to the shard of the index that has them and
    probe its arrays; the lines themselves stay where they are.  A shard's probes are cut into
    slices by document, so that a line that all documents have doesn't fill one task.
    """
    total = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    shards = max(1, -(-total // shard_lines))
    slices = max(1, -(-total // (shards * slice_probes)))
    lines = line_rows(docs, shards)
    ordered = lines if late is None else lines.join(late.select("rk", F.lit(True).alias("l")), "rk", "left").withColumn("late", F.coalesce("l", F.lit(False)))
    index = common.cut(docs.sparkSession, line_index(ordered)) if slices > 1 else line_index(ordered)
    index = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    probes = lines.select("rk", "pos", "h", "shard", F.pmod("rk", F.lit(slices)).cast("int").alias("slice"))

    kinds = {"rk": pa.int64(), "pos": pa.int32(), "other": pa.bool_()}
    schema = "rk long, pos int, other boolean"
    if late is not None:
        kinds |= {"owner": pa.int64(), "later": pa.bool_()}
        schema += ", owner long, later boolean"

    def probe(probes: pa.Table, index: pa.Table) -> pa.Table:
        rk, pos, h = (probes.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("rk", "pos", "h"))
        if not len(rk):
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        found = LineIndex.load([index.column(c)[0].as_py() for c in ("sizes", "bits", "marks", "counts", "owners")])
        counts, owners = found.probe(h.view(np.uint64))
        many = np.flatnonzero(counts > 1)
        many = many[np.lexsort((pos[many], rk[many], h[many]))]
        later = _later(h[many], rk[many], pos[many])
        gone = (owners[many] != rk[many]) | later  # the owner too has a line once
        drop = many[gone]
        found = {"rk": rk[drop], "pos": pos[drop], "other": owners[drop] != rk[drop], "owner": owners[drop], "later": later[gone]}
        return pa.table({c: pa.array(found[c], t) for c, t in kinds.items()})

    return probes.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInArrow(probe, schema)


def _later(h: np.ndarray, rk: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a row of sorted (h, rk, pos) is beyond the first pos of its (h, rk); repeated rows share a pos."""
    if not len(pos):
        return np.zeros(0, bool)
    new = np.ones(len(pos), bool)
    new[1:] = (h[1:] != h[:-1]) | (rk[1:] != rk[:-1])
    first = pos[np.flatnonzero(new)][np.cumsum(new) - 1]
    return pos > first


def dedup_lines(docs: DataFrame, shard_lines: int = SHARD_LINES, slice_probes: int = SLICE_PROBES, broadcast_rows: int = 200_000, copies: DataFrame | None = None) -> DataFrame:
    """docs with each line kept at its first place in the corpus only, with the columns of docs.

    Lines are what newlines part; the same are those whose hashes and shards are, which for other bytes at 10^12 lines in 5 * 10^6
    shards is to be expected for one pair in two hundred corpora.  The first place is in the
    row of the lowest doc_id (null last; then of the lowest row key), at the first such line.  Lines of white
    space are never removed.  A row that loses a line has its text joined again without it, and
    n_chars, if docs has it (in any case), set to the new length.  Rows are never removed: one that loses
    all its lines has an empty text.

    With `copies`, the rk, group and keep of rows that are near copies of each other, a row keeps the lines that rows of its own group
    have first: which of the copies stays is for document dedup to decide.  Rows whose keep is false come after all others in
    the order of first places, as they will go.

    A null text stays null.  Rows that repeat id and text count as one row and stay alike.
    """
    spark = docs.sparkSession
    rk, places, fresh = (common.fresh(docs, f"__tm_{c}") for c in ("rk", "gone", "new"))
    if copies is None:
        gone = repeated_lines(docs, shard_lines, slice_probes)
    else:
        late = common.maybe_broadcast(copies.where("not keep").select("rk"), broadcast_rows)
        group = common.maybe_broadcast(copies.select("rk", "group"), broadcast_rows)
        theirs = common.maybe_broadcast(copies.select(F.col("rk").alias("owner"), F.col("group").alias("theirs")), broadcast_rows)
        gone = repeated_lines(docs, shard_lines, slice_probes, late).join(group, "rk", "left").join(theirs, "owner", "left")
        kin = F.col("other") & ~F.col("later") & (F.col("group") == F.col("theirs"))
        gone = gone.where(~F.coalesce(kin, F.lit(False)))
    gone = common.cut(spark, gone.groupBy(F.col("rk").alias(rk)).agg(F.collect_set("pos").alias(places)))
    weight = 48 + 8 * F.size(places)
    keyed = docs.withColumn(rk, common.row_key()).join(common.maybe_broadcast(gone, broadcast_rows, weight), rk, "left")
    lines = F.split("text", "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places))
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = keyed.withColumn(fresh, F.when(F.col(places).isNotNull(), cut))
    new = {common.named(docs, "text"): F.coalesce(fresh, "text")}
    if chars := common.named(docs, "n_chars"):
        kind = docs.schema[chars].dataType
        new[chars] = F.when(F.col(fresh).isNotNull(), F.length(fresh).cast(kind)).otherwise(F.col(chars))
    return out.select(*(new[c].alias(c) if c in new else common.quoted(c) for c in docs.columns))
