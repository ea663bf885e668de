"""SimHash near duplicates with pigeonring filtering (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

BITS = 128
DISTANCE = 19
SEGMENTS = 10
GROUP_ROWS = 50_000
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8).view(np.uint64).ravel()


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit SimHashes (n x 16 bytes) of the texts, and which of them have a word.

    Features are a text's distinct words, each once more at every doubling of its count,
    so that a change of a few words moves few features, and a word's repetition counts little.
    """
    out, any_word = [], []
    for part in kernels.slices(text):
        h, row = kernels.words(part)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        base, owner = h[at], row[at]
        features, owners, level = [], [], 0
        while len(base):
            features.append(kernels.mix(base + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            owners.append(owner)
            level += 1
            more = times >= 1 << level
            base, owner, times = base[more], owner[more], times[more]
        bits = np.zeros((part.rows, BITS), bool)
        if features:
            f, owner = np.concatenate(features), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            f, owner = f[order], owner[order]
            raw = np.stack([f, kernels.mix(f ^ np.uint64(0xA5A5A5A5DEADBEEF))], axis=1).view(np.uint8)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(f)))
            rank = np.arange(len(f)) - np.repeat(first, size)
            chunk = np.flatnonzero(rank % 255 == 0)  # eight counters a word, each of 8 bits
            ones = np.add.reduceat(_LANES[raw], chunk, axis=0).view(np.uint8).reshape(len(chunk), BITS).astype(np.int32)
            whole = np.add.reduceat(ones, np.searchsorted(chunk, first), axis=0)
            bits[owner[first]] = 2 * whole > size[:, None]
        has = np.zeros(part.rows, bool)
        has[row] = True
        out.append(np.packbits(bits, axis=1))
        any_word.append(has)
    return (np.concatenate(out), np.concatenate(any_word)) if out else (np.zeros((0, 16), np.uint8), np.zeros(0, bool))


def with_signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rk (the row's key), doc_id and sig, which is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, has = signatures(b.column(2))
            flat = pa.array([x.tobytes() if ok else None for x, ok in zip(sig, has.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["rk", "doc_id", "sig"])

    slim = docs.select(common.row_key(doc_id, text).alias("rk"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "rk long, doc_id long, sig binary")


class Ring:
    """The pigeonring condition for BITS bits in `segments` segments with a distance of `distance`.

    If two signatures differ in at most `distance` bits, some segment starts a ring of
    consecutive segments such that for every n the first n differ in at most
    n * distance / segments bits.  All starts are searched, so no such pair is missed.
    """

    def __init__(self, distance: int = DISTANCE, segments: int = SEGMENTS):
        if not 0 <= distance < 2 * segments or not 4 <= segments <= 64:
            raise ValueError("a segment may differ in one bit at most: distance < 2 * segments")
        edge = [BITS * i // segments for i in range(segments + 1)]
        self.segments, self.distance = segments, distance
        self.start, self.width = edge[:-1], [b - a for a, b in zip(edge, edge[1:])]
        self.budget = [n * distance // segments for n in range(segments + 1)]

    def mask(self, i: int, n: int) -> tuple[np.uint64, np.uint64]:
        """The two words with the bits of n segments from segment i on, around the ring."""
        bits = 0
        for j in range(i, i + n):
            j %= self.segments
            bits |= ((1 << self.width[j]) - 1) << self.start[j]
        return np.uint64(bits & (1 << 64) - 1), np.uint64(bits >> 64)

    def value(self, lo: np.ndarray, hi: np.ndarray, i: int) -> np.ndarray:
        """Segment i of the signatures, as a number."""
        s, w = self.start[i], self.width[i]
        keep = np.uint64((1 << w) - 1)
        if s >= 64:
            return ((hi >> np.uint64(s - 64)) & keep).astype(np.int64)
        x = lo >> np.uint64(s)
        if s + w > 64:
            x = x | (hi << np.uint64(64 - s))
        return (x & keep).astype(np.int64)

    def pairs(self, lo: np.ndarray, hi: np.ndarray, i: int, shard: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the distance whose ring starts at segment i, by position.

        The rows of this shard are those whose segment has `shard` as its `high` upper bits;
        other rows are here as their segment would be in the shard with one upper bit cleared.
        """
        value = self.value(lo, hi, i)
        low = self.width[i] - high
        own = (value >> low) == shard
        index = np.flatnonzero(own)
        index = index[np.argsort(value[index], kind="stable")]
        first = np.searchsorted(value[index], (shard << low) + np.arange((1 << low) + 1))
        j = (i + 1) % self.segments
        two = (value << self.width[j] | self.value(lo, hi, j)).astype(np.uint32)
        bucket = lambda v: index[first[v] : first[v + 1]]
        full = np.flatnonzero(np.diff(first))
        for v in full.tolist():
            a = bucket(v)
            cleared = [bucket(v & ~(1 << b)) for b in range(low) if v >> b & 1] if self.budget[1] else []
            yield from self._between(lo, hi, two, i, a, a, True)
            if b := [x for x in cleared if len(x)]:
                yield from self._between(lo, hi, two, i, a, np.concatenate(b), False)
        guests = np.flatnonzero(~own)
        wanted = value[guests] & (1 << low) - 1
        order = np.argsort(wanted, kind="stable")
        guests, wanted = guests[order], wanted[order]
        for s, e in _groups(wanted):
            b = bucket(int(wanted[s]))
            if len(b):
                yield from self._between(lo, hi, two, i, guests[s:e], b, False)

    def _between(self, lo, hi, two, i, a, b, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, 2_000_000 // len(b))
        for s in range(0, len(a), step):
            close = np.bitwise_count(two[a[s : s + step]][:, None] ^ two[b][None, :]) <= self.budget[2]
            x, y = np.nonzero(close)
            if same:
                x, y = x[x + s < y], y[x + s < y]
            x, y = a[s + x], b[y]
            dl, dh = lo[x] ^ lo[y], hi[x] ^ hi[y]
            for n in range(3, self.segments + 1):
                ml, mh = self.mask(i, n)
                ok = np.flatnonzero(np.bitwise_count(dl & ml).astype(np.int16) + np.bitwise_count(dh & mh) <= self.budget[n])
                x, y, dl, dh = x[ok], y[ok], dl[ok], dh[ok]
                if not len(x):
                    break
            if len(x):
                yield x, y


def _groups(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, int)
    return list(zip(at.tolist(), np.append(at[1:], len(sorted_values)).tolist()))


def _halves(sig: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(sig.to_pylist()), "<u8").reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].copy()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component, for edges a-b over n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def edges(signature_rows: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges a, b over distinct signatures (column sig) that connect whatever pairs within the distance connect.

    Each group of rows that share a segment's upper bits gives a spanning forest of the
    pairs that it finds, so the result grows with the signatures, not with the pairs.
    """
    ring = Ring(distance, segments)
    count = signature_rows.count()
    high = min(min(ring.width) - 1, max(0, int(np.ceil(np.log2(max(1, count) / group_rows)))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = _halves(batch.column(0))
            for i in range(ring.segments):
                upper = ring.value(lo, hi, i) >> (ring.width[i] - high)
                rows, at = [np.arange(len(lo))], [upper]
                for bit in range(high if ring.budget[1] else 0):
                    flip = np.flatnonzero(upper >> bit & 1)
                    rows.append(flip)
                    at.append(upper[flip] & ~(1 << bit))
                part = np.concatenate(at) + (i << high)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0).take(pa.array(np.concatenate(rows)))], names=["part", "sig"])

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        lo, hi = _halves(rows.column("sig"))
        order = np.lexsort((hi.byteswap(), lo.byteswap()))  # as the bytes sort
        lo, hi = lo[order], hi[order]
        a, b, held, found = [], [], 0, np.arange(len(lo))
        for x, y in ring.pairs(lo, hi, part >> high, part & (1 << high) - 1, high):
            apart = found[x] != found[y]
            a.append(x[apart])
            b.append(y[apart])
            held += len(a[-1])
            if held > 1_000_000:
                found = _join(found, a, b)
                a, b, held = [], [], 0
        found = _join(found, a, b)
        child = np.flatnonzero(found != np.arange(len(lo)))
        raw = np.stack([lo, hi], axis=1)
        give = lambda at: pa.array([x.tobytes() for x in raw[at]], pa.binary())
        return pa.table({"a": give(child), "b": give(found[child])})

    routed = signature_rows.select("sig").mapInArrow(route, "part int, sig binary")
    return routed.groupBy("part").applyInArrow(search, "a binary, b binary")


def _join(label: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    if not a:
        return label
    return forest(np.concatenate([*a, np.arange(len(label))]), np.concatenate([*b, label]), len(label))


def components(links: DataFrame, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """node, root: the smallest member of each node's component, for links a, b.

    Alternates large and small stars until nothing changes, cutting the lineage at each round.  A node's least neighbour is
    an aggregate, which each task prepares for its own links, and goes back to the links by common.attach: no node's
    links meet in one task, however many it has.
    Links of a node to itself and repeated ones don't matter.  Nodes that are roots themselves are left out.
    """
    spark = links.sparkSession
    now = common.cut(spark, _oriented(links.select("a", "b").where("a <> b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, total = mark, 2 * mark[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        of = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = common.attach(both, of, "a", "n", hot_rows, total).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.cut(spark, large) if total > hot_rows else large
        small = common.attach(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", "n", hot_rows, total)
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = common.cut(spark, small)


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _grouped(slim: DataFrame, distance: int, segments: int, group_rows: int, hot_rows: int) -> DataFrame:
    """slim (rk, doc_id, sig, uid) with `first`, the doc_id, rk and uid of the group's first row, and `size`, for rows that have a sig.

    Groups are found over distinct signatures; each signature has its first row and number of rows by an aggregate, so has each group.
    """
    spark = slim.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rk", "uid"))
    by_sig = common.cut(spark, slim.where("sig is not null").groupBy("sig").agg(first.alias("f"), F.count("*").alias("n")))
    found = components(edges(by_sig.select("sig"), distance, segments, group_rows), hot_rows)
    by_sig = common.cut(spark, by_sig.join(found, F.col("sig") == F.col("node"), "left").select("sig", "f", "n", F.coalesce("root", "sig").alias("root")))
    groups = by_sig.groupBy("root").agg(F.min("f").alias("first"), F.sum("n").alias("size"), F.count("*").alias("sigs"))
    of_sig = common.attach(by_sig.select("sig", "n", "root"), groups, "root", "sigs", hot_rows).drop("root")
    return common.attach(slim.where("sig is not null"), common.cut(spark, of_sig), "sig", "n", hot_rows)


def assignments(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """rk, doc_id, group_id, group_size and keep for each row of docs."""
    slim = common.cut(docs.sparkSession, with_signatures(docs).withColumn("uid", F.monotonically_increasing_id()))
    grouped = _grouped(slim, distance, segments, group_rows, hot_rows)
    grouped = grouped.select("rk", "doc_id", F.col("first.doc_id").alias("group_id"), F.col("size").alias("group_size"), (F.col("first.uid") == F.col("uid")).alias("keep"))
    alone = slim.where("sig is null").select("rk", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return grouped.unionByName(alone)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """doc_id, group_id, group_size and keep for each row of docs.

    Rows whose SimHashes differ in at most `distance` of 128 bits are linked, and linked rows form a
    group, called by its lowest doc_id, whose row is the one to keep.  Candidates are found by the
    pigeonring filter, which loses no pair; equal SimHashes are searched once.

    A null text, an empty one and one without words is a group of its own.  A null doc_id sorts last: its
    row is kept only if its group has no other, and group_id is null if all are.  Of rows that
    repeat id and text, one is kept.  Columns besides doc_id and text are not looked at.
    """
    return assignments(docs, distance, segments, group_rows, hot_rows).drop("rk")


def copies(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """rk, group and keep of each distinct row that is in a group of near_duplicates with others; group is the rk of the one to keep."""
    spark = docs.sparkSession
    slim = common.cut(spark, with_signatures(docs).where("sig is not null").distinct().withColumn("uid", F.lit(0)))
    rows = _grouped(slim, distance, segments, group_rows, hot_rows).where("size > 1").select("rk", F.col("first.rk").alias("group"))
    return common.cut(spark, rows.select("rk", "group", (F.col("rk") == F.col("group")).alias("keep")))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs."""
    spark = docs.sparkSession
    rk = common.fresh(docs, "__tm_rk")
    by_row = common.cut(spark, assignments(docs, distance, segments).groupBy(F.col("rk").alias(rk)).agg(F.max("keep").alias("k"), F.count("*").alias("n")))
    keyed = docs.withColumn(rk, common.row_key())
    gone = common.maybe_broadcast(by_row.where("not k").select(rk), broadcast_rows)
    kept = keyed.join(gone, rk, "left_anti")
    repeated = by_row.where("k and n > 1").select(rk)
    if not repeated.isEmpty():
        repeated = common.maybe_broadcast(repeated, broadcast_rows)
        one = kept.join(repeated, rk, "left_semi").dropDuplicates([rk])
        kept = kept.join(repeated, rk, "left_anti").unionByName(one)
    return kept.select(*map(common.quoted, docs.columns))
