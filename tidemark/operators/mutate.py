"""Changes as plans: each gives the post-image of a table, after checks that each are one small job.

Base rows that a change replaces leave by an anti-join; the change's rows join by union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.errors import DuplicateKey, InvalidBulkLoad, KeyExhausted, KeyNotFound, NullKey
from tidemark.operators.reads import Key
from tidemark.plans.lineage import cut

MOST = (1 << 63) - 1
_MASK = (1 << 33) - 1


def _keys(df: DataFrame, key: Key) -> DataFrame:
    return df.select(*key)


def _any(df: DataFrame, key: Key) -> tuple | None:
    found = df.select(*key).limit(1).collect()
    return tuple(found[0]) if found else None


def no_nulls(rows: DataFrame, key: Key) -> None:
    missing = None
    for c in key:
        missing = F.col(c).isNull() if missing is None else missing | F.col(c).isNull()
    if not rows.where(missing).isEmpty():
        raise NullKey("keys have no nulls")


def repeated(rows: DataFrame, key: Key) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def must_be_distinct(rows: DataFrame, key: Key, error: type[Exception] = DuplicateKey) -> None:
    if (k := _any(repeated(rows, key), key)) is not None:
        raise error(f"key {k} occurs more than once")


def must_exist(base: DataFrame, key: Key, rows: DataFrame) -> None:
    if (k := _any(_keys(rows, key).join(_keys(base, key), list(key), "left_anti"), key)) is not None:
        raise KeyNotFound(f"no key {k}")


def must_be_new(base: DataFrame, key: Key, rows: DataFrame) -> None:
    if (k := _any(_keys(rows, key).join(_keys(base, key), list(key), "left_semi"), key)) is not None:
        raise DuplicateKey(f"key {k} exists")


def upserted(base: DataFrame, key: Key, rows: DataFrame) -> DataFrame:
    """base with rows put in, each instead of the one with its key.  Keys of rows are distinct."""
    return base.join(_keys(rows, key), list(key), "left_anti").unionByName(rows.select(*base.columns))


def without(base: DataFrame, key: Key, keys: DataFrame) -> DataFrame:
    return base.join(_keys(keys, key).distinct(), list(key), "left_anti").select(*base.columns)


def last_of_each(rows: DataFrame, key: Key, position: str) -> DataFrame:
    """Of the rows of each key the one with the greatest position."""
    rest = [c for c in rows.columns if c not in key and c != position]
    if not rest:
        return rows.select(*key).distinct()
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("__r")).select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def put(base: DataFrame, key: Key, rows: DataFrame) -> DataFrame:
    no_nulls(rows, key)
    must_be_distinct(rows, key)
    return upserted(base, key, rows)


def insert_with_keys(base: DataFrame, key: Key, rows: DataFrame) -> DataFrame:
    """All rows are new, or nothing changes."""
    no_nulls(rows, key)
    must_be_distinct(rows, key)
    must_be_new(base, key, rows)
    return base.unionByName(rows.select(*base.columns))


def update_batch(base: DataFrame, key: Key, rows: DataFrame, position: str | None = None) -> DataFrame:
    """All keys exist, or nothing changes.  With `position`, of several rows of a key the last counts."""
    no_nulls(rows, key)
    if position:
        rows = last_of_each(rows, key, position)
    else:
        must_be_distinct(rows, key)
    must_exist(base, key, rows)
    return upserted(base, key, rows)


def delete_batch(base: DataFrame, key: Key, keys: DataFrame) -> DataFrame:
    """All keys exist, or nothing changes; repeated ones don't matter."""
    must_exist(base, key, keys)
    return without(base, key, keys)


def numbered(rows: DataFrame, column: str, start: int, order: list[Column] | None = None) -> tuple[DataFrame, int]:
    """rows with ids from `start` on in `column`, without gaps, and the id after the last.

    With `order` rows are sorted over all partitions, else the order of partitions and of rows in
    them holds.  Only one total for each partition comes to the driver.
    """
    rows = rows.drop(column)
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(rows.select(*rows.columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_MASK)).alias("__at")))
    totals = sorted((r["__part"], r["n"]) for r in held.groupBy("__part").agg(F.count("*").alias("n")).collect())
    first, at = [], start
    for part, n in totals:
        first.append((part, at))
        at += n
    if at - 1 > MOST:
        raise KeyExhausted("ids end at 2^63 - 1")
    offsets = F.broadcast(rows.sparkSession.createDataFrame(first, "__part int, __first long"))  # a row for each partition
    out = held.join(offsets, "__part").select((F.col("__first") + F.col("__at")).alias(column), *rows.columns)
    return out, at


def insert_batch(base: DataFrame, key: str, rows: DataFrame, next_id: int, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The post-image, the new rows with their ids and the next id; ids are contiguous in input order."""
    new, after = numbered(rows, key, next_id, order)
    return base.unionByName(new.select(*base.columns)), new, after


def out_of_order(rows: DataFrame, key: Key, position: str) -> DataFrame:
    """The rows whose key is not above that of the row before, by position.

    Positions are put in ranges; each range is compared within and with the end of the one before, so no task has all rows.
    """
    spark = rows.sparkSession
    k = F.struct(*key)
    held = cut(rows.select(*key, position).repartitionByRange(position).sortWithinPartitions(position).withColumn("__part", F.spark_partition_id()))
    within = W.partitionBy("__part").orderBy(position)
    bad = held.withColumn("__before", F.lag(k).over(within)).where(k <= F.col("__before")).select(*key)
    ends = held.groupBy("__part").agg(F.min_by(k, position).alias("low"), F.max_by(k, position).alias("high")).orderBy("__part").collect()  # a row for each partition
    crossed = [tuple(b.low) for a, b in zip(ends, ends[1:]) if tuple(b.low) <= tuple(a.high)]
    return bad.unionByName(spark.createDataFrame(crossed, bad.schema)) if crossed else bad


def replace_sorted(rows: DataFrame, key: Key, position: str) -> DataFrame:
    """rows as a table; their keys must ascend strictly by position."""
    no_nulls(rows, key)
    if (k := _any(out_of_order(rows, key, position), key)) is not None:
        raise InvalidBulkLoad(f"key {k} is not above the one before it")
    return rows.drop(position)


def replace_unsorted(rows: DataFrame, key: Key) -> DataFrame:
    """rows as a table, in any order; keys must be distinct."""
    no_nulls(rows, key)
    must_be_distinct(rows, key, InvalidBulkLoad)
    return rows


def delta_conflicts(base: DataFrame, key: Key, inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """bucket, the key and kind of each conflict of a delta.

    Kinds are duplicate (twice in a bucket), overlap (in two buckets), missing (an update or delete of no row)
    and exists (an insert of a row that is there).
    """
    buckets = {"insert": inserts, "update": updates, "delete": deletes}
    every = None
    for name, rows in buckets.items():
        part = rows.select(F.lit(name).alias("bucket"), *key)
        every = part if every is None else every.unionByName(part)
    known = base.select(*key, F.lit(True).alias("__known"))
    counted = every.groupBy("bucket", *key).agg(F.count("*").alias("n"))
    counted = counted.withColumn("others", F.count("*").over(W.partitionBy(*key))).join(known, list(key), "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, F.lit("duplicate")),
            F.when(F.col("others") > 1, F.lit("overlap")),
            F.when((F.col("bucket") != "insert") & F.col("__known").isNull(), F.lit("missing")),
            F.when((F.col("bucket") == "insert") & F.col("__known").isNotNull(), F.lit("exists")),
        )
    )
    return counted.select("bucket", *key, F.explode(kinds).alias("kind"))


_ORDER = {"duplicate": (0, InvalidBulkLoad), "overlap": (1, InvalidBulkLoad), "missing": (2, KeyNotFound), "exists": (3, DuplicateKey)}


def delta(base: DataFrame, key: Key, inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """The post-image of three disjoint buckets; the first conflict, by the order of its kinds, is raised."""
    rank = F.create_map(*[F.lit(x) for k, (n, _) in _ORDER.items() for x in (k, n)])
    found = delta_conflicts(base, key, inserts, updates, deletes).orderBy(rank[F.col("kind")], "bucket", *key).limit(1).collect()
    if found:
        raise _ORDER[found[0].kind][1](f"{found[0].bucket}: {found[0].kind} {tuple(found[0][c] for c in key)}")
    return delta_image(base, key, inserts, updates, deletes)


def delta_image(base: DataFrame, key: Key, inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    gone = _keys(updates, key).unionByName(_keys(deletes, key))
    fresh = inserts.select(*base.columns).unionByName(updates.select(*base.columns))
    return base.join(gone, list(key), "left_anti").unionByName(fresh)


def next_after(rows: DataFrame, column: str, start: int = 1) -> int:
    """The id after the largest one."""
    top = rows.agg(F.max(column)).first()[0]
    if top is not None and top >= MOST:
        raise KeyExhausted("ids end at 2^63 - 1")
    return max(start, (top if top is not None else start - 1) + 1)
