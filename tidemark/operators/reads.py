"""Keyed reads over a DataFrame whose rows are told apart by key columns.

All are plans: filters reach the Parquet scan, ordered limits become a top-k, and key
lists join as a small side whose size is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import NullKey

Key = tuple[str, ...]
LISTED = 500  # so many keys go to the scan as a filter; more join
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Bound:
    """An end of a range: a value for the first columns of the key, within the range or not."""

    value: tuple
    included: bool = True


def included(*value: object) -> Bound:
    return Bound(value)


def excluded(*value: object) -> Bound:
    return Bound(value, False)


def as_key(value: object) -> tuple:
    out = tuple(value) if isinstance(value, (tuple, list)) else (value,)
    if any(x is None for x in out):
        raise NullKey("keys have no nulls")
    return out


def equals(columns: Sequence[Column], value: tuple) -> Column:
    return reduce(lambda a, b: a & b, (c == F.lit(v) for c, v in zip(columns, value)))


def beyond(columns: Sequence[Column], bound: Bound, above: bool) -> Column:
    """Whether the columns, compared one after another, are above (or below) a bound.

    A bound on the first columns alone covers all keys that begin with it.
    """
    pairs = list(zip(columns, bound.value))
    strict = [(c > F.lit(v)) if above else (c < F.lit(v)) for c, v in pairs]
    out = equals([c for c, _ in pairs], tuple(v for _, v in pairs)) if bound.included else F.lit(False)
    for i in reversed(range(len(pairs))):
        before = [c == F.lit(v) for c, v in pairs[:i]]
        out = out | reduce(lambda a, b: a & b, [*before, strict[i]])
    if len(pairs) == 1:
        c, v = pairs[0]
        return ((c >= F.lit(v)) if above else (c <= F.lit(v))) if bound.included else strict[0]
    c, v = pairs[0]  # implied by the rest, and one that a scan can use
    return ((c >= F.lit(v)) if above else (c <= F.lit(v))) & out


def _cols(key: Key) -> list[Column]:
    return [F.col(c) for c in key]


def get(df: DataFrame, key: Key, value: object) -> DataFrame:
    """The row of a key, if there is one."""
    return df.where(equals(_cols(key), as_key(value)))


def contains(df: DataFrame, key: Key, value: object) -> bool:
    return not get(df, key, value).select(*key).isEmpty()


def key_rows(df: DataFrame, key: Key, values: Sequence[object]) -> DataFrame:
    """pos and the key columns for a list of keys."""
    schema = T.StructType([T.StructField("pos", T.LongType(), False), *(T.StructField(c, df.schema[c].dataType) for c in key)])
    return df.sparkSession.createDataFrame([(i, *as_key(v)) for i, v in enumerate(values)], schema)


def matching(df: DataFrame, key: Key, values: Sequence[object]) -> DataFrame:
    """The rows of df whose key is listed."""
    values = list(dict.fromkeys(as_key(v) for v in values))
    if not values:
        return df.where(F.lit(False))
    if len(values) <= LISTED:
        if len(key) == 1:
            return df.where(F.col(key[0]).isin([v[0] for v in values]))
        first = F.col(key[0]).isin(list({v[0] for v in values}))
        return df.where(first & reduce(lambda a, b: a | b, (equals(_cols(key), v) for v in values)))
    keys = key_rows(df, key, values).select(*key)
    return df.join(F.broadcast(keys) if len(values) <= BROADCAST_KEYS else keys, list(key), "left_semi")


def get_many(df: DataFrame, key: Key, values: Sequence[object]) -> DataFrame:
    """pos, the key and the row for each listed key, in order of pos; the row is null where it is missing.  Repeated keys repeat."""
    keys = key_rows(df, key, values)
    found = matching(df, key, values)
    if len(values) <= BROADCAST_KEYS:  # at most as many rows as keys
        found = F.broadcast(found)
    return keys.join(found, list(key), "left").select("pos", *df.columns).orderBy("pos")


def resolve(df: DataFrame, key: Key, values: Sequence[object]) -> DataFrame:
    """pos and the row of each listed key that has one, in order of pos.  Repeated keys repeat."""
    keys = key_rows(df, key, values)
    keys = F.broadcast(keys) if len(values) <= BROADCAST_KEYS else keys
    return matching(df, key, values).join(keys, list(key)).select("pos", *df.columns).orderBy("pos")


def scan_range(df: DataFrame, key: Key, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
    """The rows between two bounds, None being no bound, in no order.  Bounds that cross give none."""
    if lower is not None:
        df = df.where(beyond(_cols(key), lower, True))
    if upper is not None:
        df = df.where(beyond(_cols(key), upper, False))
    return df


def ordered(df: DataFrame, key: Key, descending: bool = False) -> DataFrame:
    return df.orderBy(*[c.desc() if descending else c.asc() for c in _cols(key)])


def key_range(df: DataFrame, key: Key, lower: Bound | None = None, upper: Bound | None = None, descending: bool = False) -> DataFrame:
    """scan_range in order of the key."""
    return ordered(scan_range(df, key, lower, upper), key, descending)


def prefix(df: DataFrame, key: Key, *value: object) -> DataFrame:
    """The rows whose key begins with these components, in order of the key."""
    return ordered(df.where(equals(_cols(key), as_key(value))), key)


def first(df: DataFrame, key: Key) -> DataFrame:
    return ordered(df, key).limit(1)


def last(df: DataFrame, key: Key) -> DataFrame:
    return ordered(df, key, True).limit(1)


def scan(df: DataFrame, key: Key, start: object, n: int) -> DataFrame:
    """The first n rows from a key on."""
    return key_range(df, key, Bound(as_key(start))).limit(n)


def length(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
