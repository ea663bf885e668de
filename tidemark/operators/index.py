"""Secondary indexes: declared expressions, found by filters over the table's own files.

An index is unique or not, over one or several columns or SQL expressions, and holds no data: a lookup is a
filter that reaches the scan.  Nulls are values like any other here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import DuplicateKey, IndexTypeMismatch
from tidemark.operators.reads import Bound, Key, beyond


@dataclass(frozen=True)
class Index:
    name: str
    on: tuple[str, ...]
    unique: bool = False

    @property
    def columns(self) -> list[Column]:
        return [F.expr(x) for x in self.on]


@dataclass(frozen=True)
class CustomIndex:
    """A user's index: `build` makes its DataFrame from the table's, `validate` may raise on a post-image."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    validate: Callable[[DataFrame], None] | None = None


def _value(index: Index, value: object) -> tuple:
    out = tuple(value) if isinstance(value, (tuple, list)) else (value,)
    if len(out) != len(index.on):
        raise IndexTypeMismatch(f"{index.name} has {len(index.on)} columns")
    return out


def lookup(df: DataFrame, index: Index, value: object) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (c.isNull() if v is None else c == F.lit(v) for c, v in zip(index.columns, _value(index, value)))))


def get_unique(df: DataFrame, index: Index, value: object) -> DataFrame:
    """The row of a unique index's key."""
    if not index.unique:
        raise IndexTypeMismatch(f"{index.name} is not unique")
    return lookup(df, index, value)


def get_by_index(df: DataFrame, key: Key, index: Index, value: object) -> DataFrame:
    """All rows of a non-unique index's key, in order of the primary key."""
    if index.unique:
        raise IndexTypeMismatch(f"{index.name} is unique")
    return lookup(df, index, value).orderBy(*key)


def get_by_key(df: DataFrame, key: Key, index: Index, value: object) -> DataFrame:
    """The rows of a key of an index of either kind, in order of the primary key."""
    return lookup(df, index, value).orderBy(*key)


def index_range(df: DataFrame, key: Key, index: Index, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
    """The rows between two bounds of the index, in order of its key, then of the primary one."""
    if lower is not None:
        df = df.where(beyond(index.columns, lower, True))
    if upper is not None:
        df = df.where(beyond(index.columns, upper, False))
    return df.orderBy(*[c.asc() for c in index.columns], *key)


def violations(df: DataFrame, index: Index) -> DataFrame:
    """The keys that occur more than once, as k0, k1 ... with n."""
    named = [c.alias(f"k{i}") for i, c in enumerate(index.columns)]
    return df.groupBy(*named).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(df: DataFrame, index: Index, changed: DataFrame | None = None) -> None:
    """Raise if the table breaks a unique index; with `changed` rows only their keys are looked at."""
    if not index.unique:
        return
    if changed is not None:
        keys = changed.select(*[c.alias(f"__k{i}") for i, c in enumerate(index.columns)]).distinct()
        on = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(index.columns)))
        df = df.join(keys, on, "left_semi")
    if found := violations(df, index).limit(1).collect():
        raise DuplicateKey(f"index {index.name}: {tuple(found[0])[:-1]} occurs {found[0].n} times")
