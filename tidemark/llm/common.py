"""What the operators of this subpackage share: tables, row keys, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    return lineage.cut(df)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: `name`, with as many underscores after it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame, name: str) -> str | None:
    """The column of df that `name` means, as Spark resolves it: whatever the case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that stand for a row: its id and its text, either of which may be null.

    Rows that repeat both have one key and are treated alike.  Of 10^10 different rows about three pairs share a key
    by chance and are then taken for one another.
    """
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull())


#: A group of more rows than this is joined to its row by a broadcast of such groups alone.
HOT_ROWS = 1_000_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """rows with the other columns of groups, which has one row for each value of key and how many of rows have it (size).

    Groups of more than hot_rows are at most one in so many of the rows, so they are broadcast, and their rows stay where they
    are; the others, none larger than that, meet by a shuffle.  A `total` of rows up to hot_rows says that there are no hot ones.
    """
    if total is not None and total <= hot_rows:
        return rows.join(groups.drop(size), key)
    hot = groups.where(F.col(size) > hot_rows).drop(size)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= hot_rows).drop(size), key)
    return here.unionByName(rest)


_STEADY = {"Project", "Filter", "Union", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD"}


def steady(df: DataFrame) -> DataFrame:
    """df, whose tasks give the same rows in the same order when they are repeated: as it is where it only reads files, else cut."""
    left, names = [df._jdf.queryExecution().optimizedPlan()], set()
    while left:
        node = left.pop()
        names.add(node.nodeName().split(" ")[0])
        left += [node.children().apply(i) for i in range(node.children().size())]
    return df if names <= _STEADY else cut(df.sparkSession, df)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, weight: Column | None = None) -> bool:
    """Whether df has at most so many rows, and BROADCAST_BYTES by their weight; it looks at no more than one row beyond."""
    size = F.sum(weight) if weight is not None else F.lit(0)
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return found.n <= rows and found.b <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """df marked for broadcast when it is counted to be small, else left to a shuffled join.

    `weight` is the bytes of a row, to be given where rows have texts or arrays.
    """
    return F.broadcast(df) if small(df, rows, weight) else df
