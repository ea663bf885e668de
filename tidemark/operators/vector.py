"""Exact nearest neighbours over a column of vectors: distances in Arrow batches, a top-k in each task, then one over all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import DimensionMismatch, InvalidParameters, NotFinite
from tidemark.functions.distance import Metric, checked, matrix, metric

FILTER_ROWS = 1_000_000


def distances(df: DataFrame, query: Sequence[float], by: str | Metric = "cosine", id: str = "id", vector: str = "embedding", best: int | None = None) -> DataFrame:
    """id and dist of each row with a vector; with `best` only so many of each task, which are enough for a top-k over all."""
    q = checked(query)
    of = metric(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            dist = of(matrix(b.column(1), len(q)), q) + 0.0
            t = pa.table({id: b.column(0), "dist": pa.array(dist)})
            if best is None:
                yield from t.to_batches()
                continue
            t = t if held is None else pa.concat_tables([held, t])
            held = t.take(pc.select_k_unstable(t, best, [("dist", "ascending"), (id, "ascending")])) if t.num_rows > best else t
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return df.select(id, vector).mapInArrow(run, f"{id} {dict(df.dtypes)[id]}, dist double")


def knn(df: DataFrame, query: Sequence[float], k: int, by: str | Metric = "cosine", ids: DataFrame | None = None, id: str = "id", vector: str = "embedding", filter_rows: int = FILTER_ROWS) -> DataFrame:
    """id and dist of the k nearest rows, nearest first, then by id; with `ids` only of rows with such an id."""
    if k < 0:
        raise InvalidParameters("k is negative")
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias(id)).distinct()
        few = wanted.limit(filter_rows + 1).count() <= filter_rows
        df = df.join(F.broadcast(wanted) if few else wanted, id, "left_semi")
    return distances(df, query, by, id, vector, max(k, 1)).orderBy("dist", id).limit(k)


def normalize(vector: Column) -> Column:
    """The vector at length 1, in doubles; the zero vector unchanged."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def is_finite(vector: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def check_rows(df: DataFrame, dim: int, vector: str = "embedding") -> None:
    """Raise if a vector is null, of another dimension or not finite."""
    v = F.col(vector)
    found = df.select((v.isNull() | (F.size(v) != dim)).alias("size"), (~is_finite(v)).alias("finite")).where("size or finite").limit(1).collect()
    if found:
        raise DimensionMismatch(f"a row has not {dim} dimensions") if found[0]["size"] else NotFinite("a row has a NaN or an infinity")


def recall(found: Sequence[int], true: Sequence[int]) -> float:
    return len(set(found) & set(true)) / max(1, len(true))


def brute_force(m: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, by: str = "cosine") -> list[tuple[int, float]]:
    """The same on the driver, for tests."""
    d = metric(by)(m, q)
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order]
