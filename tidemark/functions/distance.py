"""Distances of a column of vectors from one query, by NumPy over Arrow batches, in doubles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidemark.errors import DimensionMismatch, InvalidParameters, NotFinite

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - cosine of the angle; 1 where either vector is zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m) * (q @ q))
    return np.where(norm > 0, 1.0 - (m @ q) / np.where(norm > 0, norm, 1.0), 1.0)


def l2(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The squared distance."""
    d = m - q
    return np.einsum("ij,ij->i", d, d)


def dot(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return -(m @ q)


def cosine_normalized(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - dot, for vectors of length 1."""
    return 1.0 - m @ q


METRICS: dict[str, Metric] = {"cosine": cosine, "l2": l2, "dot": dot, "cosine_normalized": cosine_normalized}


def metric(name: str | Metric) -> Metric:
    """A registered metric by name, or the function itself.  Register one's own in METRICS."""
    if callable(name):
        return name
    if name not in METRICS:
        raise InvalidParameters(f"no metric {name}")
    return METRICS[name]


def checked(vector: object, dim: int | None = None) -> np.ndarray:
    """A vector as doubles; of the given dimension and finite, or an error."""
    out = np.asarray(vector, np.float64)
    if dim is not None and out.shape != (dim,):
        raise DimensionMismatch(f"expected {dim} dimensions, got {out.size}")
    if not np.isfinite(out).all():
        raise NotFinite("a vector has a NaN or an infinity")
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    lengths = pa.compute.list_value_length(column)
    if len(column) and pa.compute.any(pa.compute.not_equal(lengths, dim)).as_py():
        raise DimensionMismatch(f"a row has not {dim} dimensions")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)
