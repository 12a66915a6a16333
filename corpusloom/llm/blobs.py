"""Many small values in one row: blobs of hashes and numbers, packed, split by key and looked up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from .blocks import U

LOW6 = U((1 << 48) - 1)


def six(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def within(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership in sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def by_key(key: np.ndarray) -> list[np.ndarray]:
    """Indices of equal keys together."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []


def schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def table(fields: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(fields)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(own)], schema=own)


def joined(t: pa.Table, column: str, kind) -> np.ndarray:
    """All blobs of a column as one array."""
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)
