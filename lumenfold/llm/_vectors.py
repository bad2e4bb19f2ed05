"""Vectors as packed rows: which take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "vec_id long, dims int, raw binary"


def valid_rows(column: pa.Array, zero: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, where each one's components begin, all components as doubles) of the vectors without null or non-finite components (without ``zero``, not those that are zero throughout either)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    if not zero:
        some = np.concatenate([[0], np.cumsum(np.nan_to_num(values) != 0)])
        fine &= some[begin[1:]] > some[begin[:-1]]
    return np.flatnonzero(fine), begin, values


def _packed(kind: str, scale: float | None, zero: bool):
    def run(batches):
        for rows in batches:
            at, begin, values = valid_rows(rows.column(1), zero)
            if scale is not None:
                values = np.floor(scale * values)
            values = values.astype(kind)
            raw, width = values.tobytes(), values.itemsize
            cut = [raw[width * begin[i] : width * begin[i + 1]] for i in at]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), pa.array((begin[at + 1] - begin[at]).astype(np.int32)), pa.array(cut, pa.binary())], names=["vec_id", "dims", "raw"])

    return run


def packed(vectors: DataFrame, scale: float | None = None, zero: bool = True) -> tuple[DataFrame, str]:
    """The valid vectors of (vec_id, embedding) as bytes, and the bytes' NumPy type.

    With ``scale``, components are floor(scale * x), as doubles.
    """
    kind = "<f8" if scale is not None or "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if kind == "<f8" else "array<float>").alias("embedding"))
    return typed.filter("vec_id is not null").mapInArrow(_packed(kind, scale, zero), PACKED), kind


def matrix(raw: bytes, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(-1, dims).astype(np.float64)
