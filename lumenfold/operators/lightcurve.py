"""Light curves lc_id, idx, t, y, dy: cleaning, validation, masking, adapters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import columns as C

LC = ["lc_id", "idx", "t", "y", "dy"]


def from_columns(df: DataFrame, t: str, y: str, dy: str | None = None, lc_id: str | None = None) -> DataFrame:
    """Any table as light curves; rows are numbered by time within each."""
    ident = F.col(lc_id).cast("string") if lc_id else F.lit("0")
    err = F.col(dy).cast("double") if dy else F.lit(None).cast("double")
    named = df.select(ident.alias("lc_id"), F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"), err.alias("dy"))
    return named.withColumn("idx", (F.row_number().over(Window.partitionBy("lc_id").orderBy("t", "y", "dy")) - 1).cast("long")).select(*LC)


def usable(*values: str) -> Column:
    """Every value is there, a number, positive and finite."""
    ok = F.lit(True)
    for v in values:
        c = F.col(v)
        ok = ok & c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return ok


def clean(lc: DataFrame, with_dy: bool = False) -> DataFrame:
    """Rows whose t, y (and dy) are usable, order kept; zero counts as unusable."""
    return lc.filter(usable("t", "y", "dy") if with_dy else usable("t", "y"))


def facts(lc: DataFrame) -> DataFrame:
    """One row per curve: n, min_t, max_t, mean_y, std_y, mean_dy, and status (ok, short, flat or off)."""
    agg = lc.groupBy("lc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("std_y"), F.avg("dy").alias("mean_dy")
    )
    status = F.when(F.col("n") < 3, "short").when(F.col("max_t") <= F.col("min_t"), "flat").when(~F.col("mean_y").between(0.99, 1.01), "off").otherwise("ok")
    return agg.withColumn("status", status)


def validate(lc: DataFrame, strict: bool = False) -> DataFrame:
    """Cleaned curves with dy over its mean, or the scatter of y where no dy is given.

    Curves with fewer than three points or no time span are left out, or raise if ``strict``.
    """
    has_dy = lc.groupBy("lc_id").agg(F.count("dy").alias("__dys"))
    rows = lc.join(has_dy, "lc_id").filter(usable("t", "y") & (F.col("__dys").eqNullSafe(0) | F.coalesce(usable("dy"), F.lit(False))))
    f = facts(rows)
    if strict and f.filter(F.col("status").isin("short", "flat")).limit(1).count():
        raise ValueError("a light curve has fewer than three points or no time span")
    f = f.filter(~F.col("status").isin("short", "flat")).select("lc_id", "std_y", "mean_dy")
    dy = F.when(F.col("__dys") > 0, F.col("dy") / F.col("mean_dy")).otherwise(F.col("std_y"))
    return rows.join(f, "lc_id").select("lc_id", "idx", "t", "y", dy.alias("dy"))


def mask(lc: DataFrame, period, duration, t0) -> DataFrame:
    """``lc`` with in_transit."""
    return lc.withColumn("in_transit", C.in_transit(F.col("t"), period, duration, t0))


def without_transits(lc: DataFrame, found: DataFrame, widen: float = 2.0) -> DataFrame:
    """``lc`` without the points within ``widen`` * duration (days) of each curve's found dip (lc_id, period, duration_days, T0)."""
    hit = found.select("lc_id", F.col("period").alias("__p"), (F.col("duration_days") * widen).alias("__d"), F.col("T0").alias("__t0"))
    keep = ~F.coalesce(C.in_transit(F.col("t"), F.col("__p"), F.col("__d"), F.col("__t0")), F.lit(False))
    return lc.join(hit, "lc_id", "left").filter(keep).select(*lc.columns)


def pack(lc: DataFrame) -> DataFrame:
    """One row per curve: arrays t, y, dy ordered by time."""
    rows = F.sort_array(F.collect_list(F.struct("t", "idx", "y", "dy")))
    return lc.groupBy("lc_id").agg(rows.alias("p")).select("lc_id", *[F.expr(f"transform(p, x -> x.{c})").alias(c) for c in ("t", "y", "dy")])


CHUNKS = "lc_id string, t0 double, idx0 long, t binary, y binary, dy binary"
#: Bytes of an Arrow batch at most: a chunk is one row.
BATCH_BYTES = 8 << 20


def _chunked(batches):
    for rows in batches:
        if not rows.num_rows:
            continue
        names = rows.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        t, idx, y, dy = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        begin = np.concatenate([[0], np.flatnonzero(np.diff(names)) + 1])
        ends = list(zip(begin.tolist(), [*begin[1:].tolist(), len(t)], strict=True))
        # an error that is the same at every point travels once
        errors = [dy[a : a + 1] if (dy[a:b] == dy[a]).all() else dy[a:b] for a, b in ends]
        raw = [[x[a:b].tobytes() for a, b in ends] for x in (t, y)] + [[x.tobytes() for x in errors]]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(begin)), pa.array(t[begin]), pa.array(idx[begin]), *(pa.array(x, pa.binary()) for x in raw)], names=["lc_id", "t0", "idx0", "t", "y", "dy"])


def chunks(lc: DataFrame, parts: int) -> DataFrame:
    """Curves in pieces of some thousand points, ordered by time: however long a curve, no row holds it whole and no task sorts it alone."""
    spark = lc.sparkSession
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = lc.select("lc_id", "t", "idx", "y", "dy").repartitionByRange(parts, "lc_id", "t", "idx").sortWithinPartitions("lc_id", "t", "idx", "y", "dy")
    return rows.mapInArrow(_chunked, CHUNKS)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, y = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    if len({x[2][0] for x in parts}) == 1 and all(len(x[2]) == 1 for x in parts):
        return t, y, np.broadcast_to(parts[0][2], len(t))
    return t, y, np.concatenate([np.broadcast_to(x[2], len(x[0])) if len(x[2]) == 1 else x[2] for x in parts])


def whole(batches, keys: int):
    """(the first ``keys`` columns' values, t, y, dy) of each curve, out of chunks in order that end with t, y and dy."""
    held, parts = None, []
    for rows in batches:
        for i, key in enumerate(zip(*(rows.column(k).to_pylist() for k in range(keys)), strict=True)):
            if key != held:
                if parts:
                    done, parts = _joined(parts), []
                    yield held, *done
                held = key
            parts.append(tuple(np.frombuffer(rows.column(rows.num_columns - k)[i].as_buffer()) for k in (3, 2, 1)))
    if parts:
        done, parts = _joined(parts), []
        yield held, *done
