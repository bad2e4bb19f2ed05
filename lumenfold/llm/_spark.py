"""What the operators share: materialised tables, hot-key lookups, components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000

#: A graph of so many edges after the first contraction is finished by one task; its memory is bounded by this.
ONE_TASK_EDGES = 100_000
#: Rows and bytes of an Arrow batch between the JVM and Python at most: what a task holds beside its own work.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_written: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches no larger than BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most or not spark.conf.get(key).rstrip("b").isdigit():
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; own only where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"lumenfold-{os.getpid()}")
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete every table written by :func:`materialize` so far."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clean
            continue


atexit.register(release)


def merge_join(rows: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by sorting both, whatever the planner takes their sizes for.

    Its estimates are of compressed bytes: tables that grow with the input would be broadcast by way of the driver, several at once.
    """
    return rows.join(table.hint("merge"), on, how)


def hot_lookup(rows: DataFrame, table: DataFrame, key: list[str], count: str, spread: str, values: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``, where a few keys may hold most rows.

    ``table`` has each key once, with ``count`` = the number of ``rows`` that have it.  Keys above HOT_SHARE of
    all rows are at most 1 / HOT_SHARE many, so these alone are broadcast; the rows that they serve
    then travel by ``spread`` (any column that differs between rows) instead of by the key.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).first()["t"]
    hot = table.filter(F.col(count) > F.lit(total * HOT_SHARE)).select(*[F.col(k).alias(f"__h_{k}") for k in key], *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__h"))
    cold = table.filter(F.col(count) <= F.lit(total * HOT_SHARE)).select(*[F.col(k).alias(f"__c_{k}") for k in key], *[F.col(v).alias(f"__c_{v}") for v in values], F.least(F.col(count), F.lit(0)).cast("long").alias("__c_way"))  # 0, but no literal: it must stay part of the join key
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__h_{k}") for k in key], "left")
    met = met.withColumn("__way", F.when(F.col("__h"), F.xxhash64(F.col(spread)).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    out = merge_join(met, cold, [F.col("__way") == F.col("__c_way"), *[F.col(k) == F.col(f"__c_{k}") for k in key]], "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"__h_{v}"), F.col(f"__c_{v}")).alias(v) for v in values])


def _forest(batches):
    """Edges of one partition as a spanning forest of stars: (node, root)."""
    import numpy as np
    import pyarrow as pa

    def emit(parent):
        nodes = np.fromiter(parent.keys(), dtype=np.int64, count=len(parent))
        roots = np.fromiter((find(parent, x) for x in list(parent)), dtype=np.int64, count=len(parent))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])

    def find(parent, x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(parent, a), find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:  # bounded memory: give out what is known so far
            yield emit(parent)
            parent = {}
    yield emit(parent)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (its first two long columns); component is the least node reachable.

    Each partition first reduces its own edges to a forest.  While more than ONE_TASK_EDGES edges are left, large-star and
    small-star steps alternate, each written to the shared folder, until nothing changes; a hub's neighbours travel
    by :func:`hot_lookup`.  As soon as no more are left, one task finishes them.
    Self loops and repeated edges count for nothing; no edges give no rows.
    """
    a, b = edges.columns[:2]
    cur = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "cc")

    def signature(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        return r["n"], r["h"]

    before = None
    while True:
        now = signature(cur)
        if now[0] <= ONE_TASK_EDGES:
            cur = materialize(cur.coalesce(1).mapInArrow(_forest, "u long, v long"), "cc")
            break
        if now == before:
            break
        before = now
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_lookup(both, least, ["u"], "n", "v", ["m"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc")
        # here u > v: each node with its smaller neighbours
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = hot_lookup(large, down, ["u"], "n", "v", ["m"])
        cur = materialize(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
