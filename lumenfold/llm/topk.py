"""Exact top-k by inner product without random access.

Candidates fall into groups of bounded size.  A group keeps, for each dimension, its vectors sorted by component;
a query with a positive weight reads a list from the top, one with a negative weight from the bottom.  At
depth D a component not read yet lies between the list's far end and the last value read, which gives
every candidate a lower and an upper bound on its score.  Candidates whose upper bound is below the k-th greatest lower
bound are out.  Reading stops when few are left, and these are scored in full.

A whole block of queries reads a group's lists together, depth after depth: replacing unread components by their bounds
turns both bounds into matrix products.  Query blocks visit all groups; a task has some groups pass by some query blocks
and gives k rows a query, so the merge is small.  No group is dropped or sampled.

Both sides are dealt into partitions once and each pair of partitions is a task, which reads them where they lie: what is written grows
with the vectors, not with the pairs, and nothing is broadcast, however small the planner takes a side to be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, materialize
from lumenfold.llm._vectors import matrix, packed

GROUP_ROWS, QUERY_ROWS = 4096, 512
#: Groups in a partition at most, and partitions wanted before they hold more than one; groups pass one by one.
PART_GROUPS, PARTS = 64, 16
#: Query blocks in a partition at most, and their bytes: a task holds them together.
PART_BLOCKS, PART_BYTES = 16, 16 << 20
#: Shares of the lists read before the bounds are compared.
DEPTHS = (0.125, 0.5, 1.0)
#: Reading stops for a query when no more candidates than this stand.
FEW = 64
#: The greatest long: scores beyond it, or below its negative, count as these.
MOST = 2**63 - 1


def nra(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray, lists: np.ndarray | None = None, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query (row of q) the candidates (rows of x) that may be among its k best; own[i, j]: j is i itself.

    lists: x's columns sorted, if they are at hand.  floor: for each query a score that k candidates of other groups reach;
    where all queries have one, it stands for the k-th greatest lower bound.
    """
    n, sure = len(x), floor is not None and bool(np.isfinite(floor).all())
    lists = np.sort(x, axis=0) if lists is None else lists
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    stand = [np.arange(n)] * len(q)
    todo = np.arange(len(q))
    for share in DEPTHS:
        depth = max(1, int(np.ceil(share * n)))
        high, low, mine = lists[n - depth], lists[depth - 1], own[todo]
        if depth == n:  # all is read: both bounds are the score
            upper = q[todo] @ x.T
        else:
            upper = up[todo] @ np.maximum(x, high).T + down[todo] @ np.minimum(x, low).T
        if sure:
            kth = floor[todo].astype(x.dtype)
        elif n > k:
            lower = upper.copy() if depth == n else up[todo] @ np.where(x >= high, x, lists[0]).T + down[todo] @ np.where(x <= low, x, lists[-1]).T
            lower[mine] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
        else:
            kth = np.full(len(todo), -np.inf)
        still, over = [], (upper >= kth[:, None]) & ~mine
        for j, i in enumerate(todo):
            stand[i] = np.flatnonzero(over[j])
            if len(stand[i]) > max(FEW, 2 * k):
                still.append(i)
        todo = np.array(still, dtype=np.int64)
        if not len(todo):
            break
    return stand


def _blocked(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    raw = table.column("raw").to_pylist()
    return pa.table({"block": table.column("block")[:1], "dims": table.column("dims")[:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "raw": pa.array([b"".join(raw[i] for i in order)], pa.binary())})


def _searched(k: int, kind: str):
    def run(batches):
        best: dict[tuple, tuple] = {}  # of each query block: its queries, and for each of them the scores and ids so far
        last = None
        for rows in batches:
            for dims, ids, raw, qids, qraw in zip(*(rows.column(c).to_pylist() for c in ("dims", "ids", "raw", "qids", "qraw")), strict=True):
                if (ids, raw) != last:  # a group meets one query block after the other
                    last, x = (ids, raw), matrix(raw, kind, dims)
                    lists, most = np.sort(x, axis=0), max(np.abs(x).max(initial=0), 1)
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32), lists.astype(np.float32)
                q = matrix(qraw, kind, dims)
                c, o = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                _, so_far = best.setdefault((qids, qraw), (o, [(np.zeros(0, np.int64),) * 2] * len(o)))
                bound = most * max(np.abs(q).max(initial=0), 1) * dims
                exact = bound < 2.0**53
                if exact:
                    floor, own = np.array([float(s[-1]) if len(s) == k else -np.inf for s, _ in so_far]), o[:, None] == c[None, :]
                    if bound < 2.0**24:  # whole numbers that floats hold too
                        stand = nra(short[0], q.astype(np.float32), k, own, short[1], floor)
                    else:
                        stand = nra(x, q, k, own, lists, floor)
                else:
                    stand = [np.flatnonzero(c != v) for v in o]
                for i, found in enumerate(stand):
                    if not len(found):
                        continue
                    if exact:
                        score = (x[found] @ q[i]).astype(np.int64)
                    else:  # beyond what doubles hold: whole numbers of Python
                        whole = [sum(int(a) * int(b) for a, b in zip(x[j], q[i], strict=True)) for j in found]
                        score = np.array([min(max(s, -MOST - 1), MOST) for s in whole], np.int64)
                    score, ids_ = np.concatenate([so_far[i][0], score]), np.concatenate([so_far[i][1], c[found]])
                    order = np.lexsort((ids_, ~score))[:k]
                    so_far[i] = score[order], ids_[order]
        for o, so_far in best.values():
            size = [len(s) for s, _ in so_far]
            cols = np.repeat(o, size), np.concatenate([v for _, v in so_far]), np.concatenate([s for s, _ in so_far])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest integer inner products of each query.

    Components become floor(scale * x).  Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by
    ``every``, candidates all rows with another vec_id; ties go to the smaller vec_id.  Vectors that are null, empty, or hold null or
    non-finite components take no part, nor rows without vec_id; vectors of different lengths don't meet.
    A score beyond a long's range is the nearest long, and ties with its like.  Rows that repeat a vec_id are candidates each, but one query if they are equal.
    """
    bound_batches(vectors.sparkSession)
    rows, kind = packed(vectors, scale)
    rows = materialize(rows, "vectors")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max("dims").alias("dims")).first()
    groups, parts = max(1, -(-count["n"] // GROUP_ROWS)), max(1, -(-(count["q"] or 0) // QUERY_ROWS))
    shape = "block int, dims int, ids binary, raw binary"
    blocked = lambda d, n: d.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block", "dims").applyInArrow(_blocked, shape)
    asked = blocked(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "raw"]), parts).select("dims", F.col("ids").alias("qids"), F.col("raw").alias("qraw"))
    held = blocked(rows, groups).select("dims", "ids", "raw")
    # the query blocks meet every group, partition by partition
    together = min(max(PART_BYTES // (QUERY_ROWS * 8 * (count["dims"] or 1)), 1), PART_BLOCKS)
    held, asked = held.repartition(-(-groups // min(max(groups // PARTS, 1), PART_GROUPS))), asked.repartition(-(-parts // together))
    met = held.join(asked.hint("shuffle_replicate_nl"), "dims").select("dims", "ids", "raw", "qids", "qraw")
    found = met.mapInArrow(_searched(k, kind), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
