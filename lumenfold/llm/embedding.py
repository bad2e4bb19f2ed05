"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors cosine >= c is distance <= epsilon = sqrt(2 - 2c).  Vectors are laid on a grid of cells of that width
along their leading principal directions, sorted by cell, and cut into blocks of the sequence.  Two blocks can hold a link only
if their bounding boxes along those directions come within epsilon; such pairs are found by a join on the
first coordinate's cells and that test.  A pair of blocks is joined recursively: intervals of the sequence are halved until small,
and any two whose boxes lie apart are skipped.  What is left is compared in blocks, in single precision with
a margin first, and in double precision wherever that finds something.

Equal vectors are one class with a weight.  A block pair gives a row per class with its links' number and the least
vector of its part of the graph, so no group emits its pairs.  The principal directions come from a bounded sample: any orthonormal
directions give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, connected_components, hot_lookup, materialize
from lumenfold.llm._vectors import matrix, packed

BLOCK_ROWS, LEAF_ROWS = 4096, 512
#: Directions of the grid order, and of the boxes.
GRID, BOX = 4, 8
#: Vectors from which the directions are computed, at the expectation.
SAMPLE = 20_000
#: By so much single precision may be wrong.
MARGIN = 1e-4
#: Blocks of one cell that a task of the blocks' join has on average at most, on its left side.
CELL_BLOCKS = 500


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square vanishes or overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _moments(kind: str, dims: int):
    def run(batches):
        total = np.zeros((dims, dims))
        for rows in batches:
            if rows.num_rows:
                u = _unit(matrix(b"".join(rows.column(0).to_pylist()), kind, dims))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return run


def _directions(classes: DataFrame, kind: str, dims: int, n: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, n))
    some = classes.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < int(share * 1_000_000))).select("raw").coalesce(8)
    total = sum((np.frombuffer(r["m"]).reshape(dims, dims) for r in some.mapInArrow(_moments(kind, dims), "m binary").collect()), np.zeros((dims, dims)))
    _, v = np.linalg.eigh(total)
    return np.ascontiguousarray(v[:, ::-1][:, : min(BOX, dims)])


def _celled(kind: str, directions: dict[int, np.ndarray], eps: float):
    def run(batches):
        for rows in batches:
            dims, raw = rows.column(rows.schema.get_field_index("dims")).to_numpy(), rows.column(rows.schema.get_field_index("raw")).to_pylist()
            cells = np.zeros((rows.num_rows, GRID), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = _unit(matrix(b"".join(raw[i] for i in at), kind, d)) @ directions[d]
                cells[at, : min(GRID, p.shape[1])] = np.floor(p[:, :GRID] / eps)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(cells[:, k]) for k in range(GRID))], names=[*rows.schema.names, *(f"c{k}" for k in range(GRID))])

    return run


def _cut(kind: str, directions: dict[int, np.ndarray]):
    """Blocks of the sequence: consecutive rows of one length."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        weight: list[int] = []
        raw: list[bytes] = []
        cells: list[int] = []
        dims = 0

        def block():
            nonlocal k, ids, weight, raw, cells
            p = _unit(matrix(b"".join(raw), kind, dims)) @ directions[dims]
            box = np.concatenate([p.min(0), p.max(0)])
            out = [(part << 32) | k, dims, cells[0], cells[-1], np.array(ids, np.int64).tobytes(), np.array(weight, np.int64).tobytes(), b"".join(raw), box.tolist()]
            k += 1
            ids, weight, raw, cells = [], [], [], []
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(out, kinds, strict=True)], names=["block", "dims", "lo", "hi", "ids", "weight", "raw", "box"])

        for rows in batches:
            for i, w, d, r, c in zip(*(rows.column(x).to_pylist() for x in ("cls", "n", "dims", "raw", "c0")), strict=True):
                if ids and (d != dims or len(ids) == BLOCK_ROWS):
                    yield block()
                dims = d
                ids.append(i)
                weight.append(w)
                raw.append(r)
                cells.append(c)
        if ids:
            yield block()

    return run


def joined(a: np.ndarray, b: np.ndarray | None, pa_: np.ndarray, pb: np.ndarray | None, cosine: float):
    """Leaf comparisons of two sequences of unit vectors (b None: a with itself): (rows of a, rows of b, which link)."""
    same = b is None
    if same:
        b, pb = a, pa_
    eps2 = 2 - 2 * cosine + 1e-9
    a32, b32 = a.astype(np.float32), b.astype(np.float32)

    def boxes(p: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        out = {}

        def halve(lo: int, hi: int):
            if hi - lo <= LEAF_ROWS:
                out[lo, hi] = p[lo:hi].min(0), p[lo:hi].max(0)
            else:
                mid = (lo + hi) // 2
                (l1, h1), (l2, h2) = halve(lo, mid), halve(mid, hi)
                out[lo, hi] = np.minimum(l1, l2), np.maximum(h1, h2)
            return out[lo, hi]

        halve(0, len(p))
        return out

    box_a = boxes(pa_)
    box_b = box_a if same else boxes(pb)
    todo = [((0, len(a)), (0, len(b)))]
    while todo:
        x, y = todo.pop()
        if same and y[1] <= x[0]:
            continue  # the pair stands the other way round too
        (lo_x, hi_x), (lo_y, hi_y) = box_a[x], box_b[y]
        if (np.maximum(0, np.maximum(lo_x - hi_y, lo_y - hi_x)) ** 2).sum() > eps2:
            continue
        if x[1] - x[0] > LEAF_ROWS or y[1] - y[0] > LEAF_ROWS:
            halves = [[z] if z[1] - z[0] <= LEAF_ROWS else [(z[0], (z[0] + z[1]) // 2), ((z[0] + z[1]) // 2, z[1])] for z in (x, y)]
            todo += [(u, v) for u in halves[0] for v in halves[1]]
        elif (a32[slice(*x)] @ b32[slice(*y)].T).max() >= cosine - MARGIN:
            hit = a[slice(*x)] @ b[slice(*y)].T >= cosine
            if hit.any():
                yield x, y, hit


def _linked(kind: str, directions: dict[int, np.ndarray], cosine: float):
    def run(batches):
        for rows in batches:
            for r in zip(*(rows.column(c).to_pylist() for c in ("dims", "same", "ids", "weight", "raw", "ids2", "weight2", "raw2")), strict=True):
                dims, same = r[0], r[1]
                ids, weight, a = np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int64), _unit(matrix(r[4], kind, dims))
                if same:
                    ids2, weight2, b = ids, weight, None
                else:
                    ids2, weight2, b = np.frombuffer(r[5], np.int64), np.frombuffer(r[6], np.int64), _unit(matrix(r[7], kind, dims))
                w = directions[dims]
                links = np.zeros(len(ids), np.int64)
                links2 = links if same else np.zeros(len(ids2), np.int64)
                leaves = list(joined(a, b, a @ w, None if same else b @ w, cosine))
                label = ids.copy()
                label2 = label if same else ids2.copy()
                for x, y, hit in leaves:
                    links[slice(*x)] += hit @ weight2[slice(*y)]
                    if not (same and x == y):
                        links2[slice(*y)] += hit.T @ weight[slice(*x)]
                top, moved = np.iinfo(np.int64).max, True
                while moved:
                    moved = False
                    for x, y, hit in leaves:
                        for one, other, h in ((label[slice(*x)], label2[slice(*y)], hit), (label2[slice(*y)], label[slice(*x)], hit.T)):
                            least = np.where(h, other[None, :], top).min(1)
                            if (least < one).any():
                                np.minimum(one, least, out=one)
                                moved = True
                parts = [(ids, links, label)] if same else [(ids, links, label), (ids2, links2, label2)]
                for i, n, root in parts:
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(n[at]), pa.array(root[at])], names=["cls", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows at ``cosine`` or more in double precision, copies included; component_id is the least vec_id
    reachable.  Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of different
    lengths or rows without vec_id (component_id null, kept true).  Rows that repeat a vec_id are rows of one vector.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    bound_batches(vectors.sparkSession)
    rows, kind = packed(vectors, zero=False)
    rows = materialize(rows.select("*", F.xxhash64("raw").alias("h1"), F.xxhash64("dims", "raw").alias("h2")), "vectors")
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("n"))
    heads = rows.join(classes.select("h1", "h2", "n", F.col("cls").alias("vec_id")), ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2", "vec_id"])
    classes = materialize(heads.select(F.col("vec_id").alias("cls"), "n", "h1", "h2", "dims", "raw"), "classes")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    directions = {d: _directions(classes, kind, d, n) for d, n in sizes.items()}
    grid = ", ".join(f"c{k} int" for k in range(GRID))
    celled = classes.select("cls", "n", "dims", "raw").mapInArrow(_celled(kind, directions, eps), f"cls long, n long, dims int, raw binary, {grid}")
    order = ["dims", *(f"c{k}" for k in range(GRID)), "cls"]
    parts = max(1, sum(-(-n // (2 * BLOCK_ROWS)) for n in sizes.values()))
    sequence = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = materialize(sequence.mapInArrow(_cut(kind, directions), "block long, dims int, lo int, hi int, ids binary, weight binary, raw binary, box array<double>"), "blocks")
    # pairs of blocks by the first coordinate's cells, then by their boxes; salted, since few cells may hold all blocks
    meta = blocks.select("block", "dims", "lo", "hi", "box")
    salts = max(8, -(-blocks.count() // CELL_BLOCKS))
    left = meta.withColumn("cell", F.explode(F.sequence("lo", "hi"))).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    right = meta.select(*[F.col(c).alias(f"{c}2") for c in meta.columns]).withColumn("cell", F.explode(F.expr("sequence(lo2 - 1, hi2 + 1)"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    apart = F.expr("aggregate(sequence(0, cast(size(box) / 2 as int) - 1), 0D, (s, i) -> s + pow(greatest(0D, box[i] - box2[cast(size(box) / 2 as int) + i], box2[i] - box[cast(size(box) / 2 as int) + i]), 2))")
    near = left.join(right, ["cell", "salt"]).filter((F.col("dims") == F.col("dims2")) & (F.col("block") <= F.col("block2")) & (F.col("cell") == F.greatest(F.col("lo"), F.col("lo2") - 1)) & (apart <= eps * eps + 1e-9)).select("block", "block2")
    first = blocks.select("block", "dims", "ids", "weight", "raw")
    second = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("weight").alias("weight2"), F.col("raw").alias("raw2"))
    pairs = near.join(first, "block").join(second, "block2").withColumn("same", F.col("block") == F.col("block2"))
    met = materialize(pairs.select("dims", "same", "ids", "weight", "raw", "ids2", "weight2", "raw2").mapInArrow(_linked(kind, directions, cosine), "cls long, links long, root long"), "links")
    count = met.groupBy("cls").agg(F.sum("links").alias("links"))
    found = connected_components(met.select("cls", "root"))
    state = classes.select("cls", "h1", "h2", "n").join(count, "cls", "left").join(found, F.col("cls") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce(F.col("links") - 1, F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component"))
    known = hot_lookup(rows.select("vec_id", "h1", "h2"), state, ["h1", "h2"], "n", "vec_id", ["links", "component"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
