"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best-fit.  Pieces are taken up by size, the range between capacity / (k + 1) and capacity / k in
superstep k, all that are smaller in the last.  In a superstep the pieces and the open gaps are
range-sorted together, from the largest.  Each range is swept by a task of its own: a piece takes its successor, the least gap of the range that
holds it, and the gap left stays open for later pieces.  What a sweep leaves is pieces, then gaps, each by rank; a piece left
in one range and a gap left in an earlier one meet by rank as closing and opening brackets do, so no gap is asked twice
and each piece has the nearest gap that is free.  The gaps shrink and the pieces still without a place ask again, until none finds one.
Only these open sequences: k pieces by rank share one in superstep k, which no other piece of that range could join; in the last
superstep as many are opened as the pieces' tokens fill, by as many of the longest as surely fit, and the others ask again.

What goes to the driver is a row per size (capacity at most) and one per range; pieces and gaps stay distributed and move once a sweep.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, materialize
from lumenfold.llm._text import pieces as slices
from lumenfold.llm._tokens import encoder

#: Pieces and gaps of a range, on average at most: what the task that sweeps it holds.
RANGE_ROWS = 200_000
#: The superstep of all pieces up to capacity / LAST.
LAST = 8
#: Pieces of later ranges that one gap takes in a round at most.
SLOTS = 8
#: What a sweep gives: a place, a piece left, a gap left that later ranges may use, its further slots, a gap left for the next round.
PLACED, PIECE, GAP, SLOT, LATER = 0, 1, 2, 3, 4
_SWEPT = "part int, kind int, rank long, id long, size int, sequence_id long, offset int"


def _tokenized(path: str, keep_space: bool, end_id: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        tool = encoder(path, keep_space)
        for rows, data, offsets in slices(batches, "text"):
            ids, at = tool.encode_rows(data, offsets)
            out: list[tuple] = []
            for doc, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                mine = np.concatenate([ids[a:b], end])
                for k, lo in enumerate(range(0, len(mine), capacity)):
                    piece = mine[lo : lo + capacity]
                    out.append((unit, doc, k, lo, len(piece), zlib.crc32(piece)))
                    unit += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["unit", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sweep(size: np.ndarray, ident: np.ndarray, gap: np.ndarray, capacity: int) -> tuple[list, list, list]:
    """One range, from the largest size: (places, pieces left, gaps left).

    Rows are pieces and, where ``gap``, gaps.  Places are (piece, length, sequence, offset); pieces left come by
    length from the longest, gaps left by room from the widest: (identifier, size).
    """
    order = np.lexsort((ident, ~gap, -size))
    free: dict[int, list[int]] = {}
    rooms: list[int] = []  # the sizes in free, ascending

    def put(room: int, sequence: int) -> None:
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append(sequence)

    placed, left = [], []
    for n, i, is_gap in zip(size[order].tolist(), ident[order].tolist(), gap[order].tolist(), strict=True):
        if is_gap:
            put(n, i)
            continue
        at = bisect_left(rooms, n)
        if at == len(rooms):
            left.append((i, n))
            continue
        room = rooms[at]
        sequence = free[room].pop()
        if not free[room]:
            del free[room], rooms[at]
        placed.append((i, n, sequence, capacity - room))
        if room > n:
            put(room - n, sequence)
    return placed, left, [(s, room) for room in reversed(rooms) for s in free[room]]


def _swept(capacity: int, last: int):
    def run(table: pa.Table) -> pa.Table:
        size, ident, gap = (table.column(c).to_numpy() for c in ("size", "id", "gap"))
        part, low = table.column("part")[0].as_py(), int(size.min())
        placed, left, rooms = sweep(size, ident, gap, capacity)
        out = [(part, PLACED, 0, i, n, s, at) for i, n, s, at in placed]
        out += [(part, PIECE, k + 1, i, n, None, None) for k, (i, n) in enumerate(left)]
        rank = 0
        for s, room in rooms:
            # the pieces of later ranges have ``low`` tokens at most: so many find room, and more of them next round
            slots = min(SLOTS, room // low) if part < last else 0
            out.append((part, GAP if slots else LATER, rank + 1, s, room, None, None))
            out += [(part, SLOT, rank + k, s, room, None, None) for k in range(2, slots + 1)]
            rank += slots
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in _SWEPT.split(", ")]
        return pa.table([pa.array(c, type=t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    return run


def _ranges(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(size, first range, ranges): sizes from the largest dealt to ranges of RANGE_ROWS rows, a size too frequent for one to several."""
    out, part, held = [], 0, 0
    for size in sorted(sizes, reverse=True):
        n = sizes[size]
        if held and held + n > RANGE_ROWS:
            part, held = part + 1, 0
        parts = max(1, -(-n // RANGE_ROWS))
        out.append((size, part, parts))
        part, held = (part + parts, 0) if parts > 1 else (part, held + n)
    return out


def _matched(todo: DataFrame, gaps: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, int, bool]:
    """One round: (places, pieces left with their rank from 0, gaps, number of pieces left, whether to ask again)."""
    rows = todo.select(F.col("unit").alias("id"), F.col("length").cast("int").alias("size"), F.lit(False).alias("gap")).unionByName(gaps.select(F.col("sequence_id").alias("id"), F.col("room").cast("int").alias("size"), F.lit(True).alias("gap")))
    sizes = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    ranges = _ranges(sizes)
    last = ranges[-1][1] + ranges[-1][2] - 1
    dealt = todo.sparkSession.createDataFrame(ranges, "size int, first int, parts int")
    ranged = rows.join(F.broadcast(dealt), "size").select("size", "id", "gap", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))
    swept = materialize(ranged.groupBy("part").applyInArrow(_swept(capacity, last), _SWEPT), "swept")
    counts = {(r["part"], r["kind"]): r["n"] for r in swept.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few rows a range
    placed = swept.filter(F.col("kind") == PLACED).select(F.col("id").alias("unit"), "sequence_id", "offset")
    gaps = swept.filter(F.col("kind").isin(GAP, LATER)).select(F.col("id").alias("sequence_id"), F.col("size").alias("room"))
    parts = sorted({p for p, _ in counts})
    left = sum(counts.get((p, PIECE), 0) for p in parts)
    crossing = [p for p in parts if counts.get((p, PIECE)) and any(counts.get((q, GAP)) for q in parts if q < p)][:1] if len(parts) > 1 else []
    if not crossing:
        before, at = [], 0
        for p in parts:
            before.append((p, at))
            at += counts.get((p, PIECE), 0)
        ahead = F.broadcast(todo.sparkSession.createDataFrame(before, "part int, before long"))
        rest = swept.filter(F.col("kind") == PIECE).join(ahead, "part").select(F.col("id").alias("unit"), F.col("size").cast("long").alias("length"), (F.col("before") + F.col("rank") - 1).alias("rank"))
        return placed, rest, gaps, left, False
    # brackets: a gap opens a level, a piece closes the one that is open; at each level they come in turn
    base, height = [], 0
    for p in parts:
        base.append((p, height, height - counts.get((p, PIECE), 0)))
        height += counts.get((p, GAP), 0) + counts.get((p, SLOT), 0) - counts.get((p, PIECE), 0)
    heights = F.broadcast(todo.sparkSession.createDataFrame(base, "part int, height long, low long"))
    level = F.when(F.col("kind") == PIECE, F.col("height") - F.col("rank") + 1).otherwise(F.col("low") + F.col("rank"))
    brackets = swept.filter(F.col("kind").isin(PIECE, GAP, SLOT)).join(heights, "part").withColumn("level", level)
    turn = Window.partitionBy("level").orderBy("part", "kind")
    is_piece = F.col("kind") == PIECE
    met = brackets.select("*", F.when(is_piece & (F.lag("kind").over(turn) > PIECE), F.struct(F.lag("id").over(turn).alias("sequence_id"), F.lag("size").over(turn).alias("room"))).alias("met")).filter(is_piece)
    met = materialize(met.select(F.col("id").alias("unit"), F.col("size").alias("length"), "level", "met"), "met")
    # several slots of a gap: its pieces lie one behind another
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = met.filter("met is not null").select("unit", "length", "met.*").withColumn("until", F.sum("length").over(inside))
    placed = placed.unionByName(joined.select("unit", "sequence_id", (F.lit(capacity) - F.col("room") + F.col("until") - F.col("length")).cast("int").alias("offset")))
    used = joined.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    gaps = gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("room") - F.coalesce("used", F.lit(0))).cast("int").alias("room")).filter("room > 0")
    # a piece that nothing holds is the first at its level, and these levels are 0, -1, -2, ..
    rest = met.filter("met is null").select("unit", F.col("length").cast("long").alias("length"), (-F.col("level")).alias("rank"))
    n = rest.count()
    return placed, rest, materialize(gaps, "gaps"), n, n < left


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keep_space: bool = False) -> DataFrame:
    """One row per piece of the rows of ``docs`` (doc_id, text): where it lies in which sequence.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone.  Only documents longer
    than ``capacity`` are cut.  Rows that repeat a doc_id are documents of their own; doc_id may be
    null; ties of length go by the order in which pieces were read.  Other columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; no rows give none.
    """
    bound_batches(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = materialize(typed.mapInArrow(_tokenized(tokenizer, keep_space, end_id, capacity), "unit long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    placed = best_fit(cut.select("unit", "length"), capacity)
    return cut.join(placed, "unit").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """unit, sequence_id, offset of every row of ``pieces`` (unit, length); a sequence has the number of the first piece in it."""
    step = F.least(F.floor(capacity / F.col("length")), F.lit(LAST)).cast("int")
    pieces = pieces.withColumn("step", step)
    counts = {r["step"]: r["n"] for r in pieces.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}  # LAST rows at most
    alone = pieces.filter("step = 1")
    out = alone.select("unit", F.col("unit").alias("sequence_id"), F.lit(0).alias("offset"))
    gaps = alone.select(F.col("unit").alias("sequence_id"), (F.lit(capacity) - F.col("length")).cast("int").alias("room")).filter("room > 0")
    for k in sorted(k for k in counts if k > 1):
        todo, again = pieces.filter(F.col("step") == k).select("unit", "length"), True
        while again:
            placed, todo, gaps, left, again = _matched(todo, gaps, capacity)
            out = out.unionByName(placed)
            if not left or again:
                again = bool(left)
                continue
            # sequences to open, and the pieces that each takes at once: in the last superstep no more than the tokens fill
            total, longest = todo.agg(F.sum("length"), F.max("length")).first()
            each = k if k < LAST else capacity // longest
            first = left if k < LAST else each * -(-total // capacity)
            chunk = Window.partitionBy(F.floor(F.col("rank") / each))
            filled = chunk.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            opened = todo.filter(F.col("rank") < first).select("unit", "length", F.first("unit").over(filled).alias("sequence_id"), F.sum("length").over(filled).alias("until"))
            opened = materialize(opened, "opened")
            new = opened.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("room")).filter("room > 0")
            todo, again = todo.filter(F.col("rank") >= first), left > first
            out = out.unionByName(opened.select("unit", "sequence_id", (F.col("until") - F.col("length")).cast("int").alias("offset")))
            gaps = gaps.unionByName(new)
    return out
