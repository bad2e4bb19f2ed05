"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words; a document of it is due rate = target / size of source times, that is its whole
part in full copies and the fraction as an inclusion probability.  The flight phase moves these probabilities
through the null space of two balancing constraints, expected words and expected documents: of three undecided
documents some direction changes neither sum, and moving along it until a probability is 0 or 1 decides one of them.
At the end two at most are undecided.

Sources are worked on in blocks of bounded size in parallel; what a block leaves undecided (two documents) goes to
blocks of the next level, with its probabilities as they are, so all sums still hold.  The last block of a source
lands: its remainder is decided, and a few documents exchanged, so that the words come nearest to the target.  Directions
and landings depend on hashes of doc_id, text and source alone, so reruns agree.

Rows equal in these three are units of their own, numbered from 0; which of them has which number makes no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, hot_lookup, materialize
from lumenfold.llm._text import mix, pieces, tenant, words

BLOCK = 2_000
#: The columns of a unit on its way: a document, its source, its words, its probability.
_UNIT = "unit long, skey string, size long, p double"
_EDGE = 1e-9


def _counted(batches):
    """base, doc_id, source and size of rows, with the task and the row's number in it."""
    from pyspark import TaskContext

    tenant("mixing")
    part, at_row = TaskContext.get().partitionId(), 0
    for rows, data, offsets in pieces(batches, "text"):
        _, _, at = words(data, offsets)
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(np.diff(at)), pa.array([part] * n, pa.int32()), pa.array(np.arange(at_row, at_row + n))], names=["base", "doc_id", "source", "size", "part", "at"])
        at_row += n


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Each source's target: ``share`` of all sizes by weight, none above ``most`` times its own size.

    Sources take the weights in turn by code point, null last.  What a capped source can't take goes to the
    others by weight until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not above:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in set(above)]
    return out


def flight(size: list[float], p: list[float], coin: list[float]) -> list[float]:
    """Probabilities moved until two at most are undecided; the sums of p and of size * p hold.

    ``coin``: a number from 0 to 1 for each unit, which chooses between the two ends of a direction.
    """
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if not _EDGE < p[i] < 1 - _EDGE:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            # u with ua + ub + uc = 0 and size-weighted sum 0; equal sizes leave the plane ua + ub = 0
            ua, ub, uc = size[b] - size[c], size[c] - size[a], size[a] - size[b]
            if not (ua or ub or uc):
                ua, ub, uc = 1.0, -1.0, 0.0
            up = down = float("inf")
            for k, u in ((a, ua), (b, ub), (c, uc)):
                if u > 0:
                    up, down = min(up, (1 - p[k]) / u), min(down, p[k] / u)
                elif u < 0:
                    up, down = min(up, p[k] / -u), min(down, (1 - p[k]) / -u)
            step = up if coin[c] < down / (up + down) else -down
            for k, u in ((a, ua), (b, ub), (c, uc)):
                p[k] += step * u
                if p[k] < _EDGE or p[k] > 1 - _EDGE:
                    p[k] = float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray, aim: float) -> np.ndarray:
    """The undecided (two at most) decided, so that the words come as near to ``aim`` as they can.

    Then, while it brings them nearer, the best exchange: a document taken for one that isn't, which keeps
    the documents' number; or one more or fewer.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    base = float((size * (p == 1)).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(base + sum(size[i] for j, i in enumerate(open_) if m >> j & 1) - aim), m))
    for j, i in enumerate(open_):
        p[i] = best >> j & 1
    for _ in range(4):
        lack = aim - float((size * p).sum())
        if abs(lack) < 0.5:
            break
        yes, no = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        moves = [(abs(lack - s * size[i]), (int(i),)) for s, group in ((1, no), (-1, yes)) if len(group) for i in [group[np.abs(lack - s * size[group]).argmin()]]]
        if len(yes) and len(no):
            order = no[np.argsort(size[no], kind="stable")]
            want = lack + size[yes]
            at = np.searchsorted(size[order], want)
            for shift in (at - 1, at):
                k = order[np.clip(shift, 0, len(order) - 1)]
                gap = np.abs(want - size[k])
                i = int(gap.argmin())
                moves.append((float(gap[i]), (int(yes[i]), int(k[i]))))
        gain, flips = min(moves, key=lambda m: (m[0], -len(m[1]), m[1]))
        if gain >= abs(lack):
            break
        for i in flips:
            p[i] = 1 - p[i]
    return p


def _flown(table: pa.Table) -> pa.Table:
    unit, size, p = table.column("unit").to_numpy(), table.column("size").to_numpy(), table.column("p").to_numpy()
    order = np.lexsort((unit, -size))
    unit, size, p = unit[order], size[order], p[order]
    coin = (mix(unit.view(np.uint64) ^ np.uint64(0xC0FFEE)) >> np.uint64(11)).astype(float) / float(1 << 53)
    words_of = size.astype(float)
    out = np.array(flight(words_of.tolist(), p.tolist(), coin.tolist()))
    if table.column("final")[0].as_py():
        out = landing(words_of, out, float((words_of * p).sum()))
    return pa.table({"unit": unit, "skey": table.column("skey").take(pa.array(order)), "size": size, "p": pa.array(out, pa.float64())})


def _base():
    """A number for rows equal in doc_id, text and source."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    return F.xxhash64(F.col("doc_id"), text, text.isNull(), source, source.isNull())


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (base, part, at) with a number from 0 among those of one base, however many: by task, then within it."""
    counts = rows.groupBy("base", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("base").alias("__base"), F.col("part").alias("__part"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    joined = rows.join(counts, (F.col("base") == F.col("__base")) & (F.col("part") == F.col("__part")))
    return joined.select(*rows.columns, (F.col("ahead") + F.row_number().over(Window.partitionBy("base", "part").orderBy("at")) - 1).alias("number"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Returns base (a hash of these three), number (of the row among those equal in them), doc_id, source, size (words of the text; null has 0),
    source_size, target (of its source) and copies.  A row of size 0 is taken at its source's rate too, by the same draw.
    Null is a source of its own.  Repeated rows are drawn each.  Other columns are ignored; no rows give none.
    Sources and their sizes (a row per source) go to the driver, which shares out the targets.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    sized = docs.select(_base().alias("base"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = materialize(sized.mapInArrow(_counted, "base long, doc_id long, source string, size long, part int, at long"), "sizes")
    repeated = materialize(sized.groupBy("base").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("base", "times"), "repeated")
    sized = sized.withColumn("number", F.lit(0).cast("long"))
    if repeated.limit(1).count():
        found = hot_lookup(sized, repeated, ["base"], "times", "at", ["times"])
        sized = materialize(found.filter("times is null").drop("times").unionByName(_numbered(found.filter("times is not null").drop("times", "number"))), "sizes")
    sized = sized.select("base", "number", "doc_id", "source", "size", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.when(F.col("number") > 0, F.xxhash64("base", "number")).otherwise(F.col("base")).alias("unit"))
    totals = {r["source"]: (r["n"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    aim = targets({s: n for s, (n, _) in totals.items()}, weights, share, most)
    plan = [("n" if s is None else f"s{s}", n, float(aim.get(s, 0.0)), float(aim.get(s, 0.0) / n) if n else 0.0, rows) for s, (n, rows) in totals.items()]
    plan = spark.createDataFrame(plan, "skey string, source_size long, target double, rate double, rows long")
    sized = hot_lookup(sized, plan, ["skey"], "rows", "unit", ["source_size", "target", "rate"])
    level = materialize(sized.select("unit", "skey", "size", (F.col("rate") - F.floor("rate")).alias("p")).filter(f"p > {_EDGE} and p < {1 - _EDGE}"), "open")
    decided = []
    while True:
        counts = materialize(level.groupBy("skey").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")), "blocks")
        if not counts.limit(1).count():
            break
        blocked = hot_lookup(level, counts, ["skey"], "rows", "unit", ["blocks"]).select("unit", "skey", "size", "p", F.pmod(F.xxhash64("unit"), F.col("blocks")).alias("block"), (F.col("blocks") == 1).alias("final"))
        flown = materialize(blocked.groupBy("skey", "block").applyInArrow(_flown, _UNIT), "flown")
        decided.append(flown.filter("p = 0 or p = 1").select("unit", F.col("p").cast("int").alias("drawn")))
        level = flown.filter("p > 0 and p < 1")
    drawn = decided[0] if decided else spark.createDataFrame([], "unit long, drawn int")
    for more in decided[1:]:
        drawn = drawn.union(more)
    copies = F.floor(F.col("rate") + _EDGE).cast("long") + F.coalesce("drawn", F.lit(0))
    return sized.join(drawn, "unit", "left").select("base", "number", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, all columns as they are, the others gone.

    Rows equal in doc_id, text and source share their copies out as evenly as they go, in an order of all their columns.  Nulls as in
    :func:`mix_sources`; no rows give none.
    """
    taken = materialize(mix_sources(docs, weights, share, most).groupBy("base").agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__rows")), "taken")
    keyed = docs.withColumn("__unit", _base())
    once = keyed.join(taken.filter("__rows = 1 and __sum > 0").select(F.col("base").alias("__unit"), "__sum"), "__unit")
    if taken.filter("__rows > 1").limit(1).count():
        turn = F.row_number().over(Window.partitionBy("__unit").orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))) - 1
        several = keyed.join(taken.filter("__rows > 1").withColumnRenamed("base", "__unit"), "__unit").withColumn("__turn", turn)
        share_ = F.floor(F.col("__sum") / F.col("__rows")) + (F.col("__turn") < F.col("__sum") % F.col("__rows")).cast("int")
        once = once.unionByName(several.withColumn("__sum", share_.cast("long")).filter("__sum > 0").select(*once.columns))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sum")))).select(*[F.col(f"`{c}`") for c in docs.columns])
