"""Removal of passages that documents share, by level-wise doubling.

A window is WIDTH consecutive words.  Lengths double up to the width (13, 25, 50).  At each
length below it every window nominates its least-hashed subwindow of that length, so equal windows nominate the
same one wherever they stand.  Nominees that occur in one document alone end their windows; only windows
whose nominees repeat are extended to the next length.  At the full length every surviving window is
compared by 128 bits of hash, and is removed where a smaller doc_id has it too.

Rows that share a slice of text are compared there, and travel no further under the shared key; so a
passage that a third of all documents hold sends one row per task, which remembers what it found frequent.  Word-for-word copies are settled by a hash of the
whole sequence and take no part in the later levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, hot_lookup, materialize
from lumenfold.llm._text import Known, mix, pieces, row_of, tenant, window_hashes, word_hashes, words

WIDTH = 50
SECOND = 0x6C62272E07BB0142
_U = np.uint64
_TOP = np.iinfo(np.uint64).max


def lengths(width: int) -> list[int]:
    """The lengths of the levels, shortest first; each at most doubles."""
    out = [width]
    while len(out) < 2 or out[0] > 16:
        out.insert(0, -(-out[0] // 2))
    return out


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each run of ``width`` values."""
    f, fill = (np.minimum, _TOP) if least else (np.maximum, _U(0))
    n = len(values)
    blocks = np.full(-(-n // width) * width, fill, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


class Words:
    """The words of a slice of rows, and the windows inside rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.data, self.width = data, width
        self.starts, self.ends, self.at = words(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.count = np.diff(self.at)
        self.row = row_of(self.at)
        n = len(self.hashes) - width + 1
        self.inside = self.row[:n] == self.row[width - 1 :] if n > 0 else np.zeros(0, bool)

    def subwindows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``length`` words inside a row (others greatest of all), and each window's least."""
        g = window_hashes(self.hashes, length)
        g[self.row[: len(g)] != self.row[length - 1 :]] = _TOP
        return g, _sliding(g, self.width - length + 1, True)

    def alive(self, length: int, survivors: np.ndarray) -> np.ndarray:
        """Which windows still stand after ``length``, given where repeated nominees begin."""
        g, least = self.subwindows(length)
        kept = np.full(len(g), _TOP, dtype=np.uint64)
        kept[survivors] = g[survivors]
        return self.inside & (_sliding(kept, self.width - length + 1, True) == least) & (least != _TOP)

    def nominees(self, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the nominees of living windows begin, and their hashes."""
        g, least = self.subwindows(length)
        least = np.where(alive, least, _U(0))
        span = self.width - length + 1
        padded = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
        padded[span - 1 : span - 1 + len(least)] = least
        found = np.flatnonzero((g == _sliding(padded, span, False)) & (g != _TOP))
        return found, g[found]


def _local(h: np.ndarray, docs: np.ndarray, before: Known) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of one slice: which have two documents in this task at least, and one row of each of those hashes not sent yet."""
    order = np.lexsort((docs, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.concatenate([at[1:], [len(h)]]) - 1
    many = docs[order][at] != docs[order][last]
    sure = np.zeros(len(h), bool)
    _, known = before.find(h[order][at], docs[order][at])
    sure[order] = (many | known)[group]
    heads = order[at[many & ~known]]
    before.learn(h[heads], docs[heads])
    return sure, heads


_NOMINEES = "doc_id long, th long, pos array<int>, h long, sure boolean"


def _grouped(own: np.ndarray, pos: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One entry per distinct hash of a row: where it stands first in the arrays, and all its positions as lists."""
    order = np.lexsort((pos, *hashes, own))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = own[order][1:] != own[order][:-1]
        for h in hashes:
            new[1:] |= h[order][1:] != h[order][:-1]
    at = np.flatnonzero(new)
    return order[at], pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(order)]]), pa.int32()), pa.array(pos[order], pa.int32()))


def _nominated(doc: np.ndarray, th: np.ndarray, own: np.ndarray, pos: np.ndarray, h: np.ndarray, before: Known) -> pa.RecordBatch:
    """Rows for the shuffle by h, one per document and hash.

    A nominee known to repeat travels under a hash of its own; its hash goes once, without a document.
    """
    one, lists = _grouped(own, pos, h)
    own, first, h = own[one], pos[one], h[one]
    sure, heads = _local(h, doc[own], before) if len(h) else (np.zeros(0, bool), np.zeros(0, np.int64))
    key = np.where(sure, mix(doc[own].view(np.uint64) * _U(0x100000001B3) + first.astype(np.uint64)), h)
    none = np.concatenate([np.zeros(len(h), bool), np.ones(len(heads), bool)])
    both = np.concatenate([np.arange(len(h)), heads])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[own][both], mask=none), pa.array(th[own][both]), lists.take(pa.array(both)), pa.array(np.concatenate([key, h[heads]]).view(np.int64)), pa.array(np.concatenate([sure, np.ones(len(heads), bool)]))],
        names=["doc_id", "th", "pos", "h", "sure"],
    )


def _first(width: int, length: int):
    def run(batches):
        tenant("substring")
        before = Known()
        for rows, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets, width)
            whole = [np.zeros(rows.num_rows, np.uint64) for _ in range(2)]
            for k, seed in enumerate((_U(3), _U(SECOND))):
                full = np.flatnonzero(w.count)
                value = mix((w.hashes + seed) * (np.arange(len(w.hashes)) - w.at[:-1][w.row] + 1).astype(np.uint64))
                if len(full):
                    whole[k][full] = mix(np.add.reduceat(value, w.at[:-1][full]) + w.count[full].astype(np.uint64))
            raw = data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            pos, h = w.nominees(length, w.inside) if len(w.inside) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            own = w.row[pos]
            docs = rows.column(0).to_numpy(zero_copy_only=False)
            known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs = np.where(known, docs, 0).astype(np.int64)
            mine = known[own]
            pos, h, own = pos[mine], h[mine], own[mine]
            one, where = _grouped(own, pos - w.at[:-1][own], h)
            h, own = h[one], own[one]
            sure, heads = _local(h, docs[own], before) if len(h) else (np.zeros(0, bool), np.zeros(0, np.int64))
            head = np.zeros(len(h), bool)
            head[heads] = True
            ptr = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ptr, x if isinstance(x, pa.Array) else pa.array(x)) for x in (where, h.view(np.int64), sure, head)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(w.count), pa.array(sha), *(pa.array(x.view(np.int64)) for x in whole), *lists],
                names=["doc_id", "th", "n_words", "sha", "h1", "h2", "pos", "h", "sure", "head"],
            )

    return run


_FIRST = "doc_id long, th long, n_words long, sha string, h1 long, h2 long, pos array<array<int>>, h array<long>, sure array<boolean>, head array<boolean>"


def _survivors(rows: pa.RecordBatch, w: Words) -> np.ndarray:
    lists = rows.column(rows.schema.get_field_index("pos"))
    flat = lists.flatten().to_numpy()
    own = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return flat + w.at[:-1][own]


def _next(width: int, before: int, length: int):
    def run(batches):
        sent = Known()
        for rows, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets, width)
            doc, th = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            pos, h = w.nominees(length, w.alive(before, _survivors(rows, w)))
            own = w.row[pos]
            yield _nominated(doc, th, own, pos - w.at[:-1][own], h, sent)

    return run


_LAST = "doc_id long, th long, pos array<int>, len int, h1 long, h2 long, sure boolean"


def _last(width: int, before: int):
    def run(batches):
        asked, second = Known(), Known()  # by a window's first hash: a document that asks for it, the window's second hash
        for rows, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets, width)
            doc, th = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            pos = np.flatnonzero(w.alive(before, _survivors(rows, w)))
            if not len(pos):
                continue
            h1, h2 = window_hashes(w.hashes, width)[pos], window_hashes(w.hashes, width, SECOND)[pos]
            own = w.row[pos]
            d = doc[own]
            order = np.lexsort((d, h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            first = d[order][at]
            several = d[order][np.concatenate([at[1:], [len(order)]]) - 1] != first
            earlier, known = asked.find(a[at], first)
            other, _ = second.find(a[at], b[at].view(np.int64))
            asked.learn(a[at][several & ~known], first[several & ~known])
            second.learn(a[at][several & ~known], b[at].view(np.int64)[several & ~known])
            least = np.where(other == b[at].view(np.int64), np.minimum(first, earlier), first)[group]
            sure = np.zeros(len(pos), bool)
            sure[order] = d[order] > least
            # windows surely removed go as runs of neighbours, under a hash of their own
            s = np.flatnonzero(sure)
            if len(s):
                cut = np.concatenate([[True], (pos[s][1:] != pos[s][:-1] + 1) | (own[s][1:] != own[s][:-1])])
                begin = s[cut]
                size = np.diff(np.concatenate([np.flatnonzero(cut), [len(s)]]))
            else:
                begin, size = s, s
            # the others once per document and hash, with all their positions
            ask = np.flatnonzero(~sure)
            one, lists = _grouped(own[ask], pos[ask] - w.at[:-1][own[ask]], h1[ask], h2[ask])
            ask = ask[one]
            at = np.concatenate([ask, begin])
            run_pos = pos[begin] - w.at[:-1][own[begin]]
            key = mix(d[begin].view(np.uint64) ^ mix(run_pos.astype(np.uint64)))
            runs = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1), pa.int32()), pa.array(run_pos, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d[at]), pa.array(th[own[at]]), pa.concat_arrays([lists, runs]), pa.array(np.concatenate([np.ones(len(ask), np.int64), size]), pa.int32()),
                    pa.array(np.concatenate([h1[ask], key]).view(np.int64)), pa.array(np.concatenate([h2[ask], mix(key)]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(ask), bool), np.ones(len(begin), bool)])),
                ],
                names=["doc_id", "th", "pos", "len", "h1", "h2", "sure"],
            )

    return run


def _cut(width: int):
    def run(batches):
        for rows, data, offsets in pieces(batches, "text"):
            starts, ends, at = words(data, offsets)
            raw = data.tobytes()
            gone, texts = [], []
            for i, runs in enumerate(rows.column(rows.schema.get_field_index("runs")).to_pylist()):
                n = int(at[i + 1] - at[i])
                mark = np.zeros(n + 1, np.int64)
                for r in runs:
                    for p in r["pos"]:
                        mark[p] += 1
                        mark[p + r["len"] + width - 1] -= 1
                kept = np.flatnonzero(np.cumsum(mark)[:n] == 0) + at[i]
                gone.append(n - len(kept))
                texts.append(b" ".join(raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts])],
                names=["doc_id", "th", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _repeated(nominees: DataFrame) -> DataFrame:
    """Nominees that occur in two documents at least, by document."""
    by = Window.partitionBy("h")
    met = nominees.select("*", (F.max("sure").over(by) | (F.min("doc_id").over(by) < F.max("doc_id").over(by))).alias("met"))
    return met.filter("met and doc_id is not null").groupBy("doc_id", "th").agg(F.flatten(F.collect_list("pos")).alias("pos"))


def repeats(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(status, cuts): a row per row of ``docs`` (doc_id, text), and the documents that lose some of their words.

    status: doc_id, th (hash of the text), n_words, sha (of the words joined by one space), copy (a smaller
    doc_id has the same words throughout).  cuts: doc_id, th, n_removed, kept_sha256, kept_text, for rows
    that are no such copies.  A copy of ``width`` words or more loses all, a shorter one nothing.
    Null texts have no words.  Rows of one doc_id never remove each other's words.  A null doc_id is smaller than none
    and larger than none: its row keeps all.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("th"), F.col("text").cast("string").alias("text"))
    first, *middle, _ = lengths(width)
    seen = materialize(texts.mapInArrow(_first(width, first), _FIRST), "level")
    named = seen.filter("doc_id is not null and n_words > 0")
    copies = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = copies.filter("first < last").select("h1", "h2", "first", "n")
    status = hot_lookup(seen.select("doc_id", "th", "n_words", "sha", "h1", "h2"), copies, ["h1", "h2"], "n", "th", ["first"])
    status = materialize(status.select("doc_id", "th", "n_words", "sha", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")), "status")
    each = seen.filter("size(pos) > 0").select("doc_id", "th", F.explode(F.arrays_zip("pos", "h", "sure", "head")).alias("x"))
    own = F.when(F.col("x.sure"), F.xxhash64("doc_id", "x.h")).otherwise(F.col("x.h"))
    once = F.when(F.col("x.head"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = each.select("doc_id", "th", "x", F.explode(once).alias("bare")).select(
        F.when(~F.col("bare"), F.col("doc_id")).alias("doc_id"), "th", F.col("x.pos").alias("pos"), F.when(F.col("bare"), F.col("x.h")).otherwise(own).alias("h"), F.col("x.sure").alias("sure")
    )
    living = _repeated(rows).join(status.filter("copy").select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    # the windows at stake are in few documents: their texts are moved once
    cand = materialize(texts.join(living, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "pos"), "candidates")
    before = first
    state = cand
    for length in middle:
        nominees = state.mapInArrow(_next(width, before, length), _NOMINEES)
        state = cand.select("doc_id", "th", "text").join(_repeated(nominees), ["doc_id", "th"])
        before = length
    windows = state.mapInArrow(_last(width, before), _LAST)
    gone = windows.select("*", F.min("doc_id").over(Window.partitionBy("h1", "h2")).alias("least")).filter("sure or doc_id > least")
    runs = gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "len")).alias("runs"))
    cuts = cand.select("doc_id", "th", "text").join(runs, ["doc_id", "th"]).mapInArrow(_cut(width), "doc_id long, th long, n_removed long, kept_sha256 string, kept_text string")
    return status, cuts


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; see :func:`repeats`."""
    status, cuts = repeats(docs, width)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("copy") & (F.col("n_words") >= width)
    joined = status.join(cuts.select("doc_id", "th", "n_removed", "kept_sha256"), ["doc_id", "th"], "left")
    return joined.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut from text; documents of which nothing is left go, others keep their text as it was."""
    status, cuts = repeats(docs, width)
    change = cuts.select("doc_id", "th", F.lit(False).alias("__gone"), F.col("kept_text").alias("__kept"))
    change = change.unionByName(status.filter(F.col("copy") & (F.col("n_words") >= width)).select("doc_id", "th", F.lit(True).alias("__gone"), F.lit("").alias("__kept")).distinct())
    keyed = docs.withColumn("__th", F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    change = change.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th2"), "__gone", "__kept")
    out = keyed.join(change, (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__th2")), "left")
    out = out.filter("__gone is null or (not __gone and __kept <> '')")
    text = F.coalesce("__kept", "text")
    cols = [text.alias("text") if c == "text" else (F.when(F.col("__kept").isNotNull(), F.char_length("__kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c)) for c in docs.columns]
    return out.select(*cols)
