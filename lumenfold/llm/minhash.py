"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set is its distinct ``width``-word shingles.  Its signature is SYMBOLS b-bit
MinHashes (b = 16), cut into CHUNKS chunks of CHUNK_SYMBOLS.  By pigeonhole two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS
differing symbols.  Each document therefore enters, for each chunk, under one key for every
choice of ERRORS positions to leave out: two documents within that distance share a key for certain.

Documents under one key are tied to the key's least document, never paired with one another; a task remembers the keys
that it found frequent, so such a key sends on a row per task.  The families so tied are searched in blocks for links by
breadth: signatures rule out most, the full sets confirm the rest exactly.  First each block is searched alone, with its family's head
beside it.  What is then linked to the head is one component, wherever it lies; only documents that are not meet the
other blocks.  So a family of near copies of one text costs its size, not its square.  Copies (equal sets) are one class from the start.

What Jaccard similarity 0.8 can lose: a pair at exactly 0.8 differs in 14 of 70 symbols on
average and shares no key with probability 0.0002; above it the loss falls fast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, connected_components, hot_lookup, materialize, merge_join
from lumenfold.llm._text import Known, mix, pieces, row_of, tenant, word_hashes, words

CHUNKS, CHUNK_SYMBOLS, ERRORS = 10, 7, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Documents and shingles of a block at most, on average; two blocks meet in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
#: In one batch, a key with more documents than this is tied together at once; only its least goes on.
LOCAL_KEY = 8

_U = np.uint64
_rng = np.random.default_rng(7)
_PERMUTE = _rng.integers(0, 1 << 62, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_MASKS = [m for m in combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS)]
_KEY = _rng.integers(0, 1 << 62, (CHUNKS, len(_MASKS), CHUNK_SYMBOLS), dtype=np.uint64) * _U(2) + _U(1)

SIGNATURES = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary"


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row's begin.

    A row with fewer words than ``width`` has its whole word sequence as the one shingle; no words, none.
    """
    starts, ends, at = words(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    rows = row_of(begin)
    first = at[:-1][rows] + (np.arange(begin[-1]) - begin[:-1][rows])
    value = np.full(len(first), 0x51ED270B, dtype=np.uint64)
    length = np.minimum(n, width)[rows]
    for k in range(width):
        there = length > k
        value[there] = mix(value[there] ^ h[first[there] + k]) + _U(k + 1)
    for i in np.flatnonzero(count > 1):
        value[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(value), dtype=bool)
    if len(value) > 1:
        new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return value[new], kept[begin]


def _set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first part of each set's hash; sets begin at ``at``."""
    return np.add.reduceat(mix(values ^ _U(0xA5A5A5A5)), at)


def signatures(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: a 128-bit hash of its set in two parts, and its b-bit MinHashes (zeros if empty)."""
    n = len(begin) - 1
    h1, h2, sig = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        at = begin[full]
        h1[full] = _set_hash(values, at)
        h2[full] = np.add.reduceat(mix(values + _U(0x7F4A7C15)), at)
        for k in range(SYMBOLS):
            sig[full, k] = (np.minimum.reduceat(values * _PERMUTE[k], at) & _U(0xFFFF)).astype(np.uint16)
    return h1, h2, sig


def _signed(width: int):
    def run(batches):
        tenant("minhash")
        for rows, data, offsets in pieces(batches, "text"):
            values, begin = shingles(data, offsets, width)
            h1, h2, sig = signatures(values, begin)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(begin)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([x.tobytes() for x in sig], type=pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"],
            )

    return run


def _keyed(batches):
    """Rows (key, doc, via): doc under a key, or, if via is set, doc tied to via already."""
    frequent = Known()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(len(ids), SYMBOLS).astype(np.uint64)
        ties = [np.zeros((0, 2), np.int64)]
        for c in range(CHUNKS):
            part = mix(sig[:, c * CHUNK_SYMBOLS : (c + 1) * CHUNK_SYMBOLS] + _U(1))
            keys, docs = [], []
            for m, mask in enumerate(_MASKS):
                key = mix((part[:, mask] * _KEY[c, m, : len(mask)]).sum(1) + _U(c * 1000 + m))
                order = np.lexsort((ids, key))
                k, d = key[order], ids[order]
                new = np.concatenate([[True], k[1:] != k[:-1]])
                heads = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                many = np.bincount(group) > LOCAL_KEY
                # a key known from earlier batches is tied to the document it had then
                hub, known = frequent.find(k[heads], d[heads])
                frequent.learn(k[heads][many & ~known], d[heads][many & ~known])
                tied = (many | known)[group] & (d != hub[group])
                # a tied row meets nobody under its key any more
                ties.append(np.stack([d[tied], hub[group][tied]], axis=1))
                keys.append(k[~tied])
                docs.append(d[~tied])
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.nulls(len(keys), pa.int64())], names=["key", "doc", "via"])
        # each tie once, under a key of its own, however many keys make it
        tie = np.unique(np.concatenate(ties), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(mix(tie[:, 0].view(np.uint64)).view(np.int64)), pa.array(tie[:, 0]), pa.array(tie[:, 1])], names=["key", "doc", "via"])


def _sets(width: int):
    """Shingle sets of the rows whose set is the class's that they were joined with (rows may repeat a doc_id)."""

    def run(batches):
        for rows, data, offsets in pieces(batches, "text"):
            values, begin = shingles(data, offsets, width)
            h1 = np.zeros(rows.num_rows, np.uint64)
            full = np.flatnonzero(np.diff(begin) > 0)
            if len(full):
                h1[full] = _set_hash(values, begin[full])
            mine = pa.array(np.flatnonzero(h1.view(np.int64) == rows.column(rows.schema.get_field_index("h1")).to_numpy()))
            raw = values.tobytes()
            packed = pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:], strict=True)], type=pa.binary())
            table = rows.drop_columns(["text", "h1"])
            yield pa.RecordBatch.from_arrays([*table.columns, packed], names=[*table.schema.names, "shingles"]).take(mine)

    return run


def linked(ids: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's documents, each confirmed on full sets.

    Breadth-first over the documents not reached yet, so each is compared with others
    only until it is reached.  A pair whose signatures agree in far too few symbols (4.8 standard deviations
    below the threshold's mean) is no candidate.
    """
    rate = percent / 100
    least = rate * SYMBOLS - 4.8 * (rate * (1 - rate) * SYMBOLS) ** 0.5
    size = np.array([len(s) for s in sets], dtype=np.int64)
    left = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = (100 * np.minimum(size[left], size[u]) >= percent * np.maximum(size[left], size[u])) & ((sig[left] == sig[u]).sum(1) >= least)
            at = np.flatnonzero(near)
            if not len(at):
                continue
            cand = left[at]
            begin = np.concatenate([[0], np.cumsum(size[cand])])
            pool = np.concatenate([sets[c] for c in cand])
            spot = np.minimum(np.searchsorted(sets[u], pool), size[u] - 1)
            same = np.add.reduceat((sets[u][spot] == pool).astype(np.int64), begin[:-1])
            yes = 100 * same >= percent * (size[u] + size[cand] - same)
            out += [(int(ids[c]), int(ids[u])) for c in cand[yes]]
            queue += cand[yes].tolist()
            gone = np.zeros(len(left), dtype=bool)
            gone[at[yes]] = True
            left = left[~gone]
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, signatures and sets of a block's rows, by node; a node that stands twice counts once."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    sig, packed = table.column("sig").to_pylist(), table.column("shingles").to_pylist()
    return nodes, np.frombuffer(b"".join(sig[i] for i in first), dtype=np.uint16).reshape(len(nodes), SYMBOLS), [np.frombuffer(packed[i], dtype=np.uint64) for i in first]


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        out = linked(*_unpacked(table), percent)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its class of near duplicates.

    Returns doc_id, n_shingles, class_id (least doc_id with the same set), component_id (least doc_id
    reachable over links 100 * intersection >= percent * union), kept (doc_id = component_id) and set_hash (of the set, 0 if empty).
    Null or wordless texts have an empty set and link with nothing.  Rows that repeat a doc_id are rows
    of their own, each with its own text's links.  A null doc_id cannot be named in a link: component_id is null, kept true.
    Other columns are ignored; no rows give none.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, text.isNull()).alias("text_hash"), text.alias("text")).mapInArrow(_signed(width), SIGNATURES), "signatures")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    # a class is its set: the signature is the same for all of it; its number is the node of all graphs
    classes = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", "sig").mapInArrow(_keyed, "key long, doc long, via long")
    hub = F.min("doc").over(Window.partitionBy("key"))
    ties = keyed.select("doc", F.coalesce("via", hub).alias("hub")).filter("doc <> hub")
    families = connected_components(ties)
    families = merge_join(families, classes.select("node", "cls", "n", "h1", "sig"), "node")
    extent = families.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    extent = extent.select("component", "members", F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = hot_lookup(families, extent, ["component"], "members", "node", ["blocks"])
    members = members.select("node", F.col("cls").alias("doc"), "h1", "sig", F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    packed = merge_join(texts, members, "doc").drop("doc").mapInArrow(_sets(width), "node long, sig binary, family long, blocks int, block int, shingles binary")
    packed = materialize(packed, "sets")
    # each block alone, the family's head in every one
    head = F.col("node") == F.col("family")
    within = packed.withColumn("block", F.explode(F.when(head, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = materialize(within.groupBy("family", "block").applyInArrow(_block_links(percent), "a long, b long"), "links")
    found = connected_components(links)
    if packed.filter("blocks > 1").limit(1).count():
        links = links.unionByName(_links_between_blocks(packed, found, percent))
        found = connected_components(links)
    named = merge_join(found, classes.select("node", "cls"), "node")
    least = named.groupBy("component").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("size"))
    named = hot_lookup(named, least, ["component"], "size", "node", ["least"])
    state = merge_join(classes.select("node", "h1", "h2", "copies", "cls"), named.select("node", F.col("component").alias("root"), "least"), "node", "left")
    state = state.select("h1", "h2", "copies", "cls", F.coalesce("least", "cls").alias("component"), F.coalesce("root", "node").alias("group_id"))
    known = ["doc_id", "text_hash", "n_shingles"]
    joined = hot_lookup(sets.select(*known, "h1", "h2"), state, ["h1", "h2"], "copies", "text_hash", ["cls", "component", "group_id"])
    alone = signed.filter("n_shingles = 0 or doc_id is null").select(*known, F.col("doc_id").alias("cls"), F.col("doc_id").alias("component"), F.lit(None).cast("long").alias("group_id"))
    out = joined.select(*known, "cls", "component", "group_id").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("cls").alias("class_id"), F.col("component").alias("component_id"), kept.alias("kept"), "text_hash", "group_id")


def _links_between_blocks(packed: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The links of documents that are not linked to their family's head with those in the family's other blocks."""
    slim = packed.filter("blocks > 1").select("node", "family", "blocks", "block").distinct()
    slim = merge_join(slim, found, "node", "left").select("node", "family", "blocks", "block", F.coalesce("component", "node").alias("root"))
    heads = slim.groupBy("family").agg(F.max(F.when(F.col("node") == F.col("family"), F.col("root"))).alias("head"), F.count(F.lit(1)).alias("members"))
    slim = materialize(hot_lookup(slim, heads, ["family"], "members", "node", ["head"]).withColumn("stray", F.col("root") != F.col("head")), "members")
    sizes = slim.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.count_if("stray").alias("strays"))
    sizes = sizes.filter("strays > 0").select("family", "members", F.ceil(F.col("strays") / BLOCK_ROWS).cast("int").alias("groups"))
    dealt = hot_lookup(slim, sizes, ["family"], "members", "node", ["groups"]).filter("groups is not null")
    # a group of strays meets every block
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = dealt.filter("stray").select("node", "family", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"), F.explode(every("blocks")).alias("block"))
    others = dealt.select("node", "family", F.explode(every("groups")).alias("group"), "block")
    meets = merge_join(asked.unionByName(others).distinct(), packed.select("node", "sig", "shingles"), "node")
    return materialize(meets.groupBy("family", "group", "block").applyInArrow(_block_links(percent), "a long, b long"), "links")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one of each group of near duplicates: that of the least doc_id, all columns as they are.

    Rows that repeat one doc_id with different texts are documents of their own: they go only where they are near
    duplicates of one that stays (of several with one doc_id the least by a hash of the text stays).  Of rows equal in
    doc_id and text one stays, the least by a hash of all its columns.  Null and wordless texts are near duplicates of nothing; rows with a
    null doc_id stay; no rows give none.
    """
    judged = near_duplicates(docs, width, percent).filter("doc_id is not null").select("doc_id", "text_hash", "group_id")
    grouped = judged.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    stays = materialize(grouped.unionByName(judged.filter("group_id is null").select("doc_id", "text_hash")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct(), "kept")
    text = F.col("text").cast("string")
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(text, text.isNull()) == F.col("__th"))
    out = merge_join(docs, stays, same, "left_semi")
    repeated = judged.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        first = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])))
        out = out.withColumn("__text", F.xxhash64(text, text.isNull())).withColumn("__first", first).filter("__first = 1").select(*docs.columns)
    return out.unionByName(docs.filter("doc_id is null"))
