"""Near duplicates of texts and vectors, substring dedup and top-k against brute force."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import minhash
from lumenfold.llm._spark import connected_components, hot_lookup
from lumenfold.llm.embedding import near_vectors
from lumenfold.llm.minhash import deduplicated, near_duplicates
from lumenfold.llm.substring import digest, lengths, without_repeats
from lumenfold.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, kept string"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(text):
    return (text or "").encode().split()


def near_texts(seed=1, families=6, size=14, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(size):
            out.append(" ".join(rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else w for w in base))
    return out


def components(nodes, links):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def brute(texts, width, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components(range(len(sets)), links)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    texts = [*near_texts(), None, "", "one", "ONE", "a b", "A\tB", " \n ", "x y z", "é É", *["same text here again and again"] * 30]
    n, want = brute(texts, width)
    got = {r["doc_id"]: r for r in near_duplicates(table(spark, texts), width).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    texts = near_texts(2, 3, 20)
    _, want = brute(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, texts), 2).collect()} == want


def test_strays_of_a_large_family_meet_its_other_blocks(spark, monkeypatch):
    """A chain of texts, each linked to the next alone, ends far from the family's head."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts, now = [], list(base)
    for _ in range(30):
        texts.append(" ".join(now))
        now[rng.randrange(60)] = f"v{rng.random()}"
    texts += [" ".join(base[:50] + [f"u{i}"] + base[51:]) for i in range(20)]
    _, want = brute(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, texts), 2).collect()} == want


def test_rows_of_one_doc_id_keep_their_own_texts(spark):
    """Signatures and sets of different rows are never paired."""
    a, b = near_texts(4, 1, 2, 80), near_texts(5, 1, 2, 80)
    rows = near_duplicates(table(spark, [a[0], b[0], a[0] + " x", b[0] + " y"], [7, 7, 8, 9])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(7, 7), (7, 7), (8, 7), (9, 7)]
    assert len({r["group_id"] for r in rows}) == 2


def test_frequent_keys_are_known_for_a_whole_task():
    ids = np.arange(60)
    sig = [np.ones(minhash.SYMBOLS, np.uint16).tobytes()] * 60
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 20]), pa.array(sig[k : k + 20], pa.binary())], names=["node", "sig"]) for k in (0, 20, 40)]
    rows = [r for b in minhash._keyed(batches) for r in b.to_pylist()]
    assert {r["via"] for r in rows if r["doc"] != 0} == {0} and {r["via"] for r in rows if r["doc"] == 0} == {None}
    assert sum(r["via"] is not None for r in rows) == 59  # a tie for each, not one for each key


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    rows = near_duplicates(table(spark, ["a b c", "a b c", "q r s"], [None, 7, 7])).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in rows) == [("7", True), ("7", True), ("None", True)]
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, [long, long + " end"]), 2).collect()}
    assert got == {0: 0, 1: 0}


def test_deduplicated_keeps_one_of_each(spark):
    base = "one two three four five six seven eight nine ten"
    docs = table(spark, [base, base, "quite another text of some length here", None, base], [5, 3, 4, 8, 3])
    rows = docs.collect()
    docs = spark.createDataFrame([*rows, tuple(rows[2])[:1] + ("no near copy of what stands under four, but long",) + tuple(rows[2])[2:], rows[2], tuple(rows[1])[:1] + (base + " eleven",) + tuple(rows[1])[2:]], DOCS)
    out = deduplicated(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 4, 4, 8]
    assert len({r["text"] for r in out.collect() if r["doc_id"] == 4}) == 2


def test_signatures_share_a_key_within_the_distance():
    """Pigeonhole: any two signatures that differ in CHUNKS * (ERRORS + 1) - 1 symbols meet under a key."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.CHUNKS * (minhash.ERRORS + 1) - 1, replace=False)
        b[at] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["doc_id", "sig"])
        rows = [r for out in minhash._keyed([batch]) for r in out.to_pylist()]
        keys = [{r["key"] for r in rows if r["doc"] == d} for d in (1, 2)]
        assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5400)]
    want = {i: c for i, c in components({x for e in edges for x in e}, edges).items()}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and {i for i in want if any(i in e for e in edges if e[0] != e[1])} == set(got)


def test_components_by_stars(spark, monkeypatch):
    import lumenfold.llm._spark as shared

    monkeypatch.setattr(shared, "ONE_TASK_EDGES", 0)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed, limit", [(0, 320), (1, 450), (2, 320), (3, 600)])
def test_components_at_any_limit(spark, monkeypatch, seed, limit):
    """A limit between the edges at the start and those at the end of a round."""
    import lumenfold.llm._spark as shared

    monkeypatch.setattr(shared, "ONE_TASK_EDGES", limit)
    rng = random.Random(seed)
    edges = [(i, rng.randrange(i)) for i in range(1, 301)] + [(rng.randrange(301), rng.randrange(301)) for _ in range(700)]
    rng.shuffle(edges)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    assert len(rows) == 301 and {r["node"]: r["component"] for r in rows} == dict.fromkeys(range(301), 0)


def test_components_beyond_one_task(spark):
    """90,000 nodes and 290,000 edges in eight partitions, at the real limit."""
    rng = np.random.default_rng(1)
    a = np.concatenate([np.arange(1, 90_000), rng.integers(1, 90_000, 200_000)])
    b = (a * rng.random(len(a))).astype(np.int64)
    order = rng.permutation(len(a))
    edges = spark.createDataFrame(pa.table({"a": a[order], "b": b[order]}).to_pandas()).repartition(8)
    found = connected_components(edges)
    n, nodes, most = found.selectExpr("count(1)", "count(distinct node)", "max(component)").first()
    assert (n, nodes, most) == (90_000, 90_000, 0)


def test_hot_lookup(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, "none")], "id long, k string")
    sizes = rows.filter("k <> 'none'").groupBy("k").count().selectExpr("k", "count as n", "concat(k, '!') as v")
    out = hot_lookup(rows, sizes, ["k"], "n", "id", ["v"]).collect()
    assert len(out) == 3001 and all(r["v"] == (None if r["k"] == "none" else r["k"] + "!") for r in out)


def cut(texts, ids, width):
    first, out = {}, {}
    lists = {i: words(t) for i, t in zip(ids, texts, strict=True)}
    for i in sorted(lists):
        w = lists[i]
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first.setdefault(tuple(w[p : p + width]), i) < i:
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def passages(seed=3):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [make(n) for n in (49, 50, 51, 70, 120)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(shared) if rng.random() < 0.5 else make(rng.randrange(1, 90))
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return [*texts, texts[0], texts[3], "a " * 130, "a " * 90, "a " * 49, "", None, "   ", "b"]


@pytest.mark.parametrize("width", [50, 8])
def test_substring_dedup(spark, width):
    texts = passages()
    want = cut(texts, range(len(texts)), width)
    got = {r["doc_id"]: tuple(r)[1:] for r in digest(table(spark, texts).repartition(5), width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {i: v[:3] for i, v in want.items()}
    out = {r["doc_id"]: r for r in without_repeats(table(spark, texts), width).collect()}
    for i, (n, gone, _, kept) in want.items():
        if gone == n and n:
            assert i not in out
        else:
            assert out[i]["text"] == (kept if gone else texts[i]) and out[i]["n_chars"] == len(out[i]["text"] or "")


def test_levels_double():
    assert lengths(50) == [13, 25, 50] and all(b <= 2 * a for a, b in zip(lengths(1000)[:-1], lengths(1000)[1:], strict=True))


def test_substring_dedup_of_odd_tables(spark):
    assert digest(table(spark, [])).count() == 0
    text = " ".join(f"x{i}" for i in range(60))
    rows = digest(table(spark, [text, text, text], [None, 4, 4])).collect()
    assert [r["n_removed"] for r in rows] == [0, 0, 0]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


ODD = [None, [], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [0.0, -0.0]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=9).round(2)], 0) for i in range(260)]
    rows += [(300 + i, rows[i][1], 0) for i in range(30)] + [(400 + i, e, 0) for i, e in enumerate(ODD)] + [(None, rows[0][1], 0)]
    rows.append((450, [1e5] * 9, 0))
    whole = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    got = [tuple(r) for r in top_k(vectors(spark, rows, kind)).collect()]
    assert sorted(got) == sorted(want)
    assert top_k(vectors(spark, [], kind)).count() == 0


def test_top_k_beyond_doubles(spark):
    """Scores beyond 2 ** 53 are exact, those beyond a long are the nearest long."""
    rows = [(0, [3e14, 1.0], 0), (1, [3e14, 2.0], 0), (2, [-3e14, 3.0], 0), (50, [1e6, 1.0], 0), (51, [1e6, 3.0], 0), (52, [1e6, 2.0], 0)]
    whole = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows}
    want = []
    for q in (0, 50):
        scored = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in top_k(vectors(spark, rows, "double")).collect()) == sorted(want)


def test_top_k_broadcasts_nothing(spark, monkeypatch):
    """Many groups and query blocks, small on disk: the pairs of blocks must neither be broadcast nor written."""
    import lumenfold.llm.topk as t

    for name, value in (("GROUP_ROWS", 16), ("QUERY_ROWS", 4), ("PART_BLOCKS", 2), ("PARTS", 4)):
        monkeypatch.setattr(t, name, value)
    rng = np.random.default_rng(4)
    whole = rng.integers(-9, 9, size=(1200, 6))
    out = top_k(vectors(spark, [(i, [float(v) / 256 for v in e], 0) for i, e in enumerate(whole)]))
    want = []
    for q in range(0, 1200, 50):
        score = whole @ whole[q]
        want += [(q, k + 1, i, int(score[i])) for k, i in enumerate(sorted((i for i in range(1200) if i != q), key=lambda i: (-score[i], i))[:5])]
    assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "CartesianProduct" in plan


@pytest.mark.parametrize("wide", [1, 1e4, 1e7])
def test_top_k_bounds_with_floors(wide):
    """Whatever type the bounds are in, with floors of other groups or not, the best candidates stand."""
    from lumenfold.llm.topk import nra

    rng = np.random.default_rng(5)
    x, q = np.floor(rng.normal(size=(700, 8)) * wide * 20), np.floor(rng.normal(size=(30, 8)) * 20)
    own = rng.random((30, 700)) < 0.01
    score = np.where(own, -np.inf, q @ x.T)
    for kind in (np.float64, np.float32) if np.abs(x).max() * np.abs(q).max() * 8 < 2**24 else (np.float64,):
        for floor in (None, np.full(30, -np.inf), np.sort(score, axis=1)[:, -3], np.full(30, 2.0**62), np.where(np.arange(30) % 2, 0, -np.inf)):
            for i, found in enumerate(nra(x.astype(kind), q.astype(kind), 5, own, None, floor)):
                best = np.sort(score[i])[-5]
                must = np.flatnonzero((score[i] >= max(best, -np.inf if floor is None else floor[i])) & ~own[i])
                assert set(must) <= set(found) and not own[i][found].any()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors(spark, kind):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(8):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0.05, 0.25])], 0) for k in range(25)]
    rows += [(500 + k, rows[3][1], 0) for k in range(12)] + [(600 + k, [2 * x for x in rows[3][1]], 0) for k in range(2)] + [(700 + i, e, 0) for i, e in enumerate(ODD)]
    good = [(i, np.array(e, dtype=float)) for i, e, _ in rows if e and all(x is not None and math.isfinite(x) for x in e) and any(e) and len(e) == 16]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    ids = [i for i, _ in good]
    hit = unit @ unit.T >= 0.9
    links = [(ids[a], ids[b]) for a, b in combinations(range(len(ids)), 2) if hit[a, b]]
    want = {i: (0, i) for i, _, _ in rows} | {i: (int(hit[k].sum()) - 1, c) for k, (i, c) in enumerate(components(ids, links).items())}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(vectors(spark, rows, kind)).collect()}
    assert got == want


def test_near_vectors_in_many_blocks(spark, monkeypatch):
    import lumenfold.llm.embedding as e

    assert near_vectors(vectors(spark, [])).count() == 0
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([b + rng.normal(size=(30, 8)) * 0.1 for b in base])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = np.zeros((600, 600), bool)
    monkeypatch.setattr(e, "LEAF_ROWS", 16)
    for a, b, hit in e.joined(unit, None, unit[:, :4], None, 0.9):
        found[slice(*a), slice(*b)] |= hit
        found[slice(*b), slice(*a)] |= hit.T
    assert (found == (unit @ unit.T >= 0.9)).all()
    for a, b, hit in e.joined(unit[:250], unit[250:], unit[:250, :4], unit[250:, :4], 0.9):
        assert (hit == (unit[:250][slice(*a)] @ unit[250:][slice(*b)].T >= 0.9)).all()


def test_minhash_ties_to_document_minus_one():
    ids = np.arange(-1, 19)
    sig = pa.array([np.ones(minhash.SYMBOLS, np.uint16).tobytes()] * len(ids), pa.binary())
    rows = [r for b in minhash._keyed([pa.RecordBatch.from_arrays([pa.array(ids), sig], names=["doc_id", "sig"])]) for r in b.to_pylist()]
    assert {r["via"] for r in rows if r["doc"] != -1} == {-1} and {r["via"] for r in rows if r["doc"] == -1} == {None}


def test_near_duplicates_broadcast_hot_keys_alone(spark, monkeypatch):
    """Only tables bounded by HOT_SHARE go by way of the driver, however small the planner takes the others for."""
    from lumenfold.llm import _spark

    plans = []
    written = _spark.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (minhash, _spark):
        monkeypatch.setattr(module, "materialize", seen)
    docs = table(spark, near_texts())
    out = near_duplicates(docs)
    kept = deduplicated(docs)
    for df in (out, kept):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("__h_" in line for line in joins), [line for line in joins if "__h_" not in line]
    assert any("SortMergeJoin" in plan for plan in plans)
