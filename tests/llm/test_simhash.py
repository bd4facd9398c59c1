"""Fingerprints and components against comparing all pairs."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from dubito.llm import simhash
from dubito.llm.components import components


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connect(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def families(seed):
    rng = np.random.default_rng(seed)
    fps = set()
    for x in rng.integers(0, 2**63, 25, dtype=np.uint64).tolist():
        for _ in range(14):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
    return sorted(fps)


def test_links(spark):
    fps = families(512)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node long, fp long").repartition(3)
    got = {r.node: r.component for r in components(simhash.near_links(df, 4)).collect()}
    want = connect(range(len(fps)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("dense,grow", [(8, False), (2, False), (8, True), (10**6, False)])
def test_links_of_dense_anchors(dense, grow, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    a = np.array(families(8), np.uint64)
    i, j = simhash._links(a, np.ones(len(a), bool), np.array([0, len(a) // 2]), 4, grow)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    half = len(a) // 2
    want = connect(range(len(a)), lambda p, q: (p < half) == (q < half) and bin(int(a[p]) ^ int(a[q])).count("1") <= 4)
    assert connect(range(len(a)), lambda p, q: (p, q) in pairs or (q, p) in pairs) == want


def test_which_of_repeated_rows_stays(spark):
    rows = [(1, "b c d e f", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "w"), (2, "q r s t u", "z")]
    kept = {tuple(r) for n in (1, 3) for r in simhash.keep_one(spark.createDataFrame(rows[::-1] if n == 3 else rows, "doc_id long, text string, lang string").repartition(n)).collect()}
    assert len(kept) == 2 and (2, "q r s t u", "z") in kept


def test_triples_cover_all_splits_of_four_bits():
    bits = [set(b) for _, b in simhash.tables()]
    blocks = [set(b) for b in simhash._blocks(6)]
    for errors in itertools.product(range(5), repeat=6):
        if sum(errors) == 4:
            assert any(sum(e for e, b in zip(errors, blocks, strict=True) if b <= t) <= 1 for t in bits)


def test_edges(spark, edge, edge_rows, nothing):
    rows = [(i, t) for i, t in edge_rows if i is not None]
    fp = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    near = connect(range(len(rows)), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4 or ids[a] == ids[b])
    least = {}
    for a, c in near.items():
        least[c] = min(least.get(c, ids[a]), ids[a])
    want = sorted((ids[a], f"{fp[a]:016x}", least[near[a]]) for a in near)
    assert sorted(map(tuple, simhash.simhash_groups(edge).select("doc_id", "fingerprint", "component_id").collect())) == want
    assert simhash.simhash_groups(nothing).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.schema == edge.schema
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in want}) and kept.where("doc_id is null").count() == 2
    assert simhash.keep_one(nothing).count() == 0


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000 and components(edges.where("false")).count() == 0


@pytest.mark.parametrize("hub", [1, 3, 64])
def test_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr("dubito.llm.components.HUB", hub)
    rng = np.random.default_rng(hub)
    edges = [(500, i) for i in range(300, 400)] + [(i, 900) for i in range(350, 450)] + rng.integers(1000, 1060, (40, 2)).tolist()
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {frozenset(e) for e in edges}
    want = connect(sorted({x for e in edges for x in e}), lambda a, b: frozenset((a, b)) in near)
    assert {x: got.get(x, x) for x in want} == want


def test_steps_have_tasks_for_their_rows(spark):
    """However many partitions are set, so that small graphs don't write their files by the thousand."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "u long, v long"))
        assert found.rdd.getNumPartitions() == 1 and {tuple(r) for r in found.collect()} == {(2, 1), (3, 1), (9, 7)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("shared", [4, 9, 45, 180])
def test_sets_similar_by_80_percent_share_an_anchor(shared):
    """The stage's candidates come from SimHash: from code words near to its sums, and from the signs of these."""
    rng, own, n = np.random.default_rng(shared), shared // 4, 300
    pairs = []
    for _ in range(n):
        s = rng.integers(0, 2**63, shared + own, np.uint64) * np.uint64(2)
        pairs.append((simhash.sums(s[: shared + own // 2]), simhash.sums(np.r_[s[:shared], s[shared + own // 2 :]])))
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    assert (((a > 0) != (b > 0)).sum(1) <= simhash.WIDE).all()
    x, y, t = simhash.soft_anchors(a), simhash.soft_anchors(b), simhash.TABLES
    assert ((x[:, :t] == y[:, :t]) | (x[:, t:] == y[:, :t]) | (x[:, :t] == y[:, t:])).any(1).all()
    strangers = np.roll(b, 1, 0)
    assert (((a > 0) != (strangers > 0)).sum(1) > simhash.WIDE).all()


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset()


@pytest.mark.parametrize("together,block,pivots", [(simhash.TOGETHER, 4096, 128), (3000, 7, 16)])
def test_stage_keeps_one_of_documents_similar_by_80_percent(spark, tmp_path, monkeypatch, together, block, pivots):
    import corpus_pipeline as cp

    for name, value in (("TOGETHER", together), ("BLOCK", block), ("PIVOTS", pivots)):
        monkeypatch.setattr(simhash, name, value)

    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        rows.append(" ".join(w))
        for _ in range(rng.integers(1, 6)):  # edited copies, some of copies: about 0.7 to 1 similar
            w = list(w)
            for at in rng.integers(0, len(w), rng.integers(0, max(2, len(w) // 45))):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append(" ".join(w))
    rows += ["a b", "A  b", "a c", "", " ", "a b c d e f g h i j k l m n", "x b c d e f g h i j k l m n"]
    rows += [" ".join(f"hub{i}" if i % 97 or i < 97 else f"edit{j}y{i}" for i in range(400)) for j in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    sets = [shingle_set(t) for t in rows]
    want = connect(range(len(rows)), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = sorted(r.doc_id for r in cp.simhash_near_dedup(spark, df, str(tmp_path)).collect())
    assert kept == sorted(set(want.values()))
    assert len(kept) < simhash.keep_one(df).count()  # four bits leave most edited copies


def test_stage_edges(spark, edge, nothing):
    kept = simhash.keep_one_similar(edge)
    assert kept.schema == edge.schema and simhash.keep_one_similar(nothing).count() == 0
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) and kept.where("doc_id is null").count() == 2 and {5, 6} & set(ids) == {5}
