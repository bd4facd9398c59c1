"""Repeated windows, by both methods, against counting all windows; leaks against comparing all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dubito.llm import decontaminate, rlz, segments, suffixes
from dubito.llm.text import Words, minimisers, mix, spans


def count_all(rows, length):
    """(repeated, later) marks of each row's words; rows in order of doc_id."""
    words = [(i, (t or "").encode().split()) for i, t in rows if i is not None]
    n, first = Counter(), {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            n[k] += 1
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, w in words:
        again, later = bytearray(len(w)), bytearray(len(w))
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if n[k] > 1:
                again[p : p + length] = b"\1" * length
                if first[k] != (i, p):
                    later[p : p + length] = b"\1" * length
        out.append((i, w, again, later))
    return out


def random_rows(seed, n=60):
    """Documents of few words, so that windows repeat in all ways, with copies and passages."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = "\n".join(rng.choice(parts) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(500)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5)))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("length,k", [(35, 12), (7, 3), (2, 1)])
def test_rlz_random(spark, length, k):
    rows = random_rows(length)
    got = {r.doc_id: r for r in rlz.remove_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, k).collect()}
    for i, w, again, _ in count_all(rows, length):
        kept = b" ".join(x for x, gone in zip(w, again, strict=True) if not gone)
        assert (got[i].n_words, got[i].n_removed, bytes(got[i].kept)) == (len(w), sum(again), kept)


@pytest.mark.parametrize("length,k", [(35, 12), (7, 3)])
def test_rlz_blocks_of_few_rows(spark, length, k):
    """Blocks that end within a seed's list find what one block finds."""
    rows = random_rows(length)
    marks = {i: bytearray(len(w)) for i, w, _, _ in count_all(rows, length)}
    for r in rlz.duplicate_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, k, rows=2).collect():
        marks[r.doc_id][r.start : r.start + r.n - 1 + length] = b"\1" * (r.n - 1 + length)
    assert marks == {i: again for i, _, again, _ in count_all(rows, length)}


def side(rows):
    wide = np.array([x for r in rows for x in r], ">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return segments.Side(segments._binary(wide, np.cumsum([0, *map(len, rows[:-1])]), np.array([len(r) for r in rows]), 1))


def test_rlz_parse_rests_on_its_factors(monkeypatch):
    """Windows of four words around one seed: in a factor, across its bound, and in no source."""
    seed = np.array([5, 5, 5, 5, 6])
    right, left = side([[1, 2, 3], [1, 2, 4], [1, 2, 4, 9], [1, 8], [1, 2, 3]]), side([[7, 6], [5], [7, 6], [7], [7, 6]])
    once = np.ones(5, np.int64)
    found, undecided = rlz.parse(seed, right, left, once, 4, (False, False))
    # 6 7 | 1 2 stands in the first and the third segment, which aren't neighbours
    assert found.tolist() == [[False, False, True], [False] * 3, [False, False, True], [False] * 3, [False] * 3] and not undecided.any()
    assert rlz.parse(seed, right, left, once, 4, (True, True))[1].any()
    assert rlz.parse(seed, right, left, np.array([1, 1, 1, 1, 2]), 4, (False, False))[0][4].tolist() == [False, True, True]
    monkeypatch.setattr(rlz, "factors", lambda s, r, t: (np.zeros(len(s) - 1, np.int64),) * 2)
    assert not rlz.parse(seed, right, left, once, 4, (False, False))[0].any()


def test_suffixes_rest_on_their_neighbours(monkeypatch):
    seed = np.array([5, 5, 5, 5, 6])
    right, left = side([[1, 2, 3], [1, 2, 4], [1, 2, 4, 9], [1, 8], [1, 2, 3]]), side([[7, 6], [5], [7, 6], [7], [7, 6]])
    doc, place = np.array([4, 1, 2, 1, 1]), np.array([2, 1, 2, 9, 2])
    judge = lambda ends=(False, False), copies=(1, 1, 1, 1, 1): suffixes.occurrences(seed, right, left, doc, place, np.array(copies), 4, ends)
    found, first, undecided = judge()
    assert found.tolist() == [[False, False, True], [False] * 3, [False, False, True], [False] * 3, [False] * 3] and not undecided.any()
    assert np.argwhere(first).tolist() == [[2, 2]]
    assert not judge((True, True))[0].any() and judge((True, True))[2].any()
    found, first, _ = judge(copies=(1, 1, 1, 1, 3))
    assert found[4].tolist() == first[4].tolist() == [False, True, True]
    monkeypatch.setattr(suffixes, "agreements", lambda s, r: np.zeros(len(s) - 1, np.int64))
    assert not judge()[0].any()


@pytest.mark.parametrize("length,k", [(50, 10), (9, 3)])
def test_suffixes_blocks_of_few_rows(spark, length, k):
    rows = random_rows(100 + length)
    want = {i: (again, later) for i, _, again, later in count_all(rows, length)}
    marks = {i: (bytearray(len(a)), bytearray(len(a))) for i, (a, _) in want.items()}
    for r in suffixes.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, k, rows=2).collect():
        for m in marks[r.doc_id][: 1 if r.first else 2]:
            m[r.start : r.start + r.n - 1 + length] = b"\1" * (r.n - 1 + length)
    assert marks == want


@pytest.mark.parametrize("length,k", [(50, 10), (9, 3), (4, 2)])
def test_suffixes_random(spark, length, k):
    rows = random_rows(100 + length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.find_passages(df, length, k).collect()}
    cut = {r.doc_id: r.text.encode().split() for r in suffixes.cut_repeats(df, length, k).collect()}
    for i, w, again, later in count_all(rows, length):
        assert (got[i].n_repeated if i in got else 0) == sum(again) and (got[i].n_later if i in got else 0) == sum(later)
        if i in got:
            assert sorted(p for s in got[i].spans for p in range(s.start, s.start + s.n)) == [p for p, x in enumerate(again) if x]
        kept = [x for x, gone in zip(w, later, strict=True) if not gone]
        assert cut.get(i, []) == kept and (i in cut) == bool(kept or not w)


def test_edges(spark, edge, edge_rows, nothing):
    want = {}
    for i, w, again, _ in count_all(edge_rows, rlz.WINDOW):
        kept = b" ".join(x for x, gone in zip(w, again, strict=True) if not gone)
        want.setdefault(i, []).append((len(w), sum(again), hashlib.sha256(kept).hexdigest()))
    got = {}
    for r in rlz.digest_substrings(edge).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert rlz.digest_substrings(nothing).count() == 0 and suffixes.find_passages(nothing).count() == 0 and suffixes.cut_repeats(nothing).count() == 0
    found = {r.doc_id for r in suffixes.find_passages(edge).collect()}
    assert found == {5, 6, 8, 9, 10, 13, -5}
    cut = suffixes.cut_repeats(edge)
    assert cut.columns == edge.columns and cut.schema == edge.schema
    rows = {r.doc_id: r for r in cut.collect() if r.doc_id is not None}
    assert 6 not in rows and rows[8].text == "tail a" and rows[8].n_chars == 6 and rows[1].text is None and rows[9].text == "head b " and rows[-5].text.startswith("negative id passage0")
    assert cut.where("doc_id is null").count() == 2


def test_leaks(spark, edge, nothing, benchmark):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for i in range(80):
        w = [f"T{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        if i % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                leak[rng.randrange(len(leak))] = "changed"
            w[len(w) // 2 : len(w) // 2] = leak
        docs.append((i, ", ".join(w) + "."))
    want = {}
    for d, t in docs:
        w = t.lower().replace(",", " ").replace(".", " ").split()
        marks = set()
        for i, u in items:
            u = u.split()
            for p in range(len(w) - 11):
                for q in range(len(u) - 11):
                    if sum(a == b for a, b in zip(w[p : p + 12], u[q : q + 12], strict=True)) >= 10:
                        want.setdefault(d, set()).add(i)
                        marks |= set(range(p, p + 12))
        if marks:
            want[d] = (sorted(want[d]), len(marks))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MOST, 4):  # a sparse filter, one that lets everything pass
        got = {r.doc_id: (list(r["items"]), r.n_leaked) for r in decontaminate.find_leaks(df, b, most).collect()}
        assert got == want and len(want) > 20
        assert {r.doc_id for r in decontaminate.clean(df, b, most).collect()} == {d for d, _ in docs} - set(want)
    got = {r.doc_id: list(r["items"]) for r in decontaminate.find_leaks(edge, benchmark).collect()}
    assert got == {8: [6], 9: [6], 10: [6], -5: [6]}
    kept = decontaminate.clean(edge, benchmark)
    assert kept.schema == edge.schema and kept.count() == edge.count() - 5  # with the passage without an id
    for d, b in ((nothing, benchmark), (edge, benchmark.where("false"))):
        assert decontaminate.find_leaks(d, b).count() == 0 and decontaminate.clean(d, b).count() == d.count()


def test_finer_seeds_meet_where_two_places_differ():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, (40, 12), dtype=np.uint64)
    b = a.copy()
    wrong = []
    for i in range(40):
        at = rng.choice(12, i % 5, replace=False)
        b[i, at] += np.uint64(1)
        wrong.append(len(at))
    masks = np.zeros(40, np.int32)
    for i, (x, y) in enumerate(zip(decontaminate._seeds(a.ravel()), decontaminate._seeds(b.ravel()), strict=True)):
        masks |= (x[::12] == y[::12]).astype(np.int32) << i
    seeds = [{(r, s) for r, s in zip(*map(np.ndarray.tolist, decontaminate.finer_seeds(m, k)), strict=True)} for m, k in ((a, np.full(40, 63)), (b, masks))]
    met = {r for r, _ in seeds[0] & seeds[1]}
    assert met == {i for i in range(40) if wrong[i] <= 2}


@pytest.mark.parametrize("n", [60, 120])
def test_templated_items_grow_in_proportion(spark, n):
    """Items and texts that share six tokens of twelve: nothing leaks but what is copied, and few pairs meet."""
    text = lambda kind, i: " ".join(f"fixed{j}" if j // 3 % 2 else f"{kind}{i}x{j}" for j in range(24))
    items = spark.createDataFrame([(i, text("item", i)) for i in range(n)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text("text", i)) for i in range(n)] + [(n, "see " + text("item", 7))], "doc_id long, text string")
    assert [(r.doc_id, list(r["items"]), r.n_leaked) for r in decontaminate.find_leaks(docs, items).collect()] == [(n, [7], 24)]
    test = decontaminate.benchmark_windows(items)
    found = decontaminate.candidates(docs.select(F.col("doc_id").alias("key"), "text"), "long", decontaminate.build_filter(test))
    own, other = (w.groupBy("whole").agg(F.first("tokens").alias("tokens"), F.bit_or("masks").alias("masks")) for w in (found, test))
    met = decontaminate._sown(own, "own").join(decontaminate._sown(other, "other"), "seed").select("own", "other").distinct().count()
    assert met <= 13 + n


def test_words_and_minimisers():
    w = Words(pa.array(["a bb  ccc\nd", None, "", " x", "y ", "zz", "é\x0bq"]))
    assert [w.word(i) for i in range(len(w.starts))] == [b"a", b"bb", b"ccc", b"d", b"x", b"y", b"zz", "é".encode(), b"q"] and list(w.count) == [4, 0, 0, 1, 1, 1, 2]
    h = np.arange(100, dtype=np.uint64) * np.uint64(7)
    for k in (1, 2, 3, 12, 35, 50):
        assert len(spans(h, k)) == 101 - k and spans(h, k)[3] == spans(h[3 : 3 + k], k)[0]
    g = mix(h % np.uint64(13))
    for i, m in enumerate(minimisers(g, 7)):
        assert m == i + 6 - np.argmin((g[i : i + 7] >> np.uint64(32))[::-1])
    long = Words(pa.array(["q" * 300 + " " + "q" * 301, "q" * 300])).hashes()
    assert long[0] == long[2] != long[1]
