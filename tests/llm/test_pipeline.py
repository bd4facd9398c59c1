"""The pipeline's stages on small tables, and run() against the stages in plain code."""

import random
import re

import numpy as np

import corpus_pipeline as cp
from dubito.llm import quality
from dubito.llm.queries import PIECES, vocabulary

from .test_models import plain_statistics
from .test_simhash import connect, shingle_set
from .test_spans import count_all


def test_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows, seen = docs, []
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in rows.collect()}
        rows = stage(spark, rows, data)
        seen.append((name, rows.columns, before, {r.doc_id: r.text for r in rows.collect()}))
    assert [c for _, c, _, _ in seen[:-1]] == [docs.columns] * 4
    assert all(set(after) <= before for _, _, before, after in seen)
    assert len(seen[0][3]) < docs.count() and len(seen[1][3]) < len(seen[0][3])
    # The end, from the documents of the stage before, with the library itself.
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    got = {r.doc_id: r for r in cp.run(spark, data).collect()}
    texts = seen[3][3]
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert list(got[i].ids) == library.encode(t) and got[i].text == t and got[i].n_tokens == len(got[i].ids)


def corpus(seed=9):
    """(doc_id, text) with junk, edited copies, shared passages and leaks; items; (doc_id, quality, toxic)."""
    rng = random.Random(seed)
    words = lambda n: [f"word{rng.randrange(4000)}" for _ in range(n)]
    passages = [" ".join(words(n)) for n in (55, 60, 80, 120)]
    items = [(i, " ".join(words(rng.randrange(10, 30)))) for i in range(6)]
    rows = []
    for _ in range(160):
        kind = rng.randrange(8)
        w = words(rng.randrange(40, 160))
        if kind == 0:
            rows.append(" ".join("$$$ ### !!! 12" for _ in range(rng.randrange(5, 60))))
            continue
        if kind == 1 and len(rows) > 9:
            w = rng.choice(rows).split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        elif kind == 2:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages).split(" ")
        elif kind == 3:
            leak = rng.choice(items)[1].split(" ")
            leak[rng.randrange(len(leak))] = "other"
            w[3:3] = leak
        rows.append(rng.choice([" ", "  ", "\n"]).join(w))
    docs = [*enumerate(rows), (200, None), (201, ""), (202, "a b")]
    labels = [(i, int("$$$" not in t), 0) for i, t in enumerate(rows) if i % 2]
    return docs, items, labels


def test_run_against_plain_code(spark, tmp_path):
    docs, items, labels = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    trees = quality.learn(df, marked)
    rows = {i: t for i, t in docs if trees.score(np.array([plain_statistics(t)], np.float32))[0] >= 0.5}
    assert 0 < len(rows) < len(docs)
    ids = sorted(rows)
    sets = {i: shingle_set(rows[i] or "") for i in ids}
    parts = connect(ids, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {i: rows[i] for i in ids if parts[i] == i}
    assert len(kept) < len(rows)
    cut = {}
    for i, w, _, later in count_all([(i, kept[i]) for i in sorted(kept)], 50):
        pieces = re.findall(r"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", kept[i] or "")
        assert len(pieces) == len(w)
        if not w or not all(later):
            cut[i] = "".join(p for p, gone in zip(pieces, later, strict=True) if not gone)
    assert any(cut[i] != (kept[i] or "") for i in cut)
    clean = {}
    for i, t in cut.items():
        w = re.findall(r"[^\W_]+", t.lower())
        hit = any(sum(a == b for a, b in zip(w[p : p + 12], u[q : q + 12], strict=True)) >= 10 for _, u in ((k, u.split()) for k, u in items) for p in range(len(w) - 11) for q in range(len(u) - 11))
        if not hit:
            clean[i] = t
    assert len(clean) < len(cut)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    got = {r.doc_id: (r.text, list(r.ids), r.n_tokens) for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == {i: (t, library.encode(t), len(library.encode(t))) for i, t in clean.items()}


def test_edges(spark, edge, benchmark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, edge.where("false")):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema == edge.schema and out.count() <= docs.count()
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.where("doc_id is not null").count()
