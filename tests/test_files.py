"""Sources, sinks, targets and inventory on small files."""

import json

import pytest
from pyspark.sql import functions as F

from dubito.operators import inventory as I
from dubito.operators import loaders, longform, metrics, sampling, select, targets
from dubito.sources import files, schemas, sqlite
from dubito.streaming import live
from dubito.streaming.ingest import ingest_buckets, ingest_once, progress, take_batch

GEN = {"question_idx": 1, "question": "q", "answer": "a", "prompt": "p", "low_temp_response": None, "raw_responses": ["x"]}


@pytest.fixture()
def gen(tmp_path):
    p = tmp_path / "gen.jsonl"
    rows = [GEN, GEN | {"question_idx": 2}, GEN | {"answer": "second"}, {"question_idx": 5}]
    p.write_text("\n".join(json.dumps(r) for r in rows[:3]) + "\n\n{bad\n" + json.dumps(rows[3]) + "\n")
    return str(p)


def test_read(spark, gen):
    good, bad = files.read_tolerant(spark, gen, schemas.GEN)
    assert good.count() == 4 and [r.value for r in bad.collect()] == ["{bad"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, gen, schemas.GEN).collect()
    v = {r.line: r.problem for r in files.validate(spark, gen).collect()}
    assert v == {1: None, 2: None, 3: "duplicate", 5: "malformed", 6: "missing field"}
    assert sorted(r[0] for r in select.gaps(files.done_keys(spark, gen, "question_idx"), "question_idx").collect()) == [3, 4]
    assert files.line_counts(spark, gen).first().n == 6 and files.line_count(spark, gen + "x") == -1


@pytest.mark.parametrize("each", [100, 1 << 16])
def test_gaps(spark, each, monkeypatch):
    monkeypatch.setattr(metrics, "EACH", each)
    keys = spark.createDataFrame([(2**62,), (2**62 + 3,), (2**62 + 3,), (None,), (2**62 + 200_000,)], "k long")
    got = [r.k for r in select.gaps(keys, "k").collect()]
    assert len(got) == len(set(got)) == 200_000 + 1 - 3 and min(got) == 2**62 + 1 and 2**62 + 3 not in got
    assert select.gaps(keys.where("false"), "k").count() == 0
    many = spark.range(0, 20_000, 3).withColumnRenamed("id", "k")
    assert sorted(r.k for r in select.gaps(many, "k").collect()) == [i for i in range(19_998) if i % 3]


def test_resume_and_rewrite(spark, tmp_path):
    out = str(tmp_path / "out")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "question_idx long, t string")
    files.append_resumed(items, out, "question_idx")
    files.append_resumed(items.union(spark.createDataFrame([(3, "c")], items.schema)), out, "question_idx")
    assert sorted(r.question_idx for r in spark.read.json(out).collect()) == [1, 2, 3]
    backup = files.rewrite(spark, out, spark.read.json(out).where("question_idx > 1"))
    assert spark.read.json(out).count() == 2 and spark.read.json(backup).count() == 3
    assert files.rewrite(spark, out, items) != backup


def test_documents_csv_store(spark, tmp_path):
    files.write_document(spark.createDataFrame([("d", [3, 1])], "dataset string, question_indices array<bigint>"), str(tmp_path / "doc"))
    assert [r[0] for r in files.read_subset(spark, str(tmp_path / "doc")).collect()] == [3, 1]
    df = spark.createDataFrame([('say "x"\nnow', True)], "question string, correct_A boolean")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "question string, correct_A boolean").collect() == df.collect()
    store = spark.createDataFrame([("A", "x"), ("B", "y")], "title string, text string")
    files.write_store(store, str(tmp_path / "store"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_store(store, str(tmp_path / "store"))
    hit, miss = files.lookup(store, spark.createDataFrame([("A",), ("C",)], "title string"))
    assert [r.title for r in hit.collect()] == ["A"] and [r.title for r in miss.collect()] == ["C"]
    (tmp_path / "names.txt").write_text(" Ada \n\nBob\n")
    assert sorted(r.value for r in files.read_lines(spark, str(tmp_path / "names.txt")).collect()) == ["Ada", "Bob"]


def test_sqlite(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "one.db")
    con.execute("CREATE TABLE documents (title TEXT PRIMARY KEY, text TEXT, n INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(f"t{i}", f"text {i}", i) for i in range(100)])
    con.commit()
    con.close()
    schema = "title string, text string, n bigint"
    df = sqlite.read_store(spark, str(tmp_path / "one.db"), schema)
    assert df.rdd.getNumPartitions() == 8 and sorted(r.n for r in df.collect()) == list(range(100))
    keys = spark.createDataFrame([("t5",), ("none",), ("t99",)], "title string")
    assert sorted(map(tuple, sqlite.find(keys, str(tmp_path / "one.db"), schema).collect()), key=repr) == [("none", None, None), ("t5", "text 5", 5), ("t99", "text 99", 99)]
    sqlite.write_store(df.repartition(3), str(tmp_path / "copy"), key="title")
    assert sorted(map(tuple, sqlite.read_store(spark, str(tmp_path / "copy"), schema).collect())) == sorted(map(tuple, df.collect()))
    assert sqlite.find(keys, str(tmp_path / "copy"), schema).where("n is not null").count() == 2
    with pytest.raises(Exception, match="exists"):
        sqlite.write_store(df, str(tmp_path / "copy"))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = str(tmp_path / "in"), "question_idx long, t string", str(tmp_path / "t"), str(tmp_path / "c"), "question_idx"
    for i, rows in enumerate(([1, 2, 2], [2, 3])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"question_idx": k, "t": str(i)}) for k in rows))
        ingest_once(spark, *args).awaitTermination()
    assert progress(spark, str(tmp_path / "t")).first().n == 3


def test_live_table(spark, tmp_path):
    df = spark.range(0, 3700, 3).withColumnRenamed("id", "k").repartition(3)  # 1234 rows
    live.write_live(df, str(tmp_path / "live"), "k")
    for number, want in ((1, 500), (2, 1000), (3, 1000)):
        assert sorted(r.k for r in live.snapshot(spark, str(tmp_path / "live"), number).collect()) == [3 * i for i in range(want)]


def test_targets(spark):
    j = spark.createDataFrame([(1, "p", "CORRECT", "a", 1.0, ["a", "b"]), (2, "p", "NOT_ATTEMPTED", "b", 0.0, ["a", "b"]), (3, "p", None, "c", 2.0, ["c", "d"]), (4, "p", "INCORRECT", "d", None, ["e", "f"])],
                              "question_idx long, prompt string, grade string, low_temp_response string, semantic_entropy double, raw_responses array<string>")
    got = lambda **k: {(r.question_idx, r.response) for r in targets.build_pairs(j, **k).collect()}
    assert got() == {(1, "a"), (3, "c"), (4, "d")}
    assert got(se_threshold=2.0) == {(1, "a"), (3, "c"), (4, "d")}  # equal to the threshold stays
    assert got(se_threshold="tight") == {(1, "a"), (4, "d")} and got(se_threshold=1.5, se_mode="replace") == {(1, "a"), (3, "Unknown"), (4, "d")}
    assert got(raw_samples=2, skip_not_attempted=False) >= {(2, "a"), (2, "b")}
    for bad in ({"se_threshold": 1.0, "raw_samples": 2}, {"se_mode": "x"}):
        with pytest.raises(ValueError):
            targets.build_pairs(j, **bad)
    with pytest.raises(Exception, match="too few samples"):
        targets.build_pairs(j, raw_samples=3).collect()
    with pytest.raises(KeyError):
        targets.build_pairs(j, ids=spark.createDataFrame([(9,)], "question_idx long"))
    again = spark.createDataFrame([(1, "p", "CORRECT", "old", 1.0, ["a"], 1), (1, "p", "CORRECT", "new", 1.0, ["a"], 2)], "question_idx long, prompt string, grade string, low_temp_response string, semantic_entropy double, raw_responses array<string>, line long")
    assert [r.response for r in targets.build_pairs(again, line="line").collect()] == ["new"]
    ids = spark.createDataFrame([([1, 2, 3, 4], [1, 2]), ([1, 2, 3, 4], [1, 2, 3]), ([1, 2], [1, 2, 3, 4])], "full_ids array<int>, prompt_ids array<int>")
    rows = targets.training_rows(ids, 3).collect()
    assert [(r.input_ids, r.labels) for r in rows] == [([1, 2, 3], [-100, -100, 3])]
    prompts = spark.createDataFrame([(1, "ask")], "question_idx long, prompt string")
    with pytest.raises(KeyError):
        targets.longform_pairs(spark.createDataFrame([(2, "x")], "question_idx long, teacher_response string"), prompts)
    log = spark.createDataFrame([(1, "t", 3), (2, "t", 4), (3, "u", 9)], "line long, run_tag string, hyperparameters int")
    assert targets.last_settings(log, "t").first()[0] == 4 and targets.last_settings(log, "none").first()[0] is None
    r = j.limit(1).select(targets.mask_labels(F.array(*map(F.lit, (5, 6, 7))), F.lit(2)).alias("m"), targets.reuse_guard(F.lit(None), F.lit("x")).alias("g")).first()
    assert r.m == [-100, -100, 7] and r.g == "absent"


def test_selection(spark):
    ids = spark.createDataFrame([(1,), (7,)], "question_idx long")
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "question_idx long, t string")
    assert select.keep_members(df, ids).count() == 2 and select.missing_members(df, ids).first()[0] == 7
    assert select.reuse_or_rescan(df, ids, lambda i: i).columns == ["question_idx"]
    assert select.resolve_ids(spark, explicit=[4]).first()[0] == 4 and select.resolve_ids(spark, items=df, first=1).first()[0] == 1
    with pytest.raises(KeyError):
        select.threshold_row(spark.createDataFrame([(0.5, [1])], "threshold double, question_indices array<long>"), 0.6)
    with pytest.raises(ValueError):
        select.role_column(df, "teacher")
    pool = spark.range(50).withColumnRenamed("id", "question_idx")
    s = [r[0] for r in sampling.sample_ids(pool, 10, 44, reserved_tail=5).collect()]
    assert s == sorted(set(s)) and len(s) == 10 and max(s) < 45 and s == [r[0] for r in sampling.sample_ids(pool, 10, 44, reserved_tail=5).collect()]
    with pytest.raises(ValueError):
        sampling.sample_ids(pool, 60, 1)
    assert sampling.sample_or_all(pool, 99, 1, "question_idx").count() == 50
    assert longform.remove_first and df.limit(1).select(longform.remove_first(F.array(*map(F.lit, "aba")), F.lit("a")).alias("x")).first().x == ["b", "a"]
    opts = df.limit(1).select(loaders.shuffled_options(F.lit("r"), F.array(*map(F.lit, "xyz")), F.lit(1)).alias("o")).withColumn("l", loaders.answer_label(F.col("o"), F.lit("r"))).first()
    assert sorted(opts.o) == ["r", "x", "y", "z"] and opts.o["ABCD".index(opts.l)] == "r"


def test_inventory(spark):
    lines = spark.createDataFrame([(0, "2024-01-01T00:00:00+00:00 | job=7 | stage=gen | node=n1.x | epochs=3"), (1, "2024-01-01T01:00:00+00:00 | job=7 | stage=judge | tag=t | epochs=3"), (2, "junk"), (3, "2024-01-02T00:00:00+00:00 | job=8 | stage=gen"), (4, "2024-01-02T00:00:00+00:00 | job=none | stage=gen")], "line long, value string")
    h = {r.job: r for r in I.history(I.manifest(lines)).collect()}
    assert set(h) == {"7", "8"} and h["7"].stages == ["gen", "judge"] and h["7"].node == "n1" and h["7"].description == "epochs=3 tag=t"
    logs = spark.createDataFrame([("gen_7.out", "KeyError: x"), ("gen_7.err", "judging done"), ("array_9_1.out", "host job=8\nCANCELLED")], "name string, text string")
    out = {r.job: r.outcome for r in I.with_outcome(I.history(I.manifest(lines)), logs).collect()}
    assert out == {"7": "done", "8": "cancelled"}
    counts = spark.createDataFrame([("a", 500), ("a", 3), ("a", 0)], "line string, n long")
    assert tuple(I.completeness(counts, "line").first()) == ("a", 1, 1, 3)
    with pytest.raises(Exception, match="incomplete"):
        counts.select(I.require_complete(F.col("n"))).collect()


@pytest.mark.parametrize("most", ["7b", "64b", "1k", "128m"])
def test_numbered_lines_of_split_files(spark, tmp_path, most):
    """Files cut into splits at any place give the numbers of files read at once."""
    texts = {
        "a.jsonl": "\n".join(f'{{"line": {i}, "x": "{"y" * (i % 90)}"}}' for i in range(400)) + "\n",
        "b.jsonl": "\n\nfirst after two\n\n" + "long " * 300 + "\nlast without an end", "c.jsonl": "", "d.jsonl": "\n", "e.jsonl": "one\r\ntwo\r\n\r\nfour",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        df = files.numbered_lines(spark, str(tmp_path))
        if most == "64b":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in df.collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = []
    for name, text in texts.items():
        lines = text.replace("\r\n", "\n").split("\n")
        want += [(name, i + 1, x) for i, x in enumerate(lines[:-1] if lines[-1] == "" else lines)]
    assert got == sorted(want)


def test_ingest_by_buckets(spark, tmp_path):
    """The first row of a key wins, by batch and place; a batch run again changes nothing; null keys are left out; other keys are refused."""
    (tmp_path / "in").mkdir()
    schema, folders = "k long, g string, t string", (str(tmp_path / "t"), str(tmp_path / "c"))
    held = lambda: {(r.k, r.g): (r.t, r.batch) for r in spark.read.schema(schema + ", batch long, bucket int").parquet(folders[0]).collect()}
    lines = ([(1, "a", "one"), (1, "a", "two"), (None, "a", "null"), (2, "a", None)], [(1, "a", "late"), (1, "b", "other"), (3, "a", "x")], [(3, "a", "late")])
    for i, rows in enumerate(lines):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "g": g, "t": t}) for k, g, t in rows))
        ingest_buckets(spark, str(tmp_path / "in"), schema, *folders, "k", "g", buckets=8).awaitTermination()
    want = {(1, "a"): ("one", 0), (2, "a"): (None, 0), (1, "b"): ("other", 1), (3, "a"): ("x", 1)}
    assert held() == want
    again = spark.createDataFrame([(1, "a", "late", "f", 0, 0), (1, "b", "other", "f", 0, 1), (3, "a", "x", "f", 0, 2)], schema + ", __file string, __block long, __at long")
    take_batch(again, 1, folders[0], "k", "g", buckets=8)
    assert held() == want
    with pytest.raises(ValueError, match="holds keys by"):
        ingest_buckets(spark, str(tmp_path / "in"), schema, *folders, "k", buckets=8)


def test_ingest_reads_its_own_buckets(spark, tmp_path):
    """What a batch reads of the target are the folders of its buckets."""
    held = str(tmp_path / "t")
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("f").alias("__file"), F.lit(0).alias("__block"), F.col("id").alias("__at"))
    take_batch(rows, 0, held, "k", buckets=64)
    for f in (tmp_path / "t" / "batch=0").glob("bucket=*"):
        if f.name != "bucket=" + str(spark.range(5, 6).select(F.pmod(F.xxhash64("id"), F.lit(64))).first()[0]):
            for x in f.iterdir():
                x.unlink()
            (f / "broken.parquet").write_text("not parquet")
    take_batch(rows.where("k = 5"), 1, held, "k", buckets=64)
    assert not list((tmp_path / "t" / "batch=1").glob("bucket=*"))
