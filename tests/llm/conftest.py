import pytest

#: Rows with nulls, empty, blank, short, very long, equal and repeated texts, and columns whose names clash with the operators' own.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
CLASH = ["seeds", "source", "runs", "score", "route", "start", "n", "fp", "node", "agreed", "media", "ids", "label", "stats", "first", "is_target", "held_out", "items", "suffix", "part", "__gone", "gone", "Turn", "key", "found"]


@pytest.fixture(scope="session")
def edge_rows():
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, "Ünï cödé 日本語 😀 ▁ \x00 x"), (8, PASSAGE + " tail a"),
        (9, "head b " + PASSAGE), (10, "head c " + PASSAGE + " tail d"), (None, PASSAGE), (None, None), (11, "same row"), (11, "same row"),
        (12, "twice one"), (12, "twice two other"), (13, "spam " * 300), (-5, "negative id " + PASSAGE), (2**62, "x" * 5000), (14, "a\x0bb\x0cc\rd"),
    ]
    return texts


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None, None if t is None else len(t)) for i, t in edge_rows], schema)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns}).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    long = " ".join(f"item{i}" for i in range(30))
    return spark.createDataFrame([(1, long), (2, long), (3, None), (None, long), (4, "short one"), (5, ""), (6, "Passage3 " + " ".join(f"passage{i}" for i in range(4, 20)))], "item_id long, text string")
