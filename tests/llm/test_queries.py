"""The registered queries: those that SQL expresses against it, the contracts' columns of all."""

import duckdb
import pytest

from dubito.llm.queries import oracle_sql, queries

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op4_rlz": "doc_id n_words n_removed kept_sha256", "op6_simhash": "doc_id fingerprint component_id",
    "op8_grammar": "doc_id start n_tokens ids_crc32", "op9_quality": "doc_id held_out score predicted",
    "op10_flac": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11_vectors": "vec_id code error label_error codebooks_sha256", "op12_mixing": "doc_id size source_size target taken",
    "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, data, name):
    df = queries()[name](spark, data)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    near = lambda rows: sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(df.select(want.columns).collect()) == near(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries()))
def test_columns_and_rows(spark, data, name):
    df = queries()[name](spark, data)
    assert set(COLUMNS.get(name, "doc_id").split()) <= set(df.columns)
    n = spark.read.parquet(f"{data}/{'embeddings' if name == 'op11_vectors' else 'documents'}.parquet").count()
    assert df.count() == n if name in COLUMNS or name in ("op2_crossentropy", "op7_pieces") else 0 < df.count() <= n


def test_operators():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
