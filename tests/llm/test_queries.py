"""The registered queries run over whole tables, with the columns of their contracts; SQL where it can say the same."""

import duckdb
import pytest
from cases import documents, folder  # noqa: F401

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from fieldline.llm import oracles, queries

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_pii": ["doc_id", "text"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_lm_score": ["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
    "op7_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_mix": ["doc_id", "source", "chars", "block", "slot", "position"],
    "op10_langid": ["doc_id", "held_out", "lang_pred", "score"],
}


VECTORS = {
    "op11_whiten": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12_topk": ["query_id", "rank", "vec_id", "score"],
    "op13_cluster": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


def test_all_operators_and_the_pipeline_are_registered():
    assert set(queries.queries()) == {*COLUMNS, *VECTORS} and {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert set(oracles.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_one_row_per_document(spark, folder, documents, name):
    got = queries.queries()[name](spark, folder)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in documents.collect())


@pytest.mark.parametrize("name", list(VECTORS))
def test_columns_of_vector_queries(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    assert got.columns[: len(VECTORS[name])] == VECTORS[name] and got.count() > 0


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    verdict, _ = compare(spark, con, folder, name, queries.queries()[name], oracles.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
