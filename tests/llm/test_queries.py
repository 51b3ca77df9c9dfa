"""The registered corpus queries on the smallest test tables: columns, row counts and SQL twins."""

import duckdb
import pytest

from tessera.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard_join": "doc_id class_id n_links",
    "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_token_counts": "context_limit n_docs truncated_tokens",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_url_filters": "page_id host path rule verdict",
    "op9_token_files": "doc_id start n_tokens ids_crc32",
    "op10_line_dedup": "doc_id n_lines n_removed text",
}


def test_all_ten_are_registered():
    assert set(registry.queries()) == set(COLUMNS)
    assert set(registry.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = registry.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    rows = out.collect()
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    if (sql := registry.oracle_sql().get(name)) is not None:
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want.fetchall())
    elif name not in ("op4_packing", "op5_token_counts"):
        table, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
        assert sorted(r[key] for r in rows) == [x for (x,) in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]


def test_held_out_languages(spark):
    held = registry.queries()["op7_language_id"](spark, "/root/testdata/sf0.01").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = held.join(truth, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
