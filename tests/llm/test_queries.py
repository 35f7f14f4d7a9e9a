"""The corpus queries that have SQL, against it, and all of them for their contracts' columns."""

import math

import duckdb
import pytest

from tracewright.llm.queries import ORACLE, QUERIES

from pathlib import Path

COLUMNS = {
    "op1_near_duplicates": ["doc_id", "component_id", "kept"],
    "op2_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_repeated_strings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_chat_format": ["conv_id", "turn", "chat_json"],
    "op9_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op10_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    df = QUERIES[name](spark, small)
    assert set(COLUMNS[name]) <= set(df.columns)
    if name.startswith(("op11", "op12")):  # their rows are groups', not documents'
        assert df.count()
        return
    table = "conversations" if name.startswith("op8") else "embeddings" if name.startswith("op10") else "documents"
    assert df.count() == spark.read.parquet(f"{small}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, small)
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    key = lambda rows, cols: sorted([str([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in rows])
    assert key([tuple(r) for r in df.collect()], df.columns) == key(cur.fetchall(), names)
