"""The registered queries over the smallest tables, and their SQL where there is one."""

import math
from pathlib import Path

import duckdb
import pytest

from rotativa.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

COLUMNS = {
    "op1_near_duplicates": ["doc_id", "class_id", "kept"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_nearest_vectors": ["query_id", "rank", "vec_id", "score"],
    "op6_repetition_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_warc_round_trip": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_pack_sequences": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op11_cross_tokens": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13_whitened_vectors": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_all_are_registered():
    assert QUERIES.keys() == COLUMNS.keys()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(found.columns)
    rows = found.collect()
    table = "pages" if name in ("op4_url_filter", "op8_warc_round_trip") else "documents"
    if name not in ("op5_nearest_vectors", "op10_pack_sequences", "op13_whitened_vectors"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLE:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        result = con.execute(ORACLE[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(found.columns)
        cell = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
        want = sorted((tuple(map(cell, r)) for r in result.fetchall()), key=str)
        assert sorted((tuple(cell(r[n]) for n in names) for r in rows), key=str) == want
