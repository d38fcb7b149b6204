"""The registered queries: those with SQL against it, all of them over whole tables."""

import pytest

from tideline.llm.registry import ORACLE_SQL, QUERIES

from ..oracle import DATA, database, same_rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
COLUMNS = {
    "op1": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), "op2": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), "op3": ("doc_id", "held_out", "score", "predicted"),
    "op4": ("doc_id", "n_words", "n_removed", "kept_sha256"), "op5": ("vec_id", "n_links", "component_id", "kept"), "op6": ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"),
    "op7": ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), "op8": ("doc_id", "start", "n_tokens", "ids_crc32"), "op9": ("page_id", "host", "path", "rule", "verdict"), "op10": ("doc_id", "n_shingles", "component_id"),
}


def test_ten_queries():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, str(DATA))
    assert set(COLUMNS[name.split("_")[0]]) <= set(got.columns)
    if name in ORACLE_SQL:
        same_rows(got, database(), ORACLE_SQL[name])
    elif not name.startswith("op6"):
        table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
        assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
