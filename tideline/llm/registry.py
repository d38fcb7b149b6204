"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import functools

from . import (
    best_fit_packing,
    byte_bpe,
    embedding_dedup,
    lm_scoring,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_file,
    url_filter,
)
from ._spark import prepare


def _query(operator):
    @functools.wraps(operator)
    def run(spark, sf_dir):
        prepare(spark)
        return operator(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _query(f)
    for f in (
        quality_rules.op1_quality_rules,
        byte_bpe.op2_byte_bpe,
        quality_classifier.op3_quality_classifier,
        substring_dedup.op4_substring_dedup,
        embedding_dedup.op5_embedding_dedup,
        best_fit_packing.op6_best_fit_packing,
        lm_scoring.op7_lm_scoring,
        token_file.op8_token_file,
        url_filter.op9_url_filter,
        ngram_jaccard.op10_ngram_jaccard,
    )
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op10_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
}
