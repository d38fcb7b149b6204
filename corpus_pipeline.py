"""The corpus pipeline: five of the operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of
documents; the last returns where each piece of what is left is packed.

Verdicts are carried by a hash of the whole row, not by its id: rows with a null id and rows that share
an id are each kept or dropped by their own verdict, and rows equal in all columns alike. Of
a group of near copies the row of the least id stays, of several such rows the one
of the least hash; a row without an id stays only where no row of its group has one. Substring dedup
leaves rows without an id as they are. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._spark import own_dir, prepare
from tideline.llm.best_fit_packing import best_fit_packing
from tideline.llm.ngram_jaccard import jaccard_components
from tideline.llm.quality_classifier import quality_classifier as classify
from tideline.llm.quality_rules import quality_rules as judge
from tideline.llm.substring_dedup import substring_dedup as cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The marked rows of docs whose mark is listed, with the columns of documents."""
    return docs.join(rows.select("row"), "row", "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the pairwise ranking rejects; labels train it where their documents are present."""
    prepare(spark)
    docs = _marked(docs)
    return _only(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)).filter("predicted = 1"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules with adaptive thresholds reject."""
    prepare(spark)
    docs = _marked(docs)
    return _only(docs, judge(docs, carry=("row",)).filter("kept"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    prepare(spark)
    docs = _marked(docs)
    groups = jaccard_components(docs, id_col="row").select("row", "component_id").join(docs.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = groups.groupBy("component_id").agg(first).select("first.row")
    return docs.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document holds; drops what is left empty."""
    prepare(spark)
    cut = cut_repeats(docs, carry=("lang", "source"))
    left = cut.filter("n_words > n_removed")
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers

    prepare(spark)
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_pack),
]

#: A trained classifier and the packing have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{own_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
