"""Write-once tables and files: staged, then published under their final name."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(df: DataFrame, path: str, receipt: dict | None = None) -> None:
    """Write df beside `path`, a receipt first and then the rows, and rename the whole; never replaces anything."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(receipt or {}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/receipt")
    df.write.parquet(f"{staging}/rows")
    _, source = _fs(spark, staging)
    if not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)


def published(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    receipt = spark.read.text(f"{path}/receipt").first().value
    return spark.read.parquet(f"{path}/rows"), json.loads(receipt)


def freeze(df: DataFrame, folder: str, scope: dict) -> str:
    """Store a selection under the digest of its scope; storing the same rows again is a no-op, others are refused."""
    spark = df.sparkSession
    text = json.dumps(scope, sort_keys=True, separators=(",", ":"))
    name = spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
    path = f"{folder}/{name}"
    fs, where = _fs(spark, path)
    if fs.exists(where):
        held, _ = published(spark, path)
        kinds = [[(f.name, f.dataType.simpleString()) for f in x.schema] for x in (held, df)]  # files do not keep what is never null
        if kinds[0] != kinds[1] or held.exceptAll(df).head() or df.exceptAll(held).head():
            raise FileExistsError(path)
        return path
    publish(df, path, scope)
    return path


def append_step(spark: SparkSession, path: str, step: dict, most: int = 3) -> None:
    """Append to a ledger of numbered steps: the next number only, and no more than `most`."""
    fs, where = _fs(spark, path)
    have = spark.read.json(path).agg(F.max("step")).first()[0] if fs.exists(where) else 0
    if step["step"] != have + 1 or step["step"] > most:
        raise ValueError(f"step {step['step']} cannot follow {have}")
    spark.createDataFrame([(json.dumps(step),)], "value string").write.mode("append").text(path)


def write_srt(rendered: DataFrame, folder: str) -> None:
    """One text row for each document's canonical SubRip text, partitioned by document."""
    rendered.select("doc", F.col("srt").alias("value")).write.partitionBy("doc").text(folder)
