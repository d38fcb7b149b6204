"""Shared Spark plumbing: intermediate tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship


#: Rows of an Arrow batch, so that a batch of texts of a few KB takes a few MB on either side.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Send the code out, and make Arrow batches small unless the session asks for a size of its own."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading of a file, not the
    recomputation of what led to it.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.stored_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_OWN: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends in good order."""
    path = f"{shared_dir(spark)}/tideline/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; then the files stay
        _delete(spark, path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), by alternating stars.

    Each round links every node's larger neighbours to its least neighbour (large
    star), then every node with its smaller neighbours to the least of them (small
    star), until nothing changes. Rounds grow with the logarithm of the longest
    path; no row holds a neighbourhood, so a hub is no problem. Nodes are longs;
    a component is named after its least node. Rows with a null end and loops link
    nothing; an empty input gives an empty result. It raises if max_rounds do not
    suffice, as a partial answer would be wrong.
    """
    if edges.isEmpty():
        return edges.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("component"))
    links = stored(
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    before: dict | None = None
    for _ in range(max_rounds):
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        seen = Observation()  # the write itself tells whether anything has changed
        small = small.filter("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        old, links = links, stored(small, "links")
        discard(old)
        now = seen.get
        if now == before:
            heads = links.select(F.col("v").alias("node")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads.select("node", F.col("node").alias("component")))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
