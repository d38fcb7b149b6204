"""Choosing one variant per key from a catalog, and checking what a choice leaves open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with their rank by `order` within keys; order must end in a unique column."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return ranked(rows, keys, order).filter("rank = 1").drop("rank")


def top_choices(rows: DataFrame, exact: Column, position: Column, n: int = 5) -> DataFrame:
    """Exact matches first, then the provider's order; at most n, with a flag that there are more."""
    first = rows.select("*", exact.alias("exact"), position.alias("position")).orderBy(F.desc("exact"), "position").limit(n + 1)
    every = Window.orderBy(F.desc("exact"), "position")  # over n + 1 rows
    return first.select("*", F.row_number().over(every).alias("choice"), (F.count("*").over(Window.partitionBy()) > n).alias("truncated")).filter(F.col("choice") <= n)


def fallback_choices(rows: DataFrame, excluded: DataFrame, key: str, file: str, order: Sequence[Column], n: int = 3) -> DataFrame:
    """The n best ranked of each key whose file is neither excluded nor listed twice."""
    left = rows.join(excluded.select(file).distinct(), file, "left_anti")
    once = first_per_key(left, [key, file], order)
    return ranked(once, [key], order).filter(F.col("rank") <= n)


def collapsed(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Equal rows as one, and whether a key has rows that differ."""
    distinct = rows.select(key, *columns).dropDuplicates()
    return distinct.withColumn("conflict", F.count("*").over(Window.partitionBy(key)) > 1)


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def cover(found: DataFrame, keys: Sequence[str], number: str, first: Column, last: Column) -> DataFrame:
    """keys, missing, surplus: what an expected range lacks and what lies outside it."""
    per = found.groupBy(*keys).agg(F.collect_set(number).alias("have"), first.alias("low"), last.alias("high"))
    want = F.when(F.col("high") >= F.col("low"), F.sequence("low", "high")).otherwise(F.array().cast("array<int>"))
    return per.select(*keys, F.array_sort(F.array_except(want, "have")).alias("missing"), F.array_sort(F.array_except("have", want)).alias("surplus"))


def reuse_frozen(ranked_rows: DataFrame, frozen: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's frozen value where there is one, else the ranked one."""
    kept = frozen.select(key, F.col(value).alias("frozen_value"))
    return ranked_rows.join(kept, key, "left").select(key, F.coalesce("frozen_value", value).alias(value), F.col("frozen_value").isNotNull().alias("frozen"))


def eligible(rows: DataFrame, identity: Column, skip: Column) -> DataFrame:
    """rows with verdict error (wrong identity), skip or ok: the first stops a run, the second does not."""
    return rows.withColumn("verdict", F.when(~F.coalesce(identity, F.lit(False)), "error").when(F.coalesce(skip, F.lit(True)), "skip").otherwise("ok"))


def alias_match(requests: DataFrame, manifests: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Requests whose range lies in a manifest's range of the same keys; several manifests conflict."""
    m = manifests.select(*keys, F.col(low).alias("m_low"), F.col(high).alias("m_high"), "manifest")
    found = requests.join(m, list(keys)).filter(f"m_low <= {low} and {high} <= m_high")
    return found.groupBy(*keys, low, high).agg(F.min("manifest").alias("manifest"), (F.countDistinct("manifest") > 1).alias("conflict"))
