"""Ledgers and caches: digests, recomputation checks, proofs of emptiness, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordinal_digest(rows: DataFrame, keys: Sequence[str], ordinal: str, domain: str) -> DataFrame:
    """keys, n, sha256: digest of a domain string and the ascending ordinals as big-endian 32-bit numbers."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(ordinal).cast("int"))).alias("o"))
    words = F.array_join(F.transform("o", lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return per.select(*keys, "n", F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(words)), 256).alias("sha256"))


def ledger_mismatches(stored: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on which a recomputed ledger differs from the stored one; null equals null alone."""
    a = stored.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("a_here"))
    b = computed.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("b_here"))
    differs = ~F.col("a_here").eqNullSafe(F.col("b_here"))
    for c in columns:
        differs |= ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, list(keys), "full").filter(differs).select(*keys)


def proven_empty(records: DataFrame, key: str, missing: str) -> DataFrame:
    """Keys that have records, all of which lack text."""
    return records.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.col(missing)).alias("empty")).filter("n > 0 and empty").select(key, "n")


def inventory(files: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def replay(steps: DataFrame, key: str) -> DataFrame:
    """key, current, valid of a history of steps (step, from_id, to_id): 1..n without gaps, each from where the last led."""
    per = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "from_id", "to_id"))).alias("s"))
    start = F.struct(F.lit(True).alias("ok"), F.element_at("s", 1)["from_id"].alias("at"), F.lit(0).alias("n"))
    fold = F.aggregate("s", start, lambda acc, x: F.struct((acc["ok"] & (x["step"] == acc["n"] + 1) & (x["from_id"] == acc["at"])).alias("ok"), x["to_id"].alias("at"), (acc["n"] + 1).alias("n")))
    return per.select(key, fold.alias("f")).select(key, F.when(F.col("f.ok") & (F.col("f.n") <= 3), F.col("f.at")).alias("current"), (F.col("f.ok") & (F.col("f.n") <= 3)).alias("valid"))
