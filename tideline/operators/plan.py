"""Rename plans: coverage, collisions, occupants, blocked chains and the order of moves."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collision_key


def uncovered(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Expected rows of which none of the array `on` has been found."""
    each = expected.select(*[c for c in expected.columns if c != on], F.explode(on).alias(on))
    keys = [c for c in expected.columns if c != on]
    hit = each.join(found.select(on).distinct(), on, "left_semi").select(*keys).distinct()
    return expected.join(hit, keys, "left_anti").select(*keys)


def collisions(plan: DataFrame, parent: str, target: str) -> DataFrame:
    """plan with collides: another row of the parent wants a name that may count as the same."""
    key = collision_key(F.col(target))
    return plan.withColumn("collides", F.count("*").over(Window.partitionBy(parent, key)) > 1)


def occupants(plan: DataFrame, places: DataFrame) -> DataFrame:
    """plan (source, target) with who holds the target now, and how many do; two or more is an error."""
    held = places.groupBy(collision_key(F.col("place")).alias("key")).agg(F.min("place").alias("occupant"), F.count("*").alias("holders"))
    keyed = plan.withColumn("key", collision_key(F.col("target")))
    return keyed.join(held, "key", "left").drop("key").withColumn("holders", F.coalesce("holders", F.lit(0)).cast("long"))


def blocked(plan: DataFrame) -> DataFrame:
    """plan (row, waits_for, state) with state Conflict wherever a chain of waits ends at a row that cannot move.

    Recursive SQL: from the rows that cannot move, follow the planned rows that wait for them. A
    row waits for one other at most, so no walk returns to where it was.
    """
    plan.createOrReplaceTempView("__plan")
    return plan.sparkSession.sql("""
        WITH RECURSIVE stuck(r) AS (
          SELECT `row` FROM __plan WHERE state <> 'Planned'
          UNION ALL
          SELECT p.`row` FROM __plan p JOIN stuck s ON p.waits_for = s.r WHERE p.state = 'Planned'
        ) SELECT p.`row`, p.waits_for, CASE WHEN p.state = 'Planned' AND s.r IS NOT NULL THEN 'Conflict' ELSE p.state END AS state
        FROM __plan p LEFT JOIN (SELECT DISTINCT r FROM stuck) s ON p.`row` = s.r
    """)


def tally(plan: DataFrame, state: str = "state") -> DataFrame:
    """One row: counts by state, and the exit code. Failures outweigh ambiguity, that unknowns, those success."""
    count = lambda *states: F.count_if(F.col(state).isin(*states))
    out = plan.agg(count("Planned").alias("planned"), count("Ambiguous").alias("ambiguous"), count("Unknown").alias("unknown"), count("Failed", "Conflict").alias("failed"))
    code = F.when(F.col("failed") > 0, 1).when(F.col("ambiguous") > 0, 3).when(F.col("unknown") > 0, 2).otherwise(0)
    return out.withColumn("exit_code", code)


def precedence(results: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """Each key's first Identified result, else its first Ambiguous, else its first Unknown, else an error."""
    level = F.when(F.col(outcome) == "Identified", 0).when(F.col(outcome) == "Ambiguous", 1).when(F.col(outcome) == "Unknown", 2).otherwise(3)
    best = F.min_by(F.struct(order, outcome), F.struct(level, order))
    return results.groupBy(key).agg(best.alias("b")).select(key, f"b.{order}", f"b.{outcome}")


def move_order(moves: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Moves in an order in which every target is free; a cycle is opened by one temporary name."""
    waiting, out = dict(moves), []
    if len(waiting) != len(moves) or len(set(waiting.values())) != len(moves):
        raise ValueError("two moves share a source or a target")
    waiting = {a: b for a, b in waiting.items() if a != b}
    while waiting:
        free = [a for a, b in waiting.items() if b not in waiting]
        if free:
            out += [(a, waiting.pop(a)) for a in sorted(free)]
            continue
        a = min(waiting)
        aside = f"{a}.moving"
        while aside in waiting or aside in waiting.values():
            aside += "_"
        out.append((a, aside))
        waiting[aside] = waiting.pop(a)
    return out


def apply_moves(moves: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Carry out moves on the driver without replacing anything; returns those done. A failure stops the rest."""
    done = []
    for source, target in move_order(moves):
        os.link(source, target)  # fails where the target exists, unlike a rename
        os.unlink(source)
        done.append((source, target))
    return done
