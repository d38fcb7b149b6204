"""Embedding near-dedup by a forest of random-projection trees.

Method: each tree halves the vectors by random directions at the median projection, one
direction for each level; a vector within a margin of the cut goes to both sides. The margin
follows from the threshold: unit vectors with cosine c are sqrt(2 - 2c) apart, so on a direction of
standard normal entries their projections differ by that as standard deviation, and the margin is half of it. Vectors
that share a leaf of any tree are compared in double precision, links found are united. A pair
is counted in the first leaf that holds both, so counts need no list of pairs, and a leaf
sends on one edge for each vector, not its pairs.

The first cuts are fitted on `SAMPLE` vectors at most, of all labels and lengths together: a
unit vector's projections have about the same spread whatever its length, and directions are
drawn entry by entry, so that one forest serves every length. Every vector is routed, and
only those of one label and one length are compared. Leaves that hold more than `BLOCK` of
those are split further, `STEP` levels at a time, at medians of about `LEAF_SAMPLE` vectors of each such leaf,
until they are small or a split does no more good. What cannot be split (vectors that
lie within the margin of each other nearly all) is compared block against block by several tasks. Equal vectors
are one vector with a count throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, stored

SAMPLE = 20_000
TREES = 8
LEAF = 256
BLOCK = 2048
#: A node needs so many sampled vectors to be split.
LEAST_SAMPLE = 8
#: Levels that a large leaf gains at a time, and the vectors that its cuts are fitted on, about.
STEP = 4
LEAF_SAMPLE = 2048
#: A leaf stays whole if its largest part would hold more than this share of it.
WORTH = 0.8
#: A leaf's name has a tree in its upper bits and the way down, after a leading 1, in the lower.
TREE_BITS = 56
MAX_LEVELS = 52


def directions(tree: int, levels: range, dim: int, seed: int = 11) -> np.ndarray:
    """(dim, level) standard normal entries; an entry depends on nothing but its place and seed."""
    return np.stack([np.random.default_rng((seed, tree, level)).standard_normal(dim) for level in levels], axis=1) if len(levels) else np.zeros((dim, 0))


def margin(threshold: float) -> float:
    return 0.5 * float(np.sqrt(2 - 2 * threshold))


def descend(p: np.ndarray, cuts: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of rows with projections p, one column for each level, under cuts in heap order.

    A row has several leaves where cuts are close; at a nan cut all rows go left.
    """
    row, node = np.arange(len(p)), np.zeros(len(p), np.int64)
    for level in range(p.shape[1]):
        away = p[row, level] - cuts[node]
        whole = np.isnan(away)
        left, right = whole | (away <= width), ~whole & (away >= -width)
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - len(cuts)


def fit_cuts(p: np.ndarray) -> np.ndarray:
    """Medians, in heap order, of the sampled projections that reach each node; nan for those with too few."""
    cuts = np.full((1 << p.shape[1]) - 1, np.nan)
    inside = {0: np.arange(len(p))}
    for node in range(len(cuts)):
        rows = inside.pop(node, np.zeros(0, np.int64))
        if len(rows) < LEAST_SAMPLE:
            continue
        column = p[rows, (node + 1).bit_length() - 1]
        cuts[node] = cut = np.median(column)
        inside[2 * node + 1], inside[2 * node + 2] = rows[column <= cut], rows[column > cut]
    return cuts


@dataclass(frozen=True)
class Forest:
    """For each tree the cuts of its inner nodes in heap order; a nan cut ends there."""

    cuts: np.ndarray
    width: float

    @property
    def depth(self) -> int:
        return (self.cuts.shape[1] + 1).bit_length() - 1

    @property
    def leaves(self) -> int:
        return self.cuts.shape[1] + 1

    def route(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors x."""
        return descend(x @ directions(tree, range(self.depth), x.shape[1]), self.cuts[tree], self.width)


def fit_forest(sample: list[np.ndarray], depth: int, threshold: float, trees: int = TREES) -> Forest:
    """Cuts by the sampled unit vectors, given as one array for each length."""
    cuts = np.full((trees, (1 << depth) - 1), np.nan)
    for t in range(trees):
        p = [x @ directions(t, range(depth), x.shape[1]) for x in sample]
        if p:
            cuts[t] = fit_cuts(np.concatenate(p))
    return Forest(cuts, margin(threshold))


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.array(vectors.flatten(), dtype=np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length among the vectors."""
    sizes = np.array(vectors.value_lengths())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, unit(vectors.take(pa.array(rows)), dim)


def _lists(row: np.ndarray, code: np.ndarray, n: int) -> pa.Array:
    order = np.lexsort((code, row))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), pa.array(code[order]))


def _refined(placed: DataFrame, threshold: float) -> DataFrame | None:
    """placed with its large leaves split by STEP levels; None if none is worth splitting."""
    leaves = placed.select("id", "label", "dim", F.explode("codes").alias("leaf"))
    large = leaves.groupBy("label", "dim", "leaf").count().filter((F.col("count") > BLOCK) & (F.expr(f"length(bin(leaf & {(1 << TREE_BITS) - 1}))") <= MAX_LEVELS))
    large = stored(large, "large")
    if large.isEmpty():
        return None

    def levels(leaf: int) -> tuple[int, range]:
        at = (leaf & ((1 << TREE_BITS) - 1)).bit_length() - 1
        return leaf >> TREE_BITS, range(at, at + STEP)

    def fit(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        tree, below = levels(leaf)
        vectors = table.column("embedding").combine_chunks()
        x = unit(vectors, len(vectors[0]))
        p = x @ directions(tree, below, x.shape[1])
        cuts = fit_cuts(p)
        _, part = descend(p, cuts, margin(threshold))
        good = np.bincount(part).max() <= WORTH * len(x)
        return table.select(["label", "dim", "leaf"]).slice(0, int(good)).append_column("cuts", pa.array([cuts.tolist()] * int(good), pa.list_(pa.float64())))

    rows = placed.select("id", "label", "dim", "embedding", F.explode("codes").alias("leaf")).join(large, ["label", "dim", "leaf"])
    few = rows.filter(F.expr(f"pmod(xxhash64(id, leaf), count) < {LEAF_SAMPLE}")).drop("count", "id")
    kind = dict(placed.dtypes)["label"], dict(placed.dtypes)["embedding"]
    cuts = stored(few.groupBy("label", "dim", "leaf").applyInArrow(fit, f"label {kind[0]}, dim int, leaf long, cuts array<double>"), "cuts")
    if cuts.isEmpty():
        return None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                leaf, table = np.array(batch.column(2)), np.array(batch.column(3).flatten()).reshape(len(batch), -1)
                found, names = [], []
                for rows, x in by_length(batch.column(1)):
                    for name in np.unique(leaf[rows]).tolist():
                        tree, below = levels(name)
                        mine = np.flatnonzero(leaf[rows] == name)
                        p = x[mine] @ directions(tree, below, x.shape[1])
                        row, part = descend(p, table[rows[mine[0]]], margin(threshold))
                        way = name & ((1 << TREE_BITS) - 1)
                        found.append(rows[mine[row]])
                        names.append((tree << TREE_BITS) | (way << STEP) | part)
                take = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column(0).take(pa.array(take)), pa.array(leaf[take]), pa.array(np.concatenate(names) if names else take)], ["id", "old", "new"])

    # a batch of one leaf after the other, so that a batch meets few directions
    finer = rows.join(cuts, ["label", "dim", "leaf"]).select("id", "embedding", "leaf", "cuts").sortWithinPartitions("leaf")
    finer = finer.mapInArrow(split, "id long, old long, new long").groupBy("id").agg(F.collect_set("old").alias("old"), F.collect_set("new").alias("new"))
    out = placed.join(finer, "id", "left")
    codes = F.when(F.col("old").isNull(), F.col("codes")).otherwise(F.sort_array(F.concat(F.array_except("codes", "old"), F.col("new"))))
    return stored(out.select("id", "label", "dim", "copies", "embedding", codes.alias("codes")), "placed")


def _links(named: DataFrame, threshold: float, trees: int, sample: int) -> DataFrame:
    """(id, links, root) of the distinct vectors in one leaf's block or pair of blocks, over all of them."""
    most = named.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    taken = named.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    depth = int(min(max(0, np.ceil(np.log2(max(most, 1) / LEAF))), max(0, np.floor(np.log2(max(len(taken), 1) / LEAST_SAMPLE)))))
    shared = named.sparkSession.sparkContext.broadcast(fit_forest([x for _, x in by_length(taken)], depth, threshold, trees))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                row, code = [], []
                for rows, x in by_length(batch.column(4)):
                    for tree in range(trees):
                        found, leaf = forest.route(x, tree)
                        row.append(rows[found])
                        code.append((tree << TREE_BITS) | (1 << forest.depth) | leaf)
                codes = _lists(np.concatenate(row), np.concatenate(code), len(batch))
                yield pa.record_batch([*batch.columns, codes], [*batch.schema.names, "codes"])

    kinds = dict(named.dtypes)
    shape = f"id long, label {kinds['label']}, dim int, copies long, embedding {kinds['embedding']}"
    placed = stored(named.select("id", "label", "dim", "copies", "embedding").mapInArrow(route, f"{shape}, codes array<long>"), "placed")
    while (finer := _refined(placed, threshold)) is not None:
        placed = finer
    leaves = placed.select("id", "label", "dim", F.explode("codes").alias("leaf"))
    large = leaves.groupBy("label", "dim", "leaf").count().filter(F.col("count") > BLOCK)
    large = stored(large.select("label", "dim", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = placed.select("*", F.explode("codes").alias("leaf")).join(large, ["label", "dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")
    return dealt.groupBy("label", "dim", "leaf", "low", "high").applyInArrow(lambda t: compare(t, threshold), "id long, links long, root long")


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """(id, links, root) of the rows of one leaf, or of two blocks of a leaf.

    Rows are (id, copies, embedding, codes, leaf, own, low, high); codes lists every leaf
    of every tree that holds the row, and a pair counts in the first that both have.
    """
    dim = len(table.column("embedding")[0])
    leaf, low, high = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
    ids, copies, own = (np.array(table.column(c)) for c in ("id", "copies", "own"))
    x = unit(table.column("embedding").combine_chunks(), dim)
    codes = table.column("codes").combine_chunks()
    code = np.array(codes.flatten())
    at = np.repeat(np.arange(len(ids)), np.array(codes.value_lengths()))
    earlier = code < leaf
    code, at = code[earlier], at[earlier]
    names, code = np.unique(code, return_inverse=True)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    held = np.zeros((len(ids), len(names)), np.float32)
    held[at, code] = 1
    for k in range(0, len(left), 512):
        rows = left[k : k + 512]
        near = x[rows] @ x[right].T >= threshold
        near &= rows[:, None] != right[None, :]
        if not near.any():
            continue
        new = near & (held[rows] @ held[right].T == 0) if len(names) else near
        links[rows] += new @ copies[right]
        if low != high:
            links[right] += copies[rows] @ new
        i, j = np.nonzero(new)
        for a, b in zip(rows[i].tolist(), right[j].tolist(), strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
    while (root[root] != root).any():
        root = root[root]
    some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def embedding_dedup(rows: DataFrame, threshold: float = 0.93, trees: int = TREES, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id and kept of every row.

    Only vectors of one label and one length are compared, however many lengths there are. Rows with a null label, a null,
    empty or zero vector or one with null or non-finite parts link with nothing and are kept.
    component_id is the least id reachable by links. A null id takes no part in linking, has
    a null component and is not kept. Rows that share an id are separate vectors under one
    name. Extra columns are ignored; an empty table gives an empty result.
    """
    given = F.col(vector_col)
    vector = given if rows.select(given.alias("v")).dtypes[0][1] in ("array<float>", "array<double>") else given.cast("array<double>")
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    every = every.select("id", "label", "v", F.coalesce(sound, F.lit(False)).alias("sound"))
    every = every.withColumn("k", F.when(F.col("sound"), F.struct(F.xxhash64("label", "v").alias("x"), F.hash("v", "label").alias("y"))))
    first = every.filter("sound").groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min(F.struct("label", "v")).alias("r"))
    # one id may name several vectors, so each vector goes by a 64-bit hash
    named = first.select("k", F.col("id").alias("low"), F.xxhash64("k").alias("id"), "copies", "r.label", F.col("r.v").alias("embedding"), F.size("r.v").alias("dim"))
    named = stored(named, "vectors")
    links = stored(_links(named, threshold, trees, sample), "links")
    parts = components(links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = named.select("k", "id", "low", "copies").join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    found = found.select("k", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("part"))
    least = found.groupBy("part").agg(F.min("low").alias("component"))
    found = found.join(least, "part").select("k", "links", "component")
    out = every.select("id", "k").join(found, "k", "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(other) AS component_id, v.vec_id = min(other) AS kept
FROM v JOIN reach r ON r.vec_id = v.vec_id GROUP BY v.vec_id
"""
