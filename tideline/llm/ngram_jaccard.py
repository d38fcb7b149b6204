"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of `similarity` or more.

Method: PartEnum signatures. Sizes fall into bands whose ends differ by the factor
1 / similarity, so similar sets lie in one band or in neighbouring ones; a set signs for
its own band's grid and the next one's. Sets of a grid differ in at most
k = 2 (1 - similarity) / (1 + similarity) * (largest size) features. A grid splits the
domain of features by their hash:

* k <= 2: the set without any 0..k features; similar sets share their intersection.
* k <= SMALL_K: n1 partitions split into 5; each choice of 3 of the 5 gives a signature.
  Some partition holds at most 2 differences, so one of its choices holds none. Such a
  choice says nothing where it is empty; a set with an empty choice also signs the features
  at the front of the order of hashes, as many as leave fewer behind than similar sets
  share. Both sets of a pair whose clean choices are all empty do so, and such fronts meet.
* larger k: enumerating every partition would take as many signatures as features, so
  `SIGNATURES` partitions of about 5 features each are signed, over several hashes of the
  domain where one has fewer; those of fewer than 3 features say little and are not. A
  pair at the very threshold shares each with a chance of 1/5 at
  least, and so misses all 96 with a chance below 1e-9; closer pairs less.

Equal sets are one node throughout, signed once for each partition of the input. Nodes that
share a signature are compared in two rounds: each with the first of its group, and then,
where a group still spans several components, every pair from different components. Every
link is verified on the whole sets. Links within one component are not needed for its
identity, so large groups of near copies cost one comparison each.

A signature of more than `HOT_GROUP` nodes comes from a passage that many documents hold,
or from many near copies. In the second round its nodes are not paired row by row. All nodes
of such groups are grouped anew, by shared features in an order that puts the rarest
first, as far as a sketch of `SKETCH` counts can tell: in whatever common order, a set of n
features meets every similar one within its first n - ceil(similarity * n) + 1, and features that
few others of these nodes have take up those places. So nodes
that share a passage and little else drop out here. Where groups are still crowded, their
nodes form families (whatever such groups connect), and each family is compared in
whole, block against block, by counting shared features. Blocks hold nodes of like sizes and
a bounded number of features, and only blocks whose sizes allow the similarity meet; only
links that join components leave such a task. Pairs of one family need no other comparison.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, stored
from ._text import Words, chunks, distinct_rows, mix

SIGNATURES = 96
PART_SIZE = 5
SMALL_K = 32
HOT_GROUP = 32
#: Features of a block, about; and so of a task's memory.
BLOCK_FEATURES = 1 << 18
#: Slots of the sketch of how often features stand in crowded groups; a bound on what is collected.
SKETCH = 1 << 20
SEED = 0xA0761D6478BD642F
CHOICES = list(itertools.combinations(range(5), 3))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ordered by both; A-Z count as a-z."""
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    words = Words(low, offsets)
    h, inside = words.windows(width)
    at = np.flatnonzero(inside)
    doc, value = words.doc[at], h[at]
    for n in range(1, width):
        short = np.flatnonzero(words.count == n)
        if len(short):
            g, _ = words.windows(n)
            doc, value = np.append(doc, short), np.append(value, g[words.first[short]])
    one = distinct_rows(doc, value)
    return doc[one], value[one]


def grids(similarity: float, largest: int) -> list[tuple[int, int]]:
    """(largest size, k) of each band, until `largest` is covered, and one more."""
    out, low = [], 1
    while not out or out[-1][0] < largest or low <= largest:
        high = int(low / similarity + 1e-9)
        out.append((high, int(2 * (1 - similarity) / (1 + similarity) * high + 1e-9)))
        low = high + 1
    high = int(low / similarity + 1e-9)
    return [*out, (high, int(2 * (1 - similarity) / (1 + similarity) * high + 1e-9))]


def _tag(*parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(SEED) + np.asarray(p).astype(np.uint64) + np.uint64(1))
    return h


def front(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many first features of a set, in any common order, hold one of each similar set's first ones."""
    share = round(similarity * 1000)
    return sizes - (share * sizes + 999) // 1000 + 1


def _sign_fronts(doc, value, first, sizes, vague, grid, similarity, rows, found) -> None:
    place = np.arange(len(doc)) - first[doc]
    use = np.flatnonzero(vague[doc] & (place < front(sizes, similarity)[doc]))
    found.append(mix(mix(value[use] + np.uint64(SEED)) ^ _tag(grid[doc[use]], 50)))
    rows.append(doc[use])


def signatures(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets given as ordered (row, hash) pairs with their sizes."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    table = grids(similarity, int(sizes.max()))
    top, ks = np.array([t[0] for t in table]), np.array([t[1] for t in table])
    rows, found = [], []
    first = np.concatenate([[0], np.cumsum(sizes)])
    for step in (0, 1):
        grid = np.searchsorted(top, sizes) + step
        k = ks[grid]
        for d in np.flatnonzero((k <= 2) & (sizes > 0)):
            h = mix(value[first[d] : first[d + 1]] + np.uint64(SEED))
            total = h.sum(dtype=np.uint64)
            cut = [h[list(c)].sum(dtype=np.uint64) for n in range(min(int(k[d]), len(h) - 1) + 1) for c in itertools.combinations(range(len(h)), n)]
            found.append(mix((total - np.array(cut, dtype=np.uint64)) ^ _tag(grid[d], 0)))
            rows.append(np.full(len(cut), d))
        n1 = np.where((k > 2) & (k <= SMALL_K), -(-(k + 1) // 3), 0)
        base = np.concatenate([[0], np.cumsum(n1)])
        if base[-1]:
            use = np.flatnonzero(n1[doc] > 0)
            v = mix(value[use] + np.uint64(SEED))
            p1 = ((v >> np.uint64(32)) * n1[doc[use]].astype(np.uint64)) >> np.uint64(32)
            p2 = ((v & np.uint64(0xFFFFFFFF)) * np.uint64(5)) >> np.uint64(32)
            slot = (base[doc[use]] + p1.astype(np.int64)) * 5 + p2.astype(np.int64)
            sums, n = np.zeros(base[-1] * 5, np.uint64), np.bincount(slot, minlength=base[-1] * 5).reshape(-1, 5)
            np.add.at(sums, slot, mix(v))
            sums = sums.reshape(-1, 5)
            owner = np.repeat(np.arange(len(sizes)), n1)
            part = np.arange(base[-1]) - base[owner]
            least = np.sort(n, axis=1)[:, :3].sum(1)
            vague = np.zeros(len(sizes), dtype=bool)
            vague[owner[least == 0]] = True
            _sign_fronts(doc, value, first, sizes, vague, grid, similarity, rows, found)
            for c, chosen in enumerate(CHOICES):
                full = np.flatnonzero(n[:, chosen].sum(1) > 0)
                found.append(mix(sums[full][:, chosen].sum(1, dtype=np.uint64) ^ _tag(grid[owner[full]], 1 + c, part[full])))
                rows.append(owner[full])
        n1 = np.where(k > SMALL_K, -(-top[grid] // PART_SIZE), 0)
        for seed in range(SIGNATURES):
            live = (n1 > 0) & (n1 * seed < SIGNATURES)
            if not live.any():
                break
            take = np.where(live, np.minimum(n1, SIGNATURES), 0)
            base = np.concatenate([[0], np.cumsum(take)])
            use = np.flatnonzero(live[doc])
            v = mix(value[use] + np.uint64(SEED * (2 * seed + 3) & 0xFFFFFFFFFFFFFFFF))
            p = (((v >> np.uint64(32)) * n1[doc[use]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            inside = p < take[doc[use]]
            slot = base[doc[use[inside]]] + p[inside]
            sums, n = np.zeros(base[-1], np.uint64), np.bincount(slot, minlength=base[-1])
            np.add.at(sums, slot, mix(v[inside]))
            full = np.flatnonzero(n >= 3)
            owner = np.repeat(np.arange(len(sizes)), take)[full]
            found.append(mix(sums[full] ^ _tag(grid[owner], 100 + seed, full - base[owner])))
            rows.append(owner)
    return np.concatenate(rows), np.concatenate(found)


def _sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit identity of each row's set."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(SEED)), out=total[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return mix(np.diff(total[edge]) + np.diff(edge).astype(np.uint64) * np.uint64(SEED))


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            doc, value = shingles(data, offsets, width)
            n = len(offsets) - 1
            yield batch.slice(row, n), doc, value, np.bincount(doc, minlength=n), _sums(doc, value, n)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def _runs(batches: Iterator[pa.RecordBatch]):
    """Whole groups of equal first column from ordered batches, as many as have arrived."""
    waiting: list[list[np.ndarray]] = []

    def flush() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*waiting, strict=True)]

    for batch in batches:
        cols = [np.array(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (waiting and waiting[-1][0][0] != cols[0][0]):
            waiting.append([c[:cut] for c in cols])
            if any(len(w[0]) for w in waiting):
                yield flush()
            waiting = []
        waiting.append([c[cut:] for c in cols])
    if waiting:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node, head) of signatures with several nodes; head is the group's least node.

    Rows come ordered by both and pass through, so a group of any size takes no memory.
    """
    last_sig = last_node = head = None
    lone = False  # the open group has one node so far, which has not been passed on
    for batch in batches:
        sig, node = np.array(batch.column(0)), np.array(batch.column(1))
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        if len(sig) and sig[0] == last_sig and node[0] == last_node:
            new[0] = False
        sig, node = sig[new], node[new]
        if not len(sig):
            continue
        going_on = sig[0] == last_sig
        start = np.flatnonzero(np.concatenate([[not going_on], sig[1:] != sig[:-1]]))
        if going_on:
            start = np.concatenate([[0], start])
        length = np.diff(np.append(start, len(sig)))
        heads = node[start].copy()
        if going_on:
            heads[0] = head
        many = length > 1
        many[0] |= going_on
        wait = not many[-1]
        out = np.repeat(many, length)
        columns = [sig[out], node[out], np.repeat(heads, length)[out]]
        if going_on and lone:
            columns = [np.concatenate([[x], c]) for x, c in zip((last_sig, head, head), columns, strict=True)]
        lone = wait
        last_sig, last_node, head = sig[-1], node[-1], heads[-1]
        if len(columns[0]):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["sig", "node", "head"])


def _pairs(found: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    one = distinct_rows(a, b)
    return pa.record_batch([pa.array(a[one]), pa.array(b[one])], ["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of nodes of one signature, from different components and families, of like sizes."""
    for sig, part, node, size, family in _runs(batches):
        edge = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
        found, waiting = [], 0
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if part[lo] == part[hi - 1]:
                continue
            for i in range(lo, hi - 1):
                j = int(np.searchsorted(part[i:hi], part[i], side="right")) + i
                other = np.arange(j, hi)
                like = 4 * np.minimum(size[other], size[i]) >= 3 * np.maximum(size[other], size[i])
                other = other[like & (family[other] != family[i])]
                if len(other):
                    a, b = np.full(len(other), node[i]), node[other]
                    found.append((np.minimum(a, b), np.maximum(a, b)))
                    waiting += len(other)
                if waiting > 1 << 18:
                    yield _pairs(found)
                    found, waiting = [], 0
        if found:
            yield _pairs(found)


def block_links(table: pa.Table, share: int) -> pa.Table:
    """Verified links (a, b) that join components, of the pairs a task's rows stand for.

    Rows are (family, low, high, own, node, part, set): own is the row's block; the task
    compares block low with block high, or low within itself. Shared features are counted
    by way of the postings of the right-hand rows.
    """
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    own, node, part = (np.array(table.column(c)) for c in ("own", "node", "part"))
    sets = table.column("set").combine_chunks()
    sizes = np.array(sets.value_lengths(), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    value = np.array(sets.flatten())
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    row = np.repeat(np.arange(len(sizes)), sizes)
    posted = np.flatnonzero((own == high)[row])
    posted = posted[np.argsort(value[posted], kind="stable")]
    keys, rows = value[posted], row[posted]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    a, b = [], []
    for i in left:
        if (part[right] == part[i]).all():
            continue
        mine = value[first[i] : first[i + 1]]
        lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(rows[at], minlength=len(sizes))[right]
        fits = right[(1000 * common >= share * (sizes[i] + sizes[right] - common)) & (part[right] != part[i])]
        for j in fits.tolist():
            x, y = root(int(part[i])), root(int(part[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(int(node[i]))
                b.append(int(node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_components(docs: DataFrame, similarity: float = 0.75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id of every row.

    Words are lower-cased A-Z; a text of fewer words than `width` has one shingle, its
    whole sequence; null and wordless texts have none and link with nothing. Sets link
    when their Jaccard similarity is `similarity` or more; component_id is the least id
    reachable by links, a row's own id included. Rows with a null id take no part and get
    a null component. Rows that share an id are separate sets under one name. Extra
    columns are ignored; an empty table gives an empty result. Sets and shingles are told
    apart by 64-bit hashes.
    """
    if not 0.75 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.75 and 1")
    share = round(similarity * 1000)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, sizes, node in _sets(batches, width):
            yield pa.record_batch([rows.column(0), pa.array(sizes, pa.int64()), _long(node)], ["id", "n", "node"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, doc, value, sizes, node in _sets(batches, width):
            _, at = np.unique(node, return_index=True)
            at = at[[x not in seen for x in node[at].tolist()]]
            seen.update(node[at].tolist())
            first = np.zeros(len(node), dtype=bool)
            first[at] = True
            keep = first[doc]
            row, sig = signatures(doc[keep], value[keep], np.where(first, sizes, 0), similarity)
            yield pa.record_batch([_long(sig), _long(node[row])], ["sig", "node"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                doc, value = shingles(data, offsets, width)
                ends = np.searchsorted(doc, np.arange(len(offsets)))
                sets = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), _long(value)).cast(pa.list_(pa.int64()))
                rows = pa.record_batch([batch.column(2).slice(row, len(sets)), sets], ["node", "set"])
                yield rows.filter(pc.equal(rows.column(0), _long(_sums(doc, value, len(sets)))))  # an id may have other rows

    named = texts.filter("id is not null")
    about = stored(texts.mapInArrow(describe, "id long, n long, node long"), "sets")
    signed = named.mapInArrow(sign, "sig long, node long")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = signed.repartition(partitions, "sig").sortWithinPartitions("sig", "node")
    groups = stored(groups.mapInArrow(_repeated, "sig long, node long, head long"), "groups")

    nodes = groups.select("node").distinct()
    heads = about.filter("id is not null and n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"))
    heads = stored(heads, "heads")
    wanted = heads.join(nodes, "node", "left_semi")
    single = named.join(wanted.select("id", "node"), "id").select("id", "text", "node")
    sets = stored(single.mapInArrow(expand, "node long, set array<long>"), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        both = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
        return stored(both.filter(f"1000 * common >= {share} * (total - common)").select("a", "b"), "links")

    def by_rarest(crowd: DataFrame) -> DataFrame:
        """(sig, part, node, n, head) of the nodes of crowd: groups, now by features, that span several components."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(SKETCH, np.int64)
            for batch in batches:
                value = np.array(batch.column(0).flatten()).view(np.uint64)
                found += np.bincount((value % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            some = np.flatnonzero(found)
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(found[some])], ["slot", "n"])

        def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = counted.value
            for batch in batches:
                sizes = np.array(batch.column(3).value_lengths(), dtype=np.int64)
                value = np.array(batch.column(3).flatten())
                row = np.repeat(np.arange(len(sizes)), sizes)
                count = often[(value.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((value, count, row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = order[(place < np.repeat(front(sizes, similarity), sizes)) & (count[order] > 1)]
                whose = pa.array(row[at])
                yield pa.record_batch([pa.array(value[at]), *(batch.column(c).take(whose) for c in (1, 0, 2))], ["sig", "part", "node", "n"])

        members = stored(crowd.join(sets, "node").dropDuplicates(["node"]).select("node", "part", "n", "set"), "crowd")
        often = np.zeros(SKETCH, np.int64)
        for batch in members.select("set").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
            often[np.array(batch.column(0))] = np.array(batch.column(1))
        counted = docs.sparkSession.sparkContext.broadcast(often)
        posted = stored(members.mapInArrow(fronts, "sig long, part long, node long, n long"), "posted")
        open_ = posted.groupBy("sig").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("node").alias("head")).filter("x < y").select("sig", "head")
        return stored(posted.join(open_, "sig").select("sig", "part", "node", "n", "head"), "placed")

    def in_families(crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        family = components(crowded.select(F.col("head").alias("a"), F.col("node").alias("b")).filter("a <> b")).withColumnRenamed("component", "family")
        family = stored(family.join(crowded.select("node", "part", "n").distinct(), "node"), "families")
        # similar sizes differ by a factor of 4/3 at most, so similar nodes are in one band or in neighbouring ones
        banded = family.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.34))))
        blocks = banded.groupBy("family", "band").agg(F.ceil(F.sum("n") / BLOCK_FEATURES).alias("blocks"))
        near = blocks.withColumn("code", F.expr("explode(transform(sequence(0L, blocks - 1), x -> (band << 32) + x))"))
        near = near.select("family", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), F.col("code").alias("other"))
        whole = banded.join(blocks, ["family", "band"]).withColumn("own", F.expr("(band << 32) + pmod(xxhash64(node), blocks)"))
        whole = whole.join(sets, "node").dropDuplicates(["node"]).join(near, ["family", "band"])
        whole = whole.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "part", "set")
        links = whole.groupBy("family", "low", "high").applyInArrow(lambda t: block_links(t, share), "a long, b long")
        return stored(links, "links"), family.select("node", "family")

    def divide(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups of more than HOT_GROUP nodes, and the others."""
        hot = stored(placed.groupBy("sig").count().filter(f"count > {HOT_GROUP}").select("sig"), "hot")
        return placed.join(hot, "sig", "left_semi"), placed.join(hot, "sig", "left_anti")

    star = groups.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(star)
    parts = stored(components(links), "parts")
    placed = groups.join(parts, "node", "left").select("sig", "node", "head", F.coalesce("component", "node").alias("part"))
    open_ = placed.groupBy("sig").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("sig")
    placed = stored(placed.join(open_, "sig", "left_semi").join(heads.select("node", "n"), "node").select("sig", "part", "node", "n", "head"), "placed")
    hot, cold = divide(placed)
    family = None
    if not hot.isEmpty():
        hot, rest = divide(by_rarest(hot.select("node", "part", "n").distinct()))
        cold = cold.unionAll(rest)
        # a node meets few heads in its many hot groups, so one row for each head says as much as one for each group
        crowded = stored(hot.select("head", "node", "part", "n").distinct(), "crowded")
        inside, family = in_families(crowded) if not crowded.isEmpty() else (None, None)
    more = cold.join(family, "node", "left") if family is not None else cold.withColumn("family", F.lit(None).cast("long"))
    more = more.select("sig", "part", "node", "n", F.coalesce("family", "node").alias("family"))
    more = more.repartition(partitions, "sig").sortWithinPartitions("sig", "part", "node").mapInArrow(_across, "a long, b long").distinct()
    more = more.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = verified(more)
    if family is not None:
        more = more.unionAll(inside)
    if not more.isEmpty():
        parts = stored(components(links.unionAll(more)), "parts")
    least = parts.join(heads, "node").groupBy("component").agg(F.min("id").alias("low"))
    named_parts = parts.join(least, "component").select("node", "low")
    out = about.join(heads.select("node", F.col("id").alias("head")), "node", "left").join(named_parts, "node", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("low", "head"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair that shares a shingle, counted; reachability by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
