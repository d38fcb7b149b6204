"""Substring dedup: remove passages of at least `window` words that an earlier document holds.

Method: Rabin-Karp hashes of every fixed-length word window, counted in Spark.
To count them without sending each window through a shuffle, every window is
filed under its anchor, the least hash of its `gram`-word grams. Equal windows
have equal anchors, so an anchor that one document alone holds settles all its
windows where they are. Neighbouring windows with one anchor form a run:

1. (anchor, run hash, id) is grouped; a run that an earlier document holds is
   repeated as a whole.
2. Anchors that hold different runs (a passage's ends, or edits inside it) are
   opened: the first document of each such run sends its single windows, which are
   counted by (anchor, window hash).
3. Repeated runs and windows of a document are merged into maximal intervals of
   words, and those words are removed.

No row holds more than one document's hashes, and no group is collected: hot
passages meet only in min/max aggregates, which combine before the shuffle, and in
joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored
from ._text import ALT_BASE, Words, chunks, distinct_rows, mix, prefix, sliding_min, span_hashes

GRAM_BASE = 0xC2B2AE3D27D4EB4F


def _runs(words: Words, window: int, gram: int):
    """Window hashes, their anchors, and the runs: first window, end window, anchor, hash, row."""
    h, inside = words.windows(window)
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return at, none.view(np.uint64), none, none, none.view(np.uint64), none.view(np.uint64), none
    g, _ = words.windows(gram, GRAM_BASE)
    anchor = sliding_min(g, window - gram + 1)[at]
    doc = words.doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))
    sums = prefix(words.hash, ALT_BASE)
    run = span_hashes(sums, at[begin], at[end - 1] + window, ALT_BASE)
    return at, h[at], begin, end, anchor[begin], run, doc[begin]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _batches(batch: pa.RecordBatch):
    for row, data, offsets in chunks(batch.column(1)):
        yield batch.slice(row, len(offsets) - 1), Words(data, offsets)


def _listed(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """The hashes listed for each row, each made distinct by its row."""
    lists = rows.column(name)
    lengths = np.array(lists.value_lengths().fill_null(0))
    values = np.array(lists.flatten(), dtype=np.int64).view(np.uint64)
    return values + mix(np.repeat(np.arange(1, len(rows) + 1), lengths).astype(np.uint64))


def _in_row(values: np.ndarray, doc: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    return np.isin(values + mix((doc + 1).astype(np.uint64)), listed)


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    starts, lengths, doc = words.starts[keep], (words.ends - words.starts)[keep], words.doc[keep]
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    put = np.concatenate([[0], np.cumsum(lengths + ~last)])
    got = np.concatenate([[0], np.cumsum(lengths)])
    step = np.arange(got[-1])
    out = np.full(put[-1], 32, np.uint8)
    out[step + np.repeat(put[:-1] - got[:-1], lengths)] = words.data[step + np.repeat(starts - got[:-1], lengths)]
    ends = put[np.searchsorted(doc, np.arange(len(words.count) + 1))]
    return pa.LargeStringArray.from_buffers(len(words.count), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Remove each word covered by a window whose words also start in a row with a smaller id.

    Windows are judged on the input. Returns id_col, text_col (kept words joined by
    one space), n_words, n_removed, spans (removed intervals [start, end) in words,
    maximal, in order) and the columns named in `carry`. Other columns are ignored,
    whatever their names.

    A null text has no words. A null id is smaller than none and larger than none:
    such a row loses nothing and takes nothing. Rows that share an id are one
    document's parts: none removes from another, and each loses what a smaller id
    holds. Repeats inside one document stay. Texts under `window` words stay whole.
    An empty table gives an empty result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    if clash := {*carry} & {id_col, text_col, "n_words", "n_removed", "spans"}:
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in _batches(batch):
                _, _, _, _, anchor, run, doc = _runs(words, window, gram)
                one = distinct_rows(doc, run)
                yield pa.record_batch([_long(anchor[one]), _long(run[one]), rows.column(0).take(pa.array(doc[one]))], ["a", "s", "id"])

    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in _batches(batch):
                at, h, begin, end, anchor, run, doc = _runs(words, window, gram)
                wanted = np.flatnonzero(_in_row(run, doc, _listed(rows, "runs")))
                length = (end - begin)[wanted]
                each = np.repeat(wanted, length)
                inside = np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length) + begin[each]
                yield pa.record_batch([_long(anchor[each]), _long(h[inside]), rows.column(0).take(pa.array(doc[each]))], ["a", "h", "id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in _batches(batch):
                at, h, begin, end, _, run, doc = _runs(words, window, gram)
                hit = np.repeat(_in_row(run, doc, _listed(rows, "runs")), end - begin)
                hit |= _in_row(h, words.doc[at], _listed(rows, "hits"))
                step = np.zeros(len(words.starts) + 1, np.int64)
                step[at[hit]] += 1
                over = np.zeros(len(words.starts) + 1, np.int64)
                over[at[hit] + window] += 1
                gone = np.cumsum(step - over)[:-1] > 0
                edge = gone.copy()
                edge[1:] &= ~(gone[:-1] & (words.doc[1:] == words.doc[:-1]))
                stop = gone.copy()
                stop[:-1] &= ~(gone[1:] & (words.doc[1:] == words.doc[:-1]))
                a, b = np.flatnonzero(edge), np.flatnonzero(stop) + 1
                base = words.first[words.doc[a]]
                spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], ["start", "end"])
                per_row = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, words.first), pa.int32()), spans)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                out = [rows.column(0), joined_words(words, ~gone), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), per_row]
                yield pa.record_batch([*out, *(rows.column(k) for k in range(4, rows.num_columns))], names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = stored(texts.filter("id is not null").mapInArrow(find_runs, "a long, s long, id long"), "runs")
    firsts = runs.groupBy("a", "s").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    firsts = stored(firsts, "firsts")
    whole = runs.join(firsts.filter("lo < hi").select("a", "s", "lo"), ["a", "s"]).filter("id > lo")
    whole = whole.groupBy("id").agg(F.collect_set("s").alias("runs"))
    mixed = firsts.groupBy("a").agg(F.count("*").alias("n"), F.min("lo").alias("x"), F.max("lo").alias("y")).filter("n > 1 and x < y").select("a")
    opened = firsts.join(mixed, "a").groupBy(F.col("lo").alias("id")).agg(F.collect_set("s").alias("runs"))
    single = stored(texts.join(opened, "id").select("id", "text", "runs").mapInArrow(open_runs, "a long, h long, id long"), "windows")
    shared = single.groupBy("a", "h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    hits = single.join(shared.select("a", "h", "lo"), ["a", "h"]).filter("id > lo").groupBy("id").agg(F.collect_set("h").alias("hits"))

    found = whole.join(hits, "id", "full")
    rest = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    whole_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *rest)
    whole_rows = whole_rows.join(found, "id", "left").select("id", "text", "runs", "hits", *(f"c{k}" for k in range(len(carry))))
    names = ["id", "text", "n_words", "n_removed", "spans", *(f"c{k}" for k in range(len(carry)))]
    kinds = ["long", "string", "long", "long", "array<struct<start:int,end:int>>", *(whole_rows.schema[f"c{k}"].dataType.simpleString() for k in range(len(carry)))]
    out = whole_rows.mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
    return out.toDF(id_col, text_col, "n_words", "n_removed", "spans", *carry)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: Window texts as lists; the first document of each list decides.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)
), f AS (
  SELECT t, min(doc_id) AS lo, max(doc_id) AS hi FROM s GROUP BY t
), hit AS (
  SELECT s.doc_id, s.p FROM s JOIN f USING (t) WHERE f.lo < f.hi AND s.doc_id > f.lo
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM hit
), per AS (
  SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE
         list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(qs, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
