"""Best-fit packing by sums of squares.

Method: a document goes where the sum, over residual gaps, of the squared number of open
sequences with that gap becomes smallest. Only the counts per gap are needed to choose, so
a placement costs one vector operation over `length` gaps whatever the number of open
sequences.

Documents are tokenised once; pieces as long as a sequence need no packing. The others are
dealt to shards of about `SHARD` pieces by a hash, and each shard packs its own, longest
first. Sequences that a shard leaves less than `FULL` full are opened again and their
pieces packed anew across shards, round after round while that can help, so what sharding
costs does not grow with the number of shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import text_slices, whole_text_coder
from ._spark import stored

LENGTH = 2048
SHARD = 20_000
FULL = 0.97
MAX_ROUNDS = 4


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the given order; ties go to the fullest bin."""
    open_with = np.zeros(capacity + 1, np.int64)
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, n in enumerate(lengths.tolist()):
        left = capacity - n
        # half the change of the sum: a gap g loses a bin and g - n gains one; gap 0 counts as closed
        change = 1.0 - open_with[n : capacity + 1]
        change[1:] += open_with[1 : left + 1]
        change[0] -= 0.5
        change[open_with[n : capacity + 1] == 0] = np.inf
        gap = int(change.argmin()) + n
        if open_with[left] + 0.5 < change[gap - n] or not open_with[gap]:
            gap, at = capacity, made
            made += 1
        else:
            at = bins_with[gap].pop()
            open_with[gap] -= 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > n:
            open_with[gap - n] += 1
            bins_with[gap - n].append(at)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc, row, piece, start, length, ids_crc32[, ids]) of the pieces of each text's ids with its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = whole_text_coder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for row, texts in text_slices(batch.column(1)):
                doc, piece, start, size, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(coder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    parts = -(-n // length)
                    at = 0
                    for p in range(parts):
                        upto = n - length * (parts - 1 - p)
                        part = ids[4 * at : 4 * upto]
                        doc.append(row + k)
                        piece.append(p)
                        start.append(at)
                        size.append(upto - at)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                        at = upto
                columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                yield pa.record_batch(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    names = ["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(cut, "doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """pieces (with a unique column key) and where they go: sequence_id and offset."""

    def place(table: pa.Table) -> pa.Table:
        size, where = np.array(table.column("length")), table.column("shard")[0].as_py()
        order = np.lexsort((np.array(table.column("key")), -size))
        bins, offsets = sum_of_squares(size[order], length)
        filled = np.bincount(bins, weights=size[order]).astype(np.int64)
        put = [np.empty(len(size), np.int64) for _ in range(3)]
        for column, values in zip(put, (bins, offsets, filled[bins]), strict=True):
            column[order] = values
        return pa.table({"key": table.column("key"), "length": table.column("length"), "shard": pa.array(np.full(len(size), where), pa.int32()), "bin": put[0], "offset": put[1], "filled": put[2]})

    short = pieces.filter(F.col("length") < length).select("key", "length")
    count, done, rounds = short.count(), None, 0
    while count:
        shards = max(1, round(count / shard))
        dealt = short.withColumn("shard", F.expr(f"cast(pmod(xxhash64(key, {rounds}), {shards}) as int)"))
        placed = stored(dealt.groupBy("shard").applyInArrow(place, "key long, length long, shard int, bin long, offset long, filled long"), "placed")
        rounds += 1
        loose = F.col("filled") < FULL * length
        left = placed.filter(loose).count() if shards > 1 and rounds < MAX_ROUNDS else 0
        again = 0 < left < 0.9 * count
        kept = placed.filter(~loose) if again else placed
        kept = kept.select("key", F.struct(F.lit(rounds).alias("r"), "shard", "bin").alias("sequence"), "offset")
        done = kept if done is None else done.unionAll(kept)
        short, count = placed.filter(loose).select("key", "length"), left if again else 0
    # a round, its shard and its bin in one number; whole pieces are numbered below zero
    number = F.expr("(cast(sequence.r as long) << 58) + (cast(sequence.shard as long) << 27) + sequence.bin")
    whole = pieces.filter(F.col("length") >= length)
    whole = whole.select("*", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if done is None:
        return whole
    done = done.select("key", number.alias("sequence_id"), "offset")
    return pieces.filter(F.col("length") < length).join(done, "key").select(*whole.columns).unionAll(whole)


def best_fit_packing(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every document's ids into sequences of `length`.

    Returns for each piece id_col, piece, start, length, ids_crc32, sequence_id, offset and,
    on request, ids. A document's ids are the tokenizer's and then end_id; longer ones are
    cut so that only the first piece may be shorter than `length`. A null text counts as
    empty and has its end id alone. Rows with a null or repeated id are packed like others;
    each row's pieces are its own. Sequences have no gaps; sequence_id is a number of each sequence's own, without order. Extra columns are ignored. An empty table gives an empty result.
    """
    pieces = token_pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids)
    pieces = stored(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    out = pack(pieces, length)
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Where each piece of every row of documents goes."""
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
