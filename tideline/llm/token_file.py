"""Token ids in Arrow stream files of fixed-size-list batches.

Method: documents are dealt to shards by ranges of their id, and each shard writes its ids
in ascending order into one Arrow stream whose rows are sequences of `length` ids and a mask
of as many bits, lowest bit first (1 for an id, 0 for filling at the shard's end). Rows have equal length and
buffers are uncompressed, and every batch but the last has as many rows, so a reader reaches sequence k by
arithmetic: in a mapped file without decoding or copying, elsewhere by reading one batch. A
second stream beside it lists the documents.

There are as many shards as shuffle partitions, and more where a shard would get more than
about `SHARD_BYTES` of text. Ids take the width that the tokenizer's largest one needs.

Files go to the shared folder under a name of the attempt and are renamed when whole, so a
task that is lost or runs twice leaves one whole file. Each task holds one batch of ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pieces import library_coder, text_slices
from ._spark import own_dir, stored

LENGTH = 2048
BATCH_ROWS = 256
SHARD_BYTES = 64 << 20


def schema(length: int, wide: bool) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows, else four; the mask takes a bit."""
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([pa.field("ids", pa.list_(ids, length), nullable=False), pa.field("mask", pa.list_(pa.uint8(), -(-length // 8)), nullable=False)])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema = schema(length, wide)
        self.out, self.length, self.waiting = pa.ipc.new_stream(sink, self.schema), length, bytearray()

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        while len(self.waiting) >= 4 * self.length * BATCH_ROWS:
            self._write(BATCH_ROWS)

    def _write(self, rows: int) -> None:
        upto = 4 * self.length * rows
        ids = np.frombuffer(bytes(self.waiting[:upto]), "<u4")
        n = len(ids)
        if n < rows * self.length:
            ids = np.concatenate([ids, np.zeros(rows * self.length - n, "<u4")])
        mask = np.packbits((np.arange(rows * self.length) < n).reshape(rows, -1), axis=1, bitorder="little")
        del self.waiting[:upto]
        kind = np.dtype(self.schema.field("ids").type.value_type.to_pandas_dtype())
        if n and ids.max() > np.iinfo(kind).max:
            raise OverflowError(f"id {ids.max()} does not fit {kind}")
        ids = ids.astype(kind)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n) for x, n in ((ids, self.length), (mask, mask.shape[1]))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(-(-len(self.waiting) // (4 * self.length)))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one stream: file[k] is the ids and the mask's bits, both views of a batch's buffers.

    source is an open file. Where it is mapped, a batch is a view of it; else the batch that holds k is read.
    """

    def __init__(self, source: pa.NativeFile):
        self.source = source
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(source))
        self.begin, self.held = source.tell(), (-1, None)
        end = source.size() - 8  # the stream ends with a marker of eight bytes
        self.step, self.rows = 1, 0
        if end > self.begin:
            self.step = end - self.begin
            self.rows = len(self._batch(0))
            self.step = source.tell() - self.begin
        self.batches = -(-(end - self.begin) // self.step)
        self.total = self.rows if self.batches < 2 else (self.batches - 1) * self.rows + len(self._batch(self.batches - 1))

    def _batch(self, b: int) -> pa.RecordBatch:
        if self.held[0] != b:
            self.source.seek(self.begin + b * self.step)
            self.held = (b, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema))
        return self.held[1]

    def __len__(self) -> int:
        return self.total

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        return tuple(self._flat(k // self.rows, c)[k % self.rows] for c in (0, 1))

    def mask(self, k: int) -> np.ndarray:
        """Which places of sequence k hold ids."""
        ids, bits = self[k]
        return np.unpackbits(bits, count=len(ids), bitorder="little").astype(bool)

    def _flat(self, batch: int, column: int) -> np.ndarray:
        lists = self._batch(batch).column(column)
        return lists.flatten().to_numpy(zero_copy_only=True).reshape(len(lists), -1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of the whole run."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        length = self.schema.field("ids").type.list_size
        parts = []
        for b in range(start // length // self.rows, (stop - 1) // length // self.rows + 1):
            flat, low = self._flat(b, 0).ravel(), b * self.rows * length
            parts.append(flat[max(start - low, 0) : stop - low])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _filesystem(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def read_shard(directory: str, shard: int) -> tuple[SequenceFile, pa.Table]:
    """The sequences and the document list of a shard; local files are mapped, of others batches are read."""
    files, root = _filesystem(directory)
    name = f"{root}/shard-{shard:06d}"
    local = isinstance(files, pa.fs.LocalFileSystem)
    source = pa.memory_map(f"{name}.arrows") if local else files.open_input_file(f"{name}.arrows")
    with pa.ipc.open_stream(files.open_input_file(f"{name}.docs.arrows")) as stream:
        return SequenceFile(source), stream.read_all()


def largest_id(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write_token_files(docs: DataFrame, tokenizer: str, directory: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns (shard, documents, tokens) of those written.

    Shards ascend with ids. A null text counts as empty and has its end id alone; rows with
    a null id come first, rows that share an id stand together in the order of their
    texts' hashes, over several shards if they are many. Extra columns are ignored. An empty table writes nothing.
    """
    wide = max(largest_id(tokenizer), end_id) >= 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end, task = library_coder(tokenizer, spaced=False), np.array([end_id], "<u4").tobytes(), TaskContext.get()
        files, root = _filesystem(directory)
        shard = task.partitionId()
        parts = {kind: f"{root}/.attempt-{shard:06d}-{task.taskAttemptId()}{kind}" for kind in (".arrows", ".docs.arrows")}
        writer = listed = None
        start = documents = 0
        for batch in batches:
            for row, texts in text_slices(batch.column(1)):
                if writer is None:
                    sinks = [files.open_output_stream(p) for p in parts.values()]
                    writer, listed = SequenceWriter(sinks[0], length, wide), pa.ipc.new_stream(sinks[1], DOCUMENTS)
                coded = [ids + end for ids in coder.encode(texts)]
                for ids in coded:
                    writer.add(ids)
                size = np.array([len(ids) // 4 for ids in coded], np.int64)
                begin = start + np.cumsum(size) - size
                listed.write_batch(pa.record_batch([batch.column(0).slice(row, len(texts)), pa.array(begin), pa.array(size)], schema=DOCUMENTS))
                start += int(size.sum())
                documents += len(texts)
        if writer is None:
            return
        writer.close()
        listed.close()
        for sink in sinks:
            sink.close()
        for kind, part in parts.items():
            files.move(part, f"{root}/shard-{shard:06d}{kind}")
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([documents], pa.int64()), pa.array([start], pa.int64())], ["shard", "documents", "tokens"])

    files, root = _filesystem(directory)
    files.create_dir(root, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    texts = texts.withColumn("h", F.xxhash64("text"))
    ranged = texts.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    return ranged.mapInArrow(write, "shard int, documents long, tokens long")


def read_documents(written: DataFrame, directory: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files.

    start counts the ids of all documents before it, over all shards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sequences, listed = read_shard(directory, shard)
                for part in listed.to_batches(max_chunksize=4096):
                    starts, sizes = np.array(part.column(1)), np.array(part.column(2))
                    crc = [zlib.crc32(np.ascontiguousarray(sequences.ids(s, s + n).astype("<u4"))) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.record_batch([part.column(0), pa.array(starts + base), part.column(2), pa.array(crc, pa.int64()), pa.array(np.full(len(part), shard), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    # one row for each file, so the running sum in one task is small
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = written.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    count = max(1, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bases.repartition(count, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op8_token_file(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of documents, read back from files."""
    import public_tokenizers

    directory = f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = stored(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), directory), "written")
    return read_documents(written, directory).select("doc_id", "start", "n_tokens", "ids_crc32")
