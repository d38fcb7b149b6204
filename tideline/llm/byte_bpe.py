"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Method: the words that the public pattern finds are laid out as token-position rows. A
recursive query joins neighbouring tokens with the merge table, picks each word's leftmost
pair of least rank and contracts it, which moves the later positions up, until no word has a
pair left. A word that is a token itself needs no contraction. Decoding joins ids with the vocabulary and concatenates the tokens' bytes by an
ordered aggregation. Each distinct word is contracted once for as long as a worker remembers
it; a word of more than `LONG_WORD` bytes, for which the recursion would take a round for
each byte, is contracted by the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import PieceCoder, text_slices
from ._text import HELD

LONG_WORD = 256
#: Words and tokens that one query takes at most.
WORDS_AT_ONCE, TOKENS_AT_ONCE = 20_000, 400_000
#: A worker forgets the later half of its words beyond so many, and of its pieces beyond so many bytes.
KNOWN_WORDS = 300_000
PIECE_BYTES = 200 << 20

CONTRACT = """
WITH RECURSIVE t(round, w, toks) AS (
  SELECT 0, w, toks FROM words
  UNION ALL
  (WITH positions AS (
     SELECT w, generate_subscripts(toks[2:], 1) AS p, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt FROM t
   ), best AS (
     SELECT w, min(rank::BIGINT * 65536 + p) AS b FROM positions JOIN merges ON pair = tok::BIGINT * 4294967296 + nxt GROUP BY w
   )
   SELECT round + 1, t.w, list_concat(list_append(toks[: b % 65536 - 1], (b // 65536)::INTEGER), toks[b % 65536 + 2 :])
   FROM t JOIN best ON t.w = best.w)
)
SELECT w, arg_max(toks, round) AS toks FROM t GROUP BY w ORDER BY w
"""

#: Tokens are written as text, one character U+0000 .. U+00FF for each byte.
DECODE = "SELECT d, array_to_string(list(bytes ORDER BY p), '') AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} lacks {len(missing)} single bytes")
    return ranks


class ByteBpe:
    """The merge table and vocabulary of a rank file in a DuckDB database in memory."""

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers
        import regex

        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.ranks = read_ranks(path)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.db.execute("SET preserve_insertion_order = false")
        merges = [(a << 32 | b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        pair, rank = zip(*merges, strict=True) if merges else ((), ())
        self._table("merges", pair=pa.array(pair, pa.int64()), rank=pa.array(rank, pa.int32()))
        self._table("vocabulary", tok=pa.array(list(self.ranks.values()), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in self.ranks], pa.string()))
        self.known: dict[str, bytes] = {}
        HELD.append(lambda: self.known.clear())

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _query(self, sql: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def contract(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of words, each contracted on its own."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                out[k] = self.contract_long(w)
            elif w:
                short.append(k)
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at : at + WORDS_AT_ONCE]
            lengths = np.array([len(words[k]) for k in part])
            data = np.frombuffer(b"".join(words[k] for k in part), np.uint8)
            edge = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            got = self._query(CONTRACT, "words", w=np.arange(len(part), dtype=np.int32), toks=pa.ListArray.from_arrays(edge, pa.array(self.of_byte[data])))
            toks = got.column("toks").combine_chunks()
            edge = (np.concatenate([[0], np.cumsum(np.array(toks.value_lengths()))]) * 4).tolist()
            ids = np.array(toks.flatten()).astype("<u4").tobytes()
            for k, a, b in zip(part, edge[:-1], edge[1:], strict=True):
                out[k] = ids[a:b]
        return out

    def contract_long(self, word: bytes) -> bytes:
        """The same contraction of one long word: a heap of (rank, position) and a linked list."""
        n = len(word)
        piece = [word[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda k: self.ranks.get(piece[k] + piece[after[k]]) if after[k] < n else None
        heap = [(r, k) for k in range(n - 1) if (r := rank(k)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if not piece[k] or rank(k) != r:
                continue
            gone = after[k]
            piece[k] += piece[gone]
            piece[gone] = b""
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for j in (before[k], k):
                if j >= 0 and (x := rank(j)) is not None:
                    heapq.heappush(heap, (x, j))
        return np.array([self.ranks[t] for t in piece if t], "<u4").tobytes()

    def code(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each match of the pattern separately.

        Most texts are one word; those are remembered by the caller, parts of others here.
        """
        find, known = self.find, self.known
        if len(known) > KNOWN_WORDS:
            known = self.known = dict(itertools.islice(known.items(), KNOWN_WORDS // 2))
        # letters with one space before them at most are one match
        parts = [t if t.isalpha() or (t[1:].isalpha() and t[0] == " ") else find(t) for t in texts]
        words: set[str] = set()
        for p in parts:
            if type(p) is str:
                words.add(p)
            else:
                words.update(p)
        new = [w for w in words if w not in known]
        coded = dict(zip(new, self.contract([w.encode() for w in new]), strict=True))
        out = []
        for p in parts:
            if type(p) is str:
                ids = known.get(p)
                out.append(coded[p] if ids is None else ids)
            else:
                for w in p:
                    if w not in known:
                        known[w] = coded[w]
                out.append(b"".join(map(known.__getitem__, p)))
        return out

    def decode(self, coded: Sequence[bytes]) -> list[bytes]:
        """Bytes of each run of ids."""
        out, size = [b""] * len(coded), np.array([len(c) // 4 for c in coded], np.int64)
        upto, at = np.cumsum(size), 0
        while at < len(coded):
            done = upto[at] - size[at]
            stop = max(at + 1, int(np.searchsorted(upto, done + TOKENS_AT_ONCE, side="right")))
            tok = np.frombuffer(b"".join(coded[at:stop]), "<u4").astype(np.int32)
            d = np.repeat(np.arange(at, stop, dtype=np.int32), size[at:stop])
            got = self._query(DECODE, "ids", d=d, p=np.arange(len(tok), dtype=np.int32), tok=tok)
            for k, text in zip(got.column("d").to_pylist(), got.column("bytes").to_pylist(), strict=True):
                out[k] = text.encode("latin-1")
            at = stop
        return out


_KEPT: dict[str, tuple[ByteBpe, PieceCoder]] = {}


def _coder(path: str) -> tuple[ByteBpe, PieceCoder]:
    if path not in _KEPT:
        bpe = ByteBpe(path)
        _KEPT[path] = bpe, PieceCoder(bpe.code, spaced=True, cache_bytes=PIECE_BYTES)
    return _KEPT[path]


def byte_bpe(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every text by the rank file and decode the ids again.

    Returns id_col, n_tokens, ids (array<int>) and decoded (binary), or with `digests`
    n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256. There are no special tokens. Null and empty texts have no ids. Rows are
    coded one by one, whatever their ids, and repeated rows give repeated results. Extra
    columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, coder = _coder(ranks)
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        for batch in batches:
            for row, texts in text_slices(batch.column(1)):
                coded = coder.encode(texts)
                decoded = bpe.decode(coded)
                n = pa.array([len(c) // 4 for c in coded], pa.int64())
                if digests:
                    out = [sha(coded), sha(decoded)]
                else:
                    out = [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                yield pa.record_batch([batch.column(0).slice(row, len(texts)), n, *out], names)

    names = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("string", "string") if digests else ("array<int>", "binary")
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = texts.mapInArrow(run, f"id long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")
    return out.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded (binary) of rows of ids; null ids decode to nothing, ids outside the vocabulary are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _coder(ranks)
        for batch in batches:
            coded = [np.array(x or (), "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bpe.decode(coded), pa.binary())], ["id", "decoded"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents."""
    import public_tokenizers

    return byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)
