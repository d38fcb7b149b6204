"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Method: the two words before a token, taken as vectors and each multiplied by a matrix of
its position, predict a vector; its product with a token's vector, plus the token's bias, is
the token's logit. The model knows the `VOCABULARY` most frequent words, the end, and
`BUCKETS` tokens for all other words, told apart by their last two bytes; such a word has its
bucket's probability times its share of the bucket's smoothed unigram mass. Tokens
are dealt to classes by frequency, and a token's probability is that of its class times
its own within the class, so that exact normalisation costs a few hundred products a token
and not the whole vocabulary.

Training (numpy) tells classes from draws of the classes' unigram distribution, and tokens from
draws of their class's. Scoring multiplies the predicted vectors of a slice's distinct
contexts by all class vectors at once, and those of a class's tokens by all its
token vectors, and normalises both, so log-probabilities sum to one.

Corpus statistics cover every training document: word counts are one aggregate, and every
training text is learnt from. Texts are dealt by a hash of their ids and themselves to groups of about `GROUP_TOKENS` tokens,
in an order of their own, so the model does not depend on how the table is cut. A group trains on a `ROUNDS`-th of
its texts at a time, from one common start; the groups' models are averaged in a tree, every vector
weighted by how often the group has met it, and the mean is the next round's start.

Executors hold the counts of the `FREQUENT` most frequent words (a bound in bytes); every
other word of a text is looked up by a join. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, stored
from ._text import Words, chunks, mix

VOCABULARY = 32_000
BUCKETS = 256
CLASSES = 160
FREQUENT = 200_000
WIDTH = 12
NOISE = 4
#: Draws that a batch shares: of classes, and of tokens of each class; NOISE is what they count for.
SHARED_NOISE = 64
SHARED_INNER = 16
BATCH_TOKENS = 16_384
RATE = 0.15
GROUP_TOKENS = 2_000_000
ROUNDS = 3
FAN_IN = 16


def lowered(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def buckets(words: Words, at=slice(None)) -> np.ndarray:
    """The bucket of each word, or of those at some places, by its last two bytes."""
    starts, ends = words.starts[at], words.ends[at]
    if not len(starts):
        return np.zeros(0, np.int64)
    last, before = words.data[ends - 1].astype(np.uint64), words.data[np.maximum(ends - 2, starts)].astype(np.uint64)
    return (mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


class Sorted:
    """Sorted 64-bit hashes, with an index by their leading bits for the first steps of a search."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        at = self.begin[keys >> self.shift]
        left = np.flatnonzero(self.hashes[at] < keys)
        for _ in range(32):
            at[left] += 1
            left = left[self.hashes[at[left]] < keys[left]]
        at[left] = np.searchsorted(self.hashes[:-1], keys[left])
        return np.where((self.hashes[at] == keys) & (at < len(self.hashes) - 1), at, np.int32(-1))


@dataclass
class Tokens:
    """Token numbers of a slice in order, each text ended; before: the two tokens before each."""

    ids: np.ndarray
    doc: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, words: Words, lexicon: Lexicon) -> Tokens:
        texts = len(words.count)
        ids = np.full(len(words.starts) + texts, lexicon.end, np.int32)
        ids[np.arange(len(words.starts)) + words.doc] = lexicon.number(words)
        return cls.run(ids, words.count + 1, lexicon.start)

    @classmethod
    def run(cls, ids: np.ndarray, lengths: np.ndarray, start: int) -> Tokens:
        doc = np.repeat(np.arange(len(lengths)), lengths)
        first = (np.cumsum(lengths) - lengths)[doc]
        at, before = np.arange(len(ids)), np.full((2, len(ids)), start, np.int32)
        for k in (1, 2):
            inside = at - k >= first
            before[k - 1, inside] = ids[at[inside] - k]
        return cls(ids.astype(np.int32), doc, before)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of the known words, sorted; the unigram share of each token number, and its class.

    Token numbers are those of the known words, then the buckets, the end and, as context only, the start.
    """

    hashes: np.ndarray
    share: np.ndarray
    klass: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, share: np.ndarray, classes: int = CLASSES) -> Lexicon:
        """Classes hold like sums of the square roots of shares: frequent tokens stand in small ones."""
        order = np.lexsort((np.arange(len(share)), -share))
        root = np.sqrt(share[order])
        klass = np.empty(len(share), np.int64)
        klass[order] = np.minimum((np.cumsum(root) - root) / root.sum() * classes, classes - 1).astype(np.int64)
        return cls(hashes, share / share.sum(), np.unique(klass, return_inverse=True)[1])

    @cached_property
    def table(self) -> Sorted:
        return Sorted(self.hashes)

    @property
    def end(self) -> int:
        return len(self.share) - 1

    @property
    def start(self) -> int:
        return len(self.share)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each known word, -1 for the others."""
        return self.table.find(hashes)

    def number(self, words: Words) -> np.ndarray:
        found = self.known(words.hash)
        other = np.flatnonzero(found < 0)
        found[other] = len(self.hashes) + buckets(words, other)
        return found


class LogBilinear:
    """context (vectors of tokens before), place (a matrix for each position), target and bias of
    tokens, kind and kind_bias of classes."""

    def __init__(self, lexicon: Lexicon, width: int = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, classes = len(lexicon.share), int(lexicon.klass.max()) + 1
        self.klass = lexicon.klass
        self.order = np.argsort(lexicon.klass, kind="stable")
        self.edge = np.searchsorted(lexicon.klass[self.order], np.arange(classes + 1))
        mass = np.bincount(lexicon.klass, weights=lexicon.share)
        self.class_share, self.inner = mass, lexicon.share / mass[lexicon.klass]
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.context = normal(n + 1, width) * np.float32(0.3)
        self.place = np.stack([np.eye(width)] * 2).astype(np.float32)
        self.target, self.bias = normal(n, width) * np.float32(0.1), np.log(self.inner).astype(np.float32)
        self.kind, self.kind_bias = normal(classes, width) * np.float32(0.1), np.log(mass).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.bias, self.kind, self.kind_bias]

    def log_probs(self, tokens: Tokens) -> np.ndarray:
        """Natural log-probability of each token, normalised over all token numbers."""
        n = len(self.context)
        order, pair, where, edge = _grouped(tokens.before[0].astype(np.int64) * n + tokens.before[1])
        moved = self.context @ self.place[0], self.context @ self.place[1]
        # one more component, for the bias
        h = np.ones((len(pair), self.context.shape[1] + 1), np.float32)
        np.add(moved[0][pair // n], moved[1][pair % n], out=h[:, :-1])
        kinds = np.column_stack([self.kind, self.kind_bias])
        klass = self.klass[tokens.ids]
        out = np.empty(len(tokens.ids), np.float64)
        for k in range(0, len(pair), 1024):
            rows = order[edge[k] : edge[min(k + 1024, len(pair))]]
            out[rows] = _log_softmax(h[k : k + 1024], kinds, where[rows] - k, klass[rows])
        order = np.argsort(_short(klass), kind="stable")
        edge = np.searchsorted(klass[order], np.arange(len(self.kind) + 1))
        spot = np.empty(len(self.klass), np.int64)
        spot[self.order] = np.arange(len(self.klass)) - np.repeat(self.edge[:-1], np.diff(self.edge))
        target, spot = np.column_stack([self.target, self.bias])[self.order], spot[tokens.ids]
        for c in np.flatnonzero(np.diff(edge)):
            members = target[self.edge[c] : self.edge[c + 1]]
            for k in range(edge[c], edge[c + 1], 1024):
                rows = order[k : min(k + 1024, edge[c + 1])]
                out[rows] += _log_softmax(h[where[rows]], members, np.arange(len(rows)), spot[rows])
        return out


def _log_softmax(h: np.ndarray, vectors: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Entries (row, column) of the normalised log-probabilities of h's products with all vectors."""
    logits = h @ vectors.T
    own = logits[row, column].astype(np.float64)
    top = 0.0
    longest = np.einsum("ij,ij->i", h, h).max() * np.einsum("ij,ij->i", vectors, vectors).max()  # bounds squared products
    if not longest < 60**2 and not -60 < logits[:, 0].min() <= logits.max() < 60:  # else sums neither overflow nor vanish
        top = logits.max(axis=1, keepdims=True)
        logits -= top
        top = top[row, 0]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))[row] - top


def _short(numbers: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in 16 bits where they fit, which are sorted by counting."""
    return numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of keys, the distinct ones, the place of each key among them, and where each begins in the order."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.diff(keys, prepend=-1) != 0
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return order, keys[begin], where, np.append(begin, len(keys))


class Trainer:
    """Noise-contrastive steps with Adagrad."""

    def __init__(self, model: LogBilinear, seed: int | tuple[int, ...]):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.seen = [np.full(p.shape, 1e-3, np.float32) for p in model.parts()]
        #: How often each row of context and target has been met; and all tokens.
        self.met = [np.zeros(len(model.context), np.float32), np.zeros(len(model.target), np.float32)]
        self.tokens = 0
        self.upto = np.cumsum(model.inner[model.order])
        self.class_upto = np.cumsum(model.class_share)
        self.offset = np.log(NOISE * model.inner).astype(np.float32)

    def learn(self, tokens: Tokens) -> None:
        for k in range(0, len(tokens.ids), BATCH_TOKENS):
            self._step(tokens.before[0, k : k + BATCH_TOKENS], tokens.before[1, k : k + BATCH_TOKENS], tokens.ids[k : k + BATCH_TOKENS])

    def _draw(self, klass: np.ndarray) -> np.ndarray:
        """(class, draw) tokens of each class, by their shares of it."""
        m = self.model
        at = np.searchsorted(self.upto, (klass + self.rng.random((SHARED_INNER, len(klass)))).ravel(), side="right").reshape(SHARED_INNER, -1)
        return m.order[np.clip(at, m.edge[klass], m.edge[klass + 1] - 1)].T

    def _step(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> None:
        m, n = self.model, len(self.model.context)
        key, count = np.unique((one.astype(np.int64) * n + two) * n + ids, return_counts=True)
        pair, w = np.divmod(key, n)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        u, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        a, b = np.divmod(pair[begin], n)
        left, right = m.context[a], m.context[b]
        h = np.ones((len(a), left.shape[1] + 1), np.float32)  # one more component, for the bias
        np.add(left @ m.place[0], right @ m.place[1], out=h[:, :-1])
        count = count.astype(np.float32) / np.float32(len(ids))
        weight = np.add.reduceat(count, begin) * np.float32(NOISE / SHARED_NOISE)
        # from here on tokens stand by class
        c = m.klass[w]
        by_class = np.argsort(_short(c), kind="stable")
        c, w, count, hu = c[by_class], w[by_class], count[by_class], h[u[by_class]]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        present, last = c[first], np.append(first[1:], len(c))
        # classes, against draws that the whole batch shares
        kinds = np.column_stack([m.kind, m.kind_bias - np.log(NOISE * m.class_share).astype(np.float32)])
        own = kinds[c]
        pull = _odds(count, np.einsum("ij,ij->i", hu, own))[:, None]
        du = pull * own[:, :-1]
        drawn = np.minimum(np.searchsorted(self.class_upto, self.rng.random(SHARED_NOISE)), len(m.kind) - 1)
        push = _odds(-weight[:, None], h @ -kinds[drawn].T)
        dh = push @ m.kind[drawn]
        kind = np.zeros_like(kinds)
        kind[present] = np.add.reduceat(pull * hu, first, axis=0)
        np.add.at(kind, drawn, push.T @ h)
        # tokens, against draws that the batch's tokens of one class share
        own = np.column_stack([m.target[w], m.bias[w] - self.offset[w]])
        pull = _odds(count, np.einsum("ij,ij->i", hu, own))[:, None]
        du += pull * own[:, :-1]
        noise, bounds = self._draw(present), list(zip(first.tolist(), last.tolist(), strict=True))
        other = np.concatenate([m.target[noise], (m.bias[noise] - self.offset[noise])[..., None]], axis=2)
        shared, minus = count * np.float32(NOISE / SHARED_INNER), np.ascontiguousarray(-other.transpose(0, 2, 1))
        push, away, moved = np.empty((len(c), SHARED_INNER), np.float32), np.empty_like(du), np.empty_like(other)
        for k, (lo, hi) in enumerate(bounds):
            np.matmul(hu[lo:hi], minus[k], out=push[lo:hi])
        _odds(-shared[:, None], push)
        for k, (lo, hi) in enumerate(bounds):
            np.matmul(push[lo:hi], other[k, :, :-1], out=away[lo:hi])
            np.matmul(push[lo:hi].T, hu[lo:hi], out=moved[k])
        du += away
        away[by_class] = du
        dh += np.add.reduceat(away, begin, axis=0)
        place = np.stack([left.T @ dh, right.T @ dh])
        met, noise = np.repeat(np.add.reduceat(shared, first), SHARED_INNER), noise.ravel()
        scale = np.float32(len(ids) ** 0.5)
        rows, moved = _sums(np.concatenate([w, noise]), np.concatenate([pull * hu, moved.reshape(len(noise), -1)]))
        near, turned = _sums(np.concatenate([a, b]), np.concatenate([dh @ m.place[0].T, dh @ m.place[1].T]))
        every = slice(None)
        steps = ((near, turned), (every, place), (rows, moved[:, :-1]), (rows, moved[:, -1]), (every, kind[:, :-1]), (every, kind[:, -1]))
        for p, s, (at, g) in zip(m.parts(), self.seen, steps, strict=True):
            g = g * scale
            seen = s[at] + g * g
            s[at] = seen
            p[at] += RATE * g / np.sqrt(seen)
        self.met[0] += np.bincount(one, minlength=n) + np.bincount(two, minlength=n)
        self.met[1] += np.bincount(ids, minlength=len(m.target)) + np.bincount(noise, weights=met * len(ids) / NOISE, minlength=len(m.target))
        self.tokens += len(ids)


def _odds(weight: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """weight / (1 + exp(logits)), in the place of logits."""
    np.exp(logits, out=logits)
    logits += 1
    return np.divide(weight, logits, out=logits)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in at and the sums of their rows."""
    order = np.argsort(_short(at), kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(rows[order], begin, axis=0)


def _pack(parts: list[np.ndarray]) -> bytes:
    return b"".join(p.astype("<f4").tobytes() for p in parts)


def _unpack(blob, like: list[np.ndarray]) -> list[np.ndarray]:
    values, out, at = np.frombuffer(blob, "<f4"), [], 0
    for p in like:
        out.append(values[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def mean_model(models: list[tuple[list[np.ndarray], list[np.ndarray], float]]):
    """The mean of (parts, met, tokens), each row weighted by how often it was met; with the sums of these."""
    total, met, tokens = None, None, 0.0
    for parts, rows, n in models:
        weights = [rows[0][:, None], n, rows[1][:, None], rows[1], n, n]
        weighted = [p.astype(np.float64) * w for p, w in zip(parts, weights, strict=True)]
        total = weighted if total is None else [x + y for x, y in zip(total, weighted, strict=True)]
        met = [r.astype(np.float64) for r in rows] if met is None else [x + y for x, y in zip(met, rows, strict=True)]
        tokens += n
    weights = [met[0][:, None], tokens, met[1][:, None], met[1], tokens, tokens]
    start = models[0][0]
    mean = [np.where(np.asarray(w) > 0, t / np.maximum(w, 1e-30), p) for t, w, p in zip(total, weights, start, strict=True)]
    return mean, met, tokens


def _slices(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for row, data, offsets in chunks(batch.column(column)):
            yield batch.slice(row, len(offsets) - 1), Words(lowered(data), offsets)


def word_counts(training: DataFrame) -> DataFrame:
    """(h, n, bucket): how often each word, by its hash, stands in the texts; ends are not counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(batches, 0):
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(buckets(words)[first], pa.int32())], ["h", "n", "bucket"])

    return training.select("text").mapInArrow(count, "h long, n long, bucket int").groupBy("h").agg(F.sum("n").alias("n"), F.min("bucket").alias("bucket"))


def train(training: DataFrame, lexicon: Lexicon, tokens: int) -> LogBilinear:
    """The model after ROUNDS rounds of training in groups and averaging."""
    spark, model = training.sparkSession, LogBilinear(lexicon)
    groups = max(1, round(tokens / GROUP_TOKENS))
    kinds = "g int, tokens double, model binary"
    like, met = model.parts(), [np.zeros(len(model.context)), np.zeros(len(model.target))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in _slices(batches, 0):
            ids = Tokens.of(words, lexicon).ids.astype("<u2")
            ends = np.cumsum(words.count + 1) * 2
            yield pa.record_batch([rows.column(1), pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(ids)])], ["key", "ids"])

    def start(rows: list) -> list:
        return [(_unpack(blob, [*like, *met])[: len(like)], _unpack(blob, [*like, *met])[len(like) :], n) for n, blob in rows]

    def blob(parts, rows) -> bytes:
        return _pack([*parts, *rows])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        mean, rows, n = mean_model(start(list(zip(table.column("tokens").to_pylist(), table.column("model").to_pylist(), strict=True))))
        return pa.table({"g": pa.array([table.column("g")[0].as_py() // FAN_IN], pa.int32()), "tokens": [n], "model": pa.array([blob(mean, rows)], pa.binary())})

    # ids are part of the hash, so copies of a text spread over groups
    coded = training.select("text", F.xxhash64("id", "text").alias("key")).mapInArrow(code, "key long, ids binary")
    coded = stored(coded.select("key", "ids", F.expr(f"cast(pmod(xxhash64(key), {groups}) as int)").alias("g"), F.expr(f"cast(pmod(xxhash64(key, 1), {ROUNDS}) as int)").alias("turn")), "coded")

    def fitting(turn: int, shared):
        def fit(table: pa.Table) -> pa.Table:
            g, mine = table.column("g")[0].as_py(), LogBilinear(lexicon)
            for p, q in zip(mine.parts(), _unpack(shared.value, mine.parts()), strict=True):
                p[...] = q
            trainer = Trainer(mine, (turn, g))
            ids = table.sort_by("key").column("ids")
            for k in range(0, len(ids), 4096):
                some = ids.slice(k, 4096).to_pylist()
                lengths = np.array([len(x) for x in some]) // 2
                trainer.learn(Tokens.run(np.frombuffer(b"".join(some), "<u2").astype(np.int32), lengths, lexicon.start))
            return pa.table({"g": pa.array([g], pa.int32()), "tokens": [float(trainer.tokens)], "model": pa.array([blob(mine.parts(), trainer.met)], pa.binary())})

        return fit

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(_pack(model.parts()))
        models, left = stored(coded.filter(F.col("turn") == turn).select("g", "key", "ids").groupBy("g").applyInArrow(fitting(turn, shared), kinds), "models"), groups
        while left > 1:
            left, old = -(-left // FAN_IN), models
            models = stored(old.groupBy(F.expr(f"g div {FAN_IN}")).applyInArrow(add, kinds), "models")
            discard(old)
        last = models.collect()
        discard(models)
        if last and last[0].tokens:
            for p, q in zip(model.parts(), start([(last[0].tokens, last[0].model)])[0][0], strict=True):
                p[...] = q
        shared.unpersist()
    discard(coded)
    return model


@dataclass(frozen=True)
class Trained:
    """The model, the counts of words, and what the smoothed shares are made of.

    apart holds, for each bucket, log10 of its share of the unigram mass.
    """

    lexicon: Lexicon
    model: LogBilinear
    counts: DataFrame
    often: tuple[np.ndarray, np.ndarray]
    apart: np.ndarray
    tokens: int
    ends: int
    norm: float


def learn(training: DataFrame) -> Trained:
    """Everything that scoring needs from training texts (columns id and text)."""
    counts = stored(word_counts(training), "counts")
    ends = training.count()
    words, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, words = n + ends, words + (ends > 0)
    norm = n + 0.1 * (words + 1)
    found = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    often_h, often_n, often_b = (np.array(found.column(c)) for c in ("h", "n", "bucket"))
    often_h = often_h.view(np.uint64)
    by_hash = np.argsort(often_h[:VOCABULARY])
    short_h, short_n, short_b = (x[:VOCABULARY][by_hash] for x in (often_h, often_n, often_b))
    mass = np.full(BUCKETS, 0.1)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[row.bucket] += row.n + 0.1 * row.words
    mass = np.maximum(mass - np.bincount(short_b, weights=short_n + 0.1, minlength=BUCKETS), 0.1)
    lexicon = Lexicon.of(short_h, np.concatenate([short_n + 0.1, mass, [ends + 0.1]]) / norm)
    model = train(training, lexicon, n) if ends else LogBilinear(lexicon)
    order = np.argsort(often_h)
    return Trained(lexicon, model, counts, (often_h[order], often_n[order]), np.log10(mass / norm), n, ends, norm)


def score_texts(texts: DataFrame, trained: Trained) -> DataFrame:
    """id, held, n_tokens, n_known, base_score and score of the rows (id, held, text)."""
    norm = trained.norm
    often_h, often_n = trained.often
    shared = texts.sparkSession.sparkContext.broadcast((trained.lexicon, trained.model, Sorted(often_h), np.log10((often_n + 0.1) / norm), trained.apart, trained.ends))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model, often, often_log, apart, ends = shared.value
        for rows, words in _slices(batches, 2):
            texts = len(rows)
            tokens = Tokens.of(words, lexicon)
            lm = np.bincount(tokens.doc, weights=model.log_probs(tokens), minlength=texts) / np.log(10)
            at = often.find(words.hash)
            have = at >= 0
            logs = np.zeros(len(at))
            logs[have] = often_log[at[have]]
            base = np.bincount(words.doc, weights=logs, minlength=texts) + np.log10((ends + 0.1) / norm)
            seen = np.bincount(words.doc[have], minlength=texts) + (ends > 0)
            bucket = tokens.ids[np.arange(len(at)) + words.doc] - len(lexicon.hashes)
            outside = np.flatnonzero(bucket >= 0)
            lm += np.bincount(words.doc[outside], weights=logs[outside] - apart[bucket[outside]], minlength=texts)
            rare = np.flatnonzero(~have)
            doc, h = words.doc[rare], words.hash[rare]
            way = np.lexsort((h, doc))
            doc, h = doc[way], h[way]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(h)))
            edge = np.searchsorted(doc[begin], np.arange(texts + 1))
            pairs = pa.StructArray.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(times, pa.int64())], ["h", "n"])
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pairs)
            yield pa.record_batch([*rows.columns[:2], pa.array(words.count + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(lm), lists], ["id", "held", "n_tokens", "seen", "base", "lm", "rare"])

    kinds = "id long, held boolean, n_tokens long, seen long, base double, lm double, rare array<struct<h:long,n:long>>"
    scored = texts.select("id", "held", "text").mapInArrow(score, kinds)
    scored = stored(scored.withColumn("k", F.monotonically_increasing_id()), "scored")
    rare = scored.select("k", F.explode("rare").alias("r")).select("k", "r.h", F.col("r.n").alias("times"))
    rare = rare.join(trained.counts.select("h", "n"), "h", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(float(norm)))
    rare = rare.groupBy("k").agg(F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    out = scored.drop("rare").join(rare, "k", "left")
    return out.select("id", "held", "n_tokens", (F.col("seen") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("lm") + more).alias("score"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A-Z count as a-z. A text is its words and one end; a null text has the end alone. Rows
    are scored one by one, whatever their ids; a null id is not held out. Repeated rows
    repeat their scores and each counts in training. Extra columns are ignored. An empty
    table gives an empty result; without training rows every word is unknown.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("held", held_out(F.col("id")))
    trained = learn(texts.filter("not held").select("id", "text"))
    scored = score_texts(texts, trained)
    return scored.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Token counts, base_score and score of every row of documents."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
