"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

Method: a document's strength is a linear score of its features. Every document labelled
good makes a training pair with every one labelled bad; the weights minimise the mean logistic
loss of the pairs' feature differences (Newton's method, a ridge term). A document is
accepted when its strength reaches the quantile of the training strengths that equals
the share of bad labels; the reported score is a logistic curve through 0.7 there.

Features of all rows are computed on the executors and stored, and all labelled rows that are
not held out teach. A pair's loss depends on its two strengths alone, so a round of Newton's
method adds up counts, features and their products by class and narrow band of
strength; the driver sees these sums, some hundred bands of them whatever the
input, and the slope of a pair's loss is taken as straight within its bands. The accepting
quantile is an order statistic of all training strengths, found by counting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._counts import among, base_counts, per_row, repeats
from ._spark import discard, stored
from ._text import Words, chunks

FEATURES = ("log_words", "word_length", "symbols", "upper", "shouts", "bars", "points", "digits", "wide", "breaks", "dup_lines", "repeats", "stutters", "distinct")

#: Bands of strength to one unit at zero; they widen with the distance from it (arsinh).
BANDS = 64
#: Into so many parts the range is cut at a time in the search of an order statistic.
PARTS = 4096
ACCEPT = 0.7


def features(words: Words) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    c, data, offsets = base_counts(words), words.data, words.offsets
    chars, n, lines = np.maximum(c["word_chars"], 1), np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    of = lambda chars_: per_row(among(data, chars_), offsets)
    stutter = np.zeros(len(words.starts), dtype=bool)
    stutter[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    _, again = repeats(words.doc, words.hash)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_upper"] / chars, of(b"!") / chars, of(b"|") / n, of(b".,;:?") / n,
        of(b"0123456789") / chars, per_row(data >= 0xC0, offsets) / chars, of(b"\n") / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n,
        per_row(stutter, words.first) / n, per_row(~again, words.first) / n,
    ])


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                x = features(Words(data, offsets))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                rows = batch.slice(row, len(x))
                yield pa.record_batch([rows.column(0), flat, *rows.columns[2:]], ["id", "x", *carry])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    return texts.mapInArrow(compute, "id long, x array<double>" + "".join(f", `{c}` {t}" for c, t in texts.dtypes[2:]))


@dataclass(frozen=True)
class Ranking:
    """Strength of x: bias + weights . x, so that 0 is the accepting quantile."""

    weights: np.ndarray
    bias: float

    def strength(self, x):
        """The strength as a column, of the column x of features."""
        return sum((x[k] * float(w) for k, w in enumerate(self.weights)), F.lit(0.0)) + float(self.bias)


def _added(cell: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, in order, and the sums of their rows."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
    return cell[begin], np.add.reduceat(sums[order], begin, axis=0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def band_sums(taught: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each class and band of strengths that has rows: good, their number, and the sums of
    their strengths, standardised features and products of these."""
    size = len(w)
    one, two = np.triu_indices(size)
    width = 2 + size + len(one)

    def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((_matrix(batch.column(0), size) - mean) / scale, -8, 8)
        s = z @ w
        cell = np.rint(np.arcsinh(s) * BANDS).astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
        return cell, np.column_stack([np.ones(len(s)), s, z, z[:, one] * z[:, two]])

    def add(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
        cell, sums = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            if len(batch):
                more, rows = _added(*read(batch))
                cell, sums = _added(np.concatenate([cell, more]), np.concatenate([sums, rows]))
        yield pa.record_batch([pa.array(cell), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))], ["cell", "sums"])

    kinds = "cell long, sums array<double>"
    parts = taught.select("x", "good").mapInArrow(lambda batches: add(batches, cells), kinds).repartition("cell")
    got = parts.mapInArrow(lambda batches: add(batches, lambda b: (b.column(0).to_numpy(), _matrix(b.column(1), width))), kinds).toArrow().sort_by("cell").combine_chunks()
    cell, sums = got.column("cell").to_numpy(), _matrix(got.column("sums").combine_chunks(), width)
    products = np.zeros((len(cell), size, size))
    products[:, one, two] = products[:, two, one] = sums[:, 2 + size :]
    return cell % 2 == 1, sums[:, 0], sums[:, 1], sums[:, 2 : 2 + size], products


def kth_and_next(values: DataFrame, k: int) -> tuple[float, float]:
    """The k-th (from 1) of all values of column s in order, and the one after it."""
    s = F.col("s")
    lo, hi = values.agg(F.min(s), F.max(s)).first()
    below = 0
    while lo < hi:
        part = F.floor((s - F.lit(lo)) / F.lit(hi - lo) * PARTS).alias("part")
        for row in values.filter(s.between(lo, hi)).groupBy(part).agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi")).orderBy("part").collect():
            lo, hi = row.lo, row.hi
            if below + row.n >= k:
                break
            below += row.n
    upto, after = values.agg(F.count_if(s <= lo), F.min(F.when(s > lo, s))).first()
    return lo, lo if upto > k else after


def fit(taught: DataFrame, ridge: float = 1e-3, rounds: int = 40) -> Ranking:
    """Fit on all rows (x, good); with fewer than two classes every text is accepted alike."""
    each = [F.col("x")[k] for k in range(len(FEATURES))]
    n, better, *stats = taught.agg(F.count("*"), F.count_if("good"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    if better in (0, n):
        return Ranking(np.zeros(len(FEATURES)), 0.0)
    mean, scale = np.array(stats[: len(each)]), np.array(stats[len(each) :]) + 1e-9
    worse, w = n - better, np.zeros(len(FEATURES))
    for _ in range(rounds):
        good, rows, s, z, zz = band_sums(taught, mean, scale, w)
        s, bad = s / rows, ~good
        p = 1 / (1 + np.exp(np.clip(s[good][:, None] - s[bad], -30, 30)))
        v, many = p * (1 - p), better * worse
        weight = np.empty(len(rows))
        weight[good], weight[bad] = v @ rows[bad], v.T @ rows[good]
        slope = weight @ (zz @ w - s[:, None] * z)  # strengths within a band differ from its mean
        gradient = (z[bad].T @ (p.T @ rows[good]) - z[good].T @ (p @ rows[bad]) + slope) / many + ridge * w
        cross = z[good].T @ v @ z[bad]
        step = np.linalg.solve((np.tensordot(weight, zz, 1) - cross - cross.T) / many + ridge * np.eye(len(w)), gradient)
        w -= step * min(1.0, 2.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-4:  # what is left after it is about its square
            break
    # nine digits, so that the order in which sums were added does not show
    model = Ranking(np.array([float(f"{x:.9g}") for x in w / scale]), 0.0)
    strengths = stored(taught.select(model.strength(F.col("x")).alias("s")), "strengths")
    bias = -sum(kth_and_next(strengths, worse)) / 2
    discard(strengths)
    return Ranking(model.weights, bias)


def train(rows: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on the stored features of all labelled rows that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("double").alias("q")).dropna().groupBy("k").agg(F.avg("q").alias("q"))
    marks = marks.filter(~held_out(F.col("k")))
    taught = rows.join(marks, F.col("id") == F.col("k")).groupBy("k").agg(F.min("x").alias("x"), F.min("q").alias("q"))
    taught = stored(taught.select("x", (F.col("q") >= 0.5).alias("good")), "taught")
    model = fit(taught)
    discard(taught)
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, held_out, strength, score, predicted and the columns of carry (of other names) of every row of docs.

    labels has doc_id and quality (1 good, 0 bad); rows of it with nulls teach nothing,
    and several labels of one id count by their mean. Only ids that are not held out
    teach; a null id is not held out. Labels, languages, sources and ids are no inputs of
    a score. Null and empty texts have all features zero and are scored like any other.
    Repeated rows get equal scores; without labels of both kinds every row gets 0.7.
    Extra columns are ignored. An empty table gives an empty result.
    """
    rows = stored(feature_rows(docs, id_col, text_col, carry), "features")
    model = train(rows, labels)
    strength = model.strength(F.col("x"))
    logit = float(np.log(ACCEPT / (1 - ACCEPT)))
    score = F.when(F.col("strength") >= 0, F.greatest(1 / (1 + F.exp(-F.col("strength") - logit)), F.lit(ACCEPT))).otherwise(F.least(1 / (1 + F.exp(-F.col("strength") - logit)), F.lit(np.nextafter(ACCEPT, 0).item())))
    out = rows.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), strength.alias("strength"), *carry)
    return out.select(F.col("id").alias(id_col), "held_out", "strength", score.alias("score"), F.when(score >= ACCEPT, 1).otherwise(0).alias("predicted"), *carry)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_classifier(docs, labels).select("doc_id", "held_out", "score", "predicted")
