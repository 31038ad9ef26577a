"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the counts of its character n-grams (bytes of the text in lower case),
hashed into BINS bins, as log(1 + count).  The ratio of a bin is the log of how much more often
toxic training texts hold it than clean ones; each feature is scaled by the ratio of its bin, and a
logistic regression is fitted on these scaled features.  Margins on the training texts themselves
are too good, so FOLDS models are fitted without a part of them each, and the margins that they give
to the part left out calibrate the score: a logistic function of the margin with fitted slope and
offset, which gives the chance of the label if both classes were equally frequent.  Nothing of this sees a held-out row.

Training takes at most MOST labelled texts of each class, those whose doc_id has the
smallest hashes: a bounded, documented sample, the same on every run.  Their bins, not their texts,
come to the driver.  Scoring is a map over all rows and whole texts.

Edge cases: null and empty texts have no n-grams and get the score of the bias alone; with fewer than
FOLDS labelled texts of a class the margin is not calibrated; labels that
are null or neither 0 nor 1 are ignored; a doc_id labelled both ways counts as toxic; without any
labelled text of one class every score is that class's share, 0 or 1, or 0 without labels; rows
with a null doc_id are scored and not held out; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import sliced
from .common import save, ship, table

BITS = 18
BINS = 1 << BITS
SIZES = (4, 5, 6)
#: Labelled texts, clean and toxic, that are used for training at most.
MOST = (2000, 1000)
THRESHOLD = 0.7
#: Bins of a ratio nearer to zero tell nothing and are left out.
LEAST_RATIO = 0.25
#: Training texts that must hold a bin, however many there are; the ratio and the decay weigh the rare ones.
LEAST_TEXTS = 3
#: Parts of the training texts for the calibration, and steps of a fit.
FOLDS = 4
ROUNDS = 60
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def bins(text: str | None) -> Iterator[np.ndarray]:
    """The bins of all n-grams of a text, in pieces; a bin may come again."""
    b = _LOWER[np.frombuffer((" " + text + " ").encode("utf-8", "replace") if text else b"", np.uint8)].astype(np.uint64)
    for lo in range(0, len(b), PIECE):
        part = b[lo : lo + PIECE + max(SIZES) - 1]
        code, n = part, 1
        for size in SIZES:
            while n < size:
                code = (code[:-1] << np.uint64(8)) | part[n:]
                n += 1
                if not len(code):
                    return
            yield ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)


def counted_bins(text: str | None, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of a text (only those marked in ``told``, if given) and how often it holds each."""
    got = [x if told is None else x[told[x]] for x in bins(text)]
    return np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ratios(bin: np.ndarray, n: np.ndarray, pos: np.ndarray, rows: int, toxic: int, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of every bin, from how many rows and how many toxic rows hold it."""
    out = np.zeros(BINS)
    out[bin] = np.log((pos + alpha) / (toxic + 2 * alpha)) - np.log((n - pos + alpha) / (rows - toxic + 2 * alpha))
    return out


def fit(flat: np.ndarray, of: np.ndarray, value: np.ndarray, labels: np.ndarray, use: np.ndarray | None = None, rounds: int = ROUNDS, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weight of every bin (ratio included) and the bias, from the bins ``flat`` of the rows ``of`` with log counts ``value``; only rows marked in ``use`` count.

    Logistic loss, both classes weighing the same, by accelerated gradient steps of one over the
    curvature; stopped early, so that a bin's weight stays in proportion to its evidence.
    """
    use, n = np.ones(len(labels)) if use is None else use.astype(np.float64), len(labels)
    rows, toxic = int(use.sum()), int((labels * use).sum())
    held = np.bincount(flat, weights=use[of], minlength=BINS)
    known = np.flatnonzero(held)
    ratio = ratios(known, held[known], np.bincount(flat, weights=(labels * use)[of], minlength=BINS)[known], rows, toxic)
    value, share = value * ratio[flat], np.where(labels == 1, 0.5 / toxic, 0.5 / (rows - toxic)) * use

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=w[flat] * value, minlength=n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=e[of] * value, minlength=BINS)

    u, curve = np.ones(BINS), 1.0
    for _ in range(8):  # largest eigenvalue
        u = back(margins(u) * share)
        curve = float(np.linalg.norm(u)) or 1.0
        u /= curve
    curve = curve / 4 + decay
    w, last, bias, last_bias = np.zeros(BINS), np.zeros(BINS), 0.0, 0.0
    for k in range(rounds):
        ahead = k / (k + 3)
        q, qb = w + ahead * (w - last), bias + ahead * (bias - last_bias)
        error = (1 / (1 + np.exp(-np.clip(margins(q) + qb, -30, 30))) - labels) * share
        last, last_bias = w, bias
        w, bias = q - (back(error) + decay * q) / curve, qb - 2 * float(error.sum())
    return w * ratio, bias


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function that fits the labels best, both classes weighing the same; smoothed targets, damped Newton steps."""
    toxic = labels.sum()
    weight = np.where(labels == 1, 0.5 / toxic, 0.5 / (len(labels) - toxic)) * len(labels)
    goal = np.where(labels == 1, (toxic + 1) / (toxic + 2), 1 / (len(labels) - toxic + 2))
    x = np.stack([margins, np.ones(len(margins))])

    def loss(v: np.ndarray) -> float:
        z = v @ x
        return float(((np.logaddexp(0, z) - goal * z) * weight).sum())

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ ((p - goal) * weight))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit_calibrated(flat: np.ndarray, of: np.ndarray, value: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias, scaled so that the logistic function of the margin is the calibrated score.  Row k is in fold k % FOLDS."""
    w, bias = fit(flat, of, value, labels)
    if min(labels.sum(), (1 - labels).sum()) < FOLDS:
        return w.astype(np.float32), bias
    out = np.zeros(len(labels))
    # both classes in every fold
    fold = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        at = np.flatnonzero(labels == y)
        fold[at] = np.arange(len(at)) % FOLDS
    for k in range(FOLDS):
        inside = fold == k
        v, b = fit(flat, of, value, labels, ~inside)
        out[inside] = (np.bincount(of, weights=v[flat] * value, minlength=len(labels)) + b)[inside]
    slope, offset = calibration(out, labels)
    return (slope * w).astype(np.float32), slope * bias + offset


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.w, self.told, self.bias = weights, weights != 0, bias

    def __call__(self, text: str | None) -> float:
        at, n = counted_bins(text, self.told)
        margin = float(self.w[at] @ np.log1p(n)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST) -> tuple[np.ndarray, float]:
    """Fit on labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id")
    some = [known.where(F.col("toxic") == y).orderBy(order, "id").limit(most[y]) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # at most sum(most) rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counted_bins(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([x[i].astype(np.int32) for x in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "toxic", "bins", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("t")).join(sample, F.col("doc") == F.col("id")).select("id", "toxic", "t")
    rows = rows.mapInArrow(run, "id long, toxic int, bins array<int>, counts array<int>").groupBy("id", "toxic").agg(F.min(F.struct("bins", "counts")).alias("b"))
    rows = save(rows.select("id", "toxic", "b.bins", "b.counts"), "bins")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return np.zeros(BINS, np.float32), (30.0 if toxic else -30.0)
    # counts and ratios of the bins first, so that only those that tell the classes apart come to the driver
    counts = rows.select("toxic", F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).where(F.col("n") >= LEAST_TEXTS).toArrow()
    ratio = ratios(counts["bin"].to_numpy(), counts["n"].to_numpy(), counts["pos"].to_numpy(), n, toxic)
    told = np.abs(ratio) >= LEAST_RATIO

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [told[np.array(r, np.int32)] for r in b.column(2).to_pylist()]
            cols = [pa.array([np.array(r, np.int32)[k] for r, k in zip(b.column(i).to_pylist(), kept, strict=True)], pa.list_(pa.int32())) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "toxic", "bins", "counts"])

    got = rows.mapInArrow(pick, "id long, toxic int, bins array<int>, counts array<int>").orderBy("id").toArrow().combine_chunks()
    each = got.column("bins").chunk(0)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(each.offsets.to_numpy()))
    value = np.log1p(got.column("counts").chunk(0).flatten().to_numpy())
    return fit_calibrated(each.flatten().to_numpy(), of, value, got.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` with the column __score; nothing is shuffled."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # BINS floats: one megabyte

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn("__score", scores(F.col("text").cast("string")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under THRESHOLD."""
    return score(docs, train(docs, labels)).where(F.col("__score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
