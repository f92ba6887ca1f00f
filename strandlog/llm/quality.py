"""op1: quality by a regularised quadratic discriminant."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, staged

FEATURES = ("length", "upper", "digits", "marks", "stops", "foreign", "spaces", "word", "types", "echoes", "lines", "line", "entropy")
#: A document is accepted from this score on. Of FOLDS remainders of crc32(doc_id as text), 0 is held out.
THRESHOLD, FOLDS = 0.3, 5
#: Weights of the pooled covariance, and of its diagonal, that are tried.
POOLED, DIAGONAL = (0.0, 0.1, 0.3, 0.6, 1.0), (0.001, 0.01, 0.1)
#: At most so many training rows, those with the smallest hash of doc_id, choose among these weights and calibrate the score. Means and covariances are taken over all of them.
CHOOSING = 20_000
#: Statistics of a longer text are gathered in pieces of about so many bytes.
PIECE = 1 << 22

_UPPER, _DIGITS, _STOPS, _SPACES = bytes(range(65, 91)), b"0123456789", b".,;:'\"-?", b" \t\n\r\x0b\x0c"
_LETTERS, _FOREIGN = _UPPER + bytes(range(97, 123)), bytes(range(128, 256))
_MARKS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _STOPS)


def statistics(text: bytes) -> list[float]:
    """FEATURES of a whole text: shares on a logit-like scale, sizes as logarithms. An empty one has finite ones too."""
    n, counts = len(text), np.zeros(256, np.int64)
    words = echoes = lines = 0
    kinds, line_kinds, last = set(), set(), b""
    for at in range(0, n, PIECE):  # whole lines and words but where a piece ends
        piece = text[at : at + PIECE]
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        w = piece.split()
        words += len(w)
        kinds.update(w if n <= PIECE else map(hash, w))
        echoes += sum(map(bytes.__eq__, w, [last, *w[:-1]])) if w else 0
        last = w[-1] if w else last
        own = piece.split(b"\n")
        lines += len(own)
        line_kinds.update(own if n <= PIECE else map(hash, own))
    share = lambda chars: int(counts[list(chars)].sum()) / max(1, n)
    letters = int(counts[list(_LETTERS)].sum())
    odds = lambda p: math.log((p + 1e-3) / (1 - p + 1e-3))
    p = counts[counts > 0] / max(1, n)
    return [
        math.log1p(n), odds(int(counts[list(_UPPER)].sum()) / max(1, letters)), odds(share(_DIGITS)), odds(share(_MARKS)), odds(share(_STOPS)), odds(share(_FOREIGN)), odds(share(_SPACES)),
        math.log1p(n / max(1, words)), math.log((len(kinds) + 1) / (words + 1)), odds(echoes / max(1, words)), math.log((len(line_kinds) + 1) / (lines + 1)), math.log1p(n / max(1, lines)),
        float(-(p * np.log(p)).sum()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row; labels, lang, source and doc_id have no part in x."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def moments(rows: DataFrame) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by (label, fold). rows: (label, fold, x). Each task sends one row for each number, and they are summed before they come to the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            labels, folds, x = b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(b.column(2).to_pylist())
            x = np.hstack([np.ones((len(x), 1)), x])
            for key in set(zip(labels.tolist(), folds.tolist())):
                part = x[(labels == key[0]) & (folds == key[1])]
                own[key] = own.get(key, 0) + part.T @ part
        for (label, f), m in own.items():
            flat = m.ravel()
            yield pa.record_batch([pa.array([label] * len(flat), pa.int32()), pa.array([f] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["label", "fold", "k", "v"])

    sums = rows.select(F.col("label").cast("int"), "fold", "x").mapInArrow(run, "label int, fold int, k int, v double").groupBy("label", "fold", "k").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.collect():  # labels x folds x (features + 1) squared
        out.setdefault((r["label"], r["fold"]), np.zeros((d + 1) ** 2))[r["k"]] = r["v"]
    return {key: (float(m[0]), m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for key, m in out.items()}


@dataclass
class Discriminant:
    """The factors of one fit, computed once: for each class the mean, the inverse of the covariance's Cholesky factor and the constant of the log density; and the line from log-density difference to score."""

    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0): half the difference of squared Mahalanobis distances, and constants."""
        z = [c - 0.5 * (((x - m) @ i.T) ** 2).sum(1) for m, i, c in zip(self.means, self.inverses, self.constants)]
        return z[1] - z[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -700, 700)))


def discriminant(parts: dict, pooled: float, diagonal: float) -> Discriminant:
    """From {label: (n, sum, outer)}: each class covariance drawn towards the pooled one, then towards the pooled diagonal."""
    n = {k: parts[k][0] for k in (0, 1)}
    means = {k: parts[k][1] / n[k] for k in (0, 1)}
    own = {k: parts[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)}
    together = sum(n[k] * own[k] for k in (0, 1)) / sum(n.values())
    spread = np.diag(np.maximum(np.diag(together), 1e-9))
    inverses, constants = [], []
    for k in (0, 1):
        cov = (1 - diagonal) * ((1 - pooled) * own[k] + pooled * together) + diagonal * spread
        factor = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(factor))
        constants.append(math.log(n[k] / sum(n.values())) - float(np.log(np.diag(factor)).sum()))
    return Discriminant([means[0], means[1]], inverses, constants)


def _line(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean loss of the logistic line from z to y, by Newton steps; slightly drawn towards slope 0, so that separated classes have one too."""
    scale = max(1e-9, float(np.abs(z).mean()))
    a, w = np.column_stack([z / scale, np.ones(len(z))]), np.zeros(2)
    loss = lambda v: float(np.logaddexp(0, a @ v).sum() - (y * (a @ v)).sum() + 0.5 * v[0] ** 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (p - y) + [w[0], 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1, 1e-6])
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1]), loss(w) / len(z)


def fit(rows: DataFrame) -> Discriminant | float:
    """From training rows (doc_id, label 0/1, fold 1 to FOLDS - 1, x). Without rows of both classes: the share of label 1, or a half.

    The weights and the line are chosen by the loss on rows whose own fold took no part in the fit.
    """
    m = moments(rows)
    folds = sorted({f for _, f in m})
    zero = (0.0, np.zeros(len(FEATURES)), np.zeros((len(FEATURES),) * 2))
    total = lambda skip: {k: tuple(sum(x) for x in zip(zero, *(v for (label, f), v in m.items() if label == k and f != skip))) for k in (0, 1)}
    whole = total(None)
    if min(whole[k][0] for k in (0, 1)) < 2:
        n = whole[0][0] + whole[1][0]
        return whole[1][0] / n if n else 0.5
    n = whole[0][0] + whole[1][0]
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 1.2 * CHOOSING / n))  # else every task would send CHOOSING rows
    sample = rows.where(low).select("label", "fold", "x").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id").limit(CHOOSING).collect()
    y, own, x = (np.array([r[k] for r in sample]) for k in ("label", "fold", "x"))
    best: tuple = (math.inf,)
    for pooled in POOLED:
        for diagonal in DIAGONAL:
            z, ok = np.zeros(len(y)), np.zeros(len(y), bool)
            for f in folds:
                rest = total(f)
                if min(rest[k][0] for k in (0, 1)) >= 2:
                    z[own == f], ok[own == f] = discriminant(rest, pooled, diagonal).difference(x[own == f]), True
            if not ok.any():
                z, ok = discriminant(whole, pooled, diagonal).difference(x), np.ones(len(y), bool)
            slope, offset, loss = _line(z[ok], y[ok])
            if loss < best[0]:
                best = (loss, pooled, diagonal, slope, offset)
    model = discriminant(whole, best[1], best[2])
    model.slope, model.offset = best[3], best[4]
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text; further columns don't matter).

    labels: (doc_id, quality); only rows with quality 0 or 1 and a fold other than 0 are learnt from, all of them. Statistics
    are gathered once over the whole texts and staged (some 100 bytes a row). A null text counts as empty; an empty one is
    scored by its statistics like any other. Repeated rows are scored each; a null doc_id is not held out; an empty table
    gives no rows, and without labels every score is a half.
    """
    x = staged(features(docs), "features")
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label")).withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    model = fit(x.join(known, "doc_id").select("doc_id", "label", "fold", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.full(b.num_rows, model) if isinstance(model, float) else model.score(np.array(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(own, pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: the documents that aren't rejected, with their columns. Rows without a doc_id stay."""
    rejected = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
