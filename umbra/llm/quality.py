"""Quality by ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. One weight vector over hashed text features is shared by both ordered thresholds:
P(grade <= j) = sigmoid(threshold[j] - w.x). Features are the hashed lower-cased words that occur in the whole text
(presence) and hashed token shapes with the share of tokens that have them. The fit is AdaGrad with L1 dual averaging
over at most ``max_rows`` labelled rows, those with the smallest hash of doc_id; everything else reads whole tables.

Null and empty texts have no features and get the prior grade. Rows with null labels or ids don't train; several labels of one
id count once, with the worst; of several texts of one id the one with the smallest hash trains. Without labelled rows of two grades every document is kept with the best grade.
Repeated rows are each scored; empty tables give no rows; other columns, whatever their names, pass through ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
GRADES = 3
#: Shapes of tokens; a share of 1 counts as much as this many words.
SHAPES, SHAPE_SCALE = ("plain", "upper", "marked", "bar", "repeat"), 8.0
EDGE = ".,;:!?()[]{}\"'|*#$%&_-+=/<>"
CACHE = 150_000
#: Documents are kept from this probability of the best grade on.
LEAST = 0.5


def _shape(token: str) -> int:
    if token == "|":
        return 3
    bare = token.rstrip(EDGE)
    if len(token) - len(bare) >= 2:
        return 2
    return 1 if len(bare) > 2 and bare.isupper() else 0


class Codes(dict):
    """Token to bucket * 8 + shape."""

    def __missing__(self, token: str) -> int:
        code = (zlib.crc32(token.strip(EDGE).lower().encode()) >> (32 - BITS)) * 8 + _shape(token)
        if len(self) >= CACHE:
            self.clear()
        if len(token) <= 64:
            self[token] = code
        return code


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of 2 ** BITS words, then of the shapes
    thresholds: np.ndarray

    def score(self, columns: np.ndarray, shares: np.ndarray) -> float:
        return float(self.weights[columns].sum() + self.weights[-len(SHAPES) :] @ shares)

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for j below the best."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -40, 40)))


def features(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the scaled share of tokens of each shape."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.zeros(len(SHAPES))
    c = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    shares = np.bincount(c & 7, minlength=len(SHAPES))[: len(SHAPES)].astype(float)
    shares[0], shares[4] = 0, np.count_nonzero(c[1:] == c[:-1])
    return np.unique(c >> 3), SHAPE_SCALE * shares / len(words)


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int) -> list[tuple[int, bytes, bytes]]:
    """(grade, buckets, shares) of at most ``max_rows`` labelled documents; texts stay on the executors."""
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)).alias("grade"))
    # a label whose document is missing takes no place: ids are matched before the rows are chosen
    there = graded.join(documents.select("doc_id").distinct(), "doc_id")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            got = [features(t.as_py(), codes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([y.tobytes() for _, y in got], pa.binary())], ["grade", "buckets", "shares"])

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text for each id, so no more rows than ids come to the driver however often an id is repeated
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("grade", "text").mapInArrow(run, "grade int, buckets binary, shares binary").collect()
    return sorted((r[0], bytes(r[1]), bytes(r[2])) for r in got)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss(w: np.ndarray, theta: np.ndarray, grade: np.ndarray, row: np.ndarray, column: np.ndarray, shares: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood, and its gradient by weights and by thresholds. ``row`` and ``column`` are the words that are there."""
    s = np.bincount(row, w[column], len(grade)) + shares @ w[-len(SHAPES) :]
    cuts = np.append(theta, 40)
    upper = np.where(grade < GRADES - 1, sigmoid(cuts[grade] - s), 1.0)
    lower = np.where(grade > 0, sigmoid(cuts[grade - 1] - s), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) * (grade < GRADES - 1), lower * (1 - lower) * (grade > 0)
    ds = (du - dl) / p / len(grade)  # of the loss by the score
    by_threshold = np.array([-(du / p)[grade == j].sum() + (dl / p)[grade == j + 1].sum() for j in range(GRADES - 1)]) / len(grade)
    return float(-np.log(p).mean()), np.append(np.bincount(column, ds[row], 1 << BITS), ds @ shares), by_threshold


def fit(rows: list[tuple[int, bytes, bytes]], rounds: int = 300, l1: float = 1e-3, rate: float = 0.3) -> Model | None:
    """None if there is nothing to tell apart."""
    grade = np.array([r[0] for r in rows])
    if len(np.unique(grade)) < 2:
        return None
    size = (1 << BITS) + len(SHAPES)
    buckets = [np.frombuffer(r[1], np.int32) for r in rows]
    shares = np.array([np.frombuffer(r[2]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
    column = np.concatenate(buckets)
    reached = np.array([(grade <= j).mean() for j in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.sort(np.log(reached / (1 - reached)) + np.arange(GRADES - 1) * 1e-3)
    w, total, square = np.zeros(size), np.zeros(size), np.full(size, 1e-8)
    t_total, t_square = np.zeros(GRADES - 1), np.full(GRADES - 1, 1e-8)
    for t in range(1, rounds + 1):
        _, g, gt = loss(w, theta, grade, row, column, shares)
        total += g
        square += g * g
        w = -np.sign(total) * rate * np.maximum(np.abs(total) - l1 * t, 0) / np.sqrt(square)
        w[-len(SHAPES) :] = -rate * total[-len(SHAPES) :] / np.sqrt(square[-len(SHAPES) :])
        t_square += gt * gt
        theta = np.sort(theta - 0.1 * gt / np.sqrt(t_square))
    return Model(w, theta)


def graded(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with ``expected_grade`` and ``p_best``; both columns replace any of the same name."""
    others = [c for c in documents.columns if c not in ("expected_grade", "p_best")]
    if model is None:
        return documents.select(*others, F.lit(float(GRADES - 1)).alias("expected_grade"), F.lit(1.0).alias("p_best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, at = Codes(), others.index("text")
        for b in batches:
            low = model.at_most([model.score(*features(t.as_py(), codes)) for t in b.column(at)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((1 - low).sum(axis=1)), pa.array(1 - low[:, -1])], [*others, "expected_grade", "p_best"])

    source = documents.select(*others)
    out = T.StructType([*source.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_best", T.DoubleType())])
    return source.mapInArrow(run, out)


def select(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, least: float = LEAST) -> DataFrame:
    """The documents whose tail probability of the best grade is ``least`` or more, with both figures."""
    model = fit(training_rows(documents, labels, max_rows))
    return graded(documents, model).where(F.col("p_best") >= least)
