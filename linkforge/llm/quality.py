"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = 1 / (1 + exp(threshold[k] - w . x)): one weight vector over hashed text
features is shared by all grades, and the thresholds are in order. x holds the relative
frequencies of hashed character n-grams and of a few shapes (words that repeat the word
before, lines that repeat the line before, capitals, digits, signs).

The fit uses a bounded sample of labelled rows, TRAIN_ROWS at most, taken in order of a
hash of the id; one task has the sample's features and sends the model to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .features import codes, in_pieces, ngrams, sums_by_text

BITS, ORDERS = 12, (1, 2, 3)
SHAPES = ("repeated word", "repeated line", "capital", "digit", "sign", "word")
#: Labelled rows that the fit looks at: 6,000 rows of 4,102 numbers are 98 MB.
TRAIN_ROWS = 6_000
STEPS, RATE, PENALTY = 400, 0.05, 1e-4
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class QualityModel:
    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray


def _unit_repeats(points: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: units (runs of places inside), and those equal to the unit before in the same text."""
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    texts = len(starts) - 1
    if not len(begins):
        return np.zeros(texts), np.zeros(texts)
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    at = np.arange(len(points), dtype=np.int64)
    first = np.zeros(len(points), np.int64)
    first[begins] = begins
    np.maximum.accumulate(first, out=first)
    values = np.where(inside, (points.astype(np.uint64) + np.uint64(1)) * _POWERS[(at - first) & 63], np.uint64(0))
    unit = np.add.reduceat(values, begins) + (ends - begins).astype(np.uint64)
    owner = np.searchsorted(starts, begins, "right") - 1
    same = np.concatenate(([False], (unit[1:] == unit[:-1]) & (owner[1:] == owner[:-1])))
    return np.bincount(owner, minlength=texts)[:texts].astype(float), np.bincount(owner[same], minlength=texts)[:texts].astype(float)


def _shapes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts x SHAPES, each a count."""
    line_end = points == 10
    space = (points == 32) | ((points >= 9) & (points <= 13))
    words, same_words = _unit_repeats(points, ~space, starts)
    _, same_lines = _unit_repeats(points, ~line_end, starts)
    capital = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE))
    digit = (points >= 48) & (points <= 57)
    sign = (points > 32) & (points < 127) & ~digit & ~(((points | 32) >= 97) & ((points | 32) <= 122))
    counts = [sums_by_text(x.astype(np.float64), starts) for x in (capital, digit, sign)]
    return np.stack([same_words, same_lines, *counts, words], 1)


def _relative(shapes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shape counts as shares: of words, of words, of characters (three times), and words of characters."""
    words = np.maximum(shapes[:, 5], 1)
    whole = np.maximum(size, 1)
    return np.stack([shapes[:, 0] / words, shapes[:, 1] / words, *(shapes[:, k] / whole for k in (2, 3, 4, 5))], 1)


def feature_rows(texts: list[str]) -> np.ndarray:
    """Texts x (buckets and shapes), for the fit."""
    table = np.zeros((len(texts), (1 << BITS) + len(SHAPES)), np.float32)
    shapes, size = np.zeros((len(texts), len(SHAPES))), np.zeros(len(texts))
    for numbers, pieces in in_pieces(texts):
        points, starts = codes(pieces)
        for k, n in enumerate(numbers):
            for order in ORDERS:
                stretch = ngrams(points[starts[k] - 2 : starts[k + 1]], order, BITS)[2:]
                table[n, : 1 << BITS] += np.bincount(stretch, minlength=1 << BITS)
        np.add.at(shapes, numbers, _shapes(points, starts))
        np.add.at(size, numbers, np.diff(starts))
    table[:, : 1 << BITS] /= np.maximum(size, 1)[:, None]
    table[:, 1 << BITS :] = _relative(shapes, size)
    return table


def scores(model: QualityModel, texts: list[str]) -> np.ndarray:
    """w . x of each text."""
    weights = model.weights[: 1 << BITS].astype(np.float32)
    total, size, shapes = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros((len(texts), len(SHAPES)))
    for numbers, pieces in in_pieces(texts):
        points, starts = codes(pieces)
        found = weights[ngrams(points, ORDERS[0], BITS)]
        for order in ORDERS[1:]:
            found += weights[ngrams(points, order, BITS)]
        np.add.at(total, numbers, sums_by_text(found.astype(np.float64), starts))
        np.add.at(shapes, numbers, _shapes(points, starts))
        np.add.at(size, numbers, np.diff(starts))
    return total / np.maximum(size, 1) + _relative(shapes, size) @ model.weights[1 << BITS :]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, grades: tuple[float, ...], steps: int = STEPS) -> QualityModel:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole sample; y: numbers of the grades. x is changed in place."""
    middle = x.mean(0, dtype=np.float64)
    # Block by block: the sample is held once.
    blocks = [slice(n, n + 512) for n in range(0, len(x), 512)]
    spread = np.sqrt(sum(((x[b] - middle) ** 2).sum(0) for b in blocks) / len(x))
    used = spread > 0
    scale = np.where(used, 1 / np.maximum(spread, 1e-9), 0).astype(np.float32)
    scale[: 1 << BITS] = np.minimum(scale[: 1 << BITS], 1 / max(1e-9, float(np.median(spread[: 1 << BITS][used[: 1 << BITS]])) if used[: 1 << BITS].any() else 1))
    scale[: 1 << BITS] /= np.sqrt(max(1, used.sum() / 64))
    cuts = len(grades) - 1
    share = np.array([(y > k).mean() for k in range(cuts)]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    w = np.zeros(x.shape[1])
    # The first threshold, and the logarithms of the steps to the later ones.
    cut = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    for b in blocks:
        x[b] = (x[b] - middle) * scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, cut)]
    n = np.arange(len(y))
    for step in range(1, steps + 1):
        theta = np.concatenate((cut[:1], cut[:1] + np.cumsum(np.exp(cut[1:]))))
        above = _sigmoid((x @ w.astype(np.float32))[:, None] - theta)
        wide = np.concatenate((np.ones((len(y), 1)), above, np.zeros((len(y), 1))), 1)
        p = np.maximum(wide[n, y] - wide[n, y + 1], 1e-9)
        slope = wide * (1 - wide)
        by_score = (slope[n, y] - slope[n, y + 1]) / p
        by_theta = np.zeros((len(y), cuts + 2))
        by_theta[n, y] -= slope[n, y] / p
        by_theta[n, y + 1] += slope[n, y + 1] / p
        g_theta = by_theta[:, 1:-1].mean(0)
        g_cut = np.concatenate(([g_theta.sum()], [g_theta[k:].sum() * np.exp(cut[k]) for k in range(1, cuts)]))
        g_w = (by_score / len(y)).astype(np.float32) @ x - PENALTY * w
        for (m, v), p_, g in zip(state, (w, cut), (g_w, g_cut), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = np.concatenate((cut[:1], cut[:1] + np.cumsum(np.exp(cut[1:]))))
    real = w * scale
    return QualityModel(grades, real, theta + float(middle @ real))


def train(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", rows: int = TRAIN_ROWS
) -> QualityModel:
    """Fit on at most rows rated texts. ratings: (id, grade), one grade an id (the lowest if several).

    Null ids and grades are not read; a null text is empty; long texts are read whole; rows
    that repeat an id and its text count once, an id's other texts each, in order of a hash,
    so that the same rows give the same model. Other columns are not read, whatever their
    names. Without rated rows the only grade is 0.
    """
    chosen = (
        ratings.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(F.col(grade_col).cast("double")).alias("_grade"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                for start in range(0, len(texts), 256):
                    table = feature_rows(texts[start : start + 256])
                    at = [np.flatnonzero(r) for r in table]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).slice(start, len(table)),
                            part.column(2).slice(start, len(table)),
                            pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                            pa.array([r[a].tobytes() for r, a in zip(table, at, strict=True)], pa.binary()),
                        ],
                        ["grade", "h", "at", "value"],
                    )

    # Only what is needed joins, under names of its own; rows that repeat an id and its text are one.
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rated = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_grade").alias("_y"), "_text", F.xxhash64("_doc", "_text").alias("_h"))
    made = rated.mapInArrow(rows_of, "grade double, h bigint, at binary, value binary").dropDuplicates(["grade", "h"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        given = np.concatenate([b.column("grade").to_numpy() for b in held]) if held else np.zeros(0)
        grades = tuple(np.unique(given).tolist())
        width = (1 << BITS) + len(SHAPES)
        if len(grades) < 2:
            model = QualityModel(grades or (0.0,), np.zeros(width), np.zeros(0))
        else:
            x = np.zeros((len(given), width), np.float32)
            at = 0
            while held:
                b = held.pop(0)
                for place, value in zip(b.column("at"), b.column("value"), strict=True):
                    x[at, np.frombuffer(place.as_buffer(), np.uint16)] = np.frombuffer(value.as_buffer(), np.float32)
                    at += 1
            model = fit(x, np.searchsorted(grades, given), grades)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, np.float64).tolist()], pa.list_(pa.float64())) for v in (model.grades, model.weights, model.thresholds)], ["grades", "weights", "thresholds"])

    # One task has the sample, which is bounded, and only the model goes to the driver.
    sample = made.orderBy("h", "grade").limit(rows).select("grade", "at", "value").coalesce(1)
    told = sample.mapInArrow(fitted, "grades array<double>, weights array<double>, thresholds array<double>").collect()
    if not told:
        return QualityModel((0.0,), np.zeros((1 << BITS) + len(SHAPES)), np.zeros(0))
    return QualityModel(tuple(told[0]["grades"]), np.array(told[0]["weights"]), np.array(told[0]["thresholds"]))


def tails(model: QualityModel, texts: list[str], least_grade: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of least_grade or more, of each text."""
    grades = np.array(model.grades)
    cut = int(np.searchsorted(grades, least_grade))
    above = _sigmoid(scores(model, texts)[:, None] - model.thresholds) if len(grades) > 1 and texts else np.zeros((len(texts), max(0, len(grades) - 1)))
    expected = grades[0] + above @ np.diff(grades)
    if cut == 0 or len(grades) < 2:
        return expected, np.ones(len(texts))
    return expected, above[:, cut - 1] if cut < len(grades) else np.zeros(len(texts))


def rate(
    docs: DataFrame, model: QualityModel, least_grade: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: id, expected_grade, tail_probability (of least_grade or more).

    Whole texts are read; null counts as empty; other columns are not read. A model that
    saw one grade or none gives that grade (0 if none) and tail probability 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "expected_grade", "tail_probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                expected, tail = tails(shared.value, texts, least_grade)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(tail)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, expected_grade double, tail_probability double"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def tail_probability(spark, model: QualityModel, least_grade: float):  # noqa: ANN001, ANN201
    """rate()'s tail probability of a text column as a column, for filters that keep a table's other columns."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tail(text: pd.Series) -> pd.Series:
        known: QualityModel = shared.value
        return pd.Series(tails(known, [t or "" for t in text], least_grade)[1])

    return tail
