"""Toxicity by class-conditional Kneser-Ney models of toxic and of ordinary texts.

An expression's count in a class is the number of different words that it follows there,
so that copied passages, which repeat their contexts, weigh as one. Counts are discounted
by DISCOUNT; a backoff distribution that both classes share takes the mass, with the same
weight in both whatever their sizes. Its counts are numbers of classes that have the
expression, so one that is rare in both has nearly the same probability under both.

Counts are of all labelled rows of both classes. Expressions are hashed into 2 ** BITS
buckets: the model has a fixed size however many expressions there are, none is left out,
and those of a bucket share its counts.

A text's score is a power mean, signed, of all its expressions' log-likelihood
differences, its length divided out: many small ones, within what two samples of one
language show, weigh less than a few large ones. A logistic curve over it, fitted on
labelled rows that the counts did not use, gives the probability. The curve is fitted on a
sample, TRAIN_ROWS rows of each class at most, taken in order of a hash of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .storage import discard, materialise

TRAIN_ROWS = 10_000
DISCOUNT, POWER = 0.75, 5
#: Buckets of expressions, as a power of two: 16 MB of differences are broadcast.
BITS = 22
#: Words whose hashes a worker process keeps.
CACHE_WORDS = 200_000
#: Labels are broadcast up to this number (about 64 MB); more are joined by shuffling texts.
BROADCAST_LABELS = 2_000_000
#: The score at which a text counts as toxic where no curve can be fitted, in nats.
UNFITTED_MIDDLE = 1.0
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes(dict):
    """XXH64 of the words seen so far."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = Hashes()


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's number of words."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    known = _HASHES.__getitem__
    return np.fromiter(map(known, chain.from_iterable(words)), np.uint64, int(sizes.sum())), sizes


def buckets(words: np.ndarray, bits: int) -> np.ndarray:
    return words >> np.uint64(64 - bits)


@dataclass(frozen=True)
class ToxicityModel:
    #: log P(expression | toxic) - log P(expression | ordinary) by bucket, or nothing learned.
    differences: np.ndarray
    slope: float = 1.0
    middle: float = float("inf")

    def compare(self, texts: list[str]) -> np.ndarray:
        """Signed POWER-th root of each text's mean POWER-th power of the differences; 0 without a word."""
        words, sizes = hashed(texts)
        if not len(words) or not len(self.differences):
            return np.zeros(len(texts))
        each = self.differences[buckets(words, int(len(self.differences)).bit_length() - 1)].astype(np.float64) ** POWER
        sums = np.diff(np.concatenate(([0.0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes)))]) if len(texts) > 1 else np.array([each.sum()])
        mean = sums / np.maximum(1, sizes)
        return np.sign(mean) * np.abs(mean) ** (1 / POWER)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.compare(texts) - self.middle), -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a curve through the split with the fewest errors, its slope the likeliest (0 or more).

    The middle is above 0, the score of no difference. With rows of one class, or none,
    the curve has slope 1 and UNFITTED_MIDDLE.
    """
    if not len(y) or y.min() == y.max():
        return 1.0, UNFITTED_MIDDLE
    order = np.argsort(x, kind="stable")
    sorted_x, sorted_y = x[order], y[order]
    errors = np.concatenate(([0], np.cumsum(sorted_y))) + np.concatenate((np.cumsum((1 - sorted_y)[::-1])[::-1], [0]))
    inner = np.concatenate(([True], np.diff(sorted_x) > 0, [True]))
    edges = np.concatenate(([sorted_x[0] - 1e-3], sorted_x, [sorted_x[-1] + 1e-3]))
    middles = (edges[:-1] + edges[1:]) / 2
    errors = np.where(inner & (middles > 0), errors, len(y) + 1)
    if errors.min() > len(y):
        return 1.0, UNFITTED_MIDDLE
    # Of equally good splits the middle one.
    best = np.flatnonzero(errors == errors.min())
    middle = float(middles[int(best[len(best) // 2])])
    z = x - middle
    rates = np.geomspace(0.1, 1000, 200) / max(float(np.abs(z).mean()), 1e-9)
    loss = [np.logaddexp(0, np.where(y == 1, -r * z, r * z)).mean() + 1e-4 * np.log(r) ** 2 for r in rates]
    return float(rates[int(np.argmin(loss))]), middle


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text, fold, h): all labelled rows; rows with equal texts are in one fold."""
    by_id = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    )
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h = F.xxhash64("text")
    by_id = F.broadcast(by_id) if labels.count() <= BROADCAST_LABELS else by_id
    return rows.join(by_id, F.col("_doc") == F.col("_id")).select("label", "text", F.pmod(F.shiftright(h, 7), F.lit(5)).cast("int").alias("fold"), h.alias("h"))


def context_counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, n0, n1): by bucket, the number of different words before its expressions in the texts of each class of rows(label, text)."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_numpy().astype(np.uint64)
            done = 0
            for part, texts in text_slices(batch):
                words, sizes = hashed(texts)
                before = np.concatenate((np.zeros(1, np.uint64), words[:-1])) if len(words) else words
                starts = np.cumsum(sizes) - sizes
                before[starts[sizes > 0]] = 0
                of = np.repeat(classes[done : done + part.num_rows], sizes)
                done += part.num_rows
                # Bucket, class and 63 - bits bits of the word before, in one number.
                code = buckets(words, bits) << np.uint64(64 - bits) | of << np.uint64(63 - bits) | before * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(bits + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(code).view(np.int64))], ["code"])

    seen = rows.select("label", "text").mapInArrow(contexts, "code bigint").distinct()
    of = F.shiftrightunsigned("code", 63 - bits).bitwiseAND(F.lit(1))
    return seen.groupBy(F.shiftrightunsigned("code", 64 - bits).cast("int").alias("bucket")).agg(*[F.count_if(of == c).alias(f"n{c}") for c in (0, 1)])


def kneser_ney(bucket: np.ndarray, counts: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Differences by bucket from the context counts of ordinary and of toxic texts; empty without both."""
    total = [float(n.sum()) for n in counts]
    if not all(total):
        return np.zeros(0, np.float32)
    lost = [np.minimum(n, DISCOUNT) / t for n, t in zip(counts, total, strict=True)]
    # The larger class's backoff weighs less for its size alone: both get the same weight.
    weight = max(float(x.sum()) for x in lost)
    classes = [(n > 0).astype(np.float64) for n in counts]
    shared = (classes[0] + classes[1]) / (classes[0].sum() + classes[1].sum())
    p = [n / t - x + weight * shared for n, t, x in zip(counts, total, lost, strict=True)]
    found = np.zeros(1 << bits, np.float32)
    found[bucket] = np.log(p[1] / p[0])
    return found


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, bits: int = BITS
) -> ToxicityModel:
    """Fit on labelled texts; a fifth of them is kept for the curve, at most rows of each class of that fifth.

    labels: (id, label 0 or 1); the highest label of an id counts; null ids and labels
    are not read. Texts are read whole; null and empty ones add nothing. Without both
    classes nothing is learned and no text counts as toxic; if the kept fifth has one
    class only, logistic() says which curve holds. Other columns of both tables are not
    read, whatever their names; repeated rows change no count.
    """
    sample, path = materialise(labelled_texts(docs, labels, id_col, text_col, label_col), "toxicity-sample")
    table = context_counts(sample.filter("fold > 0"), bits).toArrow()
    differences = kneser_ney(table.column("bucket").to_numpy(), tuple(table.column(f"n{c}").to_numpy().astype(np.float64) for c in (0, 1)), bits)
    if not len(differences):
        discard(docs.sparkSession, path)
        return ToxicityModel(differences)
    broadcast = docs.sparkSession.sparkContext.broadcast(ToxicityModel(differences))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(broadcast.value.compare(texts)), part.column(2)], ["label", "x", "h"])

    every = sample.filter("fold = 0").select("label", "text", "h").mapInArrow(compared, "label int, x double, h bigint")
    held, held_path = materialise(every, "toxicity-curve")
    chosen = [held.filter(F.col("label") == c).orderBy("h", "x").limit(rows).toArrow() for c in (0, 1)]
    x, y = (np.concatenate([t.column(c).to_numpy() for t in chosen]) for c in ("x", "label"))
    for done in (path, held_path):
        discard(docs.sparkSession, done)
    return ToxicityModel(differences, *logistic(x, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and score (0 to 1, higher: likelier toxic).

    Whole texts are read; a null or empty text, or one without a word, gets the score of
    no difference between the models, which is under one half. Repeated rows are scored
    each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(known.score(texts))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
