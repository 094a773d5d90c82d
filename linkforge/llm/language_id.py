"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts by language and bucket are made in one distributed pass over all labelled rows;
each task sends one sparse row set of bounded size (languages times buckets). The matrix
of log probabilities has a fixed size and is broadcast; texts are scored in batches as
sparse rows of buckets times that matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_slices
from .features import codes, in_pieces, ngrams, sums_by_text

BITS = 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The broadcast matrix: languages x buckets x 4 bytes, 1024 languages at most at 14 bits.
MAX_MATRIX_BYTES = 64 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Buckets x languages.
    log_probability: np.ndarray
    log_prior: np.ndarray
    bits: int = BITS


def _buckets(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    points, starts = codes([t.lower() for t in texts])
    return [ngrams(points, n, bits) for n in ORDERS], starts


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> LanguageModel:
    """Counts over all rows that have a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            done = 0
            for part, texts in text_slices(batch):
                of = langs[done : done + part.num_rows]
                done += part.num_rows
                for lang in set(of):
                    table = tables.setdefault(lang, np.zeros(1 << bits, np.int64))
                    rows[lang] = rows.get(lang, 0) + of.count(lang)
                    for _, pieces in in_pieces([t for t, x in zip(texts, of, strict=True) if x == lang]):
                        for b in _buckets(pieces, bits)[0]:
                            table += np.bincount(b[2:], minlength=1 << bits)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(table[at], rows[lang]))],
                ["lang", "bucket", "n"],
            )

    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = (
        labelled.select(F.col(lang_col), F.col(text_col))
        .mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(counted["lang"].unique()))
    if len(languages) * 4 << bits > MAX_MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages at {bits} bits exceed the broadcast bound; use fewer bits")
    table = np.zeros((1 << bits, max(1, len(languages))))
    prior = np.ones(max(1, len(languages)))
    place = counted["lang"].map({x: n for n, x in enumerate(languages)}).to_numpy().astype(np.int64)
    bucket, n = counted["bucket"].to_numpy().astype(np.int64), counted["n"].to_numpy()
    table[bucket[bucket >= 0], place[bucket >= 0]] = n[bucket >= 0]
    prior[place[bucket < 0]] = n[bucket < 0]
    smooth = table + SMOOTHING
    return LanguageModel(languages, np.log(smooth / smooth.sum(0)).astype(np.float32), np.log(prior / prior.sum()), bits)


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language, and its posterior probability, for each text."""
    return judge(model, texts)[:2]


def judge(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score_texts(), and the mean log-likelihood of an n-gram in the likeliest language."""
    size = np.zeros(len(texts), np.int64)
    totals = np.tile(model.log_prior, (len(texts), 1))
    columns = [np.ascontiguousarray(model.log_probability[:, k]) for k in range(model.log_probability.shape[1])]
    for numbers, pieces in in_pieces(texts):
        buckets, starts = _buckets(pieces, model.bits)
        np.add.at(size, numbers, len(ORDERS) * np.diff(starts))
        for k, column in enumerate(columns):
            found = column[buckets[0]]
            for b in buckets[1:]:
                found += column[b]
            np.add.at(totals, (numbers, k), sums_by_text(found, starts))
    best = totals.argmax(1)
    mean = (totals[np.arange(len(texts)), best] - model.log_prior[best]) / np.maximum(size, 1)
    return best, 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1), mean


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, lang_pred, score (posterior probability of lang_pred).

    A null text, and one without a letter, is ``und`` with score 0; so is every text if no
    language was learned. Of languages that are equally likely the first in order of code
    is taken. Whole texts are read, long ones piece by piece; no other column is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letter = shared.value, regex.compile(r"\p{L}").search
        for batch in batches:
            for part, texts in text_slices(batch):
                best, score = score_texts(known, texts)
                told = [bool(known.languages) and letter(t) is not None for t in texts]
                langs = [known.languages[b] if t else UNDETERMINED for b, t in zip(best.tolist(), told, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(np.where(np.array(told, bool), score, 0.0))], names
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


#: Standard deviations below the mean of learned texts at which a text is foreign to its likeliest language.
FOREIGN = 8.0


def floors(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", spread: float = FOREIGN) -> np.ndarray:
    """By language, the least mean log-likelihood of an n-gram that its texts have.

    That is spread standard deviations under the mean over all rows that have a language
    and a letter, or the least of these rows if that is lower; without such rows there is
    none. A text of a language or script that was
    not learned is likeliest in some learned one all the same, but far under its floor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letter = shared.value, regex.compile(r"\p{L}").search
        width = max(1, len(known.languages))
        sums, least = np.zeros((3, width)), np.zeros(width)
        for batch in batches:
            for _, texts in text_slices(batch):
                told = [t for t in texts if letter(t) is not None]
                if told:
                    best, _, mean = judge(known, told)
                    for k, x in enumerate((np.ones(len(told)), mean, mean * mean)):
                        sums[k] += np.bincount(best, x, width)
                    np.minimum.at(least, best, mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, sums), pa.array(least)], ["lang", "n", "x", "xx", "least"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.lit(0).alias("_"), F.col(text_col))
    every = rows.mapInArrow(run, "lang int, n double, x double, xx double, least double")
    every = every.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")], F.min("least").alias("least"))
    found = np.full(max(1, len(model.languages)), -np.inf)
    for r in every.collect():
        if r["n"]:
            mean = r["x"] / r["n"]
            found[r["lang"]] = min(r["least"], mean - spread * np.sqrt(max(0.0, r["xx"] / r["n"] - mean * mean))) - 1e-6
    return found


def certainty(spark: SparkSession, model: LanguageModel, floor: np.ndarray | None = None) -> Callable[[Column], Column]:
    """identify()'s score of a text column as a column, for filters that keep a table's other columns.

    0 for a text under its language's floor. Null and empty texts have 0; repeated rows are
    scored each; an empty table has no scores; other columns are not read.
    """
    shared = spark.sparkContext.broadcast((model, floor))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        (known, least), letter = shared.value, regex.compile(r"\p{L}").search
        texts = [t or "" for t in text]
        if not texts:
            return pd.Series(np.zeros(0))
        best, found, mean = judge(known, texts)
        told = np.array([bool(known.languages) and letter(t) is not None for t in texts], bool)
        if least is not None:
            told &= mean >= least[best]
        return pd.Series(np.where(told, found, 0.0))

    return score
