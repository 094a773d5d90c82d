"""Embeddings that need no model: a digest's bytes repeated, and a number generator seeded by the text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge import config as C

DIMENSIONS = 384


def digest_embedding(x: str, dimensions: int = DIMENSIONS) -> str:
    """SQL of a unit vector: the MD5's 16 bytes over and over, scaled to -1..1, and four counts at the end.

    From the end backwards: words / 20, bytes / 100, the share of the address terms that the
    text holds, and the share of words with a digit. An empty text has all zeros; a text of
    white space only has the digest of the empty text and no counts. Null stays null.
    """
    if dimensions < 14:
        raise ValueError("at least 14 dimensions")
    s = f"upper(trim(both ' \\t\\r\\n' from {x}))"
    terms = " + ".join(f"int(instr(t, '{w}') > 0)" for w in C.EMBEDDING_TERMS)
    counts = (
        f"array(size(filter(words, w -> w rlike '[0-9]')) / double(size(words)), ({terms}) / {float(len(C.EMBEDDING_TERMS))}D, octet_length(t) / 100D, size(words) / 20D)"
    )
    # The 16 bytes are read once, not once for each dimension.
    bytes_ = "transform(sequence(0, 15), i -> conv(substring(digest, i * 2 + 1, 2), 16, 10) / 255D * 2 - 1)"
    base = f"flatten(array_repeat({bytes_}, {-(-dimensions // 16)}))"
    raw = f"case when size(words) = 0 then slice({base}, 1, {dimensions}) else concat(slice({base}, 1, {dimensions - 4}), {counts}) end"
    # Names for parts of the expression: a list of one struct, transformed.
    named = f"transform(array(named_struct('t', {s}, 'digest', md5(cast({s} as binary)), 'words', filter(split({s}, '\\\\s+'), w -> w <> ''))), p -> {_within('p', raw)})[0]"
    # The length is taken once for all elements.
    long = f"transform(array({named}), v -> named_struct('v', v, 'length', sqrt(aggregate(v, 0D, (a, b) -> a + b * b))))[0]"
    unit = f"transform(array({long}), r -> transform(r.v, e -> float(e / r.length)))[0]"
    return f"case when {x} = '' then array_repeat(float(0), {dimensions}) when {x} is not null then {unit} end"


def _within(struct: str, sql: str) -> str:
    """The text with the names t, digest and words read from a struct."""
    return re.sub(r"\b(t|digest|words)\b(?!\()", rf"{struct}.\1", sql)


def generated_of(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed 64-bit sums of 31^k times the characters seed a linear generator; its remainders by 1000, less 500, over 1000."""
    seed = _seed(text)
    out = np.empty(dimensions, np.int64)
    for i in range(dimensions):
        seed = (seed * 1103515245 + 12345) & 0xFFFFFFFFFFFFFFFF
        out[i] = seed - (1 << 64) if seed >> 63 else seed
    # The remainder has the sign of the number, as in most compiled languages.
    return ((np.fmod(out, 1000) - 500).astype(np.float32) / np.float32(1000)).astype(np.float32)


def generated_from(seeds: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of seeds, 64-bit numbers of either sign: a row for each."""
    seeds = seeds.astype(np.int64).view(np.uint64)
    states = np.empty((len(seeds), dimensions), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(dimensions):
            seeds = seeds * np.uint64(1103515245) + np.uint64(12345)
            states[:, i] = seeds
    return (np.fmod(states.view(np.int64), 1000) - 500).astype(np.float32) / np.float32(1000)


def generated_seed(x: Column | str) -> Column:
    """The seed of each text's generated vector, as a signed number; null for null."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else (s - (1 << 64) if (s := _seed(t)) >> 63 else s) for t in texts], dtype="Int64")

    return run(x)


def generated_embedding(x: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """generated_of(), a batch at a time; null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        seeds = np.array([_seed(t) for t in texts if t is not None], np.uint64)
        made = iter(generated_from(seeds.view(np.int64), dimensions))
        return pd.Series([None if t is None else next(made) for t in texts], dtype="object")

    return run(x)


def _seed(text: str) -> int:
    seed = 0
    for c in text:
        seed = (seed * 31 + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return seed
