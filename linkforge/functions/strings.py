"""String measures that SQL has no function for: Jaro, optimal string alignment, a phonetic code.

Jaro and optimal string alignment are Arrow-batched functions of two columns; use them on
candidate pairs, not on products. The phonetic code is a built-in expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge import config as C


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity of the bytes; half of an odd number of transpositions is rounded down."""
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    free = [True] * len(y)
    left = []
    for i, c in enumerate(x):
        low = max(0, i - reach)
        j = next((j for j in range(low, min(len(y), i + reach + 1)) if free[j] and y[j] == c), -1)
        if j >= 0:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    right = [c for c, f in zip(y, free, strict=True) if not f]
    swapped = sum(p != q for p, q in zip(left, right, strict=True))
    return (m / len(x) + m / len(y) + (m - swapped // 2) / m) / 3


def osa_of(a: str, b: str, most: int | None = None) -> int | None:
    """Edits with swaps of neighbours, no part edited twice; None beyond most."""
    if most is not None and abs(len(a) - len(b)) > most:
        return None
    before, last = [], list(range(len(a) + 1))
    for j in range(1, len(b) + 1):
        now = [j]
        for i in range(1, len(a) + 1):
            cost = a[i - 1] != b[j - 1]
            best = min(last[i] + 1, now[i - 1] + 1, last[i - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[i - 2] + cost)
            now.append(best)
        if most is not None and min(now) > most:
            return None
        before, last = last, now
    return last[-1] if most is None or last[-1] <= most else None


def jaro(a: Column | str, b: Column | str) -> Column:
    """jaro_of(); null where either is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_of(p, q) for p, q in zip(x, y, strict=True)], dtype="object").astype("Float64")

    return run(a, b)


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Jaro, raised by a tenth of what it lacks for each of the first four characters in common; null where either is null."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    j = jaro(a, b)
    same = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
    shared = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    return j + F.lit(0.1) * shared * (F.lit(1.0) - j)


def osa(a: Column | str, b: Column | str, most: int | None = None) -> Column:
    """osa_of(); null where either is null, or beyond most."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa_of(p, q, most) for p, q in zip(x, y, strict=True)], dtype="object").astype("Int32")

    return run(a, b)


def phonetic_a(x: str) -> str:
    """SQL of the first phonetic code: pairs, then letters; consonants and a leading vowel; six characters, runs as one."""
    pieces = f"regexp_extract_all(upper(trim({x})), '({'|'.join(p for p, _ in C.PHONETIC_PAIRS)}|(?s:.))', 1)"
    arms = " ".join(f"when '{p}' then '{to}'" for p, to in (*C.PHONETIC_PAIRS, *C.PHONETIC_LETTERS))
    coded = f"transform({pieces}, (p, i) -> case p {arms} else case when p rlike '^[B-DF-HJ-NP-TV-Z]$' or (i = 0 and p rlike '^[AEIOU]$') then p else '' end end)"
    return f"regexp_replace(substring(array_join({coded}, ''), 1, 6), '(.)\\\\1+', '$1')"


def phonetic_tokens(x: str) -> str:
    """SQL of the codes of a text's words, without short ones, numbers, common words and empty codes."""
    words = f"filter(split(upper({x}), '\\\\s+'), w -> length(w) > 2 and not w rlike '^[0-9]+$' and not array_contains(array({', '.join(repr(w) for w in C.PHONETIC_COMMON)}), w))"
    return f"filter(transform({words}, w -> {phonetic_a('w')}), c -> c <> '')"


def phonetic_overlap(a: str, b: str) -> str:
    """SQL of the number of a's codes that b has."""
    return f"size(filter({phonetic_tokens(a)}, c -> array_contains({phonetic_tokens(b)}, c)))"
