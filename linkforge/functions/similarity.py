"""Similarities of strings, token lists, vectors and places. All functions give SQL text."""

from __future__ import annotations

from .dialect import Dialect


def trigrams(d: Dialect, x: str) -> str:
    """Different 3-grams of each lower-case word, padded with two spaces before and one after."""
    padded = d.map(d.filter(d.split(f"lower({x})", "[^a-z0-9]+"), "w", "w <> ''"), "w", "concat('  ', w, ' ')")
    grams = d.map(padded, "w", d.map(d.range("1", "length(w) - 2"), "i", "substring(w, i, 3)"))
    return d.uniq(f"flatten({grams})")


def trigram_of(d: Dialect, a: str, b: str) -> str:
    """Similarity of two trigram sets; 0 if both are empty."""
    shared = d.size(d.both(a, b))
    return f"coalesce({shared} / nullif(cast({d.size(a)} + {d.size(b)} - {shared} as double), 0), 0.0)"


def trigram(d: Dialect, a: str, b: str) -> str:
    return trigram_of(d, trigrams(d, a), trigrams(d, b))


def levenshtein(d: Dialect, a: str, b: str) -> str:
    return f"levenshtein({a}, {b})"


def edit_similarity(d: Dialect, a: str, b: str) -> str:
    """1 - distance / longer length; 1 if both are empty."""
    return f"coalesce(1 - levenshtein({a}, {b}) / nullif(cast(greatest(length({a}), length({b})) as double), 0), 1.0)"


def char_share(d: Dialect, a: str, b: str) -> str:
    """Share of a's characters that b has anywhere, of the longer length."""
    found = d.size(d.filter(d.split(a, ""), "c", f"c <> '' and {d.find(b, 'c')} > 0"))
    return f"case when {a} = {b} then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else {found} / cast(greatest(length({a}), length({b})) as double) end"


def near_char_share(d: Dialect, a: str, b: str) -> str:
    """Share of a's characters that b has within half the longer length (the staged matchers' measure)."""
    window = f"floor(greatest(length({a}), length({b})) / 2.0)"
    hit = d.any(d.range("1", f"length({b})"), "j", f"substring({b}, j, 1) = substring({a}, i, 1) and abs(i - j) <= {window}")
    found = d.size(d.filter(d.range("1", f"length({a})"), "i", hit))
    return f"case when {a} = {b} then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else {found} / cast(greatest(length({a}), length({b})) as double) end"


def overlap_smaller(d: Dialect, a: str, b: str) -> str:
    """b's elements that a has, of the smaller list; 1 if both are empty, 0 if one is."""
    found = d.size(d.filter(b, "t", d.has(a, "t")))
    return f"case when {d.size(a)} = 0 and {d.size(b)} = 0 then 1.0 when {d.size(a)} = 0 or {d.size(b)} = 0 then 0.0 else {found} / cast(least({d.size(a)}, {d.size(b)}) as double) end"


def overlap_directed(d: Dialect, a: str, b: str) -> str:
    found = d.size(d.filter(a, "t", d.has(b, "t")))
    return f"case when {d.size(a)} = 0 then 0.0 else {found} / cast({d.size(a)} as double) end"


def token_jaccard(d: Dialect, a: str, b: str) -> str:
    """Jaccard of token lists with repeats."""
    found = d.size(d.filter(a, "t", d.has(b, "t")))
    return f"case when {d.size(a)} = 0 or {d.size(b)} = 0 then 0.0 else {found} / cast({d.size(a)} + {d.size(b)} - {found} as double) end"


def bag_cosine(d: Dialect, a: str, b: str) -> str:
    """Cosine of the token counts of two lists."""
    count = lambda xs: d.size(d.filter(xs, "u", "u = t"))
    dot = d.total(d.map(d.uniq(a), "t", f"cast({count(a)} * {count(b)} as double)"))
    norm = lambda xs: f"sqrt({d.total(d.map(d.uniq(xs), 't', f'cast({count(xs)} * {count(xs)} as double)'))})"
    return f"case when {d.size(a)} = 0 and {d.size(b)} = 0 then 1.0 when {d.size(a)} = 0 or {d.size(b)} = 0 then 0.0 else {dot} / ({norm(a)} * {norm(b)}) end"


def common_element(d: Dialect, a: str, b: str) -> str:
    return d.any(a, "p", d.has(b, "p"))


def common_suffix(d: Dialect, a: str, b: str) -> str:
    """Two numbers end in one letter."""
    suffix = lambda v: d.ext(f"upper({v})", r"^.+([A-Z])$")
    return d.any(a, "p", f"{suffix('p')} <> '' and " + d.any(b, "q", f"{suffix('q')} = {suffix('p')}"))


def close_numbers(d: Dialect, a: str, b: str) -> str:
    number = lambda v: f"try_cast({d.rep(v, '[A-Z]+$', '')} as int)"
    return d.any(a, "p", d.any(b, "q", f"coalesce(abs({number('p')} - {number('q')}) <= 2, false)"))


def vector_cosine(d: Dialect, a: str, b: str) -> str:
    """Cosine in double precision; 0 for vectors of different widths or without length."""
    at = lambda xs, i: f"cast({d.at(xs, i)} as double)"
    places = d.range("1", d.size(a))
    dot = lambda x, y: d.total(d.map(places, "i", f"{at(x, 'i')} * {at(y, 'i')}"))
    return f"case when {d.size(a)} <> {d.size(b)} then 0.0 else coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 0.0) end"


def distance(d: Dialect, e1: str, n1: str, e2: str, n2: str) -> str:
    return f"sqrt(({e1} - {e2}) * ({e1} - {e2}) + ({n1} - {n2}) * ({n1} - {n2}))"


def legacy_distance(d: Dialect, e1: str, n1: str, e2: str, n2: str) -> str:
    """Half the squared distance, which some matchers take for one."""
    return f"(0.5 * (({e1} - {e2}) * ({e1} - {e2}) + ({n1} - {n2}) * ({n1} - {n2})))"


def linear_boost(d: Dialect, x: str, most: float = 0.10, reach: float = 2000.0) -> str:
    return f"greatest(0.0, {most} * (1 - {x} / {reach}))"


def decay(d: Dialect, x: str, scale: float) -> str:
    return f"exp(-({x}) / {scale})"
