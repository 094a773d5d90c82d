"""Address text: normalising, tokens, component parsing, phonetic codes. All functions give SQL text."""

from __future__ import annotations

from linkforge import config as C

from .dialect import Dialect


def words(d: Dialect, rules: tuple[tuple[str, str], ...], x: str) -> str:
    """Word-boundary rules in order."""
    for word, full in rules:
        x = d.rep(x, rf"\b{word}\b", full)
    return x


def squeeze(d: Dialect, x: str) -> str:
    return f"trim({d.rep(x, r'\s+', ' ')})"


def any_of(d: Dialect, x: str, items: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{d.find(x, d.lit(i))} > 0" for i in items) + ")"


def in_list(d: Dialect, x: str, items: tuple[str, ...]) -> str:
    return f"({x} in ({', '.join(d.lit(i) for i in items)}))"


# -- normalising --------------------------------------------------------------------
def postcode(d: Dialect, x: str) -> str:
    """First postcode, upper case, without spaces; empty if none."""
    return f"replace({d.ext(f'upper({x})', C.POSTCODE)}, ' ', '')"


def canonical(d: Dialect, x: str) -> str:
    """Upper case, postcodes and signs dropped, abbreviations and descriptors rewritten, single spaces."""
    s = d.rep(f"upper(trim({x}))", C.POSTCODE, " ")
    s = squeeze(d, d.rep(s, r"[^A-Z0-9\s]", " "))
    s = words(d, C.ABBREVIATIONS, s)
    return squeeze(d, words(d, C.DESCRIPTORS, s))


def enhanced(d: Dialect, x: str) -> str:
    """The canonical form for fuzzy work: directions, buildings, noise words and business names as well."""
    raw = f"upper(trim({x}))"
    s = f"({d.rep(raw, C.POSTCODE, ' ')})"
    s = squeeze(d, s)
    for short, full in C.ENHANCED_WORDS:
        s = f"replace({s}, ' {short} ', ' {full} ')"
    full_of = dict(C.ENHANCED_WORDS)
    for short in C.ENHANCED_AT_START:
        s = d.rep(s, rf"^{short.replace('.', '[.]')} ", f"{full_of[short]} ")
    for short in C.ENHANCED_AT_END:
        s = d.rep(s, rf" {short}$", f" {full_of[short]}")
    for word in C.NOISE_WORDS:
        s = f"replace({s}, ' {word} ', ' ')"
    s = d.rep(s, "^THE ", "")
    for variant, standard in C.BUSINESS_NAMES:
        s = f"replace({s}, {d.lit(variant)}, {d.lit(standard)})"
    s = d.rep(s, "['\"`]", "")
    s = d.rep(s, r"[-_,.;:!?()\[\]{}/\\]", " ")
    return squeeze(d, f"replace({s}, '&', ' AND ')")


def standardised(d: Dialect, x: str) -> str:
    s = words(d, C.STANDARD_WORDS, f"upper(trim({x}))")
    return f"trim({d.rep(d.rep(s, r'\s+', ' '), r'[^\w\s,.-]', '')})"


def cleaned(d: Dialect, x: str) -> str:
    """Known misspellings corrected, trimmed, upper case."""
    for wrong, right in C.CORRECTIONS:
        x = f"replace({x}, {d.lit(wrong)}, {d.lit(right)})"
    return f"trim(upper({x}))"


def without_property_name(d: Dialect, x: str) -> str:
    """What follows a property name where a number and a street do."""
    return f"case when {d.like(x, r'^[A-Z0-9\s]*, \d+[A-Z]? [A-Z\s]+')} then trim({d.ext(x, r', (.+)')}) else {x} end"


def gazetteer_canonical(d: Dialect, x: str) -> str:
    return d.rep(d.rep(f"upper({x})", r"\s+", " "), "[^A-Z0-9 ]", "")


def join_canonical(d: Dialect, x: str) -> str:
    return f"upper({d.rep(x, r'[^\w\s]', '')})"


def search_canonical(d: Dialect, x: str) -> str:
    return squeeze(d, d.rep(f"upper(trim({x}))", r"[^\w\s]", ""))


def address_hash(d: Dialect, x: str) -> str:
    return f"md5(lower(trim({x})))"


def uprn_clean(d: Dialect, x: str) -> str:
    """Trimmed, quotes and the ``UPRN:`` prefix dropped, no trailing ``.0`` or ``.00``; exponent forms are null."""
    s = d.rep(d.rep(f"trim({x})", "[\"']", ""), r"^UPRN:\s*", "")
    s = d.rep(s, r"\.00?$", "")
    return f"case when {d.like(s, r'[eE][+]?\d')} then null else nullif({s}, '') end"


def is_real_address(d: Dialect, x: str) -> str:
    street = d.like(f"lower({x})", "|".join(C.REAL_ADDRESS_WORDS))
    return (
        f"coalesce(length(trim({x})) >= 10 and not {d.like(x, r'^[A-Z]{1,3}[0-9]+/?[0-9]*$')} "
        f"and {'not ' + in_list(d, f'upper({x})', ('N/A', 'NOT APPLICABLE', 'NONE', 'NULL', 'TBC'))} and ({street} or {d.find(x, d.lit(','))} > 0), false)"
    )


def skip_address(d: Dialect, x: str) -> str:
    s = f"trim(upper({x}))"
    spaces = f"(length({s}) - length(replace({s}, ' ', '')))"
    return (
        f"coalesce({in_list(d, s, ('N/A', 'NOT APPLICABLE', 'NONE', 'NULL', ''))} "
        f"or (length({s}) < 50 and ({d.find(s, d.lit('-'))} > 0 or {d.like(s, '^F')}) and {spaces} <= 1) or (length({s}) <= 5 and {spaces} = 0), true)"
    )


def component_words(d: Dialect, x: str) -> str:
    s = f"concat(' ', {x}, ' ')"
    for short, full in C.COMPONENT_WORDS:
        s = f"replace({s}, {d.lit(short)}, {d.lit(full)})"
    return f"trim({s})"


# -- tokens -------------------------------------------------------------------------
def tokens(d: Dialect, x: str) -> str:
    return d.filter(d.split(f"trim({x})", r"\s+"), "t", "t <> ''")


def house_numbers(d: Dialect, x: str) -> str:
    return d.cat(d.ext_all(x, r"\b(\d+[A-Za-z]?)\b"), d.ext_all(x, r"\b(?:FLAT|APT|APARTMENT|UNIT|STUDIO)\s+(\d+[A-Za-z]?)\b"))


def localities(d: Dialect, x: str) -> str:
    one = tuple(t for t in C.LOCALITIES if " " not in t)
    many = d.array(*[d.lit(t) for t in C.LOCALITIES if " " in t])
    up = f"upper({x})"
    return d.cat(d.filter(tokens(d, up), "t", in_list(d, "t", one)), d.filter(many, "m", f"{d.find(up, 'm')} > 0"))


def street_tokens(d: Dialect, x: str) -> str:
    keep = f"not {d.like('t', r'\b\d+[A-Za-z]?\b')} and not {in_list(d, 't', tuple(t for t in C.LOCALITIES if ' ' not in t))} and not {in_list(d, 't', C.STREET_STOP_WORDS)} and length(t) >= 2"
    return d.filter(tokens(d, f"upper({x})"), "t", keep)


def class_numbers(d: Dialect, x: str) -> str:
    return d.filter(tokens(d, x), "t", d.like("t", r"^\d+[A-Z]?$"))


def class_localities(d: Dialect, x: str) -> str:
    return d.filter(tokens(d, x), "t", in_list(d, "t", C.TOKEN_LOCALITIES))


def class_streets(d: Dialect, x: str) -> str:
    return d.filter(tokens(d, x), "t", in_list(d, "t", C.TOKEN_STREETS))


# -- components, first parser ---------------------------------------------------------
def v1_rest(d: Dialect, x: str) -> str:
    return squeeze(d, d.rep(x, C.POSTCODE, " "))


def v1_house(d: Dialect, x: str) -> str:
    return d.ext(v1_rest(d, x), r"^(\d+[A-Z]?)\s+")


def v1_tail(d: Dialect, x: str) -> str:
    return f"upper({d.rep(v1_rest(d, x), r'^(\d+[A-Z]?)\s+', '')})"


def v1_town(d: Dialect, tail: str) -> str:
    return "case " + " ".join(f"when {d.find(tail, d.lit(t))} > 0 then {d.lit(t)}" for t in C.TOWNS) + " else '' end"


def v1_street(d: Dialect, tail: str) -> str:
    found = [rf"(\w+(?:\s+\w+)*\s+{t})" for t in C.STREET_TYPES]
    return "case " + " ".join(f"when {d.like(tail, p)} then {d.ext(tail, p)}" for p in found) + " else '' end"


def v1_county(d: Dialect, tail: str) -> str:
    return f"case when {any_of(d, tail, ('HAMPSHIRE', 'HANTS'))} then 'HAMPSHIRE' else '' end"


# -- components, production parser ----------------------------------------------------
def v2_clean(d: Dialect, x: str) -> str:
    return squeeze(d, words(d, C.COUNTY_WORDS, words(d, C.PARSER_WORDS, f"upper(trim({x}))")))


def v2_house(d: Dialect, s: str) -> str:
    """Unit, else flat, else leading number, of a cleaned address."""
    return f"coalesce(nullif({d.ext(s, C.UNIT)}, ''), nullif({d.ext(s, C.FLAT)}, ''), {d.ext(s, r'^\s*(\d+[A-Z]?)\b')})"


def v2_postcode(d: Dialect, s: str) -> str:
    return d.ext(s, C.PARSER_POSTCODE)


def v2_parts(d: Dialect, s: str, house: str, pc: str) -> str:
    """Comma parts between house number and postcode."""
    start = f"case when {house} <> '' and left({s}, length({house})) = {house} then substring({s}, length({house}) + 1) else {s} end"
    start = f"case when {house} <> '' then trim({d.rep(f'({start})', '^,', '')}) else {s} end"
    end = f"case when {pc} <> '' and right({start}, length({pc})) = {pc} then substring({start}, 1, length({start}) - length({pc})) else {start} end"
    end = f"case when {pc} <> '' then trim({d.rep(f'({end})', ',$', '')}) else {start} end"
    return d.map(d.split(f"({end})", ","), "p", "trim(p)")


def v2_is_locality(d: Dialect, p: str, i: str, n: str) -> str:
    """The i-th of n comma parts, counted from 1, names a locality."""
    near_end = f"{i} >= {n} - 1"
    looks = f"({any_of(d, p, C.LOCALITY_INDICATORS)} or ({d.find(p, d.lit(' '))} = 0 and length({p}) <= 12))"
    return f"({p} <> '' and not {any_of(d, p, C.STREET_INDICATORS)} and {near_end} and (length({p}) <= 15 or {looks}))"


def v2_locality(d: Dialect, parts: str) -> str:
    n = d.size(parts)
    return d.join(d.map(d.filter(d.range("1", n), "i", v2_is_locality(d, d.at(parts, "i"), "i", n)), "i", d.at(parts, "i")), ", ")


def v2_street(d: Dialect, parts: str) -> str:
    n = d.size(parts)
    keep = f"{d.at(parts, 'i')} <> '' and not {v2_is_locality(d, d.at(parts, 'i'), 'i', n)}"
    return d.join(d.map(d.filter(d.range("1", n), "i", keep), "i", d.at(parts, "i")), ", ")


def valid_house(d: Dialect, h: str) -> str:
    return f"({h} <> '' and {d.like(h, '^(?:' + '|'.join(C.HOUSE_NUMBER_FORMS) + ')$')})"


def valid_postcode(d: Dialect, p: str) -> str:
    return f"({p} <> '' and {d.like(f'upper(trim({p}))', r'^[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}$')})"


def v2_confidence(d: Dialect, house: str, street: str, pc: str, locality: str) -> str:
    return (
        f"((case when {house} = '' then 0.0 when {valid_house(d, house)} then 1.0 else 0.5 end "
        f"+ case when {street} = '' then 0.0 when length({street}) < 3 then 0.3 else 1.0 end "
        f"+ case when {pc} = '' then 0.0 when {valid_postcode(d, pc)} then 1.0 else 0.2 end "
        f"+ case when {locality} = '' then 0.5 else 1.0 end) / 4.0)"
    )


def vague(d: Dialect, x: str) -> str:
    return any_of(d, f"upper({x})", C.VAGUE_PHRASES)


def normal_postcode(d: Dialect, p: str) -> str:
    s = f"replace(upper(trim({p})), ' ', '')"
    return f"case when length({s}) >= 5 then concat(substring({s}, 1, length({s}) - 3), ' ', substring({s}, length({s}) - 2)) else {s} end"


def normal_street(d: Dialect, x: str) -> str:
    s = f"upper(trim({x}))"
    for p in (r"\bUNIT[,\s]+\d+[A-Z]?\b[,\s]*", r"\bFLAT[,\s]+[A-Z0-9]+\b[,\s]*", r"\bSUITE[,\s]+\d+[A-Z]?\b[,\s]*"):
        s = d.rep(s, p, "")
    s = d.rep(d.rep(words(d, C.PARSER_WORDS, s), r"\s*,\s*", ", "), r"\s+", " ")
    return f"trim({d.rep(s, r'^[,\s]+|[,\s]+$', '')})"


# -- phonetic -------------------------------------------------------------------------
def phonetic_b(d: Dialect, x: str) -> str:
    """Digraphs, vowels dropped after the first letter, runs collapsed, four characters."""
    s = f"upper(trim({x}))"
    for a, b in C.DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"concat(substring({s}, 1, 1), {d.rep(f'substring({s}, 2)', '[AEIOUY]', '')})"
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0":
        s = d.rep(s, f"{c}{c}+", c)
    return f"substring({s}, 1, 4)"
