"""Scalar functions as queries."""

from __future__ import annotations

from linkforge.functions import similarity as S
from linkforge.functions import text as T
from linkforge.functions.dialect import Dialect

from .registry import portable, scalar

RAW = "raw_address"


def _lists(d: Dialect, xs: str) -> str:
    """A list as text, for comparison."""
    return d.join(xs, "|")


scalar("n_canonical", "docs", "doc_id", {"canonical": lambda d: T.canonical(d, RAW), "postcode": lambda d: T.postcode(d, RAW), "blank": lambda d: f"({T.canonical(d, RAW)} = '')"})
scalar("n_enhanced", "docs", "doc_id", {"enhanced": lambda d: T.enhanced(d, RAW)})
scalar("n_standardise", "docs", "doc_id", {"standardised": lambda d: T.standardised(d, RAW)})
scalar("n_clean", "docs", "doc_id", {"cleaned": lambda d: T.cleaned(d, RAW), "address": lambda d: T.without_property_name(d, T.cleaned(d, RAW))})
scalar(
    "n_other_canonicals", "docs", "doc_id",
    {"gazetteer_form": lambda d: T.gazetteer_canonical(d, RAW), "join_form": lambda d: T.join_canonical(d, RAW), "search_form": lambda d: T.search_canonical(d, RAW), "components_form": lambda d: T.component_words(d, RAW)},
)
scalar("n_hash_uprn", "docs", "doc_id", {"hash": lambda d: T.address_hash(d, RAW), "uprn": lambda d: T.uprn_clean(d, "raw_uprn")})
scalar("n_real_address", "docs", "doc_id", {"is_real": lambda d: T.is_real_address(d, RAW), "skip": lambda d: T.skip_address(d, RAW)})
scalar(
    "n_planning_split", "docs", "doc_id",
    {"base": lambda d: "split_part(planning_ref, '/', 1)", "sequence": lambda d: "split_part(planning_ref, '/', 2)", "joined": lambda d: "concat(split_part(planning_ref, '/', 1), '/', split_part(planning_ref, '/', 2))"},
)
scalar("n_date_id", "orders", "o_orderkey", {"date_id": lambda d: "cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int)"})
scalar("n_parse_float", "docs", "doc_id", {"value": lambda d: "try_cast(trim(raw_uprn) as double)"})
scalar("p_house_numbers", "docs", "doc_id", {"numbers": lambda d: _lists(d, T.house_numbers(d, f"upper({RAW})")), "first_number": lambda d: f"coalesce({d.at(T.house_numbers(d, f'upper({RAW})'), 1)}, '')"})
scalar("p_localities", "docs", "doc_id", {"localities": lambda d: _lists(d, T.localities(d, RAW))})
scalar("p_street_tokens", "docs", "doc_id", {"street": lambda d: _lists(d, T.street_tokens(d, T.canonical(d, RAW)))})
scalar(
    "p_token_classes", "gaz", "address_id",
    {"numbers": lambda d: _lists(d, T.class_numbers(d, T.canonical(d, "full_address"))), "localities": lambda d: _lists(d, T.class_localities(d, T.canonical(d, "full_address"))), "streets": lambda d: _lists(d, T.class_streets(d, T.canonical(d, "full_address")))},
)
portable(
    "p_components_v1",
    lambda d: f"select doc_id, house, {T.v1_town(d, 'tail')} as town, {T.v1_street(d, 'tail')} as street, {T.v1_county(d, 'tail')} as county, pc as postcode "
    f"from (select doc_id, {T.v1_house(d, RAW)} as house, {T.v1_tail(d, RAW)} as tail, {T.postcode(d, RAW)} as pc from docs) s",
)


def parsed(d: Dialect, x: str, table: str, keep: str) -> str:
    """The production parse of a column, in steps, with the columns keep."""
    one = f"select {keep}, {x} as raw, {T.v2_clean(d, x)} as cleaned from {table}"
    two = f"select *, {T.v2_house(d, 'cleaned')} as house_number, {T.v2_postcode(d, 'cleaned')} as pc from ({one}) a"
    three = f"select *, {T.v2_parts(d, 'cleaned', 'house_number', 'pc')} as parts from ({two}) b"
    four = f"select *, {T.v2_street(d, 'parts')} as street, {T.v2_locality(d, 'parts')} as locality from ({three}) c"
    five = f"select *, {T.v2_confidence(d, 'house_number', 'street', 'pc', 'locality')} as confidence from ({four}) e"
    return f"select *, (confidence >= 0.6 and house_number <> '' and street <> '' and not {T.vague(d, 'raw')}) as suitable from ({five}) f"


portable("p_parse_v2", lambda d: f"select doc_id, house_number, street, locality, pc, confidence from ({parsed(d, RAW, 'docs', 'doc_id')}) p")
portable(
    "p_suitability",
    lambda d: f"select doc_id, suitable, {T.vague(d, 'raw')} as vague, case when {T.vague(d, 'raw')} then confidence * 0.5 else confidence end as score, "
    f"{T.valid_house(d, 'house_number')} as house_ok, {T.valid_postcode(d, 'pc')} as postcode_ok from ({parsed(d, RAW, 'docs', 'doc_id')}) p",
)


def ladders(d: Dialect) -> str:
    """The component ladders over docs paired with gazetteer rows."""
    left = parsed(d, RAW, "pairs", "doc_id, address_id, full_address")
    both = (
        f"select doc_id, address_id, house_number as h1, {T.normal_street(d, 'street')} as s1, {T.normal_postcode(d, 'pc')} as p1, suitable as ok1, full_address from ({left}) l"
    )
    right = parsed(d, "full_address", f"({both}) r", "doc_id, address_id, h1, s1, p1, ok1")
    pair = f"select doc_id, address_id, h1, s1, p1, ok1, house_number as h2, {T.normal_street(d, 'street')} as s2, {T.normal_postcode(d, 'pc')} as p2, suitable as ok2 from ({right}) q"
    digits = lambda h: f"try_cast({d.rep(h, '[^0-9]', '')} as int)"
    near = f"coalesce(abs({digits('h1')} - {digits('h2')}) between 1 and 2, false)"
    shorter, longer = "case when length(s1) > length(s2) then s2 else s1 end", "case when length(s1) > length(s2) then s1 else s2 end"
    sim = lambda a, b: f"(1 - levenshtein({a}, {b}) / nullif(cast(greatest(length({a}), length({b})) as double), 0))"
    contained = f"(length({shorter}) < length({longer}) * 0.7 and {d.find(f'({longer})', f'({shorter})')} > 0)"
    district = lambda p: f"split_part({p}, ' ', 1)"
    graded = (
        f"select *, case when h1 = '' or h2 = '' then 0.0 when h1 = h2 then 1.0 when replace(h1, ' ', '') = h2 or replace(h1, ',', '') = h2 then 0.95 else 0.0 end as house_conf, "
        f"(h1 <> '' and h2 <> '' and h1 <> h2 and {near}) as house_review, "
        f"case when s1 = '' or s2 = '' then 0.0 when s1 = s2 then 1.0 when {sim('s1', 's2')} >= 0.9 then {sim('s1', 's2')} when {contained} then 0.9 else {sim('s1', 's2')} end as street_conf, "
        f"(s1 <> '' and s2 <> '' and (s1 = s2 or {sim('s1', 's2')} >= 0.9 or {contained})) as street_ok, "
        f"case when p1 = '' or p2 = '' then 0.8 when p1 = p2 then 1.0 when {district('p1')} = {district('p2')} then 0.9 else {sim('p1', 'p2')} end as post_conf, "
        f"(p1 = '' or p2 = '' or {district('p1')} = {district('p2')}) as post_ok from ({pair}) t"
    )
    return f"select *, house_conf * 0.5 + street_conf * 0.4 + post_conf * 0.1 as overall from ({graded}) u"


def decided(d: Dialect) -> str:
    return (
        "select *, case when not (ok1 and ok2) then 0.0 when house_conf = 0 then 0.0 when not street_ok then street_conf else overall end as confidence, "
        "coalesce(ok1 and ok2 and house_conf > 0 and street_ok and overall >= 0.95, false) as accept, "
        "case when not (ok1 and ok2) then true when house_conf = 0 then house_review when not street_ok then street_conf >= 0.7 else overall >= 0.7 and overall < 0.95 end as review "
        f"from ({ladders(d)}) v"
    )


portable("p_house_ladder", lambda d: f"select doc_id, address_id, h1, h2, house_conf, house_review from ({ladders(d)}) z")
portable("p_street_ladder", lambda d: f"select doc_id, address_id, s1, s2, street_conf, street_ok from ({ladders(d)}) z")
portable("p_postcode_ladder", lambda d: f"select doc_id, address_id, p1, p2, post_conf, post_ok from ({ladders(d)}) z")
portable("p_pair_decision", lambda d: f"select doc_id, address_id, round(confidence, 6) as confidence, accept, review from ({decided(d)}) z")
scalar(
    "p_quality_grade", "docs", "doc_id",
    {"grade": lambda d: f"case when length(trim({RAW})) <= 3 or upper(trim({RAW})) = 'N A' then 'POOR' else case when "
     f"(case when length({RAW}) >= 15 then 2 when length({RAW}) >= 8 then 1 else 0 end) + (case when {T.postcode(d, RAW)} <> '' then 2 else 0 end) + "
     f"(case when easting is not null and northing is not null then 2 else 0 end) + (case when {d.like(RAW, '[0-9]')} then 1 else 0 end) >= 6 then 'GOOD' when "
     f"(case when length({RAW}) >= 15 then 2 when length({RAW}) >= 8 then 1 else 0 end) + (case when {T.postcode(d, RAW)} <> '' then 2 else 0 end) + "
     f"(case when easting is not null and northing is not null then 2 else 0 end) + (case when {d.like(RAW, '[0-9]')} then 1 else 0 end) >= 3 then 'FAIR' else 'POOR' end end"},
)
scalar("p_business_name", "docs", "doc_id", {"business": lambda d: f"case when {d.like(f'upper({RAW})', '|'.join(T.C.BUSINESS_WORDS))} then trim(split_part({RAW}, ',', 1)) else '' end"})
for _name, _a, _b in (("m_trigram", RAW, "full_address"),):
    scalar(_name, "pairs", "doc_id, address_id", {"similarity": lambda d, a=_a, b=_b: f"round({S.trigram(d, a, b)}, 6)"})
scalar(
    "m_levenshtein", "pairs", "doc_id, address_id",
    {"edits": lambda d: S.levenshtein(d, f"upper({RAW})", "full_address"), "similarity": lambda d: f"round({S.edit_similarity(d, f'upper({RAW})', 'full_address')}, 6)"},
)
scalar("m_char_share", "pairs", "doc_id, address_id", {"share": lambda d: f"round({S.char_share(d, RAW, 'full_address')}, 6)"})
scalar("m_near_char_share", "pairs", "doc_id, address_id", {"share": lambda d: f"round({S.near_char_share(d, RAW, 'road')}, 6)"})


def _tokens(d: Dialect) -> tuple[str, str]:
    return T.tokens(d, T.canonical(d, RAW)), T.tokens(d, T.canonical(d, "full_address"))


def _over_tokens(d: Dialect, columns: dict[str, str]) -> str:
    a, b = _tokens(d)
    return "select doc_id, address_id, " + ", ".join(f"round({x}, 6) as {c}" for c, x in columns.items()) + f" from (select doc_id, address_id, {a} as ta, {b} as tb from pairs) s"


portable("m_overlap", lambda d: _over_tokens(d, {"smaller": S.overlap_smaller(d, "ta", "tb"), "directed": S.overlap_directed(d, "ta", "tb"), "jaccard": S.token_jaccard(d, "ta", "tb")}))
portable("m_bow_cosine", lambda d: _over_tokens(d, {"cosine": S.bag_cosine(d, "ta", "tb")}))
portable(
    "m_number_overlap",
    lambda d: f"select doc_id, address_id, {S.common_element(d, 'a', 'b')} as same_number, {S.common_suffix(d, 'a', 'b')} as same_suffix, {S.close_numbers(d, 'a', 'b')} as close "
    f"from (select doc_id, address_id, {T.class_numbers(d, T.canonical(d, RAW))} as a, {T.class_numbers(d, T.canonical(d, 'full_address'))} as b from pairs) s",
)
scalar(
    "m_distance", "pairs", "doc_id, address_id",
    {"metres": lambda d: f"round({S.distance(d, 'easting', 'northing', 'gaz_easting', 'gaz_northing')}, 3)", "legacy": lambda d: f"round({S.legacy_distance(d, 'easting', 'northing', 'gaz_easting', 'gaz_northing')}, 3)"},
)
scalar(
    "m_spatial_boost", "pairs", "doc_id, address_id",
    {"linear": lambda d: f"round({S.linear_boost(d, S.distance(d, 'easting', 'northing', 'gaz_easting', 'gaz_northing'))}, 9)",
     "decay_300": lambda d: f"round({S.decay(d, S.distance(d, 'easting', 'northing', 'gaz_easting', 'gaz_northing'), 300)}, 9)",
     "decay_50": lambda d: f"round({S.decay(d, S.distance(d, 'easting', 'northing', 'gaz_easting', 'gaz_northing'), 50)}, 9)"},
)
scalar(
    "p_distance_bucket", "pairs", "doc_id, address_id",
    {"bucket": lambda d: "case when easting is null then 'unknown' when {0} <= 100 then '0-100m' when {0} <= 250 then '100-250m' when {0} <= 500 then '250-500m' when {0} <= 1000 then '500-1000m' when {0} <= 2000 then '1000-2000m' else '2000m+' end".format(S.distance(d, "easting", "northing", "gaz_easting", "gaz_northing"))},
)
scalar("p_descriptor_mismatch", "pairs", "doc_id, address_id", {"mismatch": lambda d: f"({T.any_of(d, f'upper({RAW})', T.C.DESCRIPTOR_FLAGS)} and not {T.any_of(d, 'upper(full_address)', T.C.DESCRIPTOR_FLAGS)})"})
scalar("f_phonetic_b", "part", "p_partkey", {"code": lambda d: T.phonetic_b(d, "split_part(p_name, ' ', 2)")})
portable(
    "m_vector_cosine",
    lambda d: f"select a.vec_id, round({S.vector_cosine(d, 'a.embedding', 'b.embedding')}, 6) as cosine, round(({S.vector_cosine(d, 'a.embedding', 'b.embedding')} + 1) / 2, 6) as rescaled "
    "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
