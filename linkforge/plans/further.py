"""Further normalisers, filters, joins, scores, strategies and reports as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions import similarity as S
from linkforge.functions import strings
from linkforge.functions import text as T
from linkforge.functions.dialect import DUCK, SPARK, Dialect
from linkforge.operators import joins
from linkforge.sinks import results

from . import firsts
from .demo import World
from .matching import BEST_DECISION, expanded, postcode_scores, trigram_sql, with_candidates, within_radius
from .registry import ORACLES, PAIRS, QUERIES, portable, register, scalar, spark_sql
from .reports import FACT
from .scalars import decided

RAW = "raw_address"
NUMBER = r"^(\d+[A-Z]?)\b"
LAND = ("LAND ADJACENT TO", "LAND ADJ TO", "LAND AT", "LAND TO REAR OF", "LAND")

# -- normalisers and parsers -----------------------------------------------------------
scalar("n_historic", "docs", "doc_id", {"historic": lambda d: d.rep(f"lower({RAW})", r"[^\w\s]", "")})


def without_land(d: Dialect, x: str) -> str:
    """The text after taking out the first phrase that it has, once."""
    arms = " ".join(f"when {d.find(x, d.lit(p))} > 0 then trim(concat(substring({x}, 1, {d.find(x, d.lit(p))} - 1), substring({x}, {d.find(x, d.lit(p))} + {len(p)})))" for p in LAND)
    return f"case {arms} else {x} end"


scalar("n_land_stripped", "docs", "doc_id", {"stripped": lambda d: without_land(d, f"upper({RAW})")})
scalar("p_first_house", "docs", "doc_id", {"house": lambda d: f"coalesce({d.at(d.filter(d.split(f'upper({RAW})', '[ ,]+'), 'w', d.like('w', '^[0-9]+[A-Z]?$')), 1)}, '')"})
scalar(
    "p_first_part", "docs", "doc_id",
    {"house": lambda d: d.ext(f"upper(split_part({RAW}, ',', 1))", NUMBER), "street": lambda d: f"trim({d.rep(f'upper(split_part({RAW}, {chr(39)},{chr(39)}, 1))', NUMBER, '')})"},
)
register(
    "p_match_status", lambda w: spark_sql(w, f"select f.doc_id, g.uprn, f.confidence from {FACT} f left join gaz g on g.address_id = f.address_id").select("doc_id", results.match_status(F.col("uprn"), F.col("confidence")).alias("status")),
    f"select doc_id, case when address_id is null then 'UNMATCHED' when confidence < 0.7 then 'NEEDS_REVIEW' else 'MATCHED' end as status from {FACT} f",
)
register(
    "m_unit_vector",
    lambda w: w.table("embeddings").selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) as v").selectExpr("vec_id", "aggregate(v, 0d, (s, x) -> s + x * x) as q", "v").selectExpr("vec_id", "round(v[0] / sqrt(q), 6) as first", "round(aggregate(transform(v, x -> x / sqrt(q)), 0d, (s, x) -> s + x * x), 6) as norm"),
    "select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first, 1.0 as norm from embeddings",
)

# -- filters ---------------------------------------------------------------------------
_LOC = lambda d: f"select c.*, {T.localities(d, 'd.can')} as la, {T.localities(d, 'g.can')} as lb, {T.house_numbers(d, 'd.can')} as na, {T.house_numbers(d, 'g.can')} as nb from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id"
with_candidates("c1_locality_filter", 0.5, 20, lambda d: f"select doc_id, address_id from ({_LOC(d)}) s where {d.size('lb')} = 0 or {S.common_element(d, 'la', 'lb')}")
with_candidates(
    "c2_number_boost", 0.5, 20,
    lambda d: f"select doc_id, address_id, round(case when similarity < 0.95 and {S.common_element(d, 'na', 'nb')} then least(1.0, similarity + 0.05) else similarity end, 6) as score from ({_LOC(d)}) s",
)
with_candidates(
    "c5_component_validator", 0.5, 20,
    lambda d: f"select doc_id, address_id from ({_LOC(d)}) s where similarity >= 0.6 and {S.common_element(d, 'na', 'nb')} and (similarity >= 0.8 or {S.common_element(d, 'la', 'lb')})",
)
portable("c8_formatting_problems", lambda d: f"select doc_id, {d.like(RAW, r'\s{2,}')} as double_space, {d.like(RAW, r'[a-z]')} as lower_case, {d.like(RAW, r',,|,$')} as stray_comma from docs where {d.like(RAW, r'\s{2,}|[a-z]|,,|,$')}")
portable("c9_code_exclusions", lambda d: f"select doc_id from docs where not {d.like('upper(raw_address)', '^(AU|F|P|N/)[0-9]')} and {d.like('raw_address', '[0-9]')}")

# -- joins -------------------------------------------------------------------------------
UNION = lambda d: f"select address_id, can, 0 as expanded from gaz union all select address_id, {T.canonical(d, 'unit_address')} as can, 1 as expanded from ({expanded(d)}) e"
portable("r19_combined_gazetteer", lambda d: f"select address_id, can, expanded from ({UNION(d)}) u")


def best_of_union(w: World) -> DataFrame:
    union = spark_sql(w, f"select address_id * 2 + expanded as unit_id, can from ({UNION(SPARK)}) u").groupBy("can").agg(F.max("unit_id").alias("unit_id"))
    found = joins.trigram_join(w.docs.filter("can <> ''"), union, "doc_id", "can", "unit_id", "can", 0.5, 5).drop("rank")
    order = [F.desc("similarity"), F.desc(F.col("unit_id") % 2), F.col("unit_id")]
    best = joins.top_k(found, ["doc_id"], order, 1)
    return best.selectExpr("doc_id", "cast(floor(unit_id / 2) as bigint) as address_id", "unit_id % 2 as expanded", "round(similarity, 6) as similarity")


register("j11_union_best", best_of_union)
with_candidates(
    "j13_street_strategy", 0.5, 50,
    lambda d: f"select doc_id, address_id, round(score, 6) as score from (select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from (select c.doc_id, c.address_id, 0.6 * c.similarity + 0.4 * {S.overlap_smaller(d, T.street_tokens(d, 'd.can'), T.street_tokens(d, 'g.can'))} as score "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id) s) t where rn = 1",
)
portable(
    "j20_postcode_number",
    lambda d: f"select d.doc_id, g.address_id from docs d join gaz g on replace(g.postcode, ' ', '') = replace(d.pc, ' ', '') where d.pc <> '' and {d.ext('d.can', NUMBER)} <> '' and {d.has(d.split('g.full_address', '[ ,]+'), d.ext('d.can', NUMBER))}",
)
with_candidates(
    "j24_flexible_search", 0.5, 50,
    lambda d: f"select doc_id, address_id, rank from (select *, row_number() over (partition by doc_id order by case when pc_same then 0 else 1 end, case when status = '1' then 0 else 1 end, similarity desc, edits, length(full_address), address_id) as rank from "
    f"(select c.*, g.status, g.full_address, g.pc = d.pc and d.pc <> '' as pc_same, levenshtein(d.can, g.can) as edits from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id "
    f"where {d.ext('d.can', NUMBER)} = '' or {d.ext('d.can', NUMBER)} = g.house) s) t where rank <= 5",
)
portable("j28_one_row_cross", "select d.doc_id, t.label from docs d cross join (select 'decision' as kind, 'Decision notice' as label) t where d.doc_type = t.kind")
portable("j32_correlated", "select g.town, g.address_id as longest from gaz g join (select town, max(length(full_address) * 1000000 - address_id) as top from gaz group by town) t on t.town = g.town and length(g.full_address) * 1000000 - g.address_id = t.top")

# -- scores ------------------------------------------------------------------------------
D9 = (
    "select c.doc_id, c.address_id, round(least(1.0, 0.6 * c.similarity + 0.4 * (case when g.house = HOUSE then 1.0 else 0.5 end) + case when g.house = HOUSE then 0.15 else 0.0 end), 6) as score "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id"
)
SAME_POSTCODE_SQL = f"with cand as (select d.doc_id, g.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from docs d join gaz g on g.pc = d.pc where d.pc <> '') "
#: The same over pairs of one postcode, which know whether the house is the document's.
_D9_PAIRS = "select doc_id, address_id, round(least(1.0, 0.6 * similarity + 0.4 * (case when same then 1.0 else 0.5 end) + case when same then 0.15 else 0.0 end), 6) as score from pairs_of p"
_D9_HOUSE = SPARK.ext("can", NUMBER)
register("d9_postcode_score", lambda w: postcode_scores(w, _D9_HOUSE, _D9_PAIRS), SAME_POSTCODE_SQL + D9.replace("HOUSE", DUCK.ext("d.can", NUMBER)))
with_candidates("d11_rule_confidence", 0.6, 10, lambda d: "select doc_id, address_id, round(least(1.0, similarity + case when similarity >= 0.90 then 0.10 when similarity >= 0.80 then 0.05 when similarity < 0.70 then -0.10 else 0.0 end), 6) as confidence from cand")
with_candidates(
    "d8_hierarchical_adjust", 0.6, 10,
    lambda d: f"select doc_id, address_id, round(greatest(0.0, least(1.0, similarity - 0.2 + case when same then 0.15 else -0.10 end + case when pc_same then 0.10 else 0.0 end + case when street then 0.10 else 0.0 end + case when town then 0.05 else 0.0 end)), 6) as score from "
    f"(select c.*, {S.common_element(d, T.house_numbers(d, 'd.can'), T.house_numbers(d, 'g.can'))} as same, d.pc = g.pc and d.pc <> '' as pc_same, {d.find('d.can', 'g.road')} > 0 as street, {d.find('d.can', 'g.town')} > 0 as town "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id) s",
)
with_candidates("d16_method_threshold", 0.6, 5, lambda d: "select doc_id, address_id, case when similarity >= threshold then 'accept' when similarity >= 0.70 then 'review' else 'reject' end as decision from cand cross join (select 0.85 as threshold) t")
_HOUSES = lambda d: f"select c.doc_id, c.address_id, c.similarity, {d.ext('d.can', NUMBER)} as a, g.house as b, g.blpu_class, g.status from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id"
_HOUSE_SCORE = lambda d: f"case when a = '' or b = '' then 0.0 when a = b then 1.0 when abs(try_cast({d.ext('a', r'^(\d+)')} as int) - try_cast({d.ext('b', r'^(\d+)')} as int)) <= 2 then 0.5 else -1.0 end"
with_candidates("dd3_house_score", 0.6, 5, lambda d: f"select doc_id, address_id, {_HOUSE_SCORE(d)} as house_score from ({_HOUSES(d)}) s")
with_candidates(
    "dd4_tie_break", 0.6, 20,
    lambda d: f"select doc_id, address_id, tied from (select *, row_number() over (partition by doc_id order by bucket desc, house_score desc, status, similarity desc, address_id) as rn, coalesce(similarity - lead(similarity) over (partition by doc_id order by bucket desc, house_score desc, status, similarity desc, address_id) < 0.02, false) as tied from "
    f"(select *, round(similarity, 3) as bucket, {_HOUSE_SCORE(d)} as house_score from ({_HOUSES(d)}) s) t) u where rn = 1",
)
with_candidates("dd6_class_family", 0.6, 5, lambda d: "select c.doc_id, c.address_id, case left(g.blpu_class, 1) when 'R' then d.doc_type <> 'enforcement' when 'C' then d.doc_type in ('decision', 'enforcement') when 'L' then d.doc_type = 'land_charge' else true end as compatible from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id")
with_candidates("dd7_penalties", 0.6, 5, lambda d: f"select doc_id, address_id, round(greatest(0.0, similarity * case when {_HOUSE_SCORE(d)} < 0 then 0.1 else 1.0 end - case status when '1' then 0.0 when '8' then 0.01 when '6' then 0.02 else 0.03 end), 6) as score from ({_HOUSES(d)}) s")
with_candidates(
    "dd9_method_scores", 0.7, 20,
    lambda d: ("select doc_id, address_id, to_json(map_from_entries(sort_array(collect_list(struct(method, score))))) as methods" if d is SPARK else "select doc_id, address_id, '{' || string_agg('\"' || method || '\":' || score, ',' order by method) || '}' as methods")
    + " from (select doc_id, address_id, 'fuzzy' as method, cast(round(similarity * 1000) as int) as score from cand union all select d.doc_id, g.address_id, 'uprn', 1000 from docs d join gaz g on g.uprn = d.legacy) s group by doc_id, address_id",
)
scalar(
    "dd11_algorithm_choice", "docs", "doc_id",
    {"spatial": lambda d: "(easting is not null and northing is not null)", "fuzzy": lambda d: f"(length({RAW}) >= 15)", "exact": lambda d: f"(length({RAW}) between 1 and 14)"},
)


def spelling_fallback(w: World) -> DataFrame:
    """Words with the same phonetic code and a Jaro-Winkler similarity above .85."""
    word = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.upper(c), F.lit("([A-Z]{3,})"), 1)).alias("w")).distinct().selectExpr("w", f"{strings.phonetic_a('w')} as code")
    a, b = word(w.docs, "raw_address"), word(w.gaz, "full_address").withColumnRenamed("w", "term")
    j = strings.jaro("w", "term")
    same = F.when(F.substring("w", 1, 4) == F.substring("term", 1, 4), 4).when(F.substring("w", 1, 3) == F.substring("term", 1, 3), 3).when(F.substring("w", 1, 2) == F.substring("term", 1, 2), 2).when(F.substring("w", 1, 1) == F.substring("term", 1, 1), 1).otherwise(0)
    met = a.join(b, "code").filter("w <> term and code <> ''").withColumn("j", j)
    return met.withColumn("winkler", F.round(F.col("j") + 0.1 * same * (1 - F.col("j")), 6)).filter("winkler > 0.85").select("w", "term", "winkler")


register("dd13_spelling_fallback", spelling_fallback)
portable(
    "dd15_cross_validation",
    f"select verdict, count(*) as n from (select case when a.address_id is null and b.address_id is null then 'BOTH_MISSED' when b.address_id is null then 'MISSED' when a.address_id = b.address_id then 'AGREE' else 'DISAGREE' end as verdict from {FACT} a "
    "left join (select doc_id, min(address_id) as address_id from (select d.doc_id, g.address_id from docs d join gaz g on g.can = d.can) x group by doc_id) b on b.doc_id = a.doc_id) s group by verdict",
)
portable(
    "dd17_synthetic_pairs",
    "select a.address_id, a.full_address as text, replace(replace(a.full_address, ' ROAD', ' RD'), ' STREET', ' ST') as variant, 1 as label from gaz a where a.address_id % 5 = 0 "
    "union all select a.address_id, a.full_address, b.full_address, 0 from gaz a join gaz b on b.road = a.road and b.town = a.town and b.address_id = a.address_id + 264 where a.address_id % 5 = 0",
)

# -- strategies ------------------------------------------------------------------------
_BEST = "select doc_id, address_id, score, case when score >= 0.85 then 'auto_accepted' when score >= 0.7 then 'needs_review' else 'rejected' end as decision from (select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from ({0}) z) y where rn = 1"
register(
    "a4_postcode",
    lambda w: postcode_scores(w, _D9_HOUSE, _BEST.format(_D9_PAIRS), lambda similarity, same: np.minimum(1.0, 0.6 * similarity + np.where(same, 0.55, 0.2))),
    f"with cand as (select d.doc_id, g.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from docs d join gaz g on g.pc = d.pc where d.pc <> '') " + _BEST.format(D9.replace("HOUSE", DUCK.ext("d.can", NUMBER))),
)
_A5 = (
    "select c.doc_id, c.address_id, round(least(1.0, 0.6 * exp(-sqrt((d.easting - g.easting) * (d.easting - g.easting) + (d.northing - g.northing) * (d.northing - g.northing)) / 50) + 0.4 * c.similarity), 6) as score "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id"
)
register(
    "a5_spatial", lambda w: spark_sql(w, _BEST.format(_A5), cand=within_radius(w)),
    f"with cand as (select d.doc_id, g.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from docs d join gaz g on (d.easting - g.easting) ** 2 + (d.northing - g.northing) ** 2 <= 10000) " + _BEST.format(_A5),
)


def parallel_fuzzy(w: World) -> DataFrame:
    """Distinct canonical texts are matched once, from a cache, and handed to all their documents."""
    texts = w.docs.filter("can <> ''").groupBy("can").agg(F.min("doc_id").alias("text_id"))
    best = joins.trigram_join(texts, w.gaz, "text_id", "can", "address_id", "can", 0.7, 1)
    return w.docs.select("doc_id", "can").join(texts, "can").join(best, "text_id").select("doc_id", "address_id", F.round("similarity", 6).alias("similarity"))


register("a3_parallel_fuzzy", parallel_fuzzy, f"select doc_id, address_id, round(similarity, 6) as similarity from ({trigram_sql(0.7, 1, 'docs', 'doc_id', 'can', 'gaz', 'address_id', 'can')}) c")
with_candidates(
    "a20_group_layer", 0.5, 20,
    lambda d: "select doc_id, address_id, layer from (select *, row_number() over (partition by doc_id order by layer, similarity desc, address_id) as rn from (select c.doc_id, c.address_id, 2 as layer, c.similarity from cand c union all "
    "select d.doc_id, b.address_id, 1, b.similarity from docs d join (select app_base, address_id, similarity from (select d.app_base, c.address_id, c.similarity, row_number() over (partition by d.app_base order by c.similarity desc, c.address_id) as rn from cand c join docs d on d.doc_id = c.doc_id) x where rn = 1 and similarity >= 0.9) b on b.app_base = d.app_base) u) v where rn = 1",
)

# -- aggregates, windows, reports ------------------------------------------------------
with_candidates("ag12_batch_statistics", 0.6, 5, lambda d: "select decision, count(*) as n, round(avg(similarity), 6) as mean from (select *, case when similarity >= 0.9 then 'auto_accept' when similarity >= 0.7 then 'review' else 'reject' end as decision from cand) s group by decision")
portable("w3_distinct_on", "select doc_type, doc_id, raw_address from (select *, row_number() over (partition by doc_type order by length(raw_address) desc, doc_id) as rn from docs) s where rn = 1")
portable("w9_random_sample", "select doc_id from docs order by md5(concat('seed-1-', cast(doc_id as string))), doc_id limit 50")
portable("x2_unnest", lambda d: f"select doc_id, {d.size(d.split(RAW, ','))} as parts, trim(part) as part from (select *, {'explode' if d is SPARK else 'unnest'}({d.split(RAW, ',')}) as part from docs) s")
portable("x7_last_year", "select count(*) as n from orders where o_orderdate >= " + "(select max(o_orderdate) from orders) - interval '1 year'")
portable("r2_simple_fact", f"select doc_id, address_id, confidence from {FACT} f where is_matched")
portable("r4_wide_fact", f"select f.doc_id, f.doc_type, f.raw_address, f.can, f.pc, f.legacy, f.method, f.confidence, g.uprn, g.full_address, g.status, g.usrn, g.blpu_class, g.easting as gaz_easting, g.northing as gaz_northing from {FACT} f left join gaz g on g.address_id = f.address_id")
portable("r10_missing_uprns", "select d.legacy as uprn, count(*) as n, min(d.raw_address) as example from docs d left join gaz g on g.uprn = d.legacy where d.legacy is not null and g.uprn is null group by d.legacy")
portable("r12_postcode_report", f"select left(pc, 4) as outward, count(*) as n, count(case when is_matched then 1 end) as matched, round(avg(confidence), 4) as mean from {FACT} f where pc <> '' group by left(pc, 4)")
portable("r12_spatial_report", f"select case when easting is null then 'none' when easting < 450000 then 'west' when easting < 465000 then 'middle' else 'east' end as band, count(*) as n, count(case when is_matched then 1 end) as matched from {FACT} f group by 1")
portable("r12_review_report", f"select doc_type, count(*) as n, round(min(confidence), 4) as low, round(max(confidence), 4) as high from {FACT} f where confidence < 0.7 group by doc_type")
portable("r14_export_statistics", f"select doc_type, count(*) as n, count(case when confidence >= 0.95 then 1 end) as high, count(case when confidence >= 0.8 and confidence < 0.95 then 1 end) as medium, count(case when confidence < 0.8 then 1 end) as low, count(case when confidence is null then 1 end) as none from {FACT} f group by doc_type")
portable("r18_inconsistency_summary", f"select n, count(*) as n_groups, sum(docs) as n_docs from (select app_base, count(distinct address_id) as n, count(*) as docs from {FACT} f group by app_base) g where n > 1 group by n")
register("k9_geojson", lambda w: results.features(w.gaz, ["address_id", "uprn", "full_address", "status"]))
register(
    "k11_audit", lambda w: results.audit_rows(
        w.candidates(0.6, 5).select("doc_id", "address_id", F.lit("fuzzy").alias("method"), F.round("similarity", 6).alias("score")),
        joins.top_k(w.candidates(0.6, 5), ["doc_id"], [F.desc("similarity"), F.col("address_id")], 1).select("doc_id", "address_id", F.lit("fuzzy").alias("method"), F.round("similarity", 6).alias("score"), F.lit("accepted").alias("decision"), F.lit("system").alias("decided_by")),
    ).select("doc_id", "address_id", "tie_rank", "decided", "decision"),
    f"select doc_id, address_id, rn as tie_rank, rn = 1 as decided, case when rn = 1 then 'accepted' else 'not_selected' end as decision from (select *, row_number() over (partition by doc_id order by round(similarity, 6) desc, address_id) as rn from ({trigram_sql(0.6, 5, 'docs', 'doc_id', 'can', 'gaz', 'address_id', 'can')}) c) s",
)

# j14 and d7 take every address of the postcode and within the radius; so does this SQL, where theirs cuts to the best by text first.
_WHOLE = {
    "j14_postcode": (trigram_sql(0.5, 50, "docs", "doc_id", "can", "gaz", "address_id", "can"), f"select d.doc_id, g.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from docs d join gaz g on g.pc = d.pc where d.pc <> ''"),
    "d7_spatial_score": (
        trigram_sql(0.6, 20, "docs", "doc_id", "can", "gaz", "address_id", "can"),
        f"select d.doc_id, g.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from docs d join gaz g on (d.easting - g.easting) ** 2 + (d.northing - g.northing) ** 2 <= 10000",
    ),
}
for _name, (_cut, _all) in _WHOLE.items():
    QUERIES[f"{_name}_all"] = QUERIES[_name]
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(_cut, _all)


# -- strategies that find their candidates ------------------------------------------------
FOUND_PAIRS = PAIRS.replace("(select *, target_id as pair_id from docs union all select *, other_id as pair_id from docs)", "(select x.*, c.address_id as pair_id from docs x join cand c on c.doc_id = x.doc_id)")


def conservative_search(w: World) -> DataFrame:
    """The ladders over the best trigram candidates; their rows are staged before the best is taken."""
    def decide() -> DataFrame:
        found = spark_sql(w, FOUND_PAIRS, cand=w.candidates(0.5, 10))
        return spark_sql(w, f"select doc_id, address_id, confidence, accept, review from ({decided(SPARK)}) z", pairs=found)

    return spark_sql(w, BEST_DECISION.format("decided_pairs"), decided_pairs=w.stage("decided_found", decide))


register("a17_conservative_search", conservative_search, BEST_DECISION.format(f"({decided(DUCK)})"))
ORACLES["a17_conservative_search"] = ORACLES["a17_conservative_search"].replace(PAIRS, f"with cand as ({trigram_sql(0.5, 10, 'docs', 'doc_id', 'can', 'gaz', 'address_id', 'can')}) {FOUND_PAIRS}")
portable(
    "d13_component_search",
    "select doc_id, address_id, score from (select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from (select doc_id, address_id, round(least(1.0, case when pc_same and num_same then 1.0 else matched / nullif(cast(total as double), 0) "
    "+ case when pc_same then 0.2 else 0.0 end + case when num_same and way_same then 0.1 else 0.0 end end), 6) as score from (select *, "
    "case when pc_same then 1 else 0 end + case when num_same then 1 else 0 end + case when way_same then 1 else 0 end + case when city_same then 1 else 0 end as matched from (select a.doc_id, b.address_id, a.pc = b.pc and a.pc <> '' as pc_same, a.num = b.num and a.num <> '' as num_same, a.way = b.way and a.way <> '' as way_same, a.city = b.city and a.city <> '' as city_same, "
    "case when a.pc <> '' then 1 else 0 end + case when a.num <> '' then 1 else 0 end + case when a.way <> '' then 1 else 0 end + case when a.city <> '' then 1 else 0 end as total from doc_parts a join "
    "(select a.doc_id, b.address_id as found from doc_parts a join gaz_parts b on a.pc = b.pc and a.pc <> '' union select a.doc_id, b.address_id from doc_parts a join gaz_parts b on a.way = b.way and a.city = b.city and a.way <> '' and a.city <> '') f on f.doc_id = a.doc_id "
    "join gaz_parts b on b.address_id = f.found) p) q) r) s where rn = 1",
    firsts.COMPONENT_SEARCH,
)
portable("j33_enrich_matched", f"select f.doc_id, coalesce(f.easting, g.easting) as easting, coalesce(f.northing, g.northing) as northing from {FACT} f left join gaz g on g.address_id = f.address_id and f.confidence >= 0.9")
