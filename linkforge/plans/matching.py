"""Candidate joins, strategies and decisions as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.config import StagedTiers, Tiers, Weights
from linkforge.functions import similarity as S
from linkforge.functions import text as T
from linkforge.functions.dialect import DUCK, SPARK, Dialect
from linkforge.operators import joins

from . import firsts
from .demo import World
from .registry import ORACLES, QUERIES, complete, portable, register, spark_sql
from .scalars import decided

W, R, G1 = Weights(), Tiers(), StagedTiers()


def trigram_sql(t: float, k: int, left: str, left_key: str, left_text: str, right: str, right_key: str, right_text: str) -> str:
    """The trigram join by counting shared grams, for the other engine."""
    tri = lambda c: S.trigrams(DUCK, c)
    return (
        f"select {left_key}, {right_key}, similarity from (select *, row_number() over (partition by {left_key} order by similarity desc, {right_key}) as rn from ("
        f"select a.{left_key}, b.{right_key}, count(*) / cast(max(a.n) + max(b.n) - count(*) as double) as similarity "
        f"from (select {left_key}, len({tri(left_text)}) as n, unnest({tri(left_text)}) as gram from {left}) a "
        f"join (select {right_key}, len({tri(right_text)}) as n, unnest({tri(right_text)}) as gram from {right}) b on a.gram = b.gram "
        f"group by a.{left_key}, b.{right_key} having similarity >= {t})) where rn <= {k}"
    )


def with_candidates(
    name: str, t: float, k: int, sql: Callable[[Dialect], str], of: str = "can", candidates: Callable[[World], DataFrame] | None = None, whole: Callable[[World], DataFrame] | None = None
) -> None:
    """A query over cand(doc_id, address_id, similarity), the trigram candidates of each document, or candidates() in Spark; or whole() in Spark."""

    def run(w: World) -> DataFrame:
        if whole:
            return whole(w)
        cand = candidates(w) if candidates else w.candidates(t, k)
        return spark_sql(w, sql(SPARK), cand=cand)

    cand = trigram_sql(t, k, "docs", "doc_id", "can", "gaz", "address_id", "can")
    body = sql(DUCK)
    head = f"with cand as ({cand})"
    register(name, run, f"{head}, {body[5:]}" if body[:5] == "with " else f"{head} {body}")


def compared(w: World, pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, address_id) with the trigram similarity of their texts, whatever it is."""
    return spark_sql(w, f"select p.doc_id, p.address_id, {S.trigram(SPARK, 'd.can', 'g.can')} as similarity from pairs_of p join docs d on d.doc_id = p.doc_id join gaz g on g.address_id = p.address_id", pairs_of=pairs)


def postcode_scores(w: World, tag: str, sql: str, score: Callable | None = None) -> DataFrame:
    """sql over pairs_of(doc_id, address_id, similarity, same), every address of the document's postcode; same: tag is the address's house."""
    return spark_sql(w, sql, pairs_of=joins.trigrams_within(w.docs, w.gaz, "doc_id", "can", "address_id", "can", "pc", tag, "house", score))


def like_roads(w: World) -> DataFrame:
    """(way_a, way_b, similarity): roads of documents and of addresses that are alike, whatever the town."""
    roads = lambda rows, c: rows.filter("way <> ''").select(F.col("way").alias(c)).distinct()
    return w.stage("like_roads", lambda: joins.trigram_join(roads(w.doc_parts, "way_a"), roads(w.gaz_parts, "way_b"), "way_a", "way_a", "way_b", "way_b", 0.6))


def within_radius(w: World) -> DataFrame:
    """Every address at most 100 m from the document's place."""
    return compared(w, joins.radius_join(w.docs, w.gaz, "doc_id", "address_id", 100.0).select("doc_id", "address_id"))


# -- equi joins ---------------------------------------------------------------------
portable("j1_uprn_equi", lambda d: f"select d.doc_id, g.address_id, g.uprn from docs d join gaz g on g.uprn = d.legacy")
portable("j2_canonical_equi", lambda d: f"select d.doc_id, g.address_id from docs d join gaz g on g.can = d.can")


def expanded(d: Dialect) -> str:
    """Ranges ``9-13`` as one row a property, at most 50 of them."""
    low, high = f"try_cast({d.ext('house', r'^(\d+)\s*-\s*\d+')} as int)", f"try_cast({d.ext('house', r'^\d+\s*-\s*(\d+)')} as int)"
    ok = f"coalesce({low} >= 1 and {high} <= 9999 and {high} > {low} and {high} - {low} <= 50, false)"
    explode = "explode" if d is SPARK else "unnest"
    return (
        f"select address_id, number, concat(cast(number as string), ' ', road, ', ', town, ', ', postcode) as unit_address from "
        f"(select *, {explode}({d.range(low, high)}) as number from gaz where {ok}) r"
    )


portable("x10_range_expand", expanded)
portable("x11_expansion_stats", lambda d: f"select address_id, count(*) as units, min(number) as low, max(number) as high from ({expanded(d)}) e group by address_id")
portable(
    "j3_expanded_equi",
    lambda d: f"select d.doc_id, g.address_id, g.uprn, e.number from docs d join (select address_id, number, {T.canonical(d, 'unit_address')} as can from ({expanded(d)}) x) e on e.can = d.can join gaz g on g.address_id = e.address_id",
)
portable(
    "j4_postcode_house",
    lambda d: f"select d.doc_id, g.address_id from (select *, {d.ext('can', r'^(\d+[A-Z]?)\b')} as num from docs x) d join gaz g on g.pc = d.pc and g.house = d.num where d.pc <> '' and d.num <> ''",
)


portable(
    "j5_any_components",
    lambda d: f"select doc_id, address_id from (select a.doc_id, b.address_id, row_number() over (partition by a.doc_id order by b.address_id) as rn from doc_parts a "
    f"join gaz_parts b on a.way = b.way and (a.num = '' or a.num = b.num) and (a.city = '' or a.city = b.city) and (a.pc = '' or a.pc = b.pc) where a.way <> '') s where rn <= 50",
    firsts.WHICHEVER,
)
portable(
    "j6_road_city",
    lambda d: f"select a.doc_id, b.address_id from doc_parts a join gaz_parts b on a.way = b.way and a.city = b.city and (a.num = '' or a.num = b.num) where a.way <> '' and a.city <> ''",
)
# -- similarity joins -----------------------------------------------------------------
with_candidates("j8_trigram_topk", 0.6, 3, lambda d: "select doc_id, address_id, round(similarity, 6) as similarity from cand")
register(
    "j7_fuzzy_road", lambda w: spark_sql(w, firsts.FUZZY_ROAD, like_roads=like_roads(w)),
    (lambda d: "select doc_id, address_id, round(similarity, 6) as similarity from (select a.doc_id, b.address_id, s.similarity, row_number() over (partition by a.doc_id order by s.similarity desc, b.address_id) as rn from doc_parts a join ("
    f"select r.city, r.way as way_a, g.way as way_b, {S.trigram(d, 'r.way', 'g.way')} as similarity from (select distinct city, way from doc_parts where way <> '' and city <> '') r "
    "join (select distinct city, way from gaz_parts where way <> '' and city <> '') g on g.city = r.city) s on s.city = a.city and s.way_a = a.way "
    "join gaz_parts b on b.city = s.city and b.way = s.way_b where s.similarity >= 0.7 and (a.num = '' or s.similarity >= 0.8 or a.num = b.num)) t where rn <= 20")(DUCK),
)
with_candidates(
    "j9_trigram_lev", 0.5, 20,
    lambda d: "select doc_id, address_id, edits from (select *, row_number() over (partition by doc_id order by similarity desc, edits, address_id) as rn from "
    "(select c.*, levenshtein(upper(d.raw_address), g.full_address) as edits from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id) s where edits <= 25) t where rn <= 5",
)
with_candidates(
    "j21_street_blend", 0.6, 10,
    lambda d: f"select doc_id, address_id, round(0.6 * similarity + 0.4 * {S.overlap_smaller(d, 'ta', 'tb')}, 6) as score from (select c.*, {T.street_tokens(d, 'd.can')} as ta, {T.street_tokens(d, 'g.can')} as tb "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id) s",
)
with_candidates("j22_land_reference", 0.5, 30, lambda d: f"select c.doc_id, c.address_id, round(0.8 * c.similarity, 6) as score from cand c join docs d on d.doc_id = c.doc_id where {d.like('upper(d.raw_address)', '^LAND (AT|ADJ|REAR)')}")


def fanout(w: World) -> DataFrame:
    """Distinct addresses are matched once, then handed to all their documents."""
    docs = spark_sql(w, "select doc_id, lower(raw_address) as text from docs where length(raw_address) > 10")
    gaz = spark_sql(w, "select address_id, lower(full_address) as text from gaz")
    texts = docs.select("text").distinct()
    best = joins.trigram_join(texts.withColumn("probe", F.col("text")), gaz, "probe", "text", "address_id", "text", 0.6, 1)
    return docs.join(best, docs["text"] == best["probe"]).select("doc_id", "address_id", F.round("similarity", 6).alias("similarity"))


register(
    "j10_distinct_fanout", fanout,
    "select d.doc_id, c.address_id, round(c.similarity, 6) as similarity from docs d join ("
    + trigram_sql(0.5, 1, "(select distinct lower(raw_address) as probe from docs where length(raw_address) > 10)", "probe", "probe", "(select address_id, lower(full_address) as text from gaz)", "address_id", "text")
    + ") c on c.probe = lower(d.raw_address) where c.similarity >= 0.6",
)
_LINES = lambda d: (
    f"select address_id, road, upper(full_address) as line from gaz union all select e.address_id, g.road, e.unit_address as line from ({expanded(d)}) e join gaz g on g.address_id = e.address_id"
)


def double_like(w: World) -> DataFrame:
    """Addresses are looked for once for each road and house of documents; only ids with several of those need a distinct of the pairs."""
    lines = spark_sql(w, _LINES(SPARK))
    asked = spark_sql(w, "select distinct doc_id, way, num from doc_parts where num <> '' and way <> ''")
    hits = (
        asked.select("way", "num").distinct().join(lines, F.col("road") == F.col("way")).filter(F.expr(f"{SPARK.find('line', 'num')} > 0"))
        .groupBy("way", "num").agg(F.collect_set("address_id").alias("ids"))
    )
    found = asked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).join(w.stage("double_like", lambda: hits), ["way", "num"])
    pairs = lambda rows: rows.select("doc_id", F.explode("ids").alias("address_id"))
    return pairs(found.filter("_n = 1")).union(pairs(found.filter("_n > 1")).distinct())


register(
    "j12_double_like", double_like,
    (lambda d: f"select distinct a.doc_id, u.address_id from doc_parts a join ({_LINES(d)}) u "
    f"on u.road = a.way where a.num <> '' and a.way <> '' and {d.find('u.line', 'a.num')} > 0")(DUCK),
)
with_candidates(
    "j14_postcode", 0.5, 50,
    lambda d: "select c.doc_id, c.address_id, round(0.6 * c.similarity + 0.4 * case when g.num = d.num and d.num <> '' then 1.0 else 0.5 end, 6) as score "
    f"from cand c join (select *, {d.ext('can', r'^(\d+[A-Z]?)\b')} as num from docs x) d on d.doc_id = c.doc_id join (select *, house as num from gaz y) g on g.address_id = c.address_id and g.pc = d.pc where d.pc <> ''",
    whole=lambda w: postcode_scores(
        w, f"nullif({SPARK.ext('can', r'^(\d+[A-Z]?)\b')}, '')", "select doc_id, address_id, round(0.6 * similarity + 0.4 * case when same then 1.0 else 0.5 end, 6) as score from pairs_of p",
    ),
)


def radius(w: World) -> DataFrame:
    return joins.radius_join(w.docs, w.gaz, "doc_id", "address_id", 100.0, 10).select("doc_id", "address_id", F.round("metres", 3).alias("metres"), "rank")


register(
    "j16_grid_radius", radius,
    "select doc_id, address_id, round(metres, 3) as metres, rank from (select *, row_number() over (partition by doc_id order by metres, address_id) as rank from "
    "(select d.doc_id, g.address_id, sqrt((d.easting - g.easting) ** 2 + (d.northing - g.northing) ** 2) as metres from docs d join gaz g on abs(d.easting - g.easting) <= 100 and abs(d.northing - g.northing) <= 100) where metres <= 100) where rank <= 10",
)


def knn(w: World) -> DataFrame:
    base = w.table("embeddings")
    return joins.nearest_vectors(base.filter("vec_id % 100 = 0"), base, k=10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


QUERIES["j17_knn_cosine"] = lambda spark, sf_dir: knn(World(spark, sf_dir))
ORACLES["j17_knn_cosine"] = (
    "select query_id, id, round(cosine, 6) as cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, id) as rank from "
    "(select q.vec_id as query_id, b.vec_id as id, list_cosine_similarity(q.embedding::double[], b.embedding::double[]) as cosine from embeddings q join embeddings b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0)) where rank <= 10"
)
portable(
    "j15_hierarchical",
    lambda d: "select doc_id, address_id, level, confidence from (select *, min(level) over (partition by doc_id) as first, row_number() over (partition by doc_id, level order by address_id) as rn from ("
    f"select d.doc_id, g.address_id, 1 as level, 0.95 as confidence from docs d join gaz g on g.can = d.can "
    f"union all select d.doc_id, g.address_id, 2, 0.90 from docs d join gaz g on g.pc = d.pc and starts_with_num(d.can, g.house) "
    f"union all select a.doc_id, b.address_id, 3, 0.80 from doc_parts a join gaz_parts b on a.way = b.way and a.city = b.city and a.way <> '' and a.city <> '' "
    f"union all select a.doc_id, b.address_id, 4, 0.70 from doc_parts a join gaz_parts b on a.way = b.way and a.way <> '') u) v where level = first and rn <= 5".replace(
        "starts_with_num(d.can, g.house)", "left(d.can, length(g.house) + 1) = concat(g.house, ' ')"
    ),
    firsts.HIERARCHICAL,
)
portable("j25_left_chain", lambda d: f"select d.doc_id, g.address_id, g.easting - d.easting as de from docs d left join gaz g on g.uprn = d.legacy")
portable("j26_anti", lambda d: f"select d.doc_id from docs d where d.legacy is not null and not exists (select 1 from gaz g where g.uprn = d.legacy)")
portable("j27_semi", lambda d: f"select d.doc_id from docs d where exists (select 1 from gaz g where g.pc = d.pc)")
portable("j30_right", "select p.status, count(d.doc_id) as n from docs d right join (select distinct status, address_id from gaz) p on p.address_id = d.target_id group by p.status")
portable(
    "j31_star",
    "select r.r_name, n.n_name, count(*) as n_lines, round(sum(l.l_extendedprice), 2) as total from lineitem l join supplier s on s.s_suppkey = l.l_suppkey join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey group by r.r_name, n.n_name",
)
portable("j33_enrich", "select d.doc_id, coalesce(d.easting, g.easting) as easting, coalesce(d.northing, g.northing) as northing from docs d left join gaz g on g.address_id = d.target_id")


def merged(w: World, policy: str) -> DataFrame:
    base = w.docs.select("doc_id", F.lit("old").alias("method"))
    new = w.docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("method")).unionByName(w.docs.filter("doc_id % 5 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("method")))
    return joins.merge(base, new, ["doc_id"], policy)


for _policy, _hit in (("overwrite", "'new'"), ("keep", "'old'")):
    register(
        f"j34_merge_{_policy}", lambda w, p=_policy: merged(w, p),
        f"select doc_id, case when doc_id % 3 = 0 then {_hit} else 'old' end as method from docs union all select doc_id + 1000000, 'new' from docs where doc_id % 5 = 0",
    )

# -- features, scores, decisions --------------------------------------------------------
def features(d: Dialect) -> str:
    """The feature columns of each candidate."""
    one = (
        f"select c.doc_id, c.address_id, c.similarity as trigram, d.raw_address, g.full_address, g.status, d.can as ca, g.can as cb, d.legacy, g.uprn, "
        f"{S.distance(d, 'd.easting', 'd.northing', 'g.easting', 'g.northing')} as metres from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id"
    )
    two = (
        f"select *, {T.house_numbers(d, 'ca')} as na, {T.house_numbers(d, 'cb')} as nb, {T.localities(d, 'ca')} as la, {T.localities(d, 'cb')} as lb, {T.street_tokens(d, 'ca')} as sa, {T.street_tokens(d, 'cb')} as sb from ({one}) f1"
    )
    phonetic = d.any("sa", "t", d.any("sb", "u", f"{T.phonetic_b(d, 't')} = {T.phonetic_b(d, 'u')}"))
    return (
        f"select doc_id, address_id, uprn, trigram, {S.edit_similarity(d, 'ca', 'cb')} as levenshtein, {S.bag_cosine(d, T.tokens(d, 'ca'), T.tokens(d, 'cb'))} as cosine_bow, "
        f"{S.common_element(d, 'na', 'nb')} as same_number, {S.common_suffix(d, 'na', 'nb')} as same_alpha, {S.overlap_smaller(d, 'la', 'lb')} as locality, {S.overlap_smaller(d, 'sa', 'sb')} as street, "
        f"({T.any_of(d, 'upper(raw_address)', T.C.DESCRIPTOR_FLAGS)} and not {T.any_of(d, 'full_address', T.C.DESCRIPTOR_FLAGS)}) as descriptor, {phonetic} as phonetic, "
        f"metres, case when metres is null then 0.0 else {S.linear_boost(d, 'metres')} end as boost, coalesce(legacy = uprn, false) as legacy_valid, status from ({two}) f2"
    )


def scored(d: Dialect) -> str:
    flag = lambda c, w: f"case when {c} then {w} else 0.0 end"
    total = (
        f"{W.trigram} * trigram + {W.embedding} * cosine_bow + {W.locality} * locality + {W.street} * street + {flag('same_number', W.house)} + {flag('same_alpha', W.alpha)} + {W.live} "
        f"+ {flag('legacy_valid', W.legacy)} + boost + {flag('descriptor', W.descriptor)} + {flag('not phonetic', W.no_phonetic)}"
    )
    return f"select *, round(greatest(0.0, least(1.0, {total})), 6) as score from ({features(d)}) f3"


def margins(source: str) -> str:
    """Rank and margin to the runner-up of each document's candidates; 1 for a single one."""
    return (
        f"select *, row_number() over (partition by doc_id order by score desc, address_id) as rank, coalesce(round(score - lead(score) over (partition by doc_id order by score desc, address_id), 6), 1.0) as margin from ({source}) m1"
    )


def feature_decision(source: str) -> str:
    return (
        f"select doc_id, address_id, score, margin, case when score < {R.least} then 'reject' when score >= {R.high} and margin >= {R.margin} then 'auto_accept' "
        f"when score >= {R.medium} and margin >= {R.medium_margin} and same_number and locality >= {R.locality} then 'auto_accept' when score >= {R.review} then 'review' else 'reject' end as decision from ({margins(source)}) m2 where rank = 1"
    )


with_candidates(
    "d_feature_struct", 0.6, 5,
    lambda d: f"select doc_id, address_id, round(trigram, 6) as trigram, round(levenshtein, 6) as levenshtein, round(cosine_bow, 6) as cosine_bow, same_number, same_alpha, round(locality, 6) as locality, round(street, 6) as street, descriptor, phonetic, round(boost, 6) as boost, legacy_valid from ({features(d)}) f",
)
with_candidates("d2_score", 0.6, 5, lambda d: f"select doc_id, address_id, score from ({scored(d)}) s")
with_candidates("d3_margin_decision", 0.6, 5, lambda d: feature_decision(scored(d)))
TIERS = "select d.doc_id, g.address_id from docs d join gaz g on g.uprn = d.legacy union select d.doc_id, g.address_id from docs d join gaz g on g.can = d.can and d.can <> ''"


def engine_candidates(w: World) -> DataFrame:
    """Legacy number, exact text and trigram candidates, each address once."""
    return compared(w, spark_sql(w, f"select doc_id, address_id from cand union {TIERS}", cand=w.candidates(0.5, 50)))


register(
    "a9_feature_engine", lambda w: spark_sql(w, feature_decision(scored(SPARK)), cand=engine_candidates(w)),
    f"with ids as (select doc_id, address_id from ({trigram_sql(0.5, 50, 'docs', 'doc_id', 'can', 'gaz', 'address_id', 'can')}) c union {TIERS}), "
    f"cand as (select i.doc_id, i.address_id, {S.trigram(DUCK, 'd.can', 'g.can')} as similarity from ids i join docs d on d.doc_id = i.doc_id join gaz g on g.address_id = i.address_id) " + feature_decision(scored(DUCK)),
)
with_candidates(
    "d4_explanation", 0.6, 5,
    lambda d: f"select doc_id, address_id, round({W.trigram} * trigram, 6) as by_trigram, round({W.embedding} * cosine_bow, 6) as by_vector, case when same_number then {W.house} else 0.0 end as by_number, round(boost, 6) as by_place from ({scored(d)}) s",
)


def staged(d: Dialect) -> str:
    total = (
        "0.50 * trigram + 0.40 * levenshtein + 0.05 * locality + 0.05 * street + case when same_number then 0.08 else 0.0 end + case when same_alpha then 0.02 else 0.0 end + case when phonetic then 0.03 else 0.0 end "
        "+ boost * 0.05 + case when status = '1' then 0.02 else 0.0 end - case when not phonetic and trigram < 0.85 then 0.03 else 0.0 end"
    )
    return f"select *, round(greatest(0.0, least(1.0, {total})), 6) as score from ({features(d)}) f3 where trigram >= 0.85 or phonetic"


def staged_decision(source: str) -> str:
    return (
        f"select doc_id, address_id, score, margin, case when score >= {G1.high} and margin >= {G1.margin} then 'auto_accepted' when score >= {G1.medium} and same_number and locality >= 0.5 and margin >= {G1.margin} then 'auto_accepted' "
        f"when score >= {G1.low} then 'needs_review' else 'rejected' end as decision from ({margins(source)}) m2 where rank = 1"
    )


with_candidates("d5_d6_staged_decision", 0.6, 20, lambda d: staged_decision(staged(d)))
with_candidates("a2_fuzzy", 0.6, 50, lambda d: staged_decision(staged(d)))
with_candidates(
    "d12_hybrid", 0.6, 20,
    lambda d: "select doc_id, address_id, score, case when score >= 0.95 then 'very_high' when score >= 0.85 then 'high' when score >= 0.75 then 'medium' when score >= 0.6 then 'low' else 'very_low' end as confidence from ("
    f"select *, round(least(1.0, trigram + case when same_number then 0.15 else 0.0 end + case when locality > 0 then 0.10 else 0.0 end + 0.10 * street + boost), 6) as score from ({features(d)}) f) s",
)
with_candidates(
    "d7_spatial_score", 0.6, 20,
    lambda d: f"select doc_id, address_id, round(least(1.0, 0.6 * {S.decay(d, 'metres', 50)} + 0.4 * trigram + case when trigram >= 0.8 then 0.10 when trigram >= 0.6 then 0.05 else 0.0 end + case when metres <= 25 then 0.15 when metres <= 50 then 0.10 else 0.0 end + case when same_number then 0.15 else 0.0 end + 0.10 * street), 6) as score from ({features(d)}) f where metres is not null and metres <= 100",
    candidates=within_radius,
)
with_candidates(
    "dd8_logistic", 0.6, 5,
    lambda d: f"select doc_id, address_id, round(1 / (1 + exp(-(-2.5 + 3.0 * trigram + 2.0 * cosine_bow + 0.8 * locality + 0.8 * street + case when same_number then 1.2 else 0.0 end + boost * 5))), 6) as p from ({features(d)}) f",
)

# -- strategies -----------------------------------------------------------------------
def deterministic(d: Dialect) -> str:
    stages = (
        f"select d.doc_id, g.address_id, 0 as priority, 'valid_uprn' as method from docs d join gaz g on g.uprn = d.legacy "
        f"union all select d.doc_id, g.address_id, 1, 'addr_exact' from docs d join gaz g on g.can = d.can"
    )
    first = f"select *, min(priority) over (partition by doc_id) as first from ({stages}) u"
    return f"select doc_id, address_id, method, case when n = 1 then 'auto_accepted' else 'needs_review' end as decision, 0.99 as score from (select *, count(*) over (partition by doc_id) as n from ({first}) v where priority = first) x"


portable("a1_deterministic", deterministic)


def tiered(d: Dialect) -> str:
    return (
        f"select d.doc_id, g.address_id, 1.00 as score, 'exact_uprn' as method from docs d join gaz g on g.uprn = d.legacy "
        f"union all select d.doc_id, g.address_id, 0.99, 'exact_text' from docs d join gaz g on g.can = d.can "
        "union all select doc_id, address_id, round(similarity, 6), case when similarity >= 0.9 then 'fuzzy_high' when similarity >= 0.8 then 'fuzzy_medium' else 'fuzzy_low' end from cand"
    )


with_candidates(
    "a10_tiered", 0.7, 50,
    lambda d: "select doc_id, address_id, score, method, case when score >= 0.9 then 'auto_accept' when score >= 0.7 then 'needs_review' else 'reject' end as decision from "
    f"(select *, row_number() over (partition by doc_id order by score desc, method, address_id) as rn from ({tiered(d)}) t) u where rn = 1",
)
with_candidates(
    "a11_optimized", 0.8, 50,
    lambda d: "select doc_id, address_id, method from (select *, row_number() over (partition by doc_id order by case method when 'exact_uprn' then 0 when 'exact_text' then 1 else 2 end, score desc, address_id) as rn "
    f"from ({tiered(d)}) t) u where rn = 1",
)
with_candidates("w7_dedupe_methods", 0.7, 50, lambda d: f"select doc_id, address_id, max(score) as score, count(distinct method) as methods from ({tiered(d)}) t group by doc_id, address_id")
portable(
    "a16_component_cascade",
    lambda d: "select doc_id, address_id, priority from (select *, min(priority) over (partition by doc_id) as first from ("
    f"select a.doc_id, b.address_id, 1 as priority from doc_parts a join gaz_parts b on a.pc = b.pc and a.num = b.num and a.pc <> '' and a.num <> '' "
    f"union all select a.doc_id, b.address_id, 2 from doc_parts a join gaz_parts b on a.way = b.way and a.city = b.city and a.num = b.num and a.way <> '' and a.city <> '' "
    f"union all select a.doc_id, b.address_id, 3 from doc_parts a join gaz_parts b on a.pc = b.pc and a.way = b.way and a.pc <> '' and a.way <> '') u) v where priority = first",
)
portable(
    "d13_component_score",
    lambda d: "select a.doc_id, b.address_id, round((case when a.pc = b.pc and a.pc <> '' then 1 else 0 end + case when a.num = b.num and a.num <> '' then 1 else 0 end + case when a.way = b.way and a.way <> '' then 1 else 0 end + case when a.city = b.city and a.city <> '' then 1 else 0 end) / "
    "nullif(cast(case when a.pc <> '' then 1 else 0 end + case when a.num <> '' then 1 else 0 end + case when a.way <> '' then 1 else 0 end + case when a.city <> '' then 1 else 0 end as double), 0), 6) as score "
    f"from doc_parts a join gaz_parts b on b.address_id = a.target_id",
)
BEST_DECISION = "select doc_id, address_id, round(confidence, 6) as confidence, review from (select *, row_number() over (partition by doc_id order by confidence desc, address_id) as rn from {0} z where accept or review) y where rn = 1"


def conservative(w: World) -> DataFrame:
    """The ladders' rows are staged first: a filter on them would be planned through every step of the parse."""
    pairs = w.stage("decided", lambda: spark_sql(w, f"select doc_id, address_id, confidence, accept, review from ({decided(SPARK)}) z"))
    return spark_sql(w, BEST_DECISION.format("decided_pairs"), decided_pairs=pairs)


register("a17_conservative", conservative, BEST_DECISION.format(f"({decided(DUCK)})"))
with_candidates(
    "a21_group_fuzzy", 0.5, 20,
    lambda d: "select app_base, address_id, case when similarity >= 0.8 then 0.85 when similarity >= 0.65 then 0.75 else 0.65 end as confidence from (select d.app_base, c.address_id, c.similarity, row_number() over (partition by d.app_base order by c.similarity desc, c.address_id) as rn "
    "from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id where levenshtein(upper(d.raw_address), g.full_address) <= 25) s where rn = 1",
)
portable(
    "a25_historic_uprns",
    lambda d: "select legacy as uprn, min(doc_id) as first_doc, count(*) as n_docs, 0.0 as easting, 0.0 as northing "
    f"from docs d where legacy is not null and not exists (select 1 from gaz g where g.uprn = d.legacy) group by legacy",
)
