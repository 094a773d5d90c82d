"""The engines with parsers and scorers of their own, rules, levels, vectors and layers as queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge import config as C
from linkforge.functions import embedding, strings
from linkforge.functions import similarity as S
from linkforge.functions import text as T
from linkforge.functions.dialect import DUCK, SPARK, Dialect
from linkforge.operators import joins
from linkforge.sinks import results
from linkforge.sources import files
from linkforge.sources.staging import staging_dir

from . import firsts
from .demo import World
from .further import UNION
from .matching import like_roads, trigram_sql, with_candidates
from .registry import ORACLES, portable, register, scalar, spark_sql
from .reports import FACT, MATCHED

RAW = "raw_address"


# -- embeddings ------------------------------------------------------------------------
def digest_rows(w: World) -> DataFrame:
    v = w.docs.select("doc_id", F.expr(embedding.digest_embedding(RAW)).alias("v"))
    return v.selectExpr("doc_id", "round(double(v[0]), 5) as first", "round(double(v[20]), 5) as later", "round(double(v[380]), 5) as numeric_share", "round(double(v[381]), 5) as terms", "round(double(v[382]), 5) as bytes", "round(double(v[383]), 5) as words", "size(v) as n")


_BYTE = "('0x' || substr(md5(s), (i % 16) * 2 + 1, 2))::int / 255.0 * 2 - 1"
register(
    "v1_digest_embedding", digest_rows,
    "select doc_id, " + ", ".join(f"round(case when raw_address = '' then 0.0 else v[{at + 1}] / sqrt(list_sum(list_transform(v, lambda e: e * e))) end, 5) as {name}" for at, name in ((0, "first"), (20, "later"), (380, "numeric_share"), (381, "terms"), (382, "bytes"), (383, "words")))
    + f", 384 as n from (select doc_id, raw_address, case when len(t) = 0 then list_transform(range(384), lambda i: {_BYTE}) else list_concat(list_transform(range(380), lambda i: {_BYTE}), "
    f"[len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) / len(t), ({' + '.join(f'contains(s, {w!r})::int' for w in C.EMBEDDING_TERMS)}) / 8, strlen(s) / 100.0, len(t) / 20.0]) end as v "
    "from (select *, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') as t from (select doc_id, raw_address, upper(trim(raw_address)) as s from docs) a) b) c",
)
register("v2_generated_embedding", lambda w: w.docs.select("doc_id", embedding.generated_embedding("can").alias("v")).selectExpr("doc_id", "v[0] as first", "v[383] as last", "size(v) as n"))


def vector_scores(w: World) -> DataFrame:
    """All addresses of at least .70 by generated vectors, scored with text similarity and shared words."""

    def seeds(rows: DataFrame, name: str) -> DataFrame:
        """The different texts, numbered: staged, so that the numbers stay the same."""
        texts = rows.filter("can <> ''").select("can").distinct().withColumn("id", F.monotonically_increasing_id())
        return w.stage(name, lambda: texts.withColumn("code", embedding.generated_seed("can")))

    docs, gaz = seeds(w.docs, "vector_docs"), seeds(w.gaz, "vector_gaz")
    near = w.stage("vector_pairs", lambda: joins.vectors_within(docs, gaz, embedding.generated_from, 0.70))
    sql = (
        "select x.doc_id, y.address_id, n.cosine as semantic, least(1.0, 0.7 * n.cosine + 0.3 * " + S.trigram(SPARK, "d.can", "g.can") + " + 0.10 * size(filter(split(d.can, ' '), t -> array_contains(split(g.can, ' '), t))) / double(size(split(d.can, ' ')))) as combined "
        "from near n join vector_docs d on d.id = n.query_id join vector_gaz g on g.id = n.id join docs x on x.can = d.can join gaz y on y.can = g.can"
    )
    return spark_sql(w, sql, near=near, vector_docs=docs, vector_gaz=gaz)


register("d10_vector_combined", lambda w: vector_scores(w).select("doc_id", "address_id", F.round("semantic", 6).alias("semantic"), F.round("combined", 6).alias("combined")))


def vector_engine(w: World) -> DataFrame:
    """The best is accepted from .85; else up to three of at least .70 go to review."""
    ranked = joins.top_k(vector_scores(w), ["doc_id"], [F.desc("combined"), F.col("address_id")], 3)
    best = F.first("combined").over(Window.partitionBy("doc_id").orderBy("rank"))
    made = ranked.withColumn("best", best).withColumn("decision", F.when(F.col("best") >= 0.85, "auto_accepted").when(F.col("best") >= 0.70, "needs_review").otherwise("rejected"))
    return made.filter("rank = 1 or (decision = 'needs_review' and combined >= 0.70)").select("doc_id", "address_id", "rank", F.round("combined", 6).alias("combined"), "decision")


register("a8_vector", vector_engine)


# -- tokens of both sides, parsed once ----------------------------------------------------
def doc_tokens(d: Dialect) -> str:
    """What the accurate and component engines read from a document's text."""
    up = f"upper({RAW})"
    holds = lambda p: d.filter("toks", "t", f"{d.find('t', d.lit(p))} > 0")
    # The last listed word that the text holds names the landmark.
    landmark = " ".join(f"when {d.find('up', d.lit(p))} > 0 and {d.size(holds(p))} > 0 then {d.at(holds(p), 1)}" for p in reversed(C.LANDMARK_WORDS))
    land = " ".join(f"when {d.find('up', d.lit(p))} > 0 then {d.lit(p)}" for p in C.LAND_PHRASES)
    lists = f"select *, {up} as up, {T.tokens(d, 'can')} as toks, {T.house_numbers(d, 'can')} as numbers, {T.localities(d, 'can')} as places, {T.street_tokens(d, 'can')} as streets from docs"
    return (
        f"select doc_id, {RAW}, up, can, pc, legacy, streets, coalesce({d.at('numbers', 1)}, '') as house, coalesce({d.at('places', 1)}, '') as locality, coalesce({d.at('places', 2)}, '') as town, "
        f"{d.join('streets', ' ')} as street, {d.ext('can', r'(?:^|\s)(?:FLAT|APARTMENT)\s+(\S+)')} as flat, case {landmark} else '' end as business, case {land} else '' end as land from ({lists}) l"
    )


def gaz_tokens(d: Dialect) -> str:
    return f"select address_id, full_address, can, pc, {T.house_numbers(d, 'can')} as numbers, {T.localities(d, 'can')} as places, {T.street_tokens(d, 'can')} as streets from gaz"


def tokened(name: str, sql: Callable[[Dialect], str], of: tuple[str, ...] = ()) -> None:
    """A query over doc_tokens, gaz_tokens and the named pair frames."""

    def run(w: World) -> DataFrame:
        text = sql(SPARK)
        matched = {f"matched_{n}": matched_pairs(w, n) for n in of if f"from matched_{n}" in text}
        best = {f"best_{n}": best_matched(w, n) for n in of if f"from best_{n}" in text}
        return spark_sql(w, text, **token_frames(w), **{n: PAIR_FRAMES[n][0](w) for n in of}, **matched, **best)

    extra = "".join(f", {n} as materialized ({PAIR_FRAMES[n][1]})" for n in of)
    register(name, run, f"with doc_tokens as materialized ({doc_tokens(DUCK)}), gaz_tokens as materialized ({gaz_tokens(DUCK)}){extra} {sql(DUCK)}")


def token_frames(w: World) -> dict[str, DataFrame]:
    return {"doc_tokens": w.stage("doc_tokens", lambda: spark_sql(w, doc_tokens(SPARK))), "gaz_tokens": w.stage("gaz_tokens", lambda: spark_sql(w, gaz_tokens(SPARK)))}


def searched(w: World, name: str, text: str, where: str, least: float, k: int) -> DataFrame:
    """(doc_id, address_id, similarity): the k best addresses for a text made of each document's parts."""

    def make() -> DataFrame:
        left = token_frames(w)["doc_tokens"].filter(where).select("doc_id", F.expr(text).alias("search"))
        return joins.trigram_join(left.filter("search <> ''"), w.gaz, "doc_id", "search", "address_id", "can", least, k).drop("rank")

    return w.stage(name, make)


def searched_sql(text: str, where: str, least: float, k: int) -> str:
    return trigram_sql(least, k, f"(select doc_id, {text} as search from doc_tokens where {where})", "doc_id", "search", "gaz", "address_id", "can")


STREET_TEXT = "trim(concat(house, ' ', street, ' ', locality))"
LAND_TEXT = "trim(concat(substring(up, 1, instr(up, land) - 1), substring(up, instr(up, land) + length(land))))"
TERM = "trim(concat(business, ' ', locality))"


def landmarks(w: World) -> DataFrame:
    left = token_frames(w)["doc_tokens"].filter("business <> ''").select("doc_id", F.expr(TERM).alias("term"))
    return w.stage("landmarks", lambda: joins.contains_join(left, w.gaz, "doc_id", "term", "address_id", "can", 20))


PAIR_FRAMES: dict[str, tuple[Callable[[World], DataFrame], str]] = {
    "by_street": (lambda w: searched(w, "by_street", STREET_TEXT, "street <> ''", 0.6, 50), searched_sql(STREET_TEXT, "street <> ''", 0.6, 50)),
    "by_land": (lambda w: searched(w, "by_land", LAND_TEXT, "land <> ''", 0.5, 30), searched_sql(LAND_TEXT, "land <> ''", 0.5, 30)),
    "by_text": (lambda w: searched(w, "by_text", "can", "can <> ''", 0.5, 200), searched_sql("can", "can <> ''", 0.5, 200)),
    "by_landmark": (
        landmarks,
        f"select doc_id, address_id from (select t.doc_id, g.address_id, row_number() over (partition by t.doc_id order by g.address_id) as rn from (select doc_id, {TERM} as term from doc_tokens where business <> '') t join gaz g on contains(g.can, t.term)) s where rn <= 20",
    ),
}

def _expanded(d: Dialect) -> str:
    s = "road"
    for short, full in ((" ST ", " STREET "), (" RD ", " ROAD "), (" AVE ", " AVENUE "), (" LN ", " LANE ")):
        s = f"replace({s}, {d.lit(short)}, {d.lit(full)})"
    return s


tokened("p12_accurate_parse", lambda d: "select doc_id, house, flat, street, locality, town, business, land, pc from doc_tokens")
portable("p13_component_parse", lambda d: f"select doc_id, pc, house, city, {_expanded(d)} as road from (select doc_id, pc, coalesce({d.at(T.house_numbers(d, 'can'), 1)}, '') as house, coalesce({d.at(T.localities(d, 'can'), 1)}, '') as city, {d.join(T.street_tokens(d, 'can'), ' ')} as road from docs) s")
tokened("j19_landmark", lambda d: "select doc_id, address_id, 0.85 as score from by_landmark", ("by_landmark",))


_BUSINESS = lambda d: f"case when {d.like('upper(raw_address)', '|'.join(C.BUSINESS_WORDS))} then trim(split_part(upper(raw_address), ',', 1)) else '' end"


def business_pairs(w: World) -> DataFrame:
    """Addresses like the first part of a text with a business word; one word alone is no name."""
    left = spark_sql(w, f"select doc_id, {_BUSINESS(SPARK)} as name from docs").filter("name like '% %'")
    return w.stage("business_pairs", lambda: joins.trigram_join(left, w.gaz, "doc_id", "name", "address_id", "full_address", 0.8, 5).drop("rank"))


_BUSINESS_SQL = trigram_sql(0.8, 5, f"(select * from (select doc_id, {_BUSINESS(DUCK)} as name from docs) b where name like '% %')", "doc_id", "name", "gaz", "address_id", "full_address")
register("j19_business_name", lambda w: business_pairs(w).select("doc_id", "address_id", F.round("similarity", 6).alias("similarity")), f"select doc_id, address_id, round(similarity, 6) as similarity from ({_BUSINESS_SQL}) s")


# -- the accurate engine ------------------------------------------------------------------
def component_match(d: Dialect, pairs: str) -> str:
    """component_join(), for Spark as matched_pairs() makes it."""
    return f"select * from matched_{pairs}" if d is SPARK else component_join(d, pairs)


def component_join(d: Dialect, pairs: str) -> str:
    """pairs(doc_id, address_id, similarity) with each component's score, the number that match, and the number asked for."""
    flag = lambda c: f"case when {c} then 1 else 0 end"
    one = (
        f"select p.doc_id, p.address_id, p.similarity, {flag(chr(100) + '.house <> ' + chr(39) * 2 + ' and ' + d.has('g.numbers', 'd.house'))} as house_hit, "
        f"case when d.street <> '' and {d.size('g.streets')} > 0 then {S.overlap_smaller(d, 'd.streets', 'g.streets')} else 0.0 end as street_score, "
        f"{flag(f'd.locality <> {chr(39) * 2} and ' + d.has('g.places', 'd.locality'))} as place_hit, {flag('d.pc <> ' + chr(39) * 2 + ' and d.pc = g.pc')} as post_hit, "
        + " + ".join(flag(f"d.{c} <> ''") for c in ("house", "street", "locality", "pc"))
        + f" as asked from {pairs} p join doc_tokens d on d.doc_id = p.doc_id join gaz_tokens g on g.address_id = p.address_id"
    )
    return f"select *, house_hit + case when street_score > 0.5 then 1 else 0 end + place_hit + post_hit as matched from ({one}) c1"


def _smaller_share(a: list[str], b: list[str]) -> float:
    return sum(t in a for t in b) / min(len(a), len(b)) if a and b else 0.0


#: Each component's score of a document's and an address's values.
COMPONENTS = {
    "house_hit": ("house", "numbers", lambda a, b: a != "" and a in b), "street_score": ("streets", "streets", _smaller_share),
    "place_hit": ("locality", "places", lambda a, b: a != "" and a in b), "post_hit": ("pc", "pc", lambda a, b: a != "" and a == b), "asked": ("asked", "pc", lambda a, b: a),
}


def matched_pairs(w: World, pairs: str) -> DataFrame:
    """component_join() of a pair frame: the pairs stay where they are, and both sides come to them as numbers, where those are few enough."""
    docs, gaz, found = token_frames(w)["doc_tokens"], token_frames(w)["gaz_tokens"], PAIR_FRAMES[pairs][0](w)
    text = lambda c: f"coalesce({c}, '') as {c}"
    words = lambda c: f"coalesce({c}, array()) as {c}"
    asked = " + ".join(f"case when {c} <> '' then 1 else 0 end" for c in ("house", "street", "locality", "pc"))
    left = docs.selectExpr("doc_id", text("house"), text("locality"), text("pc"), "case when street <> '' then coalesce(streets, array()) else array() end as streets", f"{asked} as asked")
    right = gaz.selectExpr("address_id", words("numbers"), words("streets"), words("places"), text("pc"))
    rows = joins.scored_pairs(found, left, right, "doc_id", "address_id", "similarity", COMPONENTS)
    if rows is None:
        return spark_sql(w, component_join(SPARK, pairs), **token_frames(w), **{pairs: found})
    whole = [f"int({c}) as {c}" for c in ("house_hit", "place_hit", "post_hit", "asked")]
    return rows.selectExpr("doc_id", "address_id", "similarity", "street_score", *whole, "int(house_hit + int(street_score > 0.5) + place_hit + post_hit) as matched")


_RATE = "coalesce(matched / nullif(cast(asked as double), 0), 0.0)"
_BOOSTED = "least(1.0, similarity + case when house_hit = 1 then 0.15 else 0.0 end + case when street_score > 0.8 then 0.10 else 0.0 end + case when place_hit = 1 then 0.10 else 0.0 end + case when post_hit = 1 then 0.20 else 0.0 end)"
_EDGE = lambda d: f"concat({d.lit(chr(92) + 'b')}, d.house, {d.lit(chr(92) + 'b')})"
POSTCODE_HOUSE = lambda d: (
    "select doc_id, address_id from (select d.doc_id, g.address_id, row_number() over (partition by d.doc_id order by g.address_id) as rn from doc_tokens d join gaz_tokens g on g.pc = d.pc "
    f"where d.pc <> '' and d.house <> '' and {'g.full_address rlike ' + _EDGE(d) if d is SPARK else f'regexp_matches(g.full_address, {_EDGE(d)})'}) s where rn <= 20"
)
tokened("d15_component_score", lambda d: f"select doc_id, address_id, matched, asked, round({_RATE}, 6) as overall, round({_BOOSTED}, 6) as score from ({component_match(d, 'by_text')}) c", ("by_text",))


#: The scores of two of the accurate engine's passes.
PASSES = {"by_street": f"0.6 * similarity + 0.4 * {_RATE}", "by_text": _BOOSTED}


def best_matched(w: World, pairs: str) -> DataFrame:
    """Of a pass's rows those that may be the best of a document, in accurate()'s order."""
    rows = matched_pairs(w, pairs).selectExpr("doc_id", "address_id", f"double({PASSES[pairs]}) as score", "matched").withColumn("_r", F.expr("round(score, 6)"))
    return joins.first_in_batches(rows, "doc_id", [("_r", True), ("matched", True), ("address_id", False)]).drop("_r")


def accurate(d: Dialect) -> str:
    """A valid legacy number decides; else the best of five searches, each address once."""
    # For Spark two passes come as best_matched() keeps them.
    score = lambda pairs: "score" if d is SPARK else PASSES[pairs]
    rows = lambda pairs: f"select * from best_{pairs}" if d is SPARK else component_match(d, pairs)
    passes = (
        f"select doc_id, address_id, 0.95 as score, 0 as matched, 'postcode_house' as method from ({POSTCODE_HOUSE(d)}) p1 "
        f"union all select doc_id, address_id, {score('by_street')}, matched, 'street_locality' from ({rows('by_street')}) p2 "
        f"union all select doc_id, address_id, {score('by_text')}, matched, 'component_fuzzy' from ({rows('by_text')}) p3 "
        "union all select doc_id, address_id, 0.85, 0, 'landmark' from by_landmark union all select doc_id, address_id, 0.8 * similarity, 0, 'land_reference' from by_land"
    )
    legacy = "select d.doc_id, g.address_id, 1.0 as score, 0 as matched, 'exact_uprn' as method from doc_tokens d join gaz g on g.uprn = d.legacy"
    every = f"select *, 0 as later from ({legacy}) u union all select *, 1 from ({passes}) v"
    # Scores are compared at six places, as both engines round sums alike there.
    best = f"select *, row_number() over (partition by doc_id order by later, round(score, 6) desc, matched desc, address_id, method) as rn from ({every}) e"
    return (
        "select doc_id, address_id, round(score, 6) as score, method, case when later = 0 or round(score, 6) >= 0.95 then 'auto_accept' when round(score, 6) >= 0.85 and matched >= 2 then 'auto_accept' when round(score, 6) >= 0.75 then 'needs_review' "
        f"when round(score, 6) >= 0.60 and matched >= 1 then 'needs_review' else 'low_confidence' end as decision from ({best}) b where rn = 1"
    )


tokened("a13_accurate", accurate, ("by_street", "by_text", "by_landmark", "by_land"))


# -- the component engines --------------------------------------------------------------
def component_scores(d: Dialect, pairs: str, strict: bool) -> str:
    """pairs(doc_id, address_id, ...) with the share of components that are equal; the strict form takes near roads and punishes another house."""
    flag = lambda c: f"case when {c} then 1 else 0 end"
    words = lambda x: T.tokens(d, x)
    way = f"(a.way <> '' and (a.way = b.way or (b.way <> '' and {S.overlap_smaller(d, words('a.way'), words('b.way'))} >= {'0.8' if strict else '0.7'})))"
    hits = (
        f"select p.*, a.num, b.num as other_num, (a.num <> '' and a.num = b.num) as num_hit, {way} as way_hit, (a.city <> '' and a.city = b.city) as city_hit, (a.pc <> '' and a.pc = b.pc) as pc_hit, "
        + " + ".join(flag(f"a.{c} <> ''") for c in ("num", "way", "city", "pc"))
        + f" as asked from {pairs} p join doc_parts a on a.doc_id = p.doc_id join gaz_parts b on b.address_id = p.address_id"
    )
    share = f"(({flag('num_hit')} + {flag('way_hit')} + {flag('city_hit')} + {flag('pc_hit')}) / nullif(cast(asked as double), 0))"
    if strict:
        other = f"({share} * case when num <> '' and other_num <> '' and not num_hit then 0.1 else 1.0 end)"
        score = f"case when pc_hit and num_hit then 1.0 when pc_hit and num = '' then least(1.0, {other} + 0.1) else {other} end"
    else:
        score = f"least(1.0, case when pc_hit and num_hit then 1.0 else {share} + {flag('pc_hit')} * 0.2 + {flag('num_hit and way_hit')} * 0.1 end)"
    return f"select *, round(coalesce({score}, 0.0), 6) as score from ({hits}) h1"


WHICHEVER = (
    "select doc_id, address_id from (select a.doc_id, b.address_id, row_number() over (partition by a.doc_id order by b.address_id) as rn from doc_parts a "
    "join gaz_parts b on a.way = b.way and (a.num = '' or a.num = b.num) and (a.city = '' or a.city = b.city) and (a.pc = '' or a.pc = b.pc) where a.way <> '') s where rn <= 50"
)
SAME_POST = "select doc_id, address_id from (select a.doc_id, b.address_id, row_number() over (partition by a.doc_id order by b.address_id) as rn from doc_parts a join gaz_parts b on a.pc = b.pc and a.num = b.num where a.pc <> '' and a.num <> '') s where rn <= {0}"
SAME_ROAD = "select doc_id, address_id from (select a.doc_id, b.address_id, row_number() over (partition by a.doc_id order by b.address_id) as rn from doc_parts a join gaz_parts b on a.way = b.way and a.city = b.city and (a.num = '' or a.num = b.num) where a.way <> '' and a.city <> '') s where rn <= {0}"
#: Roads that are alike, whatever the town, as distinct roads.
LIKE_ROAD = (
    "select doc_id, address_id from (select a.doc_id, b.address_id, row_number() over (partition by a.doc_id order by r.similarity desc, b.address_id) as rn from doc_parts a join like_roads r on r.way_a = a.way "
    "join gaz_parts b on b.way = r.way_b and (a.num = '' or a.num = b.num) where r.similarity >= {1}) s where rn <= {0}"
)


LIKE_ROADS_SQL = trigram_sql(0.6, 1 << 30, "(select distinct way as way_a from doc_parts where way <> '')", "way_a", "way_a", "(select distinct way as way_b from gaz_parts where way <> '')", "way_b", "way_b")


def cascade(passes: list[str], under: list[int]) -> str:
    """Pass n's rows for documents that the passes before gave fewer than under[n] rows."""
    every = " union all ".join(f"select doc_id, address_id, {n} as pass from ({p}) p{n}" for n, p in enumerate(passes))
    counts = f"select doc_id, " + ", ".join(f"sum(case when pass = {n} then 1 else 0 end) as c{n}" for n in range(len(passes))) + " from every_pass group by doc_id"
    taken, inner = "c0", counts
    for n in range(1, len(passes)):
        inner = f"select *, {taken} < {under[n]} as go{n} from ({inner}) k{n}"
        taken = f"{taken} + case when go{n} then c{n} else 0 end"
    go = " or ".join(["e.pass = 0"] + [f"(e.pass = {n} and k.go{n})" for n in range(1, len(passes))])
    return f"with every_pass as ({every}), open_passes as ({inner}) select doc_id, address_id, min(pass) as pass from (select e.* from every_pass e join open_passes k on k.doc_id = e.doc_id where {go}) t group by doc_id, address_id"


COMPONENT = cascade([WHICHEVER, SAME_POST.format(20), SAME_ROAD.format(50), LIKE_ROAD.format(50, 0.6)], [0, 10, 20, 30])
STRICT = cascade([SAME_POST.format(10), SAME_POST.format(10), "select doc_id, address_id from business_rows", SAME_ROAD.format(10), LIKE_ROAD.format(20, 0.8)], [0, 5, 10, 15, 20])

#: The same rows for Spark, cut a key of the gazetteer first.
_COMPONENT_QUICK = firsts.cascade([firsts.WHICHEVER, SAME_POST.format(20), firsts.same_road(50), firsts.like_road(50, 0.6)], [0, 10, 20, 30])
_STRICT_QUICK = firsts.cascade([SAME_POST.format(10), SAME_POST.format(10), "select doc_id, address_id from business_rows", firsts.same_road(10), firsts.like_road(20, 0.8)], [0, 5, 10, 15, 20])


def component_engine(d: Dialect) -> str:
    return f"select doc_id, address_id, score, case when score >= 0.9 then 'auto_accept' when score >= 0.7 then 'needs_review' else 'low_confidence' end as decision from (select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from ({component_scores(d, 'component_pairs', False)}) q) z where rn = 1"


def strict_engine(d: Dialect) -> str:
    """A legacy number decides, a new historic record if the gazetteer has none; else validated candidates only."""
    valid = "(num = '' or num_hit) and score >= 0.6 and (pc_hit or num_hit or way_hit)"
    best = f"select *, row_number() over (partition by doc_id order by score desc, address_id) as rn from ({component_scores(d, 'strict_pairs', True)}) q where {valid}"
    legacy = "select d.doc_id, min(g.address_id) as address_id, 1.0 as score, 'auto_accept' as decision, case when min(g.address_id) is null then 'historic' else 'uprn' end as method from docs d left join gaz g on g.uprn = d.legacy where d.legacy is not null group by d.doc_id"
    return (
        f"{legacy} union all select z.doc_id, z.address_id, z.score, case when pc_hit and num_hit then 'auto_accept' when z.score >= 0.95 then 'auto_accept' when z.score >= 0.8 then 'needs_review' else 'low_confidence' end, 'components' "
        f"from ({best}) z join docs d on d.doc_id = z.doc_id where rn = 1 and d.legacy is null"
    )


def component_pairs(w: World) -> DataFrame:
    return w.stage("component_pairs", lambda: spark_sql(w, _COMPONENT_QUICK, like_roads=like_roads(w)))


def strict_pairs(w: World) -> DataFrame:
    return w.stage("strict_pairs", lambda: spark_sql(w, _STRICT_QUICK, like_roads=like_roads(w), business_rows=business_pairs(w)))


_COMPONENT_SQL = f"with like_roads as materialized ({LIKE_ROADS_SQL}), component_pairs as materialized ({COMPONENT}) "
_STRICT_SQL = f"with like_roads as materialized ({LIKE_ROADS_SQL}), business_rows as ({_BUSINESS_SQL}), strict_pairs as materialized ({STRICT}) "
register("a14_component", lambda w: spark_sql(w, component_engine(SPARK), component_pairs=component_pairs(w)), _COMPONENT_SQL + component_engine(DUCK))
register("a15_component_strict", lambda w: spark_sql(w, strict_engine(SPARK), strict_pairs=strict_pairs(w)), _STRICT_SQL + strict_engine(DUCK))
register(
    "d14_strict_score", lambda w: spark_sql(w, f"select doc_id, address_id, pass, score from ({component_scores(SPARK, 'strict_pairs', True)}) q", strict_pairs=strict_pairs(w)),
    _STRICT_SQL + f"select doc_id, address_id, pass, score from ({component_scores(DUCK, 'strict_pairs', True)}) q",
)
with_candidates(
    "m20_weighted_components", 0.6, 5,
    lambda d: "select doc_id, address_id, round(coalesce(score / nullif(weight, 0.0), 0.0), 6) as score from (select c.doc_id, c.address_id, "
    "case when a.pc = '' or b.pc = '' then 0.0 when a.pc = b.pc then 0.35 when left(a.pc, 4) = left(b.pc, 4) then 0.20 when left(a.pc, 2) = left(b.pc, 2) then 0.10 else 0.0 end "
    f"+ case when a.num <> '' and a.num = b.num then 0.25 else 0.0 end + case when a.way <> '' and b.way <> '' then 0.20 * {S.char_share(d, 'a.way', 'b.way')} else 0.0 end + case when a.city <> '' and a.city = b.city then 0.15 else 0.0 end as score, "
    "case when a.pc <> '' and b.pc <> '' then 0.35 else 0.0 end + case when a.num <> '' and b.num <> '' then 0.25 else 0.0 end + case when a.way <> '' and b.way <> '' then 0.20 else 0.0 end + case when a.city <> '' and b.city <> '' then 0.15 else 0.0 end as weight "
    "from cand c join doc_parts a on a.doc_id = c.doc_id join gaz_parts b on b.address_id = c.address_id) s",
)


# -- rules ------------------------------------------------------------------------------
def ruled(d: Dialect) -> str:
    """Each rule that a text meets, with the text that it makes; the first match only, as a text ends it for most rules."""
    arms = []
    for n, (name, pattern, to, confidence) in enumerate(C.ADDRESS_RULES, 1):
        if name == "north_south_abbreviations":
            changed = "can"
            for short, full in C.COMPASS:
                changed = f"replace({changed}, {d.lit(short)}, {d.lit(full)})"
        else:
            # A letter may not follow a group's number directly in either dialect.
            changed = d.rep("can", pattern, to.replace("$1A", "$1")) if "$1A" not in to else f"concat({d.rep('can', pattern, '$1')}, 'A')"
        arms.append(f"select doc_id, {n} as rule_id, {confidence} as base, trim({changed}) as changed from docs where can <> '' and can <> 'N A' and {d.like('can', pattern)}")
    return " union all ".join(arms)


def rule_pairs(w: World) -> DataFrame:
    def make() -> DataFrame:
        rows = spark_sql(w, ruled(SPARK))
        texts = rows.filter("changed <> ''").select("changed").distinct()
        best = joins.trigram_join(texts.withColumnRenamed("changed", "probe").withColumn("text", F.col("probe")), w.gaz, "probe", "text", "address_id", "can", 0.70, 1).drop("rank")
        return rows.join(best, rows["changed"] == best["probe"]).select("doc_id", "rule_id", "base", "changed", "address_id", "similarity")

    return w.stage("rule_pairs", make)


RULE_PAIRS_SQL = (
    f"select r.*, c.address_id, c.similarity from ({ruled(DUCK)}) r join ("
    + trigram_sql(0.70, 1, f"(select distinct changed as probe from ({ruled(DUCK)}) x where changed <> '')", "probe", "probe", "gaz", "address_id", "can")
    + ") c on c.probe = r.changed"
)
RULE_FIRST = (
    "select doc_id, rule_id, address_id, confidence, case when confidence >= 0.85 then 'auto_accepted' when confidence >= 0.65 then 'needs_review' else 'rejected' end as decision from (select doc_id, rule_id, address_id, "
    "round(base + case when similarity >= 0.90 then 0.10 when similarity >= 0.80 then 0.05 when similarity < 0.70 then -0.10 else 0.0 end, 6) as confidence, row_number() over (partition by doc_id order by rule_id) as rn from rule_pairs) s where rn = 1"
)
register("j23_rule_similarity", lambda w: rule_pairs(w).select("doc_id", "rule_id", "changed", "address_id", F.round("similarity", 6).alias("similarity")), f"select doc_id, rule_id, changed, address_id, round(similarity, 6) as similarity from ({RULE_PAIRS_SQL}) s")
register("a7_rules", lambda w: spark_sql(w, RULE_FIRST, rule_pairs=rule_pairs(w)), f"with rule_pairs as ({RULE_PAIRS_SQL}) {RULE_FIRST}")


# -- levels -----------------------------------------------------------------------------
LEVELS = (("postcode_house_number", 0.90), ("street_house_locality", 0.85), ("street_locality", 0.75), ("partial_street_phonetic", 0.70), ("locality_nearby", 0.65))
#: Soundex starts at the first letter.
_SOUND = lambda x: f"soundex(regexp_extract({x}, '[A-Za-z].*', 0))"
_FOUND_PLACE = "case " + " ".join(f"when instr(d.can, '{p}') > 0 then '{p}'" for p in C.HIERARCHY_LOCALITIES) + " else '' end"


def level_texts(w: World) -> DataFrame:
    """The different (house, way, city, pc, place) of documents, numbered; a document's text decides by these alone."""
    rows = spark_sql(w, f"select p.doc_id, p.num, p.way, p.city, p.pc, case when p.city <> '' then p.city else {_FOUND_PLACE} end as place from doc_parts p join docs d on d.doc_id = p.doc_id where d.can <> '' and d.can <> 'N A'")
    return w.stage("level_texts", lambda: rows.withColumn("shape", F.xxhash64("num", "way", "city", "pc", "place")))


def hierarchical(w: World) -> DataFrame:
    """Five levels from postcode and house to locality; the first with any address gives its first, scored by its components.

    A street with neither house nor locality is level three; a document with neither street
    nor locality has none of levels two and three, where the empty search would match every address.
    """
    rows = level_texts(w)
    shapes = rows.select("shape", "num", "way", "city", "pc", "place").distinct()
    gaz = w.gaz.select("address_id", "full_address", "can", "pc")
    # What a text starts with, up to its first blank: a house number is a prefix of that.
    head = F.regexp_extract("can", r"^(\S{1,8})", 1)
    starts = gaz.withColumn("_head", head).filter("_head rlike '^[0-9]'").select("address_id", "pc", F.explode(F.transform(F.sequence(F.lit(1), F.length("_head")), lambda i: F.substring(F.col("_head"), F.lit(1), i))).alias("num"))
    first = lambda df: df.groupBy("shape").agg(F.min("address_id").alias("address_id"))
    one = first(shapes.filter("pc <> '' and num <> ''").select("shape", "pc", "num").join(starts, ["pc", "num"]))
    roads = shapes.filter("way <> ''").select(F.col("way").alias("term")).distinct()
    on_road = joins.contains_join(roads, gaz, "term", "term", "address_id", "can").withColumnRenamed("term", "way")
    places = shapes.select(F.explode(F.array("city", "place")).alias("term")).filter("term <> ''").distinct()
    in_place = joins.contains_join(places, gaz, "term", "term", "address_id", "can").withColumnRenamed("term", "city")
    road_start = on_road.join(starts.select("address_id", "num"), "address_id")
    # Smallest addresses of a street, of a house in it, and of both in a town, once for all shapes that ask for them.
    least = lambda df, *by: df.groupBy(*by).agg(F.min("address_id").alias("address_id"))
    both = on_road.join(in_place, "address_id")
    two = [
        shapes.filter("way <> '' and num <> '' and city <> ''").join(least(road_start.join(in_place, "address_id"), "way", "num", "city"), ["way", "num", "city"]),
        shapes.filter("way <> '' and num <> '' and city = ''").join(least(road_start, "way", "num"), ["way", "num"]),
        shapes.filter("way = '' and num <> '' and city <> ''").join(least(in_place.join(starts.select("address_id", "num"), "address_id"), "num", "city"), ["num", "city"]),
    ]
    three = [
        shapes.filter("way <> '' and city <> ''").join(least(both, "way", "city"), ["way", "city"]),
        shapes.filter("way <> '' and city = ''").join(least(on_road, "way"), "way"),
        shapes.filter("way = '' and city <> ''").join(least(in_place, "city"), "city"),
    ]
    stems = shapes.filter("way <> ''").select("way", F.substring("way", 1, 4).alias("term"), F.expr(_SOUND("way")).alias("code")).distinct()
    begun = joins.contains_join(stems.select("term").distinct(), gaz, "term", "term", "address_id", "can", 1)
    sounds = gaz.groupBy(F.expr(_SOUND("can")).alias("code")).agg(F.min("address_id").alias("address_id")).filter("code <> ''")
    alike = least(stems.join(begun, "term").select("way", "address_id").union(stems.join(sounds, "code").select("way", "address_id")), "way")
    four = shapes.filter("way <> ''").join(alike, "way")
    five = shapes.filter("place <> ''").join(least(in_place, "city").withColumnRenamed("city", "place"), "place")
    every = one.withColumn("level", F.lit(1))
    for n, part in ((2, two[0]), (2, two[1]), (2, two[2]), (3, three[0]), (3, three[1]), (3, three[2]), (4, four), (5, five)):
        every = every.union(part.select("shape", "address_id", F.lit(n).alias("level")))
    best = every.groupBy("shape").agg(F.min(F.struct("level", "address_id")).alias("b")).select("shape", "b.level", "b.address_id")
    base = F.element_at(F.array(*[F.lit(s) for _, s in LEVELS]), F.col("level"))
    hit = rows.join(best, "shape").join(w.gaz_parts.select("address_id", *[F.col(c).alias(f"g_{c}") for c in ("num", "way", "city", "pc")]), "address_id")
    same = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"g_{c}"))
    plus = lambda c, n: F.when(same(c), F.lit(n)).otherwise(F.lit(0.0))
    score = base + plus("num", 0.15) + plus("pc", 0.10) + plus("way", 0.10) + plus("city", 0.05) - F.when(~same("num") & (base > 0.85), F.lit(0.10)).otherwise(F.lit(0.0))
    made = hit.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    return made.select("doc_id", "address_id", "level", "score", F.when(F.col("score") >= 0.90, "auto_accepted").when(F.col("score") >= 0.70, "needs_review").otherwise("rejected").alias("decision"))


register("a6_hierarchical", hierarchical)


# -- layers -----------------------------------------------------------------------------
CODES = ("F", "PRD", "N/A", "ALR", "AUD", "UNKNOWN")


def layer_two(d: Dialect, eligible: str) -> str:
    """Each different open text once: the address of the same canonical form, else the likest on its road with its house."""
    return (
        f"select t.doc_id, m.address_id, m.confidence from (select d.doc_id, d.raw_address from docs d left join {MATCHED} x on x.doc_id = d.doc_id and x.confidence >= 0.9 where x.doc_id is null) t join "
        "(select raw_address, address_id, confidence from (select o.raw_address, c.address_id, round(c.confidence, 6) as confidence, row_number() over (partition by o.raw_address order by c.exact desc, round(c.confidence, 6) desc, c.expanded, c.address_id) as rn from "
        f"(select d.raw_address, min(d.doc_id) as doc_id, min(d.can) as can from docs d left join {MATCHED} x on x.doc_id = d.doc_id and x.confidence >= 0.9 where x.doc_id is null group by d.raw_address having {eligible}) o join "
        "(select p.can, u.address_id, u.expanded, 1 as exact, 1.0 as confidence from (select distinct can from docs where can <> '') p join union_rows u on u.can = p.can "
        "union all select l.can, l.address_id, l.expanded, 0, l.similarity from like_union l) c on c.can = o.can left join doc_parts a on a.doc_id = o.doc_id left join gaz g on g.address_id = c.address_id "
        f"where c.exact = 1 or (a.num <> '' and a.way <> '' and (a.num = g.house or (c.expanded = 1 and {d.find('c.can', 'a.num')} > 0)) and {d.find('g.road', 'a.way')} > 0)) s where rn = 1) m on m.raw_address = t.raw_address"
    )


def _eligible(d: Dialect) -> str:
    codes = " and ".join(f"d.raw_address not like '{c}%'" for c in CODES)
    return f"count(*) <= 50 and length(d.raw_address) > 10 and {codes} and {d.like('d.raw_address', '[0-9]')}"


def _strict_eligible(d: Dialect) -> str:
    codes = " and ".join(f"d.raw_address not like '{c}%'" for c in CODES[:3])
    return (
        f"count(*) <= 20 and length(d.raw_address) between 15 and 100 and {codes} and d.raw_address not like '%AND %' and d.raw_address not like '%PLOT%' and d.raw_address not like '%DEV%' "
        f"and {d.like('d.raw_address', r'^[0-9]+[A-Z]?\s')} and {d.like('d.raw_address', '^[^,]+,[^,]+,')}"
    )


def union_rows(w: World) -> DataFrame:
    return w.stage("union_rows", lambda: spark_sql(w, f"select address_id, can, expanded from ({UNION(SPARK)}) u"))


def like_union(w: World) -> DataFrame:
    """Canonical texts of documents without a good match and the addresses, expanded ones too, at least .8 like them."""

    def make() -> DataFrame:
        texts = spark_sql(w, f"select distinct d.can as probe from docs d left join {MATCHED} x on x.doc_id = d.doc_id and x.confidence >= 0.9 where x.doc_id is null and d.can <> ''")
        # Numbers for the texts: staged, so that they stay the same.
        other = w.stage("union_texts", lambda: union_rows(w).filter("can <> ''").select("can").distinct().withColumn("text_id", F.monotonically_increasing_id()))
        # Similarities are within 1 of each other: all pairs are taken.
        found = joins.likest(texts, other, "probe", "probe", "text_id", "can", 0.8, 1.0).join(other, "text_id")
        return found.join(union_rows(w), "can").select(F.col("probe").alias("can"), "address_id", "expanded", "similarity")

    return w.stage("like_union", make)


_LAYER_HEAD = (
    f"with union_rows as materialized (select address_id, can, expanded from ({UNION(DUCK)}) u), like_union as materialized (select t.probe as can, r.address_id, r.expanded, t.similarity from ("
    + trigram_sql(0.8, 1 << 30, "(select distinct can as probe from docs where can <> '')", "probe", "probe", "(select distinct can as text from union_rows)", "text", "text")
    + ") t join union_rows r on r.can = t.text) "
)
for _name, _test in (("a18_optimized_layer", _eligible), ("a18p_parallel_layer", _strict_eligible)):
    register(_name, lambda w, t=_test: spark_sql(w, layer_two(SPARK, t(SPARK)), union_rows=union_rows(w), like_union=like_union(w)), _LAYER_HEAD + layer_two(DUCK, _test(DUCK)))


def individual(d: Dialect) -> str:
    """Real texts without a good match: the likest whole address, of the likest the one with the fewest edits."""
    return (
        "select doc_id, address_id, round(similarity, 6) as similarity, edits from (select c.doc_id, c.address_id, c.similarity, levenshtein(upper(g.full_address), upper(d.raw_address)) as edits, "
        "row_number() over (partition by c.doc_id order by round(c.similarity, 9) desc, levenshtein(upper(g.full_address), upper(d.raw_address)), c.address_id) as rn "
        f"from whole_pairs c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id left join {MATCHED} m on m.doc_id = c.doc_id "
        f"where length(d.raw_address) > 15 and {T.is_real_address(d, 'd.raw_address')} and coalesce(m.confidence, 0.0) < 0.7) s where rn = 1 and similarity >= 0.7 and edits <= 20"
    )


def whole_pairs(w: World) -> DataFrame:
    """The likest addresses of each document that individual() may ask for: it takes the likest only, and none under .7."""

    def make() -> DataFrame:
        asked = spark_sql(w, f"select d.doc_id, d.{RAW} from docs d left join {MATCHED} m on m.doc_id = d.doc_id where length(d.{RAW}) > 15 and {T.is_real_address(SPARK, 'd.' + RAW)} and coalesce(m.confidence, 0.0) < 0.7")
        return joins.likest(asked, w.gaz, "doc_id", RAW, "address_id", "full_address", 0.7)

    return w.stage("whole_pairs", make)


_WHOLE_SQL = f"with whole_pairs as materialized ({trigram_sql(0.6, 1 << 30, 'docs', 'doc_id', RAW, 'gaz', 'address_id', 'full_address')}) "
register("a22_individual_fuzzy", lambda w: spark_sql(w, individual(SPARK), whole_pairs=whole_pairs(w)), _WHOLE_SQL + individual(DUCK))

#: Facts first, then the conservative and the fuzzy layer; what is still open follows its group's winner of two votes or more.
LAYERED = (
    "with layers as (select doc_id, address_id, confidence, layer from (select *, row_number() over (partition by doc_id order by layer, confidence desc, address_id) as rn from ("
    f"select doc_id, address_id, confidence, 1 as layer from {MATCHED} m where confidence >= 0.9 union all select doc_id, address_id, confidence, 2 from layer2 union all select doc_id, address_id, similarity, 3 from layer3) u) v where rn = 1), "
    "votes as (select app_base, address_id, row_number() over (partition by app_base order by n desc, best desc, address_id) as rn, n from (select d.app_base, l.address_id, count(*) as n, max(l.confidence) as best from layers l join docs d on d.doc_id = l.doc_id group by d.app_base, l.address_id) c) "
    "select d.doc_id, coalesce(l.address_id, v.address_id) as address_id, coalesce(l.confidence, case when v.address_id is not null then 0.85 end) as confidence, coalesce(l.layer, case when v.address_id is not null then 4 end, 0) as layer "
    "from docs d left join layers l on l.doc_id = d.doc_id left join votes v on v.app_base = d.app_base and v.rn = 1 and v.n >= 2"
)


def layered(w: World) -> DataFrame:
    """Every document with the layer that matched it; 0 where none did."""
    two = w.stage("layer2", lambda: spark_sql(w, layer_two(SPARK, _eligible(SPARK)), union_rows=union_rows(w), like_union=like_union(w)))
    three = w.stage("layer3", lambda: spark_sql(w, individual(SPARK), whole_pairs=whole_pairs(w)))
    return spark_sql(w, LAYERED, layer2=two, layer3=three)


register(
    "a24_layered", layered,
    f"with layer2 as materialized ({ORACLES['a18_optimized_layer']}), layer3 as materialized ({ORACLES['a22_individual_fuzzy']}), " + LAYERED[5:],
)


# -- evaluators --------------------------------------------------------------------------
def pair_texts(w: World, least: float, k: int) -> DataFrame:
    return spark_sql(w, "select c.doc_id, c.address_id, c.similarity as trigram, d.can as a, g.can as b, d.easting as x, d.northing as y, g.easting as u, g.northing as v from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id", cand=w.candidates(least, k))


def conservative_evaluator(w: World) -> DataFrame:
    """The first reason against a candidate, or its score."""
    d = SPARK
    rows = pair_texts(w, 0.6, 5).withColumn("jaro", strings.jaro("a", "b"))
    rows = rows.selectExpr(
        "*", f"{T.house_numbers(d, 'a')} as na", f"{T.house_numbers(d, 'b')} as nb", f"{T.localities(d, 'a')} as la", f"{T.localities(d, 'b')} as lb",
        f"{S.overlap_smaller(d, T.tokens(d, 'a'), T.tokens(d, 'b'))} as words", "sqrt((x - u) * (x - u) + (y - v) * (y - v)) as metres",
    )
    rows = rows.selectExpr("*", f"{S.common_element(d, 'na', 'nb')} as same_house", f"{S.overlap_smaller(d, 'la', 'lb')} as places")
    reason = (
        "case when trigram < 0.90 then 'trigram' when jaro < 0.92 then 'jaro' when size(na) > 0 and size(nb) > 0 and not same_house then 'house number' when places < 0.5 then 'locality' when metres > 50 then 'distance' end"
    )
    score = "least(1.0, 0.35 * trigram + 0.30 * jaro + 0.15 * words + if(same_house, 0.10, 0) + if(places >= 0.8, 0.05, 0) + if(coalesce(exp(-metres / 300), 0) > 0.8, 0.05, 0))"
    return rows.selectExpr("doc_id", "address_id", f"{reason} as reason", f"round({score}, 6) as s").selectExpr("doc_id", "address_id", "reason", "reason is null as passed", "case when reason is null then s else 0.0D end as score")


register("dd5_conservative_evaluator", conservative_evaluator)
register(
    "dd10_phonetic_bonus",
    lambda w: pair_texts(w, 0.6, 5).selectExpr("doc_id", "address_id", "trigram", f"{strings.phonetic_overlap('a', 'b')} as hits", f"size({strings.phonetic_tokens('a')}) as total").selectExpr("doc_id", "address_id", "hits", "total", "round(least(1.0, trigram + coalesce(0.05 * hits / nullif(total, 0), 0)), 6) as score"),
)


def parsed_pair_score(w: World) -> DataFrame:
    """Weighted house, road, city and postcode of parsed texts; a part that either lacks counts nothing."""
    rows = spark_sql(w, "select c.doc_id, c.address_id, a.num as n1, b.num as n2, a.way as w1, b.way as w2, a.city as c1, b.city as c2, a.pc as p1, b.pc as p2 from cand c join doc_parts a on a.doc_id = c.doc_id join gaz_parts b on b.address_id = c.address_id", cand=w.candidates(0.6, 5))
    present = lambda a, b: (F.col(a) != "") & (F.col(b) != "")
    equal = lambda a, b: F.when(present(a, b) & (F.col(a) == F.col(b)), 1.0).otherwise(0.0)
    near = lambda a, b: F.when(present(a, b), strings.jaro_winkler(a, b)).otherwise(0.0)
    score = 0.30 * equal("n1", "n2") + 0.35 * near("w1", "w2") + 0.20 * near("c1", "c2") + 0.15 * equal("p1", "p2")
    return rows.select("doc_id", "address_id", F.round(score, 6).alias("score"))


register("dd16_parsed_score", parsed_pair_score)


# -- parsers that stand in for a trained one ------------------------------------------------
def stand_in_parse(d: Dialect) -> str:
    """First word that starts with a digit, first listed town, the words up to the first road word, the flat, and the last GU postcode."""
    towns = " ".join(f"when {d.find('up', d.lit(t))} > 0 then {d.lit(t)}" for t in C.STAND_IN_TOWNS)
    # The text must have two words up to the road word, which may be part of a longer word.
    before = lambda k: f"substring(up, 1, {d.find('up', d.lit(k))} + {len(k) - 1})"
    words = lambda k: T.tokens(d, before(k))
    road = " ".join(f"when {d.find('up', d.lit(k))} > 1 and {d.size(words(k))} >= 2 then {d.join(words(k), ' ')}" for k in C.STAND_IN_ROADS)
    house = f"{d.ext('up', r'^\s*([0-9]\S*)')}"
    inner = f"select doc_id, up, {house} as house_number, case {towns} else '' end as city, case {road} else '' end as words, {d.ext('up', r'FLAT\s+(\S+)')} as flat, trim(substring({d.ext('up', r'.*(GU.{4,})$')}, 1, 8)) as postcode from (select doc_id, upper({RAW}) as up from docs) u"
    return f"select doc_id, house_number, city, postcode, case when flat <> '' then concat('FLAT ', flat) else '' end as unit, case when house_number <> '' then trim(substring(words, length(house_number) + 1)) else words end as road from ({inner}) s"


portable("p10_stand_in_parse", stand_in_parse)
scalar(
    "p11_sql_stand_in_parse", "docs", "doc_id",
    {
        "postcode": lambda d: d.ext(RAW, r"([A-Z]{1,2}[0-9]{1,2}[A-Z]?\s*[0-9][A-Z]{2})"),
        "house_number": lambda d: d.ext(RAW, r"^(\d+[A-Za-z]?)"),
        "city": lambda d: "case " + " ".join(f"when {d.find(f'upper({RAW})', d.lit(t))} > 0 then {d.lit(t)}" for t in C.STAND_IN_TOWNS[:5]) + " else '' end",
        "road": lambda d: f"trim({d.rep(d.rep(RAW, r'^\d+[A-Za-z]?\s+', ''), r'(?i)\s+(ALTON|PETERSFIELD|BORDON|LIPHOOK|LISS).*$', '')})",
    },
)

# -- filters, runs, overrides, snapshots --------------------------------------------------
with_candidates(
    "c3_spatial_filter", 0.5, 20,
    lambda d: "select c.doc_id, c.address_id from cand c join docs d on d.doc_id = c.doc_id join gaz g on g.address_id = c.address_id where d.easting is null or d.northing is null "
    f"or {S.distance(d, 'd.easting', 'd.northing', 'g.easting', 'g.northing')} <= 2000",
)
portable("s10_unmatched_page", f"select d.doc_id from docs d left join {MATCHED} m on m.doc_id = d.doc_id where m.doc_id is null and d.doc_type = 'decision' order by d.doc_id limit 100")
_LONG = lambda n: f"length(trim({RAW})) > {n} and upper(trim({RAW})) <> 'N A'"
register(
    "s11_eligible", lambda w: _eligible_rows(w),
    "select 'spatial' as strategy, doc_id from docs where easting > 0 and northing > 0 union all select 'postcode', doc_id from docs where pc <> '' union all "
    f"select 'hierarchical', doc_id from docs where {_LONG(10)} union all select 'rule', doc_id from docs where {_LONG(10)} union all select 'vector', doc_id from docs where {_LONG(15)}",
)


def _eligible_rows(w: World) -> DataFrame:
    every = None
    for strategy in ("spatial", "postcode", "hierarchical", "rule", "vector"):
        part = files.eligible(w.docs, strategy).select(F.lit(strategy).alias("strategy"), "doc_id")
        every = part if every is None else every.union(part)
    return every


def accepted_rows(w: World) -> DataFrame:
    return spark_sql(w, f"select doc_id, address_id, method, confidence as score, case when confidence >= 0.9 then 'auto_accepted' else 'needs_review' end as decision from {MATCHED} m")


register(
    "k4_run", lambda w: results.run_completed(results.run_started(w.spark, 1, "demo", "2024-01-01"), accepted_rows(w), "2024-01-02"),
    f"select 1 as run_id, 'demo' as label, '2024-01-01' as started_at, '2024-01-02' as completed_at, count(distinct doc_id) as documents, count(distinct case when confidence >= 0.9 then doc_id end) as matched from {MATCHED} m",
)


def overridden(w: World) -> DataFrame:
    """Every tenth document is given its neighbour's address, every twenty-fifth none."""
    changes = spark_sql(w, "select doc_id, case when doc_id % 25 = 0 then null else doc_id % 100 + 1 end as address_id, 'clerk' as decided_by from docs where doc_id % 10 = 0 or doc_id % 25 = 0")
    history = w.spark.createDataFrame([], "doc_id long, address_id long, method string, score double, decided_by string, decided_at string")
    base = accepted_rows(w).select("doc_id", "address_id", "method", F.col("score").cast("double").alias("score"))
    return results.override(base, history, changes, "2024-01-03")[0].select("doc_id", "address_id", "method")


register(
    "k12_override", overridden,
    f"select doc_id, address_id, method from {MATCHED} m where doc_id % 10 <> 0 and doc_id % 25 <> 0 union all select doc_id, doc_id % 100 + 1, 'manual' from docs where doc_id % 10 = 0 and doc_id % 25 <> 0",
)
portable(
    "k16_statistics_row",
    f"select count(*) as documents, count(case when is_matched then 1 end) as matched, count(case when confidence >= 0.9 then 1 end) as high, round(100.0 * count(case when is_matched then 1 end) / count(*), 4) as rate from {FACT} f",
)


def snapshots(w: World) -> DataFrame:
    """The layers of the matching as snapshots in the shared folder, compared."""
    folder = f"{staging_dir(w.spark)}/snapshots-{uuid.uuid4().hex}"
    rows = spark_sql(w, f"select doc_id, address_id, confidence, method from {FACT} f")
    open_ = F.coalesce(F.col("confidence") < 0.9, F.lit(True))
    results.snapshot(rows.withColumn("address_id", F.when(~open_, F.col("address_id"))).withColumn("confidence", F.when(~open_, F.col("confidence"))), folder, "facts")
    results.snapshot(rows, folder, "postcodes")
    return results.compare_snapshots(w.spark, folder, ["facts", "postcodes"]).withColumn("mean_confidence", F.round(F.col("mean_confidence").cast("double"), 6))


register(
    "r16_snapshot_comparison", snapshots,
    f"select 'facts' as layer, count(*) as documents, count(case when confidence >= 0.9 then 1 end) as matched, round(avg(case when confidence >= 0.9 then confidence end), 6) as mean_confidence from {FACT} a union all "
    f"select 'postcodes', count(*), count(address_id), round(avg(confidence), 6) from {FACT} b",
)
