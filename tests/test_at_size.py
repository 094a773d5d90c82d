"""Plans and operators that large tables need: what they read, and the same rows as the plain form."""


import pytest

from linkforge.functions import embedding
from linkforge.operators import joins
from linkforge.plans import catalogue, engines, firsts, matching
from linkforge.plans.demo import World, spread
from linkforge.plans.registry import spark_sql

from .test_queries import SF, duck, rows  # noqa: F401


def same_as_sql(spark, duck, name):  # noqa: F811
    got, want = catalogue.queries()[name](spark, SF), duck.execute(catalogue.oracles()[name])
    place = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert rows(got.collect()) == rows([[r[n] for n in place] for r in want.fetchall()])


def test_digest_embedding_reads_bytes_and_length_once(spark):
    sql = embedding.digest_embedding("x")
    # One hexadecimal number for each of 16 bytes; the length outside the list of elements.
    assert "sequence(0, 383)" not in sql and "e / sqrt" not in sql


def test_one_file_is_spread_over_the_cores(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and spread(one).count() == 100


def test_facts_meet_one_address_a_postcode(spark, duck):  # noqa: F811
    for name in ("r16_snapshot_comparison", "r1_fact_build", "s10_unmatched_page"):
        same_as_sql(spark, duck, name)
    plan = catalogue.queries()["r1_fact_build"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "postcode_only" in plan and "Union" not in plan and "row_number" not in plan


def test_trigrams_within_groups_are_those_of_plain_pairs(spark):
    words = ["12 MILL LANE", "12A MILL LANE", "4 OAK CLOSE", "", "LAND AT OAK", "99 HIGH STREET ALTON"]
    left = spark.createDataFrame([(n, words[n % 6], ["a", "b", "", None][n % 4], str(n % 3)) for n in range(40)], "l long, x string, pc string, tag string")
    right = spark.createDataFrame([(n, words[n % 5], ["a", "b", "", "c"][n % 4], str(n % 2)) for n in range(30)], "r long, y string, pc string, tag string")

    def tri(text):
        return {f"  {w} "[n : n + 3] for w in text.lower().split() for n in range(len(w) + 1)}

    want = {
        (a["l"], b["r"]): (len(tri(a["x"]) & tri(b["y"])) / max(1, len(tri(a["x"]) | tri(b["y"]))), a["tag"] == b["tag"])
        for a in left.collect() for b in right.collect() if a["pc"] and a["pc"] == b["pc"]
    }
    for block in (1024, 3):
        args = (left, right, "l", "x", "r", "y", "pc", "tag", "tag")
        got = joins.trigrams_within(*args, block=block).collect()
        assert len(got) == len(want) and {(g["l"], g["r"]): (g["similarity"], g["same"]) for g in got} == want
        cut = {(g["l"], g["r"]) for g in joins.trigrams_within(*args, lambda s, same: s + 0.5 * same, block=block).collect()}
        score = {k: s + 0.5 * same for k, (s, same) in want.items()}
        best = {k for k in score if score[k] == max(score[m] for m in score if m[0] == k[0])}
        assert best <= cut < set(want)


def test_postcode_engine_is_its_sql(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "a4_postcode")


def test_d9_postcode_score_is_its_sql(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "d9_postcode_score")


def test_j14_postcode_is_the_whole_sql(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "j14_postcode_all")


def test_j14_postcode_all_is_j14_postcode(spark):
    found = [{tuple(r) for r in catalogue.queries()[name](spark, SF).collect()} for name in ("j14_postcode", "j14_postcode_all")]
    assert found[0] == found[1] and found[0]


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Many addresses of few roads, so that every cut cuts, and documents that lack parts."""
    gaz = [(n, str(n % 5 or ""), ["OAK ROAD", "OAK ROADS", "MILL LANE"][n % 3], ["ALTON", "LISS", ""][n % 7 % 3], ["GU1 1AA", ""][n % 11 % 2]) for n in range(900)]
    docs = [(n, str(n % 6 or ""), ["OAK ROAD", "MILL LANE", "OAKROAD", ""][n % 4], ["ALTON", "LISS", ""][n % 5 % 3], ["GU1 1AA", "", "GU9 9ZZ"][n % 3]) for n in range(60)]
    frames = {n: spark.createDataFrame(r, f"{k} long, num string, way string, city string, pc string") for n, r, k in (("gaz_parts", gaz, "address_id"), ("doc_parts", docs, "doc_id"))}
    monkeypatch.setattr(World, "gaz_parts", property(lambda w: frames["gaz_parts"]))
    monkeypatch.setattr(World, "doc_parts", property(lambda w: frames["doc_parts"]))
    return World(spark, f"small-{id(frames)}")


def both(w, plain, quick, **frames):
    found = [sorted(tuple(r) for r in spark_sql(w, sql, **frames).collect()) for sql in (plain, quick)]
    assert found[0] == found[1] and found[0]
    plan = spark_sql(w, quick, **frames)._jdf.queryExecution().optimizedPlan().toString()
    return plan


def test_any_components_cuts_before_documents_meet(small_parts):
    both(small_parts, engines.WHICHEVER, firsts.WHICHEVER)


def test_component_pairs_cut_before_documents_meet(small_parts):
    both(small_parts, engines.COMPONENT, engines._COMPONENT_QUICK, like_roads=engines.like_roads(small_parts))


def test_roads_alike_cut_before_documents_meet(small_parts):
    both(small_parts, engines.LIKE_ROAD.format(20, 0.8), firsts.like_road(20, 0.8), like_roads=engines.like_roads(small_parts))


def test_same_road_cut_before_documents_meet(small_parts):
    both(small_parts, engines.SAME_ROAD.format(10), firsts.same_road(10))


@pytest.mark.parametrize("name", ["j15_hierarchical", "d13_component_search", "j7_fuzzy_road", "a14_component", "a15_component_strict", "d14_strict_score"])
def test_first_addresses_are_those_of_the_sql(spark, duck, name):  # noqa: F811
    same_as_sql(spark, duck, name)
    plan = " ".join(firsts_used(name))
    assert "kn <=" in plan or "min(address_id)" in plan


def firsts_used(name):
    return {"j15_hierarchical": [firsts.HIERARCHICAL], "d13_component_search": [firsts.COMPONENT_SEARCH], "j7_fuzzy_road": [firsts.FUZZY_ROAD], "a14_component": [engines._COMPONENT_QUICK]}.get(name, [engines._STRICT_QUICK])


def test_trigram_join_of_no_texts_is_empty(spark):
    none = spark.createDataFrame([], "l long, x string")
    some = spark.createDataFrame([(1, "12 OAK ROAD")], "r long, y string")
    for k, columns in ((None, ["l", "r", "similarity"]), (3, ["l", "r", "similarity", "rank"])):
        found = joins.trigram_join(none, some, "l", "x", "r", "y", 0.6, k)
        assert found.columns == columns and not found.collect()


def test_double_like_is_its_sql_and_pairs_are_not_made_distinct_for_single_documents(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "j12_double_like")
    assert "collect_set" not in catalogue.oracles()["j12_double_like"]
    # The houses of a road are met once, in a table of their own.
    held = World(spark, SF).stage("double_like", lambda: None)
    assert held.columns == ["way", "num", "ids"] and held.count() == held.select("way", "num").distinct().count() > 0


def test_double_like_of_repeated_documents(spark, small_parts, monkeypatch):
    parts = small_parts.doc_parts.selectExpr("doc_id div 3 as doc_id", "num", "way", "city", "pc")
    gaz = spark.createDataFrame([(n, f"{n % 9}", ["OAK ROAD", "MILL LANE"][n % 2], f"{n % 9} oak road {n % 5}", "ALTON", "GU1 1AA") for n in range(60)], "address_id long, house string, road string, full_address string, town string, postcode string")
    monkeypatch.setattr(World, "doc_parts", property(lambda w: parts))
    monkeypatch.setattr(World, "gaz", property(lambda w: gaz))
    got = [tuple(r) for r in matching.double_like(small_parts).select("doc_id", "address_id").collect()]
    houses = [(r["doc_id"], r["way"], r["num"]) for r in parts.collect() if r["num"] and r["way"]]
    want = {(d, r["address_id"]) for d, way, num in houses for r in gaz.collect() if r["road"] == way and num in r["full_address"].upper()}
    assert len(got) == len(set(got)) and set(got) == want and want
