"""Substring join, embeddings, evaluators and the hierarchical levels against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkforge import config as C
from linkforge.functions import embedding, strings
from linkforge.operators.joins import contains_join
from linkforge.plans import catalogue, engines
from linkforge.plans.demo import World

from .test_queries import SF, duck, rows  # noqa: F401

WITH_SQL = (
    "v1_digest_embedding", "p12_accurate_parse", "d15_component_score", "a13_accurate", "a14_component", "a15_component_strict", "m20_weighted_components",
    "a7_rules", "a22_individual_fuzzy", "a24_layered", "p10_stand_in_parse", "p11_sql_stand_in_parse", "k12_override", "s11_eligible", "r16_snapshot_comparison",
)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, duck, name):  # noqa: F811
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([[r[n] for n in place] for r in want.fetchall()])


@pytest.mark.parametrize("k", [None, 1, 3])
def test_contains_join(spark, k):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab %_\\") for _ in range(draw.randint(0, n)))
    left = [(n, word(5)) for n in range(120)] + [(900, None), (901, "ab"), (902, "ab")]
    right = [(n, word(14)) for n in range(150)] + [(800, None), (801, "abab"), (802, "abab")]
    got = contains_join(spark.createDataFrame(left, "a long, t string"), spark.createDataFrame(right, "b long, u string"), "a", "t", "b", "u", k)
    want = [(a, b) for a, t in left if t for b in sorted(n for n, u in right if u is not None and t in u)[:k]]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_contains_join_of_nothing(spark):
    none, some = spark.createDataFrame([], "a long, t string"), spark.createDataFrame([(1, "x")], "b long, u string")
    assert contains_join(none, some, "a", "t", "b", "u").count() == 0
    assert contains_join(some, none, "b", "u", "a", "t").count() == 0


def test_landmarks_hold_the_word_and_the_locality(spark):
    left = spark.createDataFrame([(1, "BELLHOTEL ALTON"), (2, "HOTEL"), (3, "")], "doc_id long, term string")
    right = spark.createDataFrame([(7, "1 BELLHOTEL ALTON"), (8, "GRANDHOTEL LISS")], "address_id long, can string")
    got = contains_join(left, right, "doc_id", "term", "address_id", "can", 20)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 7), (2, 8)]


def digest_of(text, n=384):
    s = text.strip().upper()
    digest, words = hashlib.md5(s.encode()).digest(), s.split()
    if text == "":
        return [0.0] * n
    v = [digest[i % 16] / 255 * 2 - 1 for i in range(n)]
    if words:
        v[n - 1], v[n - 2] = len(words) / 20, len(s.encode()) / 100
        v[n - 3] = sum(t in s for t in C.EMBEDDING_TERMS) / len(C.EMBEDDING_TERMS)
        v[n - 4] = sum(any(c in "0123456789" for c in w) for w in words) / len(words)
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v]


def test_embeddings(spark):
    texts = ["12 high street, alton", "", "   ", None, "é flat 2", "x" * 5000, "12 high street, alton"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", F.expr(embedding.digest_embedding("x")).alias("v"), embedding.generated_embedding("x").alias("g")).collect():
        if r.x is None:
            assert r.v is None and r.g is None
        else:
            assert np.allclose(r.v, digest_of(r.x), atol=1e-6)
            assert np.array_equal(np.array(r.g, np.float32), embedding.generated_of(r.x))
    # The generator is signed: 31 * 0 + 97 for one letter, then one step.
    assert embedding.generated_of("a")[0] == np.float32((97 * 1103515245 + 12345) % 1000 - 500) / np.float32(1000)


def test_jaro_winkler(spark):
    pairs = [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", "A"), ("SAME", "SAME"), (None, "A")]
    got = [r.v for r in spark.createDataFrame(pairs, "a string, b string").select(strings.jaro_winkler("a", "b").alias("v")).collect()]
    assert got[0] == pytest.approx(0.961, abs=1e-3) and got[1] == pytest.approx(0.813, abs=1e-3)
    assert got[2:] == [0.0, 1.0, None]


def soundex(text):
    text = "".join(c for c in text.upper()[next((i for i, c in enumerate(text) if c.isalpha()), len(text)) :])
    code = {c: d for d, cs in enumerate(("", "BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in cs}
    if not text:
        return ""
    out, last = text[0], code.get(text[0], 0)
    for c in text[1:]:
        now = code.get(c, 0) if c.isalpha() else 0
        if c in "HW":
            continue
        if now and now != last:
            out += str(now)
        last = now
        if len(out) == 4:
            break
    return out.ljust(4, "0")


def test_hierarchical_levels(spark):
    w = World(spark, SF)
    gaz = [r.asDict() for r in w.gaz.select("address_id", "can", "pc").orderBy("address_id").collect()]
    shapes = {r.doc_id: r for r in engines.level_texts(w).collect()}

    def first(test):
        return next((g["address_id"] for g in gaz if test(g)), None)

    def level(r):
        n, s, c, p = r.num, r.way, r.city, r.pc
        tests = [
            (n and p) and (lambda g: g["pc"] == p and g["can"].startswith(n)),
            (n and (s or c)) and (lambda g: g["can"].startswith(n) and s in g["can"] and c in g["can"]),
            (s or c) and (lambda g: s in g["can"] and c in g["can"]),
            s and (lambda g: soundex(g["can"]) == soundex(s) or s[:4] in g["can"]),
            r.place and (lambda g: r.place in g["can"]),
        ]
        for number, test in enumerate(tests, 1):
            if test and (found := first(test)) is not None:
                return number, found
        return None

    want = {d: level(r) for d, r in shapes.items()}
    got = {r.doc_id: (r.level, r.address_id) for r in engines.hierarchical(w).collect()}
    assert got == {d: v for d, v in want.items() if v}
    assert {v[0] for v in got.values()} >= {1, 2, 3}


def test_evaluator_gives_the_first_reason(spark):
    got = catalogue.queries()["dd5_conservative_evaluator"](spark, SF)
    texts = {(r.doc_id, r.address_id): r for r in engines.pair_texts(World(spark, SF), 0.6, 5).collect()}
    for r in got.collect():
        t = texts[(r.doc_id, r.address_id)]
        jaro = strings.jaro_of(t.a, t.b)
        if t.trigram < 0.90:
            assert r.reason == "trigram"
        elif jaro < 0.92:
            assert r.reason == "jaro"
        else:
            assert r.reason not in ("trigram", "jaro")
        assert r.passed == (r.reason is None) and (r.score > 0) == r.passed


def test_vectors_meet_equal_texts_only(spark):
    w = World(spark, SF)
    got = {(r.doc_id, r.address_id) for r in engines.vector_scores(w).collect()}
    docs = {r.doc_id: r.can for r in w.docs.select("doc_id", "can").collect()}
    known: dict = {}
    for r in w.gaz.select("address_id", "can").orderBy("address_id").collect():
        known.setdefault(r.can, r.address_id)
    assert got >= {(d, known[t]) for d, t in docs.items() if t and t in known}


@pytest.fixture
def same_texts(spark, monkeypatch):
    """A text of 15 addresses, asked for by two documents, and one that no address has."""
    docs = spark.createDataFrame([(1, "12 OAK ROAD ALTON"), (2, "12 OAK ROAD ALTON"), (3, "AU10001"), (4, ""), (5, None)], "doc_id long, can string")
    gaz = spark.createDataFrame([(n, "12 OAK ROAD ALTON") for n in range(15)] + [(20, "7 MILL LANE LISS"), (21, ""), (22, None)], "address_id long, can string")
    monkeypatch.setattr(World, "docs", property(lambda w: docs))
    monkeypatch.setattr(World, "gaz", property(lambda w: gaz))
    return f"small-{id(docs)}"


def test_vectors_give_every_address_of_a_text(spark, same_texts):
    got = [tuple(r) for r in catalogue.queries()["d10_vector_combined"](spark, same_texts).collect()]
    assert sorted(got) == [(d, n, 1.0, 1.0) for d in (1, 2) for n in range(15)]


def test_vector_engine_ranks_every_address_of_a_text(spark, same_texts):
    got = [tuple(r) for r in catalogue.queries()["a8_vector"](spark, same_texts).collect()]
    assert sorted(got) == [(d, 0, 1, 1.0, "auto_accepted") for d in (1, 2)]
    ranked = engines.vector_scores(World(spark, same_texts)).groupBy("doc_id").count().collect()
    assert {(r[0], r[1]) for r in ranked} == {(1, 15), (2, 15)}


def test_generated_vectors_of_seeds(spark):
    texts = ["12 HIGH STREET ALTON", "A", "\u00e9 FLAT 2", None]
    seeds = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(embedding.generated_seed("x")).collect()]
    assert seeds[3] is None
    assert np.array_equal(embedding.generated_from(np.array(seeds[:3])), np.array([embedding.generated_of(t) for t in texts[:3]]))


def test_layer_two_takes_the_exact_text_then_the_likest_on_its_road(spark):
    make = spark.createDataFrame
    docs = make(
        [(n, t, t.replace(",", ""), "", None) for n, t in ((1, "1 HIGH STREET, ALTON"), (2, "1 HIGH STREET, ALTON"), (3, "2 HIGH STREET, LISS"), (4, "F123456 1 HIGH STREET"), (5, "9 MILL LANE, ALTON"))],
        "doc_id long, raw_address string, can string, pc string, legacy string",
    )
    gaz = make([(10, "X", "", "u1", "1", "HIGH STREET"), (11, "Y", "", "u2", "2", "HIGH STREET"), (12, "Z", "", "u3", "3", "HIGH STREET")], "address_id long, can string, pc string, uprn string, house string, road string")
    parts = make([(1, "1", "HIGH STREET"), (2, "1", "HIGH STREET"), (3, "2", "HIGH STREET"), (4, "", ""), (5, "9", "MILL LANE")], "doc_id long, num string, way string")
    union = make([(10, "1 HIGH STREET ALTON", 1), (12, "1 HIGH STREET ALTON", 0)], "address_id long, can string, expanded int")
    like = make([("2 HIGH STREET LISS", 12, 0, 0.99), ("2 HIGH STREET LISS", 11, 0, 0.9), ("9 MILL LANE ALTON", 11, 0, 0.85)], "can string, address_id long, expanded int, similarity double")
    from linkforge.functions.dialect import SPARK
    from linkforge.plans.registry import spark_sql

    got = spark_sql(World(spark, SF), engines.layer_two(SPARK, engines._eligible(SPARK)), docs=docs, gaz=gaz, doc_parts=parts, union_rows=union, like_union=like)
    # Both rows of a text are matched; an address itself goes before one of a range; another house or road is none.
    assert sorted((r.doc_id, r.address_id, float(r.confidence)) for r in got.collect()) == [(1, 12, 1.0), (2, 12, 1.0), (3, 11, 0.9)]


@pytest.mark.parametrize("pairs", ["by_text", "by_street"])
def test_matched_pairs_are_those_of_the_join_without_one(spark, pairs):
    from linkforge.functions.dialect import SPARK
    from linkforge.plans.registry import spark_sql

    w = World(spark, SF)
    columns = ["doc_id", "address_id", "similarity", "house_hit", "street_score", "place_hit", "post_hit", "asked", "matched"]
    want = spark_sql(w, engines.component_join(SPARK, pairs), **engines.token_frames(w), **{pairs: engines.PAIR_FRAMES[pairs][0](w)}).select(*columns)
    got = engines.matched_pairs(w, pairs).select(*columns)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows_ = sorted(tuple(r) for r in want.collect())
    assert sorted(tuple(r) for r in got.collect()) == rows_ and rows_
    # Too much to broadcast, or keys that repeat: the join.
    docs = w.docs.select("doc_id", "can")
    one = {"same": ("can", "can", lambda a, b: a == b)}
    args = (spark.createDataFrame([(1, 1, 0.5)], "doc_id long, address_id long, similarity double"), docs, w.gaz.select("address_id", "can"), "doc_id", "address_id", "similarity", one)
    assert engines.joins.scored_pairs(*args, 100) is None
    assert engines.joins.scored_pairs(args[0], docs.union(docs), *args[2:]) is None


def test_accurate_passes_keep_the_best_of_a_document_only(spark):
    w = World(spark, SF)
    for pairs in engines.PASSES:
        every = engines.matched_pairs(w, pairs).selectExpr("doc_id", "address_id", f"double({engines.PASSES[pairs]}) as score", "matched").collect()
        best: dict = {}
        for r in every:
            mine = (-round(r.score, 6), -r.matched, r.address_id)
            best[r.doc_id] = min(best.get(r.doc_id, mine), mine)
        got = [(r.doc_id, (-round(r.score, 6), -r.matched, r.address_id)) for r in engines.best_matched(w, pairs).collect()]
        assert set(best.items()) <= set(got) and len(got) < len(every)
