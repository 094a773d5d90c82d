"""The trigram search by frames of frequent words gives the rows of the plain trigram join."""

import random

import numpy as np
import pytest

from linkforge.operators import joins
from linkforge.plans import catalogue, engines
from linkforge.plans.demo import World

from .test_at_size import same_as_sql
from .test_queries import SF, duck  # noqa: F401


def texts(spark):
    rng = random.Random(3)
    line = lambda: f"{rng.randint(1, 60)} {rng.choice(['HIGH', 'MILL', 'OAK'])} {rng.choice(['ROAD', 'LANE'])}, {rng.choice(['ALTON', 'LISS'])}, GU3{rng.randint(0, 3)} {rng.randint(1, 9)}{rng.choice('AB')}{rng.choice('PQ')}"
    right = [(n, line()) for n in range(700)] + [(900, None), (901, ""), (902, "--"), (903, "12 MILL LANE, LISS"), (904, "12 MILL LANE, LISS")]
    odd = ["LAND AT OAK ROAD, ALTON", "12 MILL LANE, LISS", "MLL LANE", "", None, "zzz", "12 mill lane liss", "\u00c9 HIGH ROAD"]
    left = [(n, t) for n, t in enumerate([line() for _ in range(120)] + odd + odd)]
    return spark.createDataFrame(left, "l long, x string"), spark.createDataFrame(right, "r long, y string")


def plain(monkeypatch, call):
    with monkeypatch.context() as m:
        m.setattr(joins, "_by_frame", lambda *a: None)
        return sorted(tuple(r) for r in call().collect())


@pytest.mark.parametrize("size", [1 << 27, 9000])
def test_frames_give_the_rows_of_the_plain_join(spark, monkeypatch, size):
    left, right = texts(spark)
    monkeypatch.setattr(joins, "MAX_RIGHT_BYTES", size)
    args = (left, right, "l", "x", "r", "y")
    assert joins._by_frame(*args, 0.5, 1) is not None
    for t, k in ((0.6, 1), (0.4, 7), (0.5, 2000)):
        call = lambda: joins.trigram_join(*args, t, k).select("l", "r", "similarity", "rank")  # noqa: B023, E731
        assert sorted(tuple(r) for r in call().collect()) == plain(monkeypatch, call)
    call = lambda: joins.likest(*args, 0.5).select("l", "r", "similarity")
    got = sorted(tuple(r) for r in call().collect())
    assert got == plain(monkeypatch, call) and len(got) > len({g[0] for g in got})


def test_texts_without_frequent_words_take_the_plain_join(spark):
    rng = random.Random(1)
    rows = [(n, "".join(rng.choices("abcdefghij", k=30))) for n in range(200)]
    left, right = spark.createDataFrame(rows, "l long, x string"), spark.createDataFrame(rows, "r long, y string")
    assert joins._by_frame(left, right, "l", "x", "r", "y", 0.5, 1) is None


def test_groups_below_the_bound_are_not_looked_at(monkeypatch):
    import pyarrow as pa

    word = lambda n: np.arange(n, n + 10, dtype=np.uint16)
    rows = [(n, word(100 * (n % 5)), np.append(word(100 * (n % 5)), np.uint16(5000 + n))) for n in range(500)]
    table = pa.table({"id": [r[0] for r in rows], "sig": [r[1].tobytes() for r in rows], "n": pa.array([11] * 500, pa.int32()), "grams": [r[2].tobytes() for r in rows]})
    right, looked = joins._framed(table), []
    partition = np.nonzero
    monkeypatch.setattr(joins.np, "nonzero", lambda x: looked.append(x.shape) or partition(x))
    i, ids, found = joins._best_of([rows[3][2]], right, 0.3, 1)
    assert ids.tolist() == [3] and found.tolist() == [1.0] and sum(x[1] for x in looked if len(x) == 2) == 100


@pytest.mark.parametrize("name", ["j10_distinct_fanout", "r8_match_rate_by_type", "a22_individual_fuzzy", "a24_layered"])
def test_queries_are_their_sql(spark, duck, name):  # noqa: F811
    same_as_sql(spark, duck, name)


def test_the_individual_layer_keeps_the_likest_pairs_only(spark):
    pairs = engines.whole_pairs(World(spark, SF))
    assert pairs.groupBy("doc_id").agg({"similarity": "max", "doc_id": "count"}).filter("`max(similarity)` < 0.7").count() == 0
    assert pairs.join(pairs.groupBy("doc_id").agg({"similarity": "max"}), "doc_id").filter("similarity < `max(similarity)` - 2e-9").count() == 0


def test_match_rate_takes_one_candidate_a_document(spark):
    catalogue.queries()["r8_match_rate_by_type"](spark, SF).collect()
    best = World(spark, SF).likest(0.6)
    assert best.count() == best.select("doc_id").distinct().count() > 0


def test_texts_with_a_good_match_are_not_compared_again(spark):
    w = World(spark, SF)
    found = {r["can"] for r in engines.like_union(w).select("can").distinct().collect()}
    exact = {r["can"] for r in w.docs.join(w.gaz.select("can"), "can", "left_semi").select("can").collect()}
    assert found and exact and not found & exact


def test_all_pairs_come_with_a_slack_of_one(spark, monkeypatch):
    left, right = texts(spark)
    args = (left, right, "l", "x", "r", "y", 0.4)
    got = sorted(tuple(r) for r in joins.likest(*args, 1.0).select("l", "r", "similarity").collect())
    want = plain(monkeypatch, lambda: joins.trigram_join(*args).select("l", "r", "similarity"))
    assert got == want and got


def test_right_rows_are_framed_in_a_task(spark, monkeypatch):
    left, right = texts(spark)
    plain_framed, here = joins._framed, []
    monkeypatch.setattr(joins, "_framed", lambda rows: here.append(1) or plain_framed(rows))
    assert joins._by_frame(left, right, "l", "x", "r", "y", 0.5, 200).count() > 0 and not here


def test_arrays_come_to_the_driver_in_pieces(monkeypatch):
    monkeypatch.setattr(joins, "PIECE_BYTES", 16)
    arrays = {"a": np.arange(11), "b": np.arange(12, dtype=np.float32).reshape(3, 4), "c": np.zeros(0, np.uint16), "d": np.zeros((2, 0), np.float32)}
    pieces = [r for b in joins._array_rows(arrays) for r in b.to_pylist()]
    assert max(len(p["data"]) for p in pieces) <= 16 and len(pieces) == 6 + 3 + 1 + 1
    got = joins._arrays(type("Rows", (), {"toLocalIterator": lambda self: iter(pieces)})())
    assert all(got[n].dtype == v.dtype and np.array_equal(got[n], v) for n, v in arrays.items())
