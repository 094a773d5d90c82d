import random

import pytest

from linkforge.functions.strings import jaro, jaro_of, osa, osa_of, phonetic_a, phonetic_overlap
from linkforge.operators import spelling


def brute_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + cost)
    return d[len(a), len(b)]


def test_distances(spark):
    import duckdb

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("ABCD", k=rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(400)] + [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("CA", "ABC"), (None, "A")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro("a", "b").alias("j"), osa("a", "b").alias("o"), osa("a", "b", 2).alias("c")).collect()
    for r in got:
        if r["a"] is None:
            assert r["j"] is None and r["o"] is None
            continue
        want = brute_osa(r["a"], r["b"])
        assert (r["o"], r["c"]) == (want, want if want <= 2 else None)
        if r["a"] and r["b"]:
            assert abs(r["j"] - duckdb.execute("select jaro_similarity(?, ?)", [r["a"], r["b"]]).fetchone()[0]) < 1e-9
    assert jaro_of("", "A") == 0.0 and osa_of("CA", "ABC") == 3


@pytest.mark.parametrize(
    ("word", "code"), [("PHILLIP", "FLP"), ("knight", "NFT"), ("ALTON", "ALTN"), ("CHURCH", "KHRKH"), ("WRIGHT", "RFT"), ("", ""), ("QUEEN", "KWN"), ("YZ", "IS"), ("123", "")]
)
def test_phonetic_code(spark, word, code):
    assert spark.createDataFrame([(word,)], "w string").selectExpr(f"{phonetic_a('w')} as c").first()["c"] == code


def test_phonetic_overlap_counts_each_word_once(spark):
    row = spark.createDataFrame([("PHILIP PHILLIP THE 12 ROAD", "filip  rode")], "a string, b string").selectExpr(f"{phonetic_overlap('a', 'b')} as n").first()
    assert row["n"] == 3


def some_dictionary(spark):
    return spark.createDataFrame([("ALTON", 100), ("PETERSFIELD", 80), ("ROAD", 500), ("ALTONS", 5), ("HALTON", 100)], "term string, freq bigint")


def test_lookup_is_brute_force(spark):
    rng = random.Random(2)
    terms = [("".join(rng.choices("ABC", k=rng.randint(3, 6))), rng.randint(1, 9)) for _ in range(60)]
    terms = list(dict(terms).items())
    words = sorted({"".join(rng.choices("ABC", k=rng.randint(1, 7))) for _ in range(80)})
    dictionary = spark.createDataFrame(terms, "term string, freq bigint")
    got = spelling.lookup(spark.createDataFrame([(w,) for w in words], "word string"), dictionary).collect()
    want = set()
    for w in words:
        found = [(brute_osa(w, t), -f, t) for t, f in terms]
        if w in dict(terms):
            found = [(0, -dict(terms)[w], w)]
        want |= {(w, t, d, -f, n) for n, (d, f, t) in enumerate(sorted(x for x in found if x[0] <= 2), 1)}
    assert {(r["word"], r["term"], r["distance"], r["freq"], r["rank"]) for r in got} == want


def test_correction_leaves_numbers_suffixes_and_short_words(spark):
    texts = [(1, "12A Altn  Raod"), (2, "ALTON ROAD"), (3, "ZZ 12B LANE"), (4, None), (5, ""), (6, "petersfeild  alton")]
    got = {r["id"]: r for r in spelling.correct(spark.createDataFrame(texts, "id bigint, t string"), some_dictionary(spark), "id", "t").collect()}
    assert got[1]["corrected"] == "12A ALTON ROAD" and got[1]["corrections"] == 2 and got[1]["confidence"] == 0.5
    assert [got[n]["corrected"] for n in (2, 3, 4, 5)] == ["ALTON ROAD", "ZZ 12B LANE", None, ""] and got[2]["confidence"] is None
    assert got[6]["corrected"] == "PETERSFIELD alton"


def test_dictionary_counts_and_seeds(spark):
    rows = spark.createDataFrame([("1 MILL LANE, ALTON",), ("2 MILL WAY, OAK END",), ("3 THE MILL, OAK END",), (None,), ("",)], "t string")
    plain = {r["term"]: r["freq"] for r in spelling.build_dictionary(rows, "t", seeded=False).collect()}
    assert plain == {"MILL": 3, "LANE": 1, "WAY": 1, "ALTON": 1, "OAK": 2, "END": 2, "OAK END": 2}
    seeded = {r["term"]: r["freq"] for r in spelling.build_dictionary(rows, "t").collect()}
    assert seeded["LANE"] == 50_000 and seeded["ALTON"] == 10_000 and seeded["MILL"] == 3
    stats = spelling.dictionary_statistics(spark.createDataFrame([("ABC", 2), ("ABD", 3)], "term string, freq bigint")).first()
    assert (stats["terms"], stats["deletes"], stats["total_frequency"], stats["longest"]) == (2, len({"AB", "AC", "BC", "A", "B", "C", "AD", "BD", "D"}), 5, 3)
    impact = spelling.correction_impact(spark.createDataFrame([("ALTN",), ("ALTN",), ("ROAD",)], "t string"), some_dictionary(spark), "t").first()
    assert tuple(impact) == (2, 1, 1)
