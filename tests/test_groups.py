from linkforge.config import GroupLimits
from linkforge.operators import groups

SCHEMA = "doc_id bigint, app_base string, raw_address string, address_id bigint, confidence double, method string"
A, B, REF = "12 MILL ROAD, ALTON", "9 OAK LANE, LISS", "AU12345"


def fact(spark, members):
    return spark.createDataFrame([(n, *m, None if m[2] is None else "addr_exact") for n, m in enumerate(members)], SCHEMA)


def test_safe_groups_and_corrections(spark):
    rows = [("ok", A, 1, 0.9), ("ok", A, 1, 0.8), ("ok", A, None, None), ("ok", B, 2, 0.97)]  # two votes of three matches
    rows += [("one_vote", A, 1, 0.9), ("one_vote", A, None, None)]
    rows += [("all_matched", A, 1, 0.9), ("all_matched", A, 1, 0.9)]
    rows += [("references", A, 1, 0.9), ("references", A, 1, 0.9), ("references", REF, None, None), ("references", REF, None, None)]
    rows += [("weak", A, 1, 0.9), ("weak", A, 1, 0.9), ("weak", A, 1, 0.45), ("weak", A, None, None), ("weak", REF, None, None)]
    rows += [("many", A, 1, 0.9)] * 20 + [("many", A, None, None)] * 11
    rows += [(None, A, 1, 0.9), (None, A, None, None)]
    safe = {r["app_base"]: r for r in groups.safe_groups(fact(spark, rows)).collect()}
    assert set(safe) == {"ok", "weak"} and safe["ok"]["votes"] == 2 and safe["weak"]["n_real"] == 4
    got = {(r["doc_id"], r["original"], r["corrected"], r["confidence"]) for r in groups.corrections(fact(spark, rows)).collect()}
    weak = next(n for n, r in enumerate(rows) if r[0] == "weak")
    assert got == {(2, None, 1, 0.85), (3, 2, 1, 0.85), (weak + 2, 1, 1, 0.85), (weak + 3, None, 1, 0.85)}
    done = {r["doc_id"]: (r["address_id"], r["is_corrected"]) for r in groups.effective(fact(spark, rows), groups.corrections(fact(spark, rows))).collect()}
    assert done[2] == (1, True) and done[0] == (1, False) and len(done) == len(rows)


def test_levels_ties_and_variations(spark):
    rows = [("five", A, 1, 0.9)] * 5 + [("five", A, None, None)] + [("three", A, 1, 0.9)] * 3 + [("three", A, None, None)]
    rows += [("tie", A, 7, 0.9), ("tie", A, 7, 0.6), ("tie", A, 5, 0.9), ("tie", A, 5, 0.7), ("tie", A, None, None)]
    rows += [("varied", f"{n} SOME ROAD, ALTON", 1 if n < 3 else None, 0.9 if n < 3 else None) for n in range(6)]
    got = {r["app_base"]: (r["corrected"], r["confidence"]) for r in groups.corrections(fact(spark, rows)).collect() if r["original"] is None}
    assert got == {"five": (1, 0.95), "three": (1, 0.90), "tie": (5, 0.85)}
    strict = groups.safe_groups(fact(spark, rows), GroupLimits(most_variations=6))
    assert "varied" in {r["app_base"] for r in strict.collect()}
