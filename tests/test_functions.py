"""Cases of the address functions, stated one by one."""

import pytest

from linkforge.functions import text as T
from linkforge.functions.dialect import SPARK
from linkforge.plans import catalogue, further

CANONICAL = [
    ("12 High St, Alton, GU34 1AB", "GU341AB"), ("flat 2, 3 mill rd", ""), ("", ""), ("Land adj to Oak Ln, Liss GU33 7AA", "GU337AA"),
]


@pytest.mark.parametrize(("text", "postcode"), CANONICAL)
def test_postcode_and_canonical(spark, text, postcode):
    row = spark.createDataFrame([(text,)], "x string").selectExpr(f"{T.postcode(SPARK, 'x')} as pc", f"{T.canonical(SPARK, 'x')} as can").first()
    assert row["pc"] == postcode and row["can"] == row["can"].upper().strip() and "  " not in row["can"]
    assert not postcode or postcode not in row["can"].replace(" ", "")


def test_abbreviations_become_words(spark):
    row = spark.createDataFrame([("12 High St, 3 Oak Rd and 4 Elm Ave",)], "x string").selectExpr(f"{T.canonical(SPARK, 'x')} as can").first()
    assert "STREET" in row["can"] and "ROAD" in row["can"] and "AVENUE" in row["can"]


@pytest.mark.parametrize(("text", "real"), [("12 MILL ROAD, ALTON", True), ("AU12345", False), ("N/A", False), ("short", False), ("20001/001", False), ("Some place, Liss", True), (None, False)])
def test_real_addresses(spark, text, real):
    assert spark.createDataFrame([(text,)], "x string").selectExpr(f"{T.is_real_address(SPARK, 'x')} as r").first()["r"] is real


def test_land_phrase_is_taken_out_once(spark):
    rows = spark.createDataFrame([("LAND AT LAND AT MILL LANE",), ("12 MILL LANE",), ("REAR, LAND TO REAR OF OAK",)], "x string")
    got = [r[0] for r in rows.selectExpr(further.without_land(SPARK, "x")).collect()]
    assert got == ["LAND AT MILL LANE", "12 MILL LANE", "REAR,  OAK"]


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries()) and len(catalogue.queries()) > 190
