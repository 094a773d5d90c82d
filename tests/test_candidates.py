from linkforge.plans import catalogue
from linkforge.plans.demo import World

SF = "/root/testdata/sf0.001"


def test_postcode_scores_every_address_of_the_postcode(spark):
    w = World(spark, SF)
    docs, gaz = w.docs.select("doc_id", "pc").collect(), w.gaz.select("address_id", "pc").collect()
    want = {(d["doc_id"], g["address_id"]) for d in docs for g in gaz if d["pc"] and d["pc"] == g["pc"]}
    assert {(r["doc_id"], r["address_id"]) for r in catalogue.queries()["j14_postcode"](spark, SF).collect()} == want


def test_postcode_keeps_addresses_of_little_similarity(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "LAND AT REAR GU341AP", "GU34 1AP")], "doc_id bigint, can string, pc string")
    gaz = spark.createDataFrame([(7, "12 CHURCH ROAD ALTON", "GU34 1AP", "12"), (8, "12 CHURCH ROAD ALTON", "GU34 1AB", "12")], "address_id bigint, can string, pc string, house string")
    monkeypatch.setattr(World, "docs", property(lambda w: docs))
    monkeypatch.setattr(World, "gaz", property(lambda w: gaz))
    assert [r["address_id"] for r in catalogue.queries()["j14_postcode"](spark, "none").collect()] == [7]


def test_spatial_scores_every_address_in_reach(spark):
    w = World(spark, SF)
    docs = w.docs.filter("easting is not null").select("doc_id", "easting", "northing").collect()
    gaz = w.gaz.select("address_id", "easting", "northing").collect()
    want = {(d[0], g[0]) for d in docs for g in gaz if (d[1] - g[1]) ** 2 + (d[2] - g[2]) ** 2 <= 100.0**2}
    assert {(r["doc_id"], r["address_id"]) for r in catalogue.queries()["d7_spatial_score"](spark, SF).collect()} == want
