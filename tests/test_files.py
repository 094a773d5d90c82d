import json

import pytest
from pyspark.sql import functions as F

from linkforge.functions.places import to_latitude_longitude
from linkforge.sinks import results
from linkforge.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_gazetteer(spark, tmp_path):
    path = write(
        tmp_path / "g.csv",
        "\ufeffLOCADDRESS,ogc_fid,easting,northing,lgcstatusc,bs7666uprn,bs7666usrn,landparcel,blpuclass,postal\n"
        '"12 Mill Rd, Alton, GU34 1AB",1,470000.5,140000,1,100012345678,77,,RD06,Y\n'
        "short,row\n"
        '"No number",2,1,2,1,,,,,N\n'
        '"No place, Alton",3,x,2,1,5,,,,\n'
        ',4,1,2,1,6,,,,yes\n',
    )
    staging = files.read_gazetteer(spark, path)
    assert staging.count() == 4 and staging.columns == list(files.GAZETTEER_COLUMNS)
    rows = files.gazetteer_dimension(staging).collect()
    assert [(r["uprn"], r["easting"], r["postal"], r["pc"]) for r in rows] == [("100012345678", 470000.5, True, "GU341AB")]
    known = spark.createDataFrame([("9",)], "uprn string")
    locations, addresses = files.new_addresses(files.gazetteer_dimension(staging), known)
    assert locations.count() == addresses.count() == 1
    assert files.new_addresses(files.gazetteer_dimension(staging), locations)[0].count() == 0


def test_national_places(spark, tmp_path):
    path = write(tmp_path / "n.csv", "UPRN,X_COORDINATE,Y_COORDINATE,LATITUDE,LONGITUDE\n1,10,20,51.5,-1\n,10,20,51,-1\n2,,20,51,-1\n3,10,y,51,-1\n4,1,2,,\n")
    rows = files.read_national(spark, path)
    assert sorted(r["uprn"] for r in rows.collect()) == ["1", "4"]
    gaz = spark.createDataFrame([("1", 7), ("8", 9)], "uprn string, a int")
    assert {(r["uprn"], r["latitude"]) for r in files.located(gaz, rows).collect()} == {("1", 51.5), ("8", 0.0)}


def test_documents_of_all_types(spark, tmp_path):
    decision = write(
        tmp_path / "d.csv",
        "\ufeffJob Number,Filepath,Planning Application Number,Adress,Decision Date,Decision Type,Document Type,BS7666UPRN,Easting,Northing\n"
        '7,C:\\scans\\a\\one.pdf,20001/001,"1 High St, Alton",3/7/1999,GRANT,Notice,100,1.5,2\n'
        "8,C:\\x.pdf,20002,,3/7/1999,G,N,,,\n9,too,few\n"
        '10,D:\\y.pdf,20003,"2 High St",31/12/04,G,N,,bad,\n',
    )
    agreement = write(tmp_path / "a.csv", "Job Number,Filepath,Address,Date,BS7666UPRN,Easting,Northing\n1,/p/q/ref.pdf,3 Oak Lane,2001-02-03,,,\n")
    maps = write(tmp_path / "m.csv", "job_number,filepath,enlargement_map_number\n1,a\\b.tif,SU71\n")
    rows = {r["raw_address"]: r for r in files.read_all_documents(spark, {"decision": decision, "agreement": agreement, "maps": maps}).collect()}
    assert set(rows) == {"1 High St, Alton", "2 High St", "3 Oak Lane", "Map SU71"}
    one = rows["1 High St, Alton"]
    assert (one["filepath"], one["external_reference"], str(one["document_date"]), one["easting"], one["raw_uprn"]) == ("C:\\scans\\a\\one.pdf", "20001/001", "1999-07-03", 1.5, "100")
    assert str(rows["2 High St"]["document_date"]) == "2004-12-31" and rows["2 High St"]["easting"] is None
    assert (rows["3 Oak Lane"]["external_reference"], str(rows["3 Oak Lane"]["document_date"])) == ("ref.pdf", "2001-02-03")
    swapped = files.to_documents(files.read_documents(spark, decision, "decision", positional=True), "decision")
    assert swapped.count() == 2


@pytest.mark.parametrize(
    ("text", "date"),
    [("1/2/1999", "1999-02-01"), ("01/02/1999", "1999-02-01"), ("1/2/99", "2099-02-01"), ("01/02/05", "2005-02-01"), ("1999-02-01", "1999-02-01"), ("", None), ("1/13/1999", None), ("32/1/1999", None), ("x", None), (None, None)],
)
def test_dates(spark, text, date):
    got = spark.createDataFrame([(text,)], "d string").select(files.parse_date("d").alias("d")).first()["d"]
    assert got == date or str(got) == date


def test_unmatched_and_eligible(spark):
    docs = spark.createDataFrame([(1, "a", "N A", "", 1.0, 1.0), (2, "b", "12 Some Long Road, Alton", "GU1 1AA", None, 2.0), (3, "a", "12 High Road", "", 0.0, 5.0)], "doc_id bigint, doc_type string, raw_address string, pc string, easting double, northing double")
    done = spark.createDataFrame([(2,)], "doc_id bigint")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(files.unmatched(docs, done)) == [1, 3] and ids(files.unmatched(docs, done, "a", after=1)) == [3] and ids(files.unmatched(docs, done, limit=1)) == [1]
    assert [ids(files.eligible(docs, s)) for s in ("spatial", "postcode", "hierarchical", "vector")] == [[1], [2], [2, 3], [2]]


def test_exports_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x, \"y\"", 0.5, "100", 7), (2, None, "z", None, None, None)], "doc_id bigint, doc_type string, raw_address string, score double, uprn string, address_id bigint")
    rows = rows.withColumn("match_status", results.match_status(F.col("uprn"), F.col("score"))).withColumn("confidence", F.col("score"))
    results.export_by_type(rows, str(tmp_path / "out"))
    back = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "out"))
    got = {r["Source_ID"]: r for r in back.collect()}
    assert back.columns[:24] == [t for t, _ in results.EXPORT_COLUMNS]
    assert (got["1"]["Match_Score"], got["1"]["Match_Status"], got["1"]["Original_Address"], got["1"]["_type"]) == ("0.500", "NEEDS_REVIEW", 'x, "y"', "a")
    assert (got["2"]["Match_Status"], got["2"]["_type"], got["2"]["Match_Score"]) == ("UNMATCHED", "none", None)
    assert results.guarded(rows, 2).count() == 2
    with pytest.raises(ValueError):
        results.guarded(rows, 1)
    results.snapshot(rows, str(tmp_path / "snap"), "one")
    results.snapshot(rows.filter("doc_id = 1"), str(tmp_path / "snap"), "two")
    assert [tuple(r) for r in results.compare_snapshots(spark, str(tmp_path / "snap"), ["one", "two"]).collect()] == [("one", 2, 1, 0.5), ("two", 1, 1, 0.5)]
    results.write_views({"v": rows.select("doc_id")}, str(tmp_path / "views"))
    assert spark.read.option("header", True).csv(str(tmp_path / "views" / "v")).count() == 2


def test_results_audit_and_overrides(spark):
    candidates = spark.createDataFrame([(1, n, "m", 1 - n / 10) for n in range(8)] + [(2, 3, "m", 0.5)], "doc_id bigint, address_id bigint, method string, score double")
    kept = results.result_rows(candidates.withColumn("features", F.struct("score")), 9, 3).collect()
    assert [(r["address_id"], r["tie_rank"]) for r in sorted(kept, key=lambda r: (r["doc_id"], r["tie_rank"]))] == [(0, 1), (1, 2), (2, 3), (3, 1)]
    decisions = spark.createDataFrame([(1, 0, "m", 1.0, "accepted", "auto"), (2, 9, "m", 0.9, "accepted", "auto")], "doc_id bigint, address_id bigint, method string, score double, decision string, decided_by string")
    audit = results.audit_rows(candidates, decisions)
    assert {(r["doc_id"], r["address_id"], r["decision"]) for r in audit.collect()} == {(1, 0, "accepted"), (2, 9, "accepted"), (2, 3, "not_selected"), *((1, n, "not_selected") for n in range(1, 5))}
    none = spark.createDataFrame([], "doc_id bigint, address_id bigint, method string, score double")
    accepted = results.accept(none, decisions)
    assert {(r["doc_id"], r["address_id"]) for r in accepted.collect()} == {(1, 0), (2, 9)}
    history = spark.createDataFrame([], "doc_id bigint, address_id bigint, method string, score double, decided_by string, decided_at string")
    changes = spark.createDataFrame([(1, 5, "ann"), (2, None, "ann")], "doc_id bigint, address_id bigint, decided_by string")
    now, history = results.override(accepted, history, changes, "2026-01-01")
    assert [tuple(r) for r in now.collect()] == [(1, 5, "manual", 1.0)] and history.count() == 2
    assert [r["decision"] for r in results.decision_history(audit, history, 1).collect()][:2].count("override") == 1
    run = results.run_completed(results.run_started(spark, 1, "x", "a"), decisions.withColumn("decision", F.lit("auto_accepted")), "b").first()
    assert (run["documents"], run["matched"], run["completed_at"]) == (2, 2, "b")


def test_features_have_degrees(spark):
    rows = spark.createDataFrame([(1, 651409.903, 313177.270, None), (2, None, 1.0, "x"), (3, 400000.0, 100000.0, "y")], "doc_id bigint, easting double, northing double, note string")
    latitude, longitude = to_latitude_longitude(F.col("easting"), F.col("northing"))
    got = rows.filter("doc_id = 1").select(latitude.alias("lat"), longitude.alias("lng")).first()
    # A published worked example of the grid, within some metres.
    assert abs(got["lat"] - 52.657977) < 1e-4 and abs(got["lng"] - 1.716038) < 1e-4
    found = json.loads(results.feature_collection(rows, ["doc_id", "note"]))
    assert found["type"] == "FeatureCollection" and [f["properties"] for f in found["features"]] == [{"doc_id": 1, "note": None}, {"doc_id": 3, "note": "y"}]
    assert json.loads(results.feature_collection(rows, ["doc_id"], bounds=(1.0, 50.0, 2.0, 60.0)))["features"][0]["properties"] == {"doc_id": 1}
