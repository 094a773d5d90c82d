"""Record changes, filters, the calendar and golden records case by case."""

import pytest

from linkforge.operators import records
from linkforge.plans import catalogue

from .test_queries import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", ["x5_calendar", "c6_record_filter", "k13_changes", "dd18_golden_pairs", "ag13_run_statistics"])
def test_same_rows(spark, duck, name):  # noqa: F811
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([[r[n] for n in place] for r in want.fetchall()])


def test_calendar_edges(spark):
    assert records.calendar(spark, "2024-02-28", "2024-03-01").count() == 3
    assert records.calendar(spark, "2024-03-01", "2024-02-28").count() == 0
    r = records.calendar(spark, "2024-03-31", "2024-04-01").orderBy("date_id").collect()
    assert [(x.day_name, x.day_of_week, x.financial_year, x.financial_quarter) for x in r] == [("Sunday", 0, 2023, 4), ("Monday", 1, 2024, 1)]


def test_changes_keep_what_was_before(spark):
    base = spark.createDataFrame([(1, 5, "fuzzy", 1.0, 2.0, "x"), (2, None, None, None, None, "y"), (3, 6, "fuzzy", 3.0, 4.0, "z")], "doc_id long, address_id long, method string, easting double, northing double, extra string")
    actions = spark.createDataFrame(
        [(2, 1, "reject", None, None, None, None, "c"), (1, 1, "accept", 9, None, None, None, "c"), (3, 2, "accept", 7, None, None, "seen", "c"), (4, 2, "set_coordinates", None, 8.0, 9.0, None, "c"), (5, 99, "accept", 1, None, None, None, "c"), (6, 3, "erase", None, None, None, None, "c")],
        "seq int, doc_id long, action string, address_id long, easting double, northing double, note string, decided_by string",
    )
    now, audit = records.changed(base, actions, "2024-01-01")
    assert sorted(map(tuple, now.collect())) == [(1, None, None, 1.0, 2.0, "x"), (2, 7, "manual", 8.0, 9.0, "y"), (3, 6, "fuzzy", 3.0, 4.0, "z")]
    assert sorted((r.seq, r.doc_id, r.action) for r in audit.collect()) == [(1, 1, "accept"), (2, 1, "reject"), (3, 2, "accept"), (4, 2, "set_coordinates")]
    assert '"address_id":5' in audit.filter("seq = 2").first().before


def test_filters_that_are_absent_test_nothing(spark):
    df = spark.createDataFrame([("a", 0.5, "1 HIGH_ST"), ("b", None, None), ("c", 0.7, "1 HXST")], "doc_type string, confidence double, raw_address string")
    assert records.filtered(df).count() == 3
    # Wildcards are plain characters: the first row has them, the last one only fits them.
    assert records.filtered(df, search="high%").count() == 0 and [r.doc_type for r in records.filtered(df, search="h_s").collect()] == ["a"]
    assert records.filtered(df, search="H_ST", least=0.5, most=0.5).count() == 1


def test_golden_pairs_of_nothing(spark):
    assert records.golden_pairs(spark.createDataFrame([], "doc_id long, app_base string, address_id long, confidence double")).count() == 0
