import hashlib

import pytest

from linkforge.llm import warc
from linkforge.llm.storage import new_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, extra string")


@pytest.mark.parametrize("split", ["700b", "128m"])
def test_round_trip_with_magic_inside_payloads(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = [(n, f"http://h/{n}", ("x" * (37 * n % 900)) + FAKE * (n % 4) + "é\r\n\r\n" * (n % 3), "e") for n in range(60)]
        rows += [(100, None, None, None), (101, "u", "", ""), (102, "a\r\nb", "z" * 1500, ""), (103, "c", "z" * 1500, ""), (104, "c", "y" * 999, ""), (105, "c", "y" * 999, "")]
        rows += [(200 + n, "c", FAKE * 200, "") for n in range(3)]
        got = {r["page_id"]: r for r in warc.round_trip(pages_of(spark, rows)).collect()}
        assert set(got) == {r[0] for r in rows}
        for n, _, html, _ in rows:
            data = (html or "").encode()
            assert (got[n]["payload_bytes"], got[n]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()), n
            same = [m for m, _, h, _ in rows if (h or "").encode() == data]
            first = max(same) if len(data) >= 1000 else n
            assert (got[n]["record_type"], got[n]["refers_to"]) == (("response", None) if first == n else ("revisit", first))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_come_back(spark):
    rows = [(1, "http://a/", "one" + FAKE + "two", ""), (2, "http://b/", "plain", "")]
    path = new_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, rows), path)
    read = warc.read_archives(spark, path, with_payload=True)
    assert {(r["target_uri"], bytes(r["payload"]).decode()) for r in read.collect()} == {(u, h) for _, u, h, _ in rows}


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, [])).collect() == []


def test_repeated_and_missing_ids_keep_their_own_payloads(spark):
    a, b, c = "a" * 1200, "b" * 1200, "c" * 1200
    rows = [(5, "u", a, ""), (5, "u", b, ""), (5, "u", c, ""), (9, "u", a, ""), (8, "u", b, ""), (9, "u", a, ""), (None, "u", a, ""), (None, "u", "d" * 1200, ""), (None, None, None, "")]
    got = sorted(map(tuple, warc.round_trip(pages_of(spark, rows)).collect()), key=str)
    largest = {a: 9, b: 8, c: 5, "d" * 1200: None, None: None}
    want = []
    for n, _, html, _ in rows:
        data = (html or "").encode()
        first = largest[html]
        revisit = first is not None and n != first
        want.append((n, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
