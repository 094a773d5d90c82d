"""Exact deduplication against a dictionary of normalised texts."""

import hashlib
import re

import pytest
from linkforge.llm import exact_dedup as E

SCHEMA = "doc_id bigint, text string, bucket int, owner string, _nth string, h string, keep_id string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def rows_of():
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\nb", "é" * 9000, "word " * 30_000]
    rows = [(n, texts[n % len(texts)]) for n in range(60)] + [(n, f"own text {n}") for n in range(100, 160)]
    rows += [(n, "hot copy") for n in range(300, 340)] + [(300, "hot  copy")] * 3 + [(None, "hot copy"), (None, "nobody"), (None, "nobody"), (7, "own text 100"), (7, "again"), (7, "again")]
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(n, t, 1, "o", "n", "h", "k") for n, t in rows], SCHEMA).repartition(5)


def wanted(rows):
    by = {}
    for n, t in rows:
        by.setdefault(norm(t), []).append(n)
    want = []
    for t, ids in by.items():
        known = [n for n in ids if n is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        seen = False
        for n in ids:
            kept = n == keep and not seen
            seen |= kept
            want.append((n, keep, len(ids), kept, sha))
    return sorted(want, key=str)


@pytest.mark.parametrize("hot_rows", [1000, 10])
@pytest.mark.parametrize("capacity", [50_000, 1])
def test_rows_are_those_of_a_dictionary(spark, hot_rows, capacity):
    rows = rows_of()
    got = E.exact_dedup(docs_of(spark, rows), capacity=capacity, hot_rows=hot_rows).collect()
    assert sorted(map(tuple, got), key=str) == wanted(rows)
    stay = E.first_copies(docs_of(spark, rows), capacity=capacity, hot_rows=hot_rows)
    assert stay.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(((r["doc_id"], norm(r["text"])) for r in stay.collect()), key=str) == sorted(
        ((n, t) for t in {norm(t) for _, t in rows} for n in [min((m for m, x in rows if norm(x) == t and m is not None), default=None)]), key=str
    )


def test_empty_table(spark):
    empty = docs_of(spark, rows_of()).limit(0)
    assert E.exact_dedup(empty).collect() == [] and E.first_copies(empty).collect() == []


def test_chains_are_told_apart_by_bytes(spark, monkeypatch):
    """With a hash that all texts share, the owner still keeps different texts apart."""
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: E.F.length(c[0]).cast("bigint"))
    rows = [(n, t) for n, t in rows_of() if n is None or n < 400]
    for hot_rows in (1000, 10):
        got = E.exact_dedup(docs_of(spark, rows), hot_rows=hot_rows).collect()
        assert sorted(map(tuple, got), key=str) == wanted(rows)
    index, _, _ = E.build_index(docs_of(spark, rows))
    assert index.agg({"chain": "max"}).first()[0] > 10


def test_lookup_reads_its_buckets_only(spark):
    rows = [(n, f"text number {n}") for n in range(500)]
    index, path, directory = E.build_index(docs_of(spark, rows), capacity=4)
    assert len(directory.local_depths) > 8 and directory.owners > 4
    assert E.index_buckets(spark, path).agg({"entries": "sum"}).first()[0] == 500
    probe = spark.createDataFrame([("text  number 7", 1), ("absent", 2), (None, 3)], "text string, bucket int")
    found = E.lookup(index, directory, probe)
    assert {r["text"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {"text  number 7": (7, 1), "absent": (None, None), None: (None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "owner#" in plan.split("PartitionFilters: [")[1][:60] and "In(bucket" in plan.split("PushedFilters: [")[1][:60]
