"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from linkforge.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "n_canonical", "n_enhanced", "n_clean", "p_house_numbers", "p_parse_v2", "p_pair_decision", "m_trigram", "m_bow_cosine", "f_phonetic_b", "j2_canonical_equi",
    "j8_trigram_topk", "j16_grid_radius", "j34_merge_keep", "d3_margin_decision", "a1_deterministic", "g1_consensus_winner", "r6_integrity", "r8_match_rate_by_type", "st1_recent_counts",
)


def rows(values):
    def plain(v):
        return "" if v is None else f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.sql(f"create view {p[:-8]} as select * from '{SF}/{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([[r[n] for n in place] for r in want.fetchall()])


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())
