"""Recall of links just above the threshold, by brute force, at every width of the tables' keys."""

import numpy as np
import pytest
from linkforge.llm import itq
from linkforge.llm.itq import near_vectors

SCHEMA = "vec_id bigint, embedding array<double>, label string, t int, rep string, n string"


def planted(n, width, cosine, seed):
    rng = np.random.default_rng(seed)
    x = itq.unit_rows(rng.normal(size=(n, width)))
    other = rng.normal(size=(n, width))
    other = itq.unit_rows(other - (other * x).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * other


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_recall_is_the_same_at_every_key_width(spark, bits):
    x, y = planted(1500, 64, 0.981, bits)
    rows = [(2 * n + k, v[n].tolist(), "a", 0, "", "") for n in range(len(x)) for k, v in enumerate((x, y))]
    every = np.stack([x, y], 1).reshape(-1, 64)
    links = np.triu(every @ every.T >= 0.98, 1).sum()
    assert links == len(x)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), least_bits=bits, block=256).collect()
    assert len(got) == len(rows) and all(r["n_links"] <= 1 for r in got)
    assert sum(r["n_links"] for r in got) / 2 >= 0.985 * links
    assert all(r["component_id"] == r["vec_id"] // 2 * 2 for r in got if r["n_links"])


def test_widths_and_tables_grow_together():
    shapes = [itq.tables_for(n, 0.98) for n in (1, 10**4, 10**6, 10**8, 10**12)]
    assert shapes == sorted(shapes) and shapes[0][0] == 1 and shapes[-1][0] == 4
    same = 1 - np.arccos(0.98) / np.pi
    assert all((1 - same ** (8 * b)) ** t <= itq.MISSED for b, t in shapes)


def test_extreme_components_and_empty_table(spark):
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1.0, 2.0], "a"), (3, [1e300, 2e300], "a"), (4, [-1.0, -2.0], "a"), (5, [1.0, 2.0], "b"), (6, [1e-310, 2e-310], "a")]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)).collect()}
    assert [got[n]["n_links"] for n in (1, 2, 3, 4, 5)] == [3, 3, 3, 0, 0] and got[3]["component_id"] == 1
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
