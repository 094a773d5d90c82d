"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn vectors, unit length and centred on the
sample, into binary codes with balanced bits. Each table's key is a label with some bits
of the codes, bits of its own; vectors that agree on the bits of one table are candidates,
which the original vectors decide in double precision. The number of bits in a key grows
with the largest label, so buckets stay small at any size, and the number of tables grows
with the bits, so that a pair at the threshold is missed with the same probability, MISSED,
at any size (taking a bit to differ as often as the angle's share of a half turn).

A pair that meets in several tables counts in the first of them only, so each task can
pass on counts and one edge a member, never pairs. Equal vectors are one class with a
count, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import BLOCK, components, deal
from .simhash import join_roots, whole_groups
from .storage import materialise

THRESHOLD = 0.98
#: Vectors that the rotations are learned from, and rounds of learning.
SAMPLE_ROWS, ROUNDS = 10_000, 30
#: Least and most bits of a table's key, in whole bytes; classes that a bucket should have on average at most.
LEAST_BITS, MOST_BITS, BUCKET = 8, 32, 64
#: The share of pairs just at the threshold that no table may have, by the model of the docstring.
MISSED = 0.002


@dataclass(frozen=True)
class Rotation:
    """code = sign((unit vector - middle) @ axes), packed in bytes, table by table."""

    middle: np.ndarray
    axes: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit - self.middle) @ self.axes > 0
        return np.packbits(bits, axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, none of them zero; very small and very large components neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def learn(sample: np.ndarray, wanted: int, rounds: int = ROUNDS, seed: int = 0) -> Rotation:
    """wanted axes: principal axes turned so that their signs lose least (alternating codes and Procrustes rotation), several turns of them where they are fewer."""
    n, width = sample.shape
    unit = unit_rows(sample)
    middle = unit.mean(0)
    centred = unit - middle
    _, _, axes = np.linalg.svd(centred, full_matrices=True) if n <= 4 * width else (0, 0, np.linalg.eigh(centred.T @ centred)[1].T[::-1])
    rng = np.random.default_rng(seed)
    found = []
    while sum(a.shape[1] for a in found) < wanted:
        kept = axes[: min(width, wanted)].T
        projected = centred @ kept
        turn, _ = np.linalg.qr(rng.normal(size=(kept.shape[1], kept.shape[1])))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ vt).T
        found.append(kept @ turn)
    return Rotation(middle, np.concatenate(found, 1)[:, :wanted])


def tables_for(largest: int, threshold: float, least_bits: int = LEAST_BITS) -> tuple[int, int]:
    """Bytes of a table's key, by the number of classes of the largest label, and the number of tables."""
    bits = least_bits
    while bits < MOST_BITS and largest / 2**bits > BUCKET:
        bits += 8
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return bits // 8, max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(same**bits, 1 - 1e-12)))))


def compare(batches: Iterator[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) of the members of each group that link with others in it; width: bytes of a table's key."""
    for data in whole_groups(batches, 16_384):
        g = data.column("_g").to_numpy()
        side, rep, count, table, label = (data.column(c).to_numpy() for c in ("_side", "rep", "n", "t", "_label"))
        code = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(g), -1)
        keys = sum(code[:, k::width].astype(np.uint32) << np.uint32(8 * k) for k in range(width))
        lists = data.column("embedding").combine_chunks()
        values = np.asarray(lists.flatten()).astype(np.float64)
        begins = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(g)], strict=True):
            x = unit_rows(values[offsets[a] : offsets[b]].reshape(b - a, -1))
            s = side[a:b]
            near = x @ x.T >= threshold
            near &= (s[:, None] == 2) | (s[:, None] != s[None, :])
            i, j = np.nonzero(np.triu(near, 1))
            # A group is named by a hash: its rows' labels and tables are compared too.
            mine = (label[a:b][i] == label[a:b][j]) & (table[a:b][i] == table[a:b][j])
            i, j = i[mine], j[mine]
            if not len(i):
                continue
            # The first table that has the pair counts it.
            own = table[a:b][i]
            for t in range(int(own.max())):
                mine = (own <= t) | (keys[a + i, t] != keys[a + j, t])
                i, j, own = i[mine], j[mine], own[mine]
            if not len(i):
                continue
            links = np.bincount(i, count[a:b][j], b - a) + np.bincount(j, count[a:b][i], b - a)
            root = join_roots(np.arange(b - a), i, j)
            at = np.flatnonzero(links)
            out.append((rep[a:b][at], links[at].astype(np.int64), rep[a:b][root[at]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "links", "root"])


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    least_bits: int = LEAST_BITS,
) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and their cosine, in double
    precision, is at least threshold. A vector that is null, empty or zero, or holds a
    null or non-finite component, links with nothing, nor do vectors of different widths
    or a row with a null id (component_id null, kept true). Repeated rows link with each
    other. Other columns are not read; an empty table gives no rows. least_bits: bits of a
    table's key at least, a multiple of 8.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes, _ = materialise(
        marked.filter("sound").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes"
    )
    widths = classes.groupBy(F.size("embedding").alias("width"), "label").count().groupBy("width").agg(F.max("count").alias("largest")).collect()
    edges = None
    for width, largest in [(r["width"], r["largest"]) for r in widths]:
        of_width = classes.filter(F.size("embedding") == width)
        sample = of_width.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").collect()
        key_bytes, tables = tables_for(largest, threshold, least_bits)
        rotation = vectors.sparkSession.sparkContext.broadcast(learn(np.array([r[0] for r in sample], np.float64), 8 * key_bytes * tables))

        def encode(batches: Iterator[pa.RecordBatch], rotation=rotation) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                lists = batch.column(3)
                v = np.asarray(lists.flatten()).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
                if batch.num_rows:
                    codes = rotation.value.codes(unit_rows(v))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["rep", "n", "label", "embedding", "code"])

        kinds = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in ("rep", "n", "label", "embedding"))
        coded = of_width.select("rep", "n", "label", "embedding").mapInArrow(encode, f"{kinds}, code binary")
        keys = [F.struct(F.lit(t).alias("t"), F.substring("code", t * key_bytes + 1, key_bytes).alias("key")) for t in range(tables)]
        spread = coded.select("*", F.explode(F.array(*keys)).alias("_k")).select("rep", "n", "label", "embedding", "code", "_k.t", "_k.key")
        groups = deal(spread, ["label", "t", "key"], "rep", block).select("rep", "n", "embedding", "code", "t", F.xxhash64("label", F.lit(17)).alias("_label"), "_g", "_side")

        def run(batches: Iterator[pa.RecordBatch], width=key_bytes) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            yield from compare(batches, threshold, width)

        found = groups.repartition("_g").sortWithinPartitions("_g", "_side").mapInArrow(run, "rep bigint, links bigint, root bigint")
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = vectors.sparkSession.createDataFrame([], "rep bigint, links bigint, root bigint")
    edges, _ = materialise(edges, "vector-links")
    linked = edges.groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(edges.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = (
        classes.join(linked, "rep", "left").join(reach, classes["rep"] == reach["node"], "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    good = marked.filter("sound").select("id", "label", "embedding").join(told, ["label", "embedding"]).select("id", "n_links", "component_id")
    other = marked.filter("not sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(other).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
