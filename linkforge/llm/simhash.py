"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over the hashes of a text's word shingles. Documents
with one fingerprint are one class; classes are compared where they agree on two of four
16-bit chunks, which any two fingerprints at most two bits apart do, so no link is lost.
Within a group the fingerprints are stored as bit planes; a shift of the planes lines up
every member with the one some places on, carry-save counters add up 64 lanes at a time,
and words of lanes that have all passed the radius are given up early.

Each group passes on one edge a member, to the root of its cluster in the group, so a
cluster of any size costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .graph import BLOCK, components, deal
from .storage import materialise

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
CHUNKS, AGREE = 4, 2
#: Rows that are sliced together, and planes between looks for lanes that are still near.
CHUNK_ROWS, LOOK = 65_536, 8


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of the shingles of a text, A-Z lower-cased; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        spans = zip(starts[at : min(n, at + 65_536)].tolist(), last[at : at + 65_536].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Majority bits of 64-bit hashes as a signed number; 0 of none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fingerprints as signed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes of packed bits, one lane a value, with room for shifts at the end."""
    n = len(values)
    words = -(-n // 64) + 2
    bits = np.unpackbits(values.astype(np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _pack(mask: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


def near_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i of valid whose value is within the radius of lane i + shift's."""
    packed = _pack(valid)
    word = np.flatnonzero(packed)
    live = packed[word]
    skip, by = divmod(shift, 64)
    counters = [np.zeros(len(word), np.uint64) for _ in range(int(radius + 1).bit_length())]
    over = np.zeros(len(word), np.uint64)
    for k, plane in enumerate(planes):
        ahead = plane[word + skip]
        if by:
            ahead = (ahead >> np.uint64(by)) | (plane[word + skip + 1] << np.uint64(64 - by))
        carry = plane[word] ^ ahead
        for c in counters:
            new = c & carry
            c ^= carry
            carry = new
        over |= carry
        if k % LOOK == LOOK - 1:
            beyond, equal = over.copy(), ~np.uint64(0)
            for bit in range(len(counters) - 1, -1, -1):
                if radius >> bit & 1:
                    equal = equal & counters[bit]
                else:
                    beyond |= equal & counters[bit]
                    equal = equal & ~counters[bit]
            live &= ~beyond
            near = live != 0
            if not near.all():
                word, live, over = word[near], live[near], over[near]
                counters = [c[near] for c in counters]
            if not len(word):
                return np.zeros(0, np.int64)
    lanes = np.unpackbits(live.view(np.uint8).reshape(len(word), 8), axis=1, bitorder="little").astype(bool)
    return (word[:, None] * 64 + np.arange(64))[lanes]


def near_pairs(group: np.ndarray, side: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, of one group (rows of a group are neighbours) and not of one cut side."""
    rows = np.arange(len(group))
    shift = 1
    while len(rows):
        g, s = group[rows], side[rows]
        planes = bit_planes(values[rows])
        begun = len(rows)
        while True:
            valid = np.zeros(len(rows), bool)
            if shift < len(rows):
                together = g[:-shift] == g[shift:]
                valid[:-shift] = together & ((s[:-shift] == 2) | (s[:-shift] != s[shift:]))
            else:
                together = np.zeros(0, bool)
            if valid.any():
                lanes = near_lanes(planes, shift, valid, radius)
                if len(lanes):
                    yield rows[lanes], rows[lanes + shift]
            shift += 1
            # Rows whose group reaches no further than the shift fall out.
            if 2 * together.sum() < begun:
                _, first, size = np.unique(g, return_index=True, return_counts=True)
                keep = np.zeros(len(rows), bool)
                for a, n in zip(first[size > shift].tolist(), size[size > shift].tolist(), strict=True):
                    keep[a : a + n] = True
                rows = rows[keep]
                break


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking rows a and b."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(root, deeper := root[root]):
            root = deeper


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Batches whose rows are in order of the column _g, as tables of whole groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            g = table.column("_g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def cluster_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches):
        rep, fp = table.column("rep").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        root = np.arange(len(rep))
        for a, b in near_pairs(table.column("_g").to_numpy(), table.column("_side").to_numpy(), fp):
            root = join_roots(root, a, b)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], ["a", "b"])


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of classes(rep, fp): an edge from each member of a cluster to its root, in each group of fingerprints that share two chunks."""
    bits = 64 // CHUNKS
    chunk = [F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(CHUNKS)]
    keys = [
        F.struct(F.lit(t).alias("t"), (chunk[a] * F.lit(1 << bits) + chunk[b]).alias("key"))
        for t, (a, b) in enumerate(combinations(range(CHUNKS), AGREE))
    ]
    spread = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("_k")).select("rep", "fp", "_k.t", "_k.key")
    groups = deal(spread, ["t", "key"], "rep", block).select("rep", "fp", "_g", "_side")
    return groups.repartition("_g").sortWithinPartitions("_g", "_side").mapInArrow(cluster_edges, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest id
    reachable by links, the document's own included. Whole texts are read; a null or
    empty text has fingerprint zero and links like any other. Repeated rows stay. A row
    with a null id links with nothing and has a null component. Other columns are not
    read; an empty table gives no rows.
    """
    marked, _ = materialise(fingerprints(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("bigint")), "fingerprints")
    classes, _ = materialise(marked.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    edges = links(classes, block)
    found = components(edges)
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(labelled, "fp", "left").select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )
