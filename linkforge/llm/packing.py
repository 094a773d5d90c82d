"""Packing documents into fixed-length token sequences.

The plan is made from the histogram of piece lengths alone, which has at most as many
entries as a sequence has tokens. Single lengths, pair sums and triple sums are indexed
by presence; the longest piece left takes one, two or three others that fill its gap
exactly, as often as the counts allow, and what finds no exact filling is packed best
fit, longest first. A plan is a list of patterns, each with the number of sequences
that follow it.

Pieces get their place without meeting in one task: each has a number among those of
its length and task, tasks get offsets from their counts, and the resulting rank falls
in one of the plan's segments for that length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Encoder, list_array, text_slices
from .storage import materialise

SEQUENCE_LENGTH = 2048
Pattern = tuple[int, ...]


class MergingEncoder(Encoder):
    """The same ids, with pieces that were not seen before encoded by a compiled merge loop.

    That loop takes the lower id first, which is the order of merges where ids are given
    in that order, as a vocabulary made by training has them; any other vocabulary keeps
    to the slower way.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        made = [n for n in self.made_by if n >= 0]
        self.library = None
        if made == sorted(made):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in self.specials.values()}
            self.library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_of_segment(self, text: str) -> bytes:
        if self.library is None:
            return super().ids_of_segment(text)
        return array("I", self.library.encode_ordinary(text)).tobytes()


_ENCODERS: dict[str, MergingEncoder] = {}


def encoder(path: str) -> MergingEncoder:
    """This process's encoder for the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MergingEncoder(path)
    return _ENCODERS[path]


def _take(counts: np.ndarray, pattern: Pattern) -> int:
    """How often the pattern can be taken; takes it so often."""
    need: dict[int, int] = {}
    for n in pattern:
        need[n] = need.get(n, 0) + 1
    times = min(int(counts[n]) // k for n, k in need.items())
    for n, k in need.items():
        counts[n] -= times * k
    return times


class SumIndex:
    """Combinations of one, two and three lengths by their sum, under counts that only fall.

    A sum's entry is made when it is first asked for and kept while the counts allow it; a
    sum that has none has none from then on.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pairs: dict[int, Pattern | None] = {}
        self.triples: dict[int, Pattern | None] = {}

    def available(self, pattern: Pattern) -> bool:
        return all(self.counts[n] >= pattern.count(n) for n in set(pattern))

    def pair(self, total: int) -> Pattern | None:
        """Two lengths, the longer first, the shorter as short as can be."""
        found = self.pairs.get(total, ())
        if found is None or (found and self.available(found)):
            return found
        present = self.counts > 0
        short = np.flatnonzero(present[: total // 2 + 1])
        short = short[short > 0]
        fits = short[present[total - short] & ((total - short != short) | (self.counts[short] > 1))]
        self.pairs[total] = (total - int(fits[0]), int(fits[0])) if len(fits) else None
        return self.pairs[total]

    def triple(self, total: int) -> Pattern | None:
        """Three lengths, the first as long as can be, the others a pair no longer than it."""
        found = self.triples.get(total, ())
        if found is None or (found and self.available(found)):
            return found
        self.triples[total] = next(self._triples(total), None)
        return self.triples[total]

    def _triples(self, total: int) -> Iterator[Pattern]:
        present = self.counts > 0
        for a in np.flatnonzero(present[:total])[::-1].tolist():
            rest = total - a
            if 2 * a < rest:
                return
            if self.pair(rest) is None:
                continue
            b = np.flatnonzero(present[: min(a, rest - 1) + 1])
            b = b[(b > 0) & (2 * b >= rest)]
            for x in b[present[rest - b]].tolist():
                if self.available((a, x, rest - x)):
                    yield (a, x, rest - x)

    def filling(self, gap: int, most: int) -> Pattern | None:
        """Up to most lengths that add up to the gap, as few as can be."""
        if self.counts[gap] > 0:
            return (gap,)
        found = self.pair(gap) if most > 1 else None
        return found or (self.triple(gap) if most > 2 else None)


def exact_then_best_fit(lengths: dict[int, int], capacity: int, most: int) -> list[tuple[Pattern, int]]:
    """Exact fillings of up to most pieces, the longest piece first; then best fit."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in lengths.items():
        counts[n] = k
    found: list[tuple[Pattern, int]] = []
    if counts[capacity]:
        found.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    residual = np.zeros_like(counts)
    index = SumIndex(counts)
    for n in range(capacity - 1, 0, -1):
        while counts[n]:
            # The piece itself is not available for its filling.
            counts[n] -= 1
            filling = index.filling(capacity - n, most)
            counts[n] += 1
            if filling is None:
                residual[n], counts[n] = counts[n], 0
            else:
                pattern = (n, *filling)
                found.append((pattern, _take(counts, pattern)))
    return found + best_fit(residual, capacity)


def plan(lengths: dict[int, int], capacity: int = SEQUENCE_LENGTH) -> list[tuple[Pattern, int]]:
    """(pattern, times): all pieces in patterns of at most capacity tokens.

    Triple fillings can use up the short pieces that later gaps would have needed, so
    plans with fillings of up to three, two and one pieces are made and the one with the
    fewest sequences is kept.
    """
    plans = [exact_then_best_fit(lengths, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(k for _, k in p))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first; open sequences with the same content are one entry with a count."""
    open_by_gap: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        for gap in sorted(g for g in open_by_gap if g >= n):
            for pattern in list(open_by_gap[gap]):
                have = open_by_gap[gap][pattern]
                each = gap // n
                full, some = divmod(left, each)
                full = min(full, have)
                if full:
                    open_by_gap[gap - each * n][pattern + (n,) * each] += full
                    left -= full * each
                if full < have and left and some and left < each:
                    open_by_gap[gap - left * n][pattern + (n,) * left] += 1
                    full, left = full + 1, 0
                open_by_gap[gap][pattern] -= full
                if not open_by_gap[gap][pattern]:
                    del open_by_gap[gap][pattern]
                if not left:
                    break
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            if not left:
                break
        if left:
            each = capacity // n
            full, some = divmod(left, each)
            if full:
                open_by_gap[capacity - each * n][(n,) * each] += full
            if some:
                open_by_gap[capacity - some * n][(n,) * some] += 1
    return [(p, k) for by in open_by_gap.values() for p, k in by.items() if k]


def segments(planned: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces a sequence, first offset) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in planned:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            each = pattern.count(n)
            rows[n].append((used[n], sequence, each, offset))
            used[n] += times * each
            offset += n * each
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def tokenised_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32 (ids), task, nth among the task's pieces of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(vocabulary), array("I", [end_id]).tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            for part, texts in text_slices(batch):
                rows, held = [], []
                for n, text in enumerate(texts):
                    ids = known.ids_of_text(text) + end
                    total = len(ids) // 4
                    start, piece = 0, 0
                    stop = total % capacity or capacity
                    while start < total:
                        cut = ids[4 * start : 4 * stop]
                        length = stop - start
                        rows.append((n, piece, start, length, zlib.crc32(cut), task, seen[length]))
                        if with_ids:
                            held.append(cut)
                        seen[length] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                at, piece, start, length, crc, of, nth = map(np.array, zip(*rows, strict=True))
                columns = [part.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(of.astype(np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns + [list_array(held)] * with_ids, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "_task", "_nth", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _nth bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = SEQUENCE_LENGTH,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset (and, with_ids, ids).

    A document is its text's ids and then end_id. One with more than capacity ids is cut
    into pieces of capacity ids, the first of which takes the remainder; no other is cut.
    Pieces of a sequence lie side by side from offset 0. A null or empty text is end_id
    alone; repeated rows are packed each; an empty table has no pieces.
    """
    pieces, _ = materialise(
        tokenised_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), "pieces"
    )
    # At most capacity lengths a task.
    by_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = materialise(by_task, "piece-counts")
    planned = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    places = docs.sparkSession.sparkContext.broadcast(segments(planned))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(first, ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_nth"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            table = places.value[int(lengths[rows[0]])]
            r = ranks[rows]
            first_rank, first_sequence, each, first_offset = table[np.searchsorted(table[:, 0], r, "right") - 1].T
            sequence[rows] = first_sequence + (r - first_rank) // each
            offset[rows] = first_offset + (r - first_rank) % each * lengths[rows]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"), *["ids"] * with_ids
    )
