"""Near-duplicate texts by the exact Jaccard similarity of their word shingles.

Two sets whose similarity reaches t share a member among the first n - ceil(t n) + 1 of
each in any one order of all shingles, so texts are compared where they share one of
those; no pair is lost. The order is that of the hashes, but shingles that a sample of
the texts repeats come last: the sample changes which pairs are looked at, not which are
found. SimHash comes first: texts whose fingerprints of five-word shingles are within
op6's radius meet by its operator, and those alike in their sets are linked. It cannot find
all: at similarity 0.8 two fingerprints differ in ten bits on average. The prefixes find the rest.

Pairs are first held against a bound: a text's signature has a bit for the parity of its
shingles in each of SIGNATURE_BITS buckets, and two sets differ in no fewer members than
their signatures differ in bits. Only pairs within that bound have their whole sets compared.

Texts that share a shingle are first compared with one of them, in ROUNDS rounds with
another one each. What that links is one cluster. Where a shingle still has many texts
outside its largest cluster, those are compared with HEADS of its members, again while
half of the pairs link. Then every pair that is still in two clusters is held
against the bound, the rows of a shingle's largest cluster only with the others, so a
cluster costs about as many comparisons as it has members. Of the shingles that such a pair
shares, only those count that have no shared one among the BEFORE ahead of them in both
prefixes: the first always does, so no pair is lost.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_slices
from .graph import BLOCK, components
from .simhash import SEED, links, majority
from .storage import batches_of, discard, materialise

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: One text of so many is in the sample; shingles of so many of its texts come last in the order, at most LATE of them.
SAMPLE, OFTEN, LATE = 8, 3, 1 << 20
SIGNATURE_BITS, ROUNDS = 512, 2
#: Texts outside its largest cluster that make a shingle busy, members that those are compared with, most rounds of that.
BUSY, HEADS, MORE_ROUNDS = 8, 4, 4
#: Open shingles ahead of its own that a row keeps.
BEFORE = 6
#: Whole texts that a Python worker gets at once, and characters of texts whose sets it hands back at once.
TEXT_ROWS, SLICE_CHARS = 256, 1 << 20


def shingle_set(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted XXH64 of a text's different shingles, A-Z lower-cased; a shorter text is one shingle, one without a word has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def give_back() -> None:
    """Free memory of this worker goes back to the machine: the worker stays for other stages, whose executor it shares."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sets_of(docs: DataFrame, shingle_words: int, make: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """(id, *make(shingles)) of docs(id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(f"id bigint, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, chars=SLICE_CHARS):
                columns = list(zip(*[make(shingle_set(t, shingle_words)) for t in texts], strict=True))
                if columns:
                    made = [pa.array(list(c), f.type) for c, f in zip(columns, list(types)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *made], types.names)
        give_back()

    return docs.mapInArrow(run, f"id bigint, {schema}")


def alike(a: Column, b: Column, shared: Column, least: float) -> Column:
    """Whether sets of a and b members that share so many reach the similarity."""
    return shared >= least * (a + b - shared) - 1e-9


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each bucket, as 64-bit words."""
    counts = np.bincount((shingles.view(np.uint64) % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS)
    return np.packbits(counts & 1 == 1, bitorder="little").view(np.int64)


def within_bound(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Those of pairs(x, y) whose signatures allow the similarity; signatures: (key, n, sig)."""
    x = signatures.select(F.col("key").alias("x"), "n", "sig")
    y = signatures.select(F.col("key").alias("y"), F.col("n").alias("m"), F.col("sig").alias("sig_y"))
    return pairs.join(x, "x").join(y, "y").filter(bound("n", "sig", "m", "sig_y", least)).select("x", "y")


def bound(n: str, sig: str, m: str, other: str, least: float) -> Column:
    differ = sum((F.bit_count(F.col(sig)[k].bitwiseXOR(F.col(other)[k])) for k in range(SIGNATURE_BITS // 64)), F.lit(0))
    # Sets of n and m members that share s differ in n + m - 2 s, which is most at the least s.
    return differ <= (F.col(n) + F.col(m)) * F.lit((1 - least) / (1 + least)) + 1e-6


def simhash_pairs(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y): keys of classes(key, fp) that op6's operator links, and those of one fingerprint with the smallest."""
    same, _ = materialise(classes.groupBy("fp").agg(F.min("key").alias("rep")), "shingle-fingerprints")
    star = classes.select("key", "fp").join(same, "fp").filter("key != rep").select(F.col("key").alias("x"), F.col("rep").alias("y"))
    pairs, _ = materialise(star.union(links(same, block).select(F.col("a").alias("x"), F.col("b").alias("y"))).distinct(), "shingle-simhash")
    return pairs


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """(a, b): the smallest ids of pairs(x, y) of classes that reach the similarity, as a table."""
    needed = pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct().join(classes.select("key", "rep"), "key")
    texts = docs.join(needed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    made = sets_of(texts, shingle_words, lambda s: (class_key(s), s), "key bigint, shingles array<bigint>")
    # An id may have other texts: the key tells which is meant.
    sets, path = materialise(made.join(needed.withColumnRenamed("rep", "id"), ["key", "id"], "left_semi").dropDuplicates(["key"]), "shingle-sets", TEXT_ROWS)
    x = sets.select(F.col("key").alias("x"), F.col("id").alias("a"), F.col("shingles").alias("p"))
    y = sets.select(F.col("key").alias("y"), F.col("id").alias("b"), F.col("shingles").alias("q"))
    met = pairs.join(x, "x").join(y, "y").withColumn("shared", F.size(F.array_intersect("p", "q")))
    found, _ = materialise(met.filter(alike(F.size("p"), F.size("q"), F.col("shared"), least)).select("a", "b"), "shingle-edges")
    discard(docs.sparkSession, path)
    return found


def class_key(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def late_shingles(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come last, sorted, and how often the sample has each."""
    sample = docs.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLE)) == 0)
    grams = sets_of(sample, shingle_words, lambda s: (s,), "grams array<bigint>").select(F.explode("grams").alias("gram"))
    with batches_of(docs.sparkSession, TEXT_ROWS):
        often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "gram").limit(LATE).toPandas()
    often = often.sort_values("gram")
    return often["gram"].to_numpy(np.int64), often["n"].to_numpy(np.int64)


def possible(n: str, pos: str, m: str, at: str, least: float) -> Column:
    """At the first shingle that both have, so many can still be shared."""
    return alike(F.col(n), F.col(m), F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)), least)


def open_grams(named: DataFrame) -> DataFrame:
    """(gram, top, c): shingles with several clusters, the size and name of the largest, and all rows, of named(gram, cluster)."""
    sizes = named.groupBy("gram", "cluster").agg(F.count(F.lit(1)).alias("c")).groupBy("gram")
    return sizes.agg(F.max(F.struct("c", "cluster")).alias("top"), F.sum("c").alias("c")).filter("c > top.c")


def busy_pairs(named: DataFrame, turn: int, least: float) -> DataFrame:
    """(x, y): the texts outside the largest cluster of busy shingles, and members of that cluster."""
    busy = open_grams(named).filter(F.col("c") - F.col("top.c") >= BUSY).select("gram", F.col("top.cluster").alias("_top"))
    rows = named.join(busy, "gram")
    heads = rows.filter("cluster = _top").groupBy("gram").agg(*[F.min(F.struct(F.xxhash64("key", F.lit(HEADS * turn + h)).alias("by"), "key", "n", "pos")).alias(f"_{h}") for h in range(HEADS)])
    heads = heads.select("gram", F.explode(F.array_distinct(F.array(*[F.struct(f"_{h}.key", f"_{h}.n", f"_{h}.pos") for h in range(HEADS)]))).alias("head"))
    heads = heads.select("gram", F.col("head.key").alias("y"), F.col("head.n").alias("m"), F.col("head.pos").alias("at"))
    return rows.filter("cluster != _top").join(heads, "gram").filter(possible("n", "pos", "m", "at", least)).select(F.col("key").alias("x"), "y").distinct()


def open_rows(named: DataFrame, signatures: DataFrame, block: int) -> DataFrame:
    """Rows of named(key, gram, n, pos, cluster) of open shingles, with signatures, blocks and the open shingles ahead of each."""
    blocks = lambda c: F.ceil(c / F.lit(block)).cast("int")
    open_ = open_grams(named).select("gram", F.col("top.cluster").alias("_top"), blocks(F.col("c") - F.col("top.c")).alias("_less"), blocks(F.col("c")).alias("_all"))
    ahead = Window.partitionBy("key").orderBy("pos").rowsBetween(-BEFORE, -1)
    return named.join(open_, "gram").join(signatures.select("key", "sig"), "key").withColumn("before", F.collect_list("gram").over(ahead))


def open_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(x, y) of open_rows() in two clusters and within the bound; most pairs once."""
    # Of each shingle with several clusters: the rows of its largest one, and the others, cut in blocks that all meet.
    place = lambda k, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(k)).cast("int")
    every_block = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rest = rows.filter("cluster != _top").select("*", place("_less", 5).alias("_i"), every_block("_all").alias("_j"))
    other = rows.select(
        "gram", every_block("_less").alias("_i"), place("_all", 7).alias("_j"), F.col("key").alias("y"), F.col("n").alias("m"),
        F.col("pos").alias("at"), F.col("cluster").alias("_c"), F.col("sig").alias("sig_y"), F.col("before").alias("before_y"),
    )
    # Two rows that are both not in the largest cluster meet once.
    once = (F.col("_c") == F.col("_top")) | (F.col("key") < F.col("y"))
    first = ~F.arrays_overlap("before", "before_y")
    met = rest.join(other, ["gram", "_i", "_j"]).filter((F.col("cluster") != F.col("_c")) & once & possible("n", "pos", "m", "at", least) & bound("n", "sig", "m", "sig_y", least) & first)
    return met.select(F.least("key", "y").alias("x"), F.greatest("key", "y").alias("y"))


def near_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, least: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """One row for each row of docs: id, component_id.

    Texts link whose sets of shingles have a Jaccard similarity of at least `least`;
    component_id is the smallest id reachable by links, the document's own included.
    Whole texts are read; texts without a word link with each other. Repeated rows stay. A
    row with a null id links with nothing and has a null component.
    """
    every = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = every.filter("id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(late_shingles(known, shingle_words))

    def prefix(s: np.ndarray) -> tuple:
        late, often = shared.value
        rank = np.zeros(len(s), np.int64)
        if len(late):
            at = np.minimum(np.searchsorted(late, s), len(late) - 1)
            rank = np.where(late[at] == s, often[at], 0)
        take = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1 if len(s) else 0
        return class_key(s), len(s), s[np.lexsort((s, rank))[:take]], signature(s), majority(s)

    spark = docs.sparkSession
    marked, marked_path = materialise(sets_of(known, shingle_words, prefix, "key bigint, n int, grams array<bigint>, sig array<bigint>, fp bigint"), "shingle-prefixes", TEXT_ROWS)
    ids, _ = materialise(marked.select("id", "key"), "shingle-keys")
    classes, classes_path = materialise(marked.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("sig").alias("sig"), F.first("fp").alias("fp")), "shingle-classes")
    discard(spark, marked_path)
    reps, _ = materialise(classes.select("key", "rep"), "shingle-reps")
    signatures, signatures_path = materialise(classes.select("key", "n", "sig", "fp"), "shingle-signatures")
    # Most shingles are one text's: only the others travel with their texts.
    every_gram = classes.select(F.explode("grams").alias("gram"))
    shared_grams, grams_path = materialise(every_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"), "shingle-grams")
    few, few_path = materialise(classes.select("key", "n", F.posexplode("grams").alias("pos", "gram")).join(shared_grams, "gram", "left_semi"), "shingle-rows")
    for path in (classes_path, grams_path):
        discard(spark, path)

    edges = verified(known, within_bound(simhash_pairs(signatures, block), signatures, least), reps, shingle_words, least)
    found = components(edges)
    label = reps.join(found, reps["rep"] == found["node"], "left").select("key", F.coalesce("component", "rep").alias("cluster"))
    for turn in range(ROUNDS):
        named, named_path = materialise(few.join(label, "key"), "shingle-named")
        order = F.struct((F.col("n") if turn == 0 else F.xxhash64("key", F.lit(turn))).alias("by"), "key", "n", "pos", "cluster")
        heads = named.groupBy("gram").agg(F.min(order).alias("head"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo != hi")
        first = named.join(heads, "gram").filter(F.col("cluster") != F.col("head.cluster"))
        first = first.select("key", "n", "pos", F.col("head.key").alias("y"), F.col("head.n").alias("m"), F.col("head.pos").alias("at"))
        star = first.filter(possible("n", "pos", "m", "at", least)).select(F.col("key").alias("x"), "y").distinct()
        near, near_path = materialise(within_bound(star, signatures, least), "shingle-pairs")
        linked = verified(known, near, reps, shingle_words, least)
        edges = edges.union(linked)
        found = components(edges)
        label = reps.join(found, reps["rep"] == found["node"], "left").select("key", F.coalesce("component", "rep").alias("cluster"))
        for path in (named_path, near_path):
            discard(spark, path)
    named, named_path = materialise(few.join(label, "key"), "shingle-named")
    for turn in range(MORE_ROUNDS):
        near, near_path = materialise(within_bound(busy_pairs(named, turn, least), signatures, least), "shingle-pairs")
        linked = verified(known, near, reps, shingle_words, least)
        gained, tried = linked.count(), near.count()
        discard(spark, near_path)
        if not gained:
            break
        edges = edges.union(linked)
        found = components(edges)
        label = reps.join(found, reps["rep"] == found["node"], "left").select("key", F.coalesce("component", "rep").alias("cluster"))
        discard(spark, named_path)
        named, named_path = materialise(few.join(label, "key"), "shingle-named")
        if 2 * gained < tried:
            break
    discard(spark, few_path)
    rows, rows_path = materialise(open_rows(named, signatures, block), "shingle-groups")
    cross, _ = materialise(open_pairs(rows, least).distinct(), "shingle-pairs")
    for path in (named_path, rows_path, signatures_path):
        discard(spark, path)
    found = components(edges.union(verified(known, cross, reps, shingle_words, least)))
    label = reps.join(found, reps["rep"] == found["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    kept = ids.join(label, "key").select(F.col("id").alias(id_col), "component_id")
    return kept.union(every.filter("id is null").select("id", F.lit(None).cast("bigint")))
