"""Exact deduplication with an extendible-hash index kept as shared files.

A text's slot is the leading bits of its normalised form's 64-bit hash; the directory maps
slots to buckets and is doubled until no bucket is over its capacity, so a bucket is a
contiguous range of hashes. Owners hold contiguous ranges of buckets. Every row is sent to
its bucket's owner, whose task sorts its texts by hash and bytes: entries whose hashes are
equal form a chain, and members of a chain are told apart by their bytes. The same task
gives each row its entry, the row that stays and the size of its group.

Hashes with many rows are known from the counts that the directory is made from. Their
rows are collapsed by a map-side aggregation on the bytes first, so a group of copies of
any size reaches its owner as one row, and its other rows read the owner's entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, new_path

#: Slots of the finest histogram: 2 ** MAX_DEPTH rows at most reach the driver.
MAX_DEPTH = 16
BUCKET_CAPACITY = 50_000
#: Buckets and owners for each task, so that tasks get even shares.
BUCKETS_A_TASK, OWNERS_A_TASK = 16, 8
#: A hash is hot with more rows than this, and with more than one of HOT_SHARE of all: HOT_SHARE hashes are hot at most.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass(frozen=True)
class Directory:
    """depth leading hash bits select a slot; buckets[slot] is the bucket's number."""

    depth: int
    buckets: tuple[int, ...]
    local_depths: tuple[int, ...]
    owners: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        """(slot, bucket, owner): the directory as a table; an owner's buckets are neighbours."""
        n = len(self.local_depths)
        return spark.createDataFrame([(s, b, b * self.owners // n) for s, b in enumerate(self.buckets)], "_slot int, bucket int, owner int")

    def place(self, rows: DataFrame, h: str = "h") -> DataFrame:
        """rows with their bucket and owner; the directory has 2 ** MAX_DEPTH slots at most and is broadcast."""
        slot = F.shiftrightunsigned(h, 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return rows.withColumn("_slot", slot).join(F.broadcast(self.rows(rows.sparkSession)), "_slot").drop("_slot")


def build_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Split overfull buckets, doubling the directory where the slots run out.

    counts: entries by their leading max_depth hash bits. A bucket that is still
    overfull at max_depth keeps its entries (its owner task has more to do).
    """
    depth, buckets = 0, [(0, 0)]  # (prefix, local depth), in key order
    slots = [0]
    while True:
        load = [0] * len(buckets)
        for fine, n in counts.items():
            load[slots[fine >> (max_depth - depth)]] += n
        over = {i for i, n in enumerate(load) if n > capacity and buckets[i][1] < max_depth}
        if not over:
            return Directory(depth, tuple(slots), tuple(d for _, d in buckets))
        if any(buckets[i][1] == depth for i in over):
            depth += 1
        split = []
        for i, (prefix, local) in enumerate(buckets):
            split += [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)] if i in over else [(prefix, local)]
        buckets = split
        slots = [i for i, (_, local) in enumerate(buckets) for _ in range(1 << (depth - local))]


def _hashed(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(_id, _norm, h) and, to carry, all of a row's columns as _row."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] * carry
    return docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"), *row).withColumn("h", F.xxhash64("_norm"))


def make_directory(hashes: DataFrame, capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS) -> tuple[Directory, list[int], str]:
    """The directory for rows(h), the hot hashes, and the path of the table of counts."""
    spark = hashes.sparkSession
    counts, path = materialise(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-hashes")
    slot = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int").alias("slot")
    load = {r["slot"]: (r["entries"], r["n"]) for r in counts.groupBy(slot).agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n")).collect()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries, total = (sum(x[k] for x in load.values()) for k in (0, 1))
    built = build_directory({s: e for s, (e, _) in load.items()}, max(1, min(capacity, entries // (BUCKETS_A_TASK * tasks))))
    hot = [r["h"] for r in counts.filter(F.col("n") > max(hot_rows, total // HOT_SHARE)).select("h").collect()]
    return Directory(built.depth, built.buckets, built.local_depths, max(1, min(len(built.local_depths), OWNERS_A_TASK * tasks))), hot, path


def _owned(docs: DataFrame, id_col: str, text_col: str, capacity: int, hot_rows: int, carry: bool) -> tuple[DataFrame, DataFrame | None, Directory]:
    """Rows as their owners decide them, the hot rows (_id, h, text_sha256) that were sent collapsed (none when carrying), and the directory.

    Owners' rows: owner, bucket, h, chain, n_chars, text_sha256, keep_id, group_size, _id,
    _nth (the row that stays is the first), _hot (a collapsed one), and to carry, _row.
    """
    spark = docs.sparkSession
    rows = _hashed(docs, id_col, text_col, carry)
    directory, hot, counts = make_directory(rows.select("h"), capacity, hot_rows)
    discard(spark, counts)
    payload = ["_row"] * carry
    sent = rows.select("_id", "_norm", "h", F.lit(1).cast("bigint").alias("_weight"), F.lit(False).alias("_hot"), *payload)
    copies = None
    if hot:
        flags = F.broadcast(spark.createDataFrame([(h,) for h in hot], "h bigint"))
        many = rows.join(flags, "h", "left_semi")
        first = [F.min_by("_row", F.struct(F.col("_id").isNull(), "_id")).alias("_row")] * carry
        collapsed = many.groupBy("h", "_norm").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_weight"), *first)
        sent = sent.join(flags, "h", "left_anti").select(*sent.columns).union(collapsed.select("_id", "_norm", "h", "_weight", F.lit(True).alias("_hot"), *payload))
        copies = many.select("_id", "h", F.sha2("_norm", 256).alias("text_sha256"))
    owned = directory.place(sent).repartition(max(1, min(directory.owners, int(spark.conf.get("spark.sql.shuffle.partitions")))), "owner")
    entry = ["owner", "bucket", "h", "_norm"]
    group, chained = Window.partitionBy(*entry), Window.partitionBy("owner", "bucket", "h").orderBy("_norm")
    ordered = group.orderBy(F.col("_id").asc_nulls_last())
    decided = (
        owned.withColumn("_nth", F.row_number().over(ordered))
        .withColumn("keep_id", F.first("_id").over(ordered))
        .withColumn("group_size", F.sum("_weight").over(group))
        .withColumn("chain", F.dense_rank().over(chained))
    )
    told = decided.select(
        "owner", "bucket", "h", "chain", F.length("_norm").alias("n_chars"), F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size", "_id", "_nth", "_hot", *payload
    )
    return told, copies, directory


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, str, Directory]:
    """The index table (owner, bucket, h, chain, text_sha256, n_chars, keep_id, group_size), its path and directory.

    The files are partitioned by owner and in order of bucket and hash.
    """
    told, _, directory = _owned(docs, id_col, text_col, capacity, hot_rows, carry=False)
    path = new_path(docs.sparkSession, "dedup-index")
    told.filter("_nth = 1").drop("_id", "_nth", "_hot").write.partitionBy("owner").parquet(path)
    return docs.sparkSession.read.parquet(path), path, directory


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Null and empty texts are one
    text. The row with the smallest id stays; of rows that repeat that id with the
    same text one stays. A null id stays only in a group that has no other id (one
    row of them). Other columns are not read. An empty table gives no rows.
    """
    told, copies, _ = _owned(docs, id_col, text_col, capacity, hot_rows, carry=False)
    columns = [F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"]
    if copies is None:
        return told.withColumn("kept", F.col("_nth") == 1).select(*columns)
    decided, _ = materialise(told, "dedup-rows")
    # The hot entries are as many as there are hot hashes, and the more only where different texts have one hash.
    entries = decided.filter("_hot").select("h", "text_sha256", "keep_id", "group_size")
    # Rows that repeat the id which stays: all but one are copies.
    times = copies.groupBy("_id", "h", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    found = times.join(entries, ["h", "text_sha256"]).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    found = found.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1))
    return decided.filter("not _hot").withColumn("kept", F.col("_nth") == 1).select(*columns).union(found.select(*columns))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, all their columns.

    Rows travel to their owners whole, once; of rows that repeat the smallest id with the
    same text, and differ in other columns, any one stays.
    """
    told, _, _ = _owned(docs, id_col, text_col, capacity, hot_rows, carry=True)
    return told.filter("_nth = 1").select("_row.*")


def lookup(index: DataFrame, directory: Directory, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with keep_id and group_size of their entry (null where the index has none).

    Only the owners' files that the texts fall in are read, and of those the row groups
    with their buckets: there are 2 ** MAX_DEPTH buckets at most.
    """
    named = normalised(F.col(text_col))
    whole = F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("_text")
    probe = directory.place(texts.select(whole, F.xxhash64(named).alias("_h"), F.sha2(named, 256).alias("_sha")), "_h")
    wanted = probe.select("owner", "bucket").distinct().collect()
    near = index.filter(F.col("owner").isin(sorted({r["owner"] for r in wanted})) & F.col("bucket").isin(sorted({r["bucket"] for r in wanted})))
    found = near.select("bucket", F.col("h").alias("_h"), F.col("text_sha256").alias("_sha"), "keep_id", "group_size")
    return probe.drop("owner").join(found, ["bucket", "_h", "_sha"], "left").select("_text.*", "keep_id", "group_size")


def index_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Entries and chained collisions by bucket of an index that was written before."""
    return spark.read.parquet(path).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("chain") > 1).alias("collisions")
    )
