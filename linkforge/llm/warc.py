"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are plain WARC/1.0 files written by Spark's text writer, each record followed by
two line ends, so any store that Spark reaches will do and no record meets the driver.

Reading splits the files at the magic ``WARC/1.0``, wherever it stands. Each such place
is a candidate record, and its headers say where the next record has to be. Payloads may
hold the magic too: only candidates that the chain from the file's start reaches are
records. Each task follows the candidates of its own block to the first place beyond it;
pointer jumping over those exits, doubling in each round, finds the blocks' true entries,
and a second pass follows the chain from there. Fragments of a payload that held the
magic are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, new_path

MAGIC = "WARC/1.0\r\n"
BETWEEN = "\r\n\r\n"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: Column, sha1: Column) -> Column:
    """Of a page and its payload; rows that repeat both are one record, written each."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record for each row of pages.

    Of the rows with equal payloads of at least REVISIT_BYTES bytes the one with the
    largest id is a response and the others are revisits that refer to it; smaller
    payloads are responses all. A null payload is empty; a null id is smaller than any.
    Line ends in urls are dropped. Rows that repeat an id are written each, with their own
    payloads; of rows that repeat a payload's largest id all are responses.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("sha1", F.sha1("payload"))
    # Equal payloads meet by a 256-bit digest; only those that have copies come back.
    keyed = rows.withColumn("key", F.when(F.col("size") >= REVISIT_BYTES, F.sha2("payload", 256)))
    large = keyed.filter(F.col("key").isNotNull()).select("id", "key")
    first = large.groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    linked = large.join(first, "key").filter("not id <=> first").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "first").distinct()
    revisits, staged = materialise(linked, "revisits")
    # A payload's rows meet by their ids too, so a group of copies of any size is spread.
    marked = keyed.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").cast("binary")
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    headers = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("id"), F.col("sha1")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first"), F.col("sha1")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    marked.select(F.concat(headers.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", BETWEEN).text(path)
    discard(pages.sparkSession, staged)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what follows each magic, in the order of each block; the first of a file is what precedes any."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _from(data: Column, start: Column) -> Column:
    return F.substring(data, start, F.greatest(F.octet_length(data) - start + 1, F.lit(0)))


def _split(value: Column) -> tuple[Column, Column]:
    """What stands before the first empty line, as text, and all that follows it, as bytes; null without one."""
    head = F.when(F.instr(value, "\r\n\r\n") > 0, F.substring_index(value, "\r\n\r\n", 1))
    return head, _from(value.cast("binary"), F.octet_length(head) + 5)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _payload(value: Column) -> Column:
    """The payload of a record's text after the magic, _length being its block's: what follows the HTTP headers."""
    _, rest = _split(value)
    block = F.substring(rest, F.lit(1), F.least(F.col("_length"), F.octet_length(rest).cast("bigint")).cast("int"))
    return _split(block.cast("string"))[1]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, size, body, head, payload_bytes, payload_sha1): one row a candidate, none of its payload.

    body: bytes from the magic to the next record by the candidate's own headers, or null.
    payload_bytes and payload_sha1 hold if the candidate is a record without the magic in it.
    """
    head, _ = _split(F.col("value"))
    lines = _lines(spark, path).select("*", F.monotonically_increasing_id().alias("_m"), head.alias("head"))
    lines = lines.withColumn("_length", F.regexp_extract("head", r"(?i)(?:^|\r\n)Content-Length: *(\d{1,18}) *(?:\r|$)", 1).try_cast("bigint"))
    payload = _payload(F.col("value"))
    table, _ = materialise(
        lines.select(
            "file", "block", "_m", F.octet_length("value").cast("bigint").alias("size"), "head",
            (F.lit(len(MAGIC) + 4 + len(BETWEEN)) + F.octet_length("head") + F.col("_length")).alias("body"),
            F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_sha1"),
        ),
        "warc-candidates",
    )
    order = Window.partitionBy("file", "block").orderBy("_m")
    return table.withColumn("nth", F.row_number().over(order).cast("bigint") - 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value) with the same numbers, for those who need the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            nth = []
            for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                nth.append(seen.get(key, 0))
                seen[key] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], ["file", "block", "value", "nth"])

    lines = _lines(spark, path).withColumn("value", F.col("value").cast("binary"))
    return lines.mapInArrow(run, "file string, block bigint, value binary, nth bigint")


def _by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[str, int], list[np.ndarray]]]:
    """Rows in order of file, block and place, as one set of columns a block."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        start = 0
        for n in range(1, batch.num_rows + 1):
            if n == batch.num_rows or (files[n], blocks[n]) != (files[start], blocks[start]):
                if key is not None and key != (files[start], blocks[start]):
                    table = pa.Table.from_batches(held)
                    yield key, [table.column(c).to_numpy() for c in columns]
                    held = []
                key = (files[start], blocks[start])
                held.append(batch.slice(start, n - start))
                start = n
    if held:
        table = pa.Table.from_batches(held)
        yield key, [table.column(c).to_numpy() for c in columns]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, exit): where the chain from each candidate leaves its block."""
    for (file, block), (at, successor) in _by_block(batches, ["at", "successor"]):
        place = {a: n for n, a in enumerate(at.tolist())}
        out = successor.copy()
        for n in range(len(at) - 1, -1, -1):
            if (k := place.get(int(successor[n]))) is not None and k > n:
                out[n] = out[k]
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(at)), pa.array(np.full(len(at), block)), pa.array(at), pa.array(out)], ["file", "block", "at", "exit"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, nth, at, owner): the record that each candidate belongs to, -1 where an earlier block's does."""
    for (file, block), (nth, at, successor, entry) in _by_block(batches, ["nth", "at", "successor", "entry"]):
        owner = np.full(len(at), -1, np.int64)
        place = {a: n for n, a in enumerate(at.tolist())}
        now = int(entry[0])
        while (n := place.get(now)) is not None:
            owner[n:] = now
            now = int(successor[n])
            if now <= int(at[n]):
                break
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(at)), pa.array(np.full(len(at), block)), pa.array(nth), pa.array(at), pa.array(owner)], ["file", "block", "nth", "at", "owner"]
        )


def owners(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(file, block, nth, at, owner): each candidate's offset and that of the true record that holds it."""
    by_block = sizes.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select("file", "block", F.coalesce(F.sum("bytes").over(blocks), F.lit(0)).alias("_start"))
    within = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_in", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(within), F.lit(0))).join(starts, ["file", "block"])
    # A file's first line precedes any magic, every other line follows one.
    placed = placed.withColumn("at", F.col("_start") + F.col("_in") - len(MAGIC))
    placed, _ = materialise(
        placed.select("file", "block", "nth", "at", F.coalesce(F.col("at") + F.col("body"), F.lit(-1)).alias("successor")), "warc-places"
    )
    ordered = placed.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    exits, _ = materialise(
        ordered.filter("at >= 0").select("file", "block", "at", "successor").mapInArrow(_exits, "file string, block bigint, at bigint, exit bigint"),
        "warc-exits",
    )
    # Only places that some chain leaves its block for can be entries.
    entering = exits.select("file", F.col("exit").alias("at")).distinct()
    leap, _ = materialise(exits.join(entering, ["file", "at"], "left_semi").union(exits.filter("at = 0")).select("file", "at", "exit").distinct(), "warc-leaps")
    nodes = leap.select("file", "at")
    reached = nodes.filter("at = 0")
    blocks_of_a_file = exits.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    for _ in range(max(0, int(blocks_of_a_file) - 1).bit_length()):
        there = reached.join(leap, ["file", "at"]).select("file", F.col("exit").alias("at")).join(nodes, ["file", "at"], "left_semi")
        reached, _ = materialise(reached.union(there).distinct(), "warc-reached")
        far = leap.select("file", F.col("at").alias("exit"), F.col("exit").alias("_to"))
        leap, _ = materialise(leap.join(far, ["file", "exit"]).select("file", "at", F.col("_to").alias("exit")), "warc-leaps")
    entries = exits.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    walked = placed.join(entries, ["file", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(-2).cast("bigint")))
    walked = walked.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    owned, _ = materialise(
        walked.select("file", "block", "nth", "at", "successor", "entry").mapInArrow(_walk, "file string, block bigint, nth bigint, at bigint, owner bigint"),
        "warc-owners",
    )
    # A record that runs on into later blocks holds their first lines.
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("_last"))
    last = last.select("file", "block", F.coalesce(F.max("_last").over(blocks), F.lit(-1)).alias("_carried"))
    held = F.when(F.col("owner") < 0, F.col("_carried")).otherwise(F.col("owner"))
    return owned.join(last, ["file", "block"]).select("file", "block", "nth", "at", held.alias("owner"))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record: record_id, record_type, target_uri, payload_digest, refers_to, payload_bytes, payload_sha1 (and payload).

    Only records that the chain of lengths from their file's start reaches are given,
    whatever their payloads hold. payload_bytes and payload_sha1 are of the bytes read
    back; payload_digest is what the headers say. Files without records give no rows.
    """
    found = candidates(spark, path)
    owned, _ = materialise(owners(spark, found), "warc-owned")
    true = owned.filter("at >= 0 and owner = at").select("file", "block", "nth", "owner")
    records = found.join(true, ["file", "block", "nth"])
    broken = owned.filter("at >= 0 and owner >= 0 and owner <> at").select("file", "owner").distinct()
    if with_payload or not broken.isEmpty():
        wanted = owned.filter("at >= 0 and owner >= 0").select("file", "block", "nth", "at", "owner")
        if not with_payload:
            wanted = wanted.join(broken, ["file", "owner"], "left_semi")
        lines = numbered_lines(spark, path).join(wanted, ["file", "block", "nth"])
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"].cast("string"))
        whole = lines.groupBy("file", "owner").agg(F.array_join(parts, MAGIC).alias("value"))
        head, _ = _split(F.col("value"))
        whole = whole.withColumn("_length", _header(head, "Content-Length").try_cast("bigint")).withColumn("payload", _payload(F.col("value")))
        whole = whole.select("file", "owner", "payload", F.octet_length("payload").cast("bigint").alias("_bytes"), F.sha1("payload").alias("_sha1"))
        records = records.join(whole, ["file", "owner"], "left")
        records = records.withColumn("payload_bytes", F.coalesce("_bytes", "payload_bytes")).withColumn("payload_sha1", F.coalesce("_sha1", "payload_sha1"))
    headers = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    return records.select(
        *[_header(F.col("head"), h).alias(c) for c, h in headers.items()], "payload_bytes", "payload_sha1", *["payload"] * with_payload
    )


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives and read them back: one row a page: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response that it refers to. Rows that repeat an id
    and rows without one come back each; an empty table gives no rows; other columns are
    not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("bigint")
    read, _ = materialise(read_archives(spark, path).select("record_id", "record_type", "refers_to", "payload_bytes", "payload_sha1"), "warc-records")
    is_revisit = F.col("record_type") == "revisit"
    # Records with one id hold one payload.
    responses = read.filter(~is_revisit).groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.struct("payload_bytes", "payload_sha1")).alias("_of"))
    columns = [number("record_id").alias(id_col), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    # Responses refer to nothing: they stay out of the join, where a null key would meet in one task.
    told = read.filter(is_revisit).drop("payload_bytes", "payload_sha1").join(responses, "refers_to", "left").select("*", "_of.*").select(*columns)
    return read.filter(~is_revisit).select(*columns).unionByName(told)
