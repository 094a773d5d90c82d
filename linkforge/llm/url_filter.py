"""URL filtering by listed hosts and path prefixes.

Every listed rule is a canonical key, its lower-case host followed by its path. A
url's candidate keys are its host's suffixes with its path's prefixes, for the label
counts and path lengths that occur in the list, so their number is set by the list and
not by the url. A blocked Bloom filter of the listed keys (eight bits within one
256-bit block) lets through possible hits, and an exact hash join on the key removes
the false ones.

The filter's size is bounded by MAX_FILTER_BLOCKS: beyond that it lets more false hits
through and the join still decides. The rules are broadcast while their measured size
is under MAX_BROADCAST_BYTES and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BITS, KEY_BITS, BITS_PER_KEY = 256, 8, 12
#: 4 words of 64 bits each: 8 MB of filter.
MAX_FILTER_BLOCKS = 1 << 18
MAX_BROADCAST_BYTES = 8 << 20
#: Odd multipliers, one for each of a key's bits.
_SALTS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 63) | 1 for i in range(KEY_BITS))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    """Places of the key's bits in its block: the top bits of its hash times each salt."""
    h = F.xxhash64(key)
    return F.array(*[F.shiftrightunsigned(F.xxhash64(h, F.lit(s)), 56).cast("int") for s in _SALTS])


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, w1, w2, w3): the blocks that have any bit, of keys(key)."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("bit"))
    word = F.shiftrightunsigned("bit", 6)
    one = F.expr("shiftleft(1L, bit % 64)")
    return bits.groupBy("block").agg(
        *[F.coalesce(F.bit_or(F.when(word == i, one)), F.lit(0).cast("bigint")).alias(f"w{i}") for i in range(4)]
    )


def _possible(key: Column) -> Column:
    """All of the key's bits are set in the joined block."""
    held = F.lit(True)
    h = F.xxhash64(key)
    for s in _SALTS:
        bit = F.shiftrightunsigned(F.xxhash64(h, F.lit(s)), 56).cast("int")
        word = F.shiftrightunsigned(bit, 6)
        chosen = F.when(word == 0, F.col("w0")).when(word == 1, F.col("w1")).when(word == 2, F.col("w2")).otherwise(F.col("w3"))
        held = held & (F.call_function("getbit", chosen, F.pmod(bit, F.lit(64))) == 1)
    return F.coalesce(held, F.lit(False))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(rule, action) -> (key, rule, action, labels, path_len), one row a key; block wins over allow."""
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    return (
        rules.filter(F.col("rule").isNotNull() & (host != ""))
        .select(F.concat(host, path).alias("key"), "action", _labels(host).alias("labels"), F.length(path).alias("path_len"))
        .groupBy("key", "labels", "path_len")
        .agg(F.max("action").alias("action"))
    )


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    rules: (rule, action) with action ``allow`` or ``block``, rule a host and a path.
    A rule fits its host and every subdomain of it where the url's path starts with
    the rule's path; the longest rule wins, and of two as long the one with the longer
    host. Without one, rule is null and the verdict is default. A null url, or one
    without ``://``, has an empty host and path and fits no rule. Repeated rows stay
    repeated; other columns are not read; null rules are ignored.
    """
    listed = prepare_rules(rules)
    n, size, shapes = listed.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0)), F.collect_set(F.struct("labels", "path_len"))
    ).first()
    urls = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    if n == 0:
        return urls.select(
            F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    blocks = max(1, min(MAX_FILTER_BLOCKS, -(-n * BITS_PER_KEY // BLOCK_BITS)))
    bloom = build_filter(listed.select("key"), blocks)
    keys = F.array(*[
        F.when(
            (_labels(F.col("host")) >= k) & (F.length("path") >= m),
            F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, m)),
        )
        for k, m in sorted((s["labels"], s["path_len"]) for s in shapes)
    ])
    candidates = urls.select("*", F.posexplode(keys).alias("_nth", "key"))
    tested = (
        candidates.withColumn("block", _block(F.col("key"), blocks))
        .join(F.broadcast(bloom), "block", "left")
        .withColumn("key", F.when(_possible(F.col("key")), F.col("key")))
        .select("_id", "_url", "host", "path", "_nth", "key")
    )
    exact = listed.select("key", "action", F.col("path_len"), F.col("key").alias("rule"))
    if size <= max_broadcast_bytes:
        joined = tested.join(F.broadcast(exact), "key", "left")
    else:  # only possible hits are shuffled, and a hot key is split by adaptive skew handling
        hits = tested.filter(F.col("key").isNotNull()).join(exact, "key", "left")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("action", "string"), ("path_len", "int"), ("rule", "string"))]
        rest = tested.filter(F.col("key").isNull()).select("key", "_id", "_url", "host", "path", "_nth", *none)
        joined = hits.unionByName(rest)
    best = F.max(F.when(
        F.col("rule").isNotNull(),
        F.struct(F.length("rule").alias("n"), (-F.col("path_len")).alias("h"), "rule", "action"),
    ))
    return (
        joined.groupBy("_id", "_url", "host", "path")
        .agg(best.alias("_best"), F.count_if(F.col("_nth") == 0).cast("int").alias("_times"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(
            F.col("_id").alias(id_col), "host", "path",
            F.col("_best.rule").alias("rule"),
            F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
        )
    )
