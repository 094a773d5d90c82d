"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkforge.functions.dialect import DUCK, SPARK, Dialect

from .demo import World, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "labels", "benchmark", "conversations",
}
STAGED = {"gaz", "docs", "doc_parts", "gaz_parts"}

#: Parts of a query that Spark is given in another form with the same rows.
REWRITES: dict[str, str] = {}

#: Frames that any query may start from, as SQL over the world's frames.
PAIRS = (
    "select d.*, g.address_id, g.uprn, g.full_address, g.house, g.road, g.town, g.postcode as gaz_postcode, g.status, g.easting as gaz_easting, g.northing as gaz_northing "
    "from (select *, target_id as pair_id from docs union all select *, other_id as pair_id from docs) d join gaz g on g.address_id = d.pair_id"
)


def register(name: str, run: Callable[[World], DataFrame], sql: str | None = None) -> None:
    """sql: an oracle; ``gaz``, ``docs`` and ``pairs`` in it are the world's frames."""
    QUERIES[name] = lambda spark, sf_dir: run(World(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = complete(sql)


def complete(sql: str) -> str:
    head = with_clause() + f", pairs as ({PAIRS})"
    body = sql.strip()
    return f"{head}, {body[5:].strip()}" if body[:5].lower() == "with " else f"{head} {body}"


def spark_sql(world: World, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL text over frames: the world's tables by name, and others as given."""
    spark = world.spark
    for plain, quick in REWRITES.items():
        sql = sql.replace(plain, quick)
    named = set(re.findall(r"\b(?:from|join) (\w+)\b", sql)) - set(frames)
    for name in named & TABLES:
        frames[name] = world.table(name)
    for name in named & STAGED:
        frames[name] = getattr(world, name)
    if "pairs" in named:
        frames["pairs"] = spark.sql(re.sub(r"\b(from|join) (docs|gaz)\b", r"\1 {\2}", PAIRS), docs=world.docs, gaz=world.gaz)
    escaped = sql.replace("{", "{{").replace("}", "}}")
    text = re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], escaped)
    return spark.sql(text, **frames)


def portable(name: str, sql: Callable[[Dialect], str] | str, quick: str | None = None) -> None:
    """A query that is one SQL text for both engines, but for the dialect's functions; quick: Spark's own text with the same rows."""
    text = sql if callable(sql) else lambda d: sql
    register(name, lambda w: spark_sql(w, quick or text(SPARK)), text(DUCK))


def scalar(name: str, table: str, key: str, columns: dict[str, Callable[[Dialect], str]], where: str = "") -> None:
    """Scalar functions over a frame: one output column each."""
    portable(name, lambda d: f"select {key}, " + ", ".join(f"{f(d)} as {c}" for c, f in columns.items()) + f" from {table} {where}")
