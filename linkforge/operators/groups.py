"""Consensus of document groups: votes, safe groups, corrections and the matches that result.

A fact table has a row a document: doc_id, group (here ``app_base``), raw_address,
address_id and confidence (null where unmatched). Votes are counted by partial
aggregation, so a group of any size reaches its task as one row an address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.config import GroupLimits
from linkforge.functions import text as T
from linkforge.functions.dialect import SPARK

LIMITS = GroupLimits()
#: Confidence of a vote, and of a match that a group may overrule.
VOTE, WEAK = 0.5, 0.5


def votes(fact: DataFrame, group: str = "app_base") -> DataFrame:
    """(group, address_id, votes, best): matches above VOTE by address."""
    voting = fact.filter((F.col("confidence") > VOTE) & F.col("address_id").isNotNull() & F.col(group).isNotNull())
    return voting.groupBy(group, "address_id").agg(F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("best"))


def winners(fact: DataFrame, group: str = "app_base") -> DataFrame:
    """Each group's address with the most votes, then the highest confidence, then the smallest id."""
    first = F.max_by(F.struct("address_id", "votes", "best"), F.struct("votes", "best", -F.col("address_id")))
    return votes(fact, group).groupBy(group).agg(first.alias("w")).select(group, "w.*")


def safe_groups(fact: DataFrame, limits: GroupLimits = LIMITS, group: str = "app_base") -> DataFrame:
    """(group, address_id, votes, n_docs, n_real): groups that may be corrected by their winner."""
    real = F.expr(T.is_real_address(SPARK, "raw_address"))
    sizes = fact.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("confidence") > 0).alias("n_matched"),
        F.count_if(real).alias("n_real"),
        F.count_distinct(F.when(real, F.substring("raw_address", 1, limits.prefix))).alias("n_variations"),
    )
    allowed = (
        F.col("n_docs").between(limits.least_docs, limits.most_docs)
        & (F.col("n_matched") > 0)
        & (F.col("n_matched") < F.col("n_docs"))
        & (F.col("n_real") >= F.col("n_docs") * limits.real_share)
        & (F.col("n_docs") - F.col("n_real") <= limits.most_references)
        & (F.col("n_variations") <= limits.most_variations)
        & (F.col("votes") >= limits.least_votes)
        & (F.col("votes") >= F.col("n_matched") * limits.vote_share)
    )
    return sizes.join(winners(fact, group), group).filter(allowed).select(group, "address_id", "votes", "n_docs", "n_real")


def corrections(fact: DataFrame, limits: GroupLimits = LIMITS, group: str = "app_base") -> DataFrame:
    """(doc_id, group, original, corrected, confidence): documents of safe groups with no match, a weak one or another one."""
    real = F.expr(T.is_real_address(SPARK, "raw_address"))
    safe = safe_groups(fact, limits, group).select(group, F.col("address_id").alias("corrected"), "votes")
    wrong = F.col("address_id").isNull() | (F.col("confidence") < WEAK) | (F.col("address_id") != F.col("corrected"))
    level = F.when(F.col("votes") >= 5, 0.95).when(F.col("votes") >= 3, 0.90).otherwise(0.85)
    return fact.join(safe, group).filter(real & wrong).select("doc_id", group, F.col("address_id").alias("original"), "corrected", level.alias("confidence"))


def ratio_corrections(fact: DataFrame, group: str = "app_base") -> DataFrame:
    """(doc_id, corrected, confidence, reason): unmatched documents get their group's own-number match, else its winner.

    A winner's confidence is the share of its votes in the group's matches, 0.85 at least.
    """
    matched = fact.filter("address_id is not null")
    own = matched.filter("method = 'valid_uprn'").groupBy(group).agg(F.min("address_id").alias("own"))
    shares = winners(fact, group).join(matched.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    shares = shares.select(group, F.col("address_id").alias("winner"), F.greatest(F.lit(0.85), F.col("votes") / F.col("n")).alias("share"))
    open_ = fact.filter("address_id is null").select("doc_id", group).join(own, group, "left").join(shares, group, "left")
    return open_.filter("own is not null or winner is not null").select(
        "doc_id", F.coalesce("own", "winner").alias("corrected"), F.when(F.col("own").isNotNull(), 1.0).otherwise(F.col("share")).alias("confidence"),
        F.when(F.col("own").isNotNull(), "source_uprn").otherwise("group_votes").alias("reason"),
    )


def best_group_match(fact: DataFrame, group: str = "app_base") -> DataFrame:
    """(group, address_id, source, votes): own-number matches first, then votes, then confidence."""
    own = fact.filter("method = 'valid_uprn'").groupBy(group, "address_id").agg(F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("best"))
    every = own.withColumn("source", F.lit("source_uprn")).unionByName(votes(fact, group).withColumn("source", F.lit("votes")))
    order = Window.partitionBy(group).orderBy(F.col("source") != "source_uprn", F.desc("votes"), F.desc("best"), "address_id")
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(group, "address_id", "source", "votes")


def effective(fact: DataFrame, corrected: DataFrame) -> DataFrame:
    """(doc_id, address_id, is_corrected): the correction where there is one, else the match."""
    return fact.select("doc_id", "address_id").join(corrected.select("doc_id", "corrected"), "doc_id", "left").select(
        "doc_id", F.coalesce("corrected", "address_id").alias("address_id"), F.col("corrected").isNotNull().alias("is_corrected")
    )
