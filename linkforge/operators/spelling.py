"""Spelling correction by symmetric deletes, as joins.

A dictionary is a table (term, freq). Its index has a row for each string that a term
becomes by at most MAX_DISTANCE deletions, the term itself included. Words meet terms
where they share such a string; optimal string alignment then decides. Words of a table
are looked up once each, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge import config as C
from linkforge.functions.strings import osa

LIMITS = C.Spelling()


def with_deletes(words: DataFrame, word: str, distance: int = LIMITS.max_distance, to: str = "key") -> DataFrame:
    """words with a column of every different string that the word becomes by at most distance deletions; none gets empty."""
    one = lambda x: F.when(
        F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    ).otherwise(F.array().cast("array<string>"))
    every = F.array(F.col(word))
    layer = every
    for _ in range(distance):
        layer = F.array_distinct(F.flatten(F.transform(layer, one)))
        every = F.array_union(every, layer)
    return words.withColumn(to, F.explode(every))


def build_dictionary(addresses: DataFrame, text: str, limits: C.Spelling = LIMITS, seeded: bool = True) -> DataFrame:
    """(term, freq): last comma parts and words of upper-case addresses with their counts, and the seeds, of which the later source counts."""
    spark = addresses.sparkSession
    known = addresses.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.upper(F.col(text)).alias("t"))
    towns = known.select(F.trim(F.element_at(F.split("t", ","), -1)).alias("term"))
    words = known.select(F.explode(F.regexp_extract_all("t", F.lit(r"([A-Z]+)"), 1)).alias("term")).filter(~F.col("term").isin(*C.SPELLING_SKIPPED))
    counted = [
        part.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= limits.min_frequency).withColumn("source", F.lit(n))
        for n, part in enumerate((towns, words))
    ]
    every = counted[0].union(counted[1])
    if seeded:
        seeds = [(t, limits.locality_frequency, 2) for t in C.SPELLING_LOCALITIES] + [(t, limits.suffix_frequency, 3) for t in C.SPELLING_SUFFIXES]
        every = every.union(spark.createDataFrame(seeds, "term string, freq bigint, source int"))
    return every.filter(F.length("term") >= limits.min_length).groupBy("term").agg(F.max_by("freq", "source").alias("freq"))


def lookup(words: DataFrame, dictionary: DataFrame, word: str = "word", distance: int = LIMITS.max_distance) -> DataFrame:
    """(word, term, distance, freq, rank): suggestions for each different word, nearest first, then the most frequent, then by term.

    A word that the dictionary has is its only suggestion. Null and blank words have none.
    """
    distinct = words.select(F.upper(F.trim(F.col(word))).alias("word")).filter("word <> ''").distinct()
    exact = distinct.join(dictionary, F.col("word") == F.col("term")).select("word", "term", F.lit(0).alias("distance"), "freq")
    probes = with_deletes(distinct.join(dictionary, F.col("word") == F.col("term"), "left_anti"), "word", distance)
    met = probes.join(with_deletes(dictionary, "term", distance), "key").select("word", "term", "freq").distinct()
    near = met.withColumn("distance", osa("word", "term", distance)).filter("distance is not null").select("word", "term", "distance", "freq")
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    return exact.union(near).withColumn("rank", F.row_number().over(order))


def correct(texts: DataFrame, dictionary: DataFrame, key: str, text: str, limits: C.Spelling = LIMITS) -> DataFrame:
    """(key, text, corrected, corrections, confidence): each row's text with its misspelt words replaced.

    Words shorter than min_length, house numbers and street suffixes stay. A text without
    a correction stays as it is; confidence is the least of its corrections', null without.
    """
    words = texts.select(key, F.posexplode(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")).alias("at", "token")).withColumn("word", F.upper("token"))
    eligible = (F.length("word") >= limits.min_length) & ~F.col("word").rlike(r"^\d+[A-Z]?$") & ~F.col("word").isin(*C.UNCORRECTED_SUFFIXES)
    best = lookup(words.filter(eligible), dictionary, "word", limits.max_distance).filter("rank = 1 and distance > 0").select("word", "term", "distance")
    told = words.join(best, "word", "left").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("term", "token").alias("w")))), lambda x: x["w"]), " ").alias("joined"),
        F.count("term").alias("corrections"),
        (1 - F.max("distance") / F.lit(float(limits.max_distance))).alias("confidence"),
    )
    rows = texts.select(key, text).join(told, key, "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))
    return rows.select(key, text, F.when(F.col("corrections") > 0, F.col("joined")).otherwise(F.col(text)).alias("corrected"), "corrections", "confidence")


def dictionary_statistics(dictionary: DataFrame, distance: int = LIMITS.max_distance) -> DataFrame:
    """(terms, deletes, total_frequency, longest): the dictionary's size and its index's."""
    index = with_deletes(dictionary, "term", distance).filter("key <> term").agg(F.count_distinct("key").alias("deletes"))
    return dictionary.agg(F.count(F.lit(1)).alias("terms"), F.sum("freq").alias("total_frequency"), F.max(F.length("term")).alias("longest")).crossJoin(F.broadcast(index))


def correction_impact(texts: DataFrame, dictionary: DataFrame, text: str, rows: int = 5000, seed: int = 0) -> DataFrame:
    """(texts, corrected, corrections): what correction does to a sample of different texts, taken in order of a hash."""
    sample = texts.select(text).filter(F.col(text) != "").distinct().orderBy(F.xxhash64(F.col(text), F.lit(seed)), text).limit(rows)
    done = correct(sample.withColumn("_id", F.xxhash64(text)), dictionary, "_id", text)
    return done.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("corrections") > 0).alias("corrected"), F.coalesce(F.sum("corrections"), F.lit(0)).alias("corrections"))



