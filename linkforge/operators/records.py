"""Records as the web screens change and filter them, the calendar, and golden records of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACTIONS = ("accept", "reject", "set_coordinates", "add_note")


def calendar(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    """One row a day, both ends included; weeks start on Sunday as 0, the financial year on 1 April. None if last is before first."""
    days = spark.range(1).selectExpr(f"explode(case when date'{last}' >= date'{first}' then sequence(date'{first}', date'{last}') else array() end) as date_actual")
    month, year = F.month("date_actual"), F.year("date_actual")
    return days.select(
        F.date_format("date_actual", "yyyyMMdd").cast("int").alias("date_id"), "date_actual", F.date_format("date_actual", "EEEE").alias("day_name"),
        (F.dayofweek("date_actual") - 1).alias("day_of_week"), F.dayofmonth("date_actual").alias("day_of_month"), F.dayofyear("date_actual").alias("day_of_year"),
        F.weekofyear("date_actual").alias("week_of_year"), F.date_format("date_actual", "MMMM").alias("month_name"), month.alias("month_number"), F.quarter("date_actual").alias("quarter"),
        year.alias("year"), F.dayofweek("date_actual").isin(1, 7).alias("is_weekend"), F.when(month >= 4, year).otherwise(year - 1).alias("financial_year"),
        F.when(month >= 4, F.quarter("date_actual") - 1).otherwise(4).alias("financial_quarter"),
    )


def filtered(
    rows: DataFrame, doc_type: str | None = None, status: str | None = None, quality: str | None = None, least: float | None = None, most: float | None = None, search: str | None = None
) -> DataFrame:
    """The rows that meet all filters that are given; the search is for a part of the address, in any case, with no wildcards."""
    tests: list[Column] = []
    for column, value in (("doc_type", doc_type), ("status", status), ("quality", quality)):
        if value:
            tests.append(F.col(column) == value)
    if least is not None:
        tests.append(F.col("confidence") >= least)
    if most is not None:
        tests.append(F.col("confidence") <= most)
    if search:
        tests.append(F.contains(F.lower("raw_address"), F.lower(F.lit(search))))
    return rows.filter(reduce(Column.__and__, tests)) if tests else rows


def changed(records: DataFrame, actions: DataFrame, decided_at: str) -> tuple[DataFrame, DataFrame]:
    """(records, audit) after actions(seq, doc_id, action, address_id, easting, northing, note, decided_by).

    records have doc_id, address_id, method, easting and northing. The last accept or reject
    of a document decides its address, the last set_coordinates its place; notes are kept in
    the audit only, which has a row for each action with the values before it. Actions of no
    known kind and ones on unknown documents are left out.
    """
    known = actions.filter(F.col("action").isin(*ACTIONS)).join(records.select("doc_id").distinct(), "doc_id", "left_semi")
    last = lambda kinds, *cs: known.filter(F.col("action").isin(*kinds)).groupBy("doc_id").agg(F.max_by(F.struct("action", *cs), "seq").alias("_t"))
    told = last(("accept", "reject"), "address_id").select("doc_id", F.col("_t.action").alias("_action"), F.when(F.col("_t.action") == "accept", F.col("_t.address_id")).alias("_address"))
    put = last(("set_coordinates",), "easting", "northing").select("doc_id", F.lit(True).alias("_put"), F.col("_t.easting").alias("_e"), F.col("_t.northing").alias("_n"))
    both = records.join(told, "doc_id", "left").join(put, "doc_id", "left")
    set_ = lambda hit, new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
    decided, moved = F.col("_action").isNotNull(), F.col("_put").isNotNull()
    now = both.select(
        *[
            set_(decided, "_address", c) if c == "address_id" else F.when(F.col("_action") == "accept", "manual").when(~decided, F.col(c)).alias(c) if c == "method"
            else set_(moved, "_e", c) if c == "easting" else set_(moved, "_n", c) if c == "northing" else F.col(c)
            for c in records.columns
        ]
    )
    before = F.to_json(F.struct("address_id", "method", "easting", "northing")).alias("before")
    audit = known.select("seq", "doc_id", "action", "note", "decided_by").join(records.select("doc_id", before), "doc_id").withColumn("decided_at", F.lit(decided_at))
    return now, audit


def golden_pairs(fact: DataFrame, least: float = 0.9, fewest: int = 2, most: int = 8, golden: int = 2) -> DataFrame:
    """(doc_id, app_base, address_id): unmatched documents of small groups with golden records, and the best of those.

    fact(doc_id, app_base, address_id, confidence). Of equal confidence the smallest document's counts.
    """
    good, open_ = F.col("confidence") >= least, F.coalesce(F.col("confidence"), F.lit(0)) == 0
    groups = fact.filter("app_base is not null").groupBy("app_base").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"), F.count_if(open_).alias("n_open"),
        F.min(F.when(good, F.struct((-F.col("confidence")).alias("c"), "doc_id", "address_id"))).alias("best"),
    )
    fit = groups.filter((F.col("n").between(fewest, most)) & (F.col("n_good") >= golden) & (F.col("n_open") >= 1)).select("app_base", F.col("best.address_id").alias("address_id"))
    return fact.filter(open_).select("doc_id", "app_base").join(fit, "app_base").select("doc_id", "app_base", "address_id")


def run_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count and the mean, least and greatest score of each document's best row, by the given columns."""
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.col("address_id")))).filter("_rn = 1")
    return best.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
