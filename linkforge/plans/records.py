"""Calendar, record filters and changes, golden records and run statistics as queries; their SQL is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators import records
from linkforge.sinks import results

from .demo import World
from .engines import accepted_rows
from .groups import GROUPED, fact
from .registry import register, spark_sql
from .reports import FACT, MATCHED

register(
    "x5_calendar", lambda w: records.calendar(w.spark),
    "select strftime(d, '%Y%m%d')::int as date_id, d::date as date_actual, dayname(d) as day_name, extract(dow from d) as day_of_week, extract(day from d) as day_of_month, extract(doy from d) as day_of_year, "
    "extract(week from d) as week_of_year, monthname(d) as month_name, extract(month from d) as month_number, extract(quarter from d) as quarter, extract(year from d) as year, extract(dow from d) in (0, 6) as is_weekend, "
    "case when extract(month from d) >= 4 then extract(year from d) else extract(year from d) - 1 end as financial_year, "
    "case when extract(month from d) between 4 and 6 then 1 when extract(month from d) between 7 and 9 then 2 when extract(month from d) between 10 and 12 then 3 else 4 end as financial_quarter "
    "from (select unnest(generate_series(date '2020-01-01', date '2030-12-31', interval 1 day)) as d) s",
)
register(
    "c6_record_filter", lambda w: records.filtered(spark_sql(w, f"select doc_id, doc_type, raw_address, confidence from {FACT} f"), doc_type="decision", least=0.9, most=1.0, search="Road").select("doc_id", "raw_address"),
    f"select doc_id, raw_address from {FACT} f where doc_type = 'decision' and confidence between 0.9 and 1.0 and raw_address ilike '%road%'",
)


def changes(w: World) -> DataFrame:
    """Every fourth document is accepted, then every eighth rejected; every fifth gets a place."""
    actions = spark_sql(
        w,
        "select 1 as seq, doc_id, 'accept' as action, doc_id % 50 as address_id, cast(null as double) as easting, cast(null as double) as northing, cast(null as string) as note, 'clerk' as decided_by from docs where doc_id % 4 = 0 "
        "union all select 2, doc_id, 'reject', null, null, null, 'wrong', 'clerk' from docs where doc_id % 8 = 0 union all select 3, doc_id, 'set_coordinates', null, 1.5, 2.5, null, 'clerk' from docs where doc_id % 5 = 0",
    )
    base = spark_sql(w, f"select doc_id, address_id, method, easting, northing from {FACT} f")
    return records.changed(base, actions, "2024-01-03")[0]


register(
    "k13_changes", changes,
    "select doc_id, case when doc_id % 8 = 0 then null when doc_id % 4 = 0 then doc_id % 50 else address_id end as address_id, case when doc_id % 8 = 0 then null when doc_id % 4 = 0 then 'manual' else method end as method, "
    f"case when doc_id % 5 = 0 then 1.5 else easting end as easting, case when doc_id % 5 = 0 then 2.5 else northing end as northing from {FACT} f",
)
register(
    "dd18_golden_pairs", lambda w: records.golden_pairs(fact(w)),
    f"with fact as materialized (select * from {GROUPED} g), fit as (select app_base from fact group by app_base having count(*) between 2 and 8 and count(*) filter (where confidence >= 0.9) >= 2 and count(*) filter (where coalesce(confidence, 0) = 0) >= 1), "
    "best as (select distinct on (app_base) app_base, address_id from fact where confidence >= 0.9 order by app_base, confidence desc, doc_id) "
    "select f.doc_id, f.app_base, b.address_id from fact f join fit on fit.app_base = f.app_base join best b on b.app_base = f.app_base where coalesce(f.confidence, 0) = 0",
)
register(
    "ag13_run_statistics",
    lambda w: records.run_statistics(accepted_rows(w).withColumn("score", F.col("score").cast("double")), ["decision", "method"]).select("decision", "method", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")]),
    f"select case when confidence >= 0.9 then 'auto_accepted' else 'needs_review' end as decision, method, count(*) as n, round(avg(confidence), 6) as mean, min(confidence) as low, max(confidence) as high from {MATCHED} m group by all",
)


def history(w: World) -> DataFrame:
    """What was decided of one document: its audited rows and an override."""
    rows = w.candidates(0.6, 5).select("doc_id", "address_id", F.lit("fuzzy").alias("method"), F.round("similarity", 6).alias("score"))
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("address_id", "method", "score"), F.struct("score", -F.col("address_id"))).alias("b"))
    decided = best.select("doc_id", "b.*", F.lit("accepted").alias("decision"), F.lit("system").alias("decided_by"))
    told = w.docs.filter("doc_id = 10").select("doc_id", F.lit(1).cast("bigint").alias("address_id"), F.lit("manual").alias("method"), F.lit(1.0).alias("score"), F.lit("clerk").alias("decided_by"))
    return results.decision_history(results.audit_rows(rows, decided), told, 10).select("doc_id", "address_id", "method", "decision", "decided_by")


register("r15_decision_history", history)
