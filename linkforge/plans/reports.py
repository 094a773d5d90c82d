"""Group consensus, aggregates, windows, warehouse, reports and web queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkforge.functions import text as T
from linkforge.functions.dialect import SPARK, Dialect
from linkforge.operators.joins import dense_ids
from linkforge.streaming.changes import recent_counts

from .matching import with_candidates
from .registry import ORACLES, QUERIES, REWRITES, portable, register

#: Matches used by the reports: legacy UPRN, else exact canonical text, lowest address first.
MATCHED = (
    "(select doc_id, address_id, method, confidence from (select *, row_number() over (partition by doc_id order by confidence desc, address_id) as rn from ("
    "select d.doc_id, g.address_id, 'valid_uprn' as method, 1.0 as confidence from docs d join gaz g on g.uprn = d.legacy "
    "union all select d.doc_id, g.address_id, 'addr_exact' as method, 0.97 as confidence from docs d join gaz g on g.can = d.can "
    "union all select d.doc_id, g.address_id, 'postcode_only' as method, 0.45 as confidence from docs d join gaz g on g.pc = d.pc) s) t where rn = 1)"
)
#: The same from the first address of each number, text and postcode: no document meets all addresses of its postcode.
_FIRST = "(select {0} as k_{0}, min(address_id) as by_{0} from gaz group by {0})"
REWRITES[MATCHED] = (
    "(select doc_id, coalesce(by_uprn, by_can, by_pc) as address_id, case when by_uprn is not null then 'valid_uprn' when by_can is not null then 'addr_exact' else 'postcode_only' end as method, "
    "case when by_uprn is not null then 1.0 when by_can is not null then 0.97 else 0.45 end as confidence from docs d "
    f"left join {_FIRST.format('uprn')} u on u.k_uprn = d.legacy left join {_FIRST.format('can')} c on c.k_can = d.can left join {_FIRST.format('pc')} p on p.k_pc = d.pc "
    "where by_uprn is not null or by_can is not null or by_pc is not null)"
)
FACT = f"(select d.*, m.address_id, m.method, m.confidence, m.address_id is not null as is_matched from docs d left join {MATCHED} m on m.doc_id = d.doc_id)"

with_candidates(
    "r8_match_rate_by_type", 0.6, 5,
    lambda d: "select d.doc_type, count(*) as n_docs, count(m.doc_id) as n_matched, round(100.0 * count(m.doc_id) / count(*), 2) as match_rate, round(avg(m.score), 4) as avg_score "
    f"from docs d left join (select doc_id, max(score) as score from (select doc_id, similarity as score from cand union all select doc_id, confidence from {MATCHED} e) u group by doc_id) m on m.doc_id = d.doc_id group by d.doc_type",
    # Of a document's candidates only the largest similarity counts.
    candidates=lambda w: w.likest(0.6),
)

# -- groups -------------------------------------------------------------------------
VOTES = f"(select app_base, address_id, count(*) as votes, max(confidence) as best from {FACT} f where confidence > 0.5 group by app_base, address_id)"
WINNER = f"(select app_base, address_id, votes, best from (select *, row_number() over (partition by app_base order by votes desc, best desc, address_id) as rn from {VOTES} v) w where rn = 1)"
portable("g1_consensus_winner", f"select * from {WINNER} w")
portable("g7_inconsistent", f"select app_base, n, case when n > 2 then 'many_addresses' else 'two_addresses' end as issue from (select app_base, count(distinct address_id) as n from {FACT} f where address_id is not null group by app_base) g where n > 1")
portable("g9_golden_groups", f"select app_base, count(*) as n_docs, count(case when confidence >= 0.9 then 1 end) as golden from {FACT} f group by app_base having count(case when confidence >= 0.9 then 1 end) >= 2 and count(*) between 2 and 8 and count(case when not is_matched then 1 end) >= 1")

# -- aggregates ---------------------------------------------------------------------
portable("ag_filter_distinct", "select event_type, count(*) as n, count(*) filter (where value > 50) as high, count(distinct user_id) as users, count(distinct user_id) filter (where value > 50) as high_users from events group by event_type")
portable("ag_having", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey having count(*) >= 12")
portable("ag_bands", "select case when o_totalprice < 100000 then 'low' when o_totalprice < 250000 then 'middle' else 'high' end as band, count(*) as n, round(avg(o_totalprice), 2) as mean from orders group by case when o_totalprice < 100000 then 'low' when o_totalprice < 250000 then 'middle' else 'high' end")
portable("ag_share_of_total", "select o_orderstatus, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from orders group by o_orderstatus")
portable("ag_mode", "select l_suppkey, l_returnflag from (select l_suppkey, l_returnflag, row_number() over (partition by l_suppkey order by count(*) desc, l_returnflag) as rn from lineitem group by l_suppkey, l_returnflag) s where rn = 1")
portable("ag_metric_rows", "select 'docs' as metric, count(*) as n from docs union all select 'gaz' as metric, count(*) as n from gaz union all select 'places' as metric, count(*) as n from docs where easting is not null")
portable("ag_array_agg", lambda d: f"select town, {'array_join(sort_array(collect_set(suffix)), chr(44))' if d is SPARK else 'array_to_string(list_sort(list(distinct suffix)), chr(44))'} as kinds from (select town, split_part(road, ' ', 2) as suffix from gaz) s group by town")
portable("ag_listagg", lambda d: f"select blpu_class, {'listagg(distinct status, chr(124)) within group (order by status)' if d is SPARK else 'string_agg(distinct status, chr(124) order by status)'} as statuses from gaz group by blpu_class")
portable(
    "ag_threshold_tuning",
    f"select threshold, tp, fp, round(tp / nullif(cast(tp + fp as double), 0), 6) as precision_, round(tp / cast(n as double), 6) as recall_ from (select t.threshold, count(case when f.confidence >= t.threshold and f.address_id = f.target_id then 1 end) as tp, "
    f"count(case when f.confidence >= t.threshold and f.address_id <> f.target_id then 1 end) as fp, count(*) as n from {FACT} f join (select 0.4 as threshold union all select 0.9 union all select 0.99) t on true group by t.threshold) s",
)
portable("ag_token_frequency", lambda d: f"select word, count(*) as n from (select {'explode' if d is SPARK else 'unnest'}({d.split('can', ' ')}) as word from gaz) s where length(word) >= 3 group by word")

# -- windows ------------------------------------------------------------------------
portable("w_row_number", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) s where rn = 1")
register("w_dense_rank", lambda w: dense_ids(w.docs, "app_base"), "select distinct app_base, dense_rank() over (order by app_base) as group_id from docs")
portable("w_runner_up", "select o_custkey, o_orderkey, round(o_totalprice - coalesce(lead(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey), 0), 2) as margin from orders")
portable("w_topk", "select l_suppkey, l_orderkey, l_linenumber, rn from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) s where rn <= 3")
portable("w_page", "select doc_id, raw_address from docs order by doc_id limit 100 offset 200")
portable("w_priority_sort", "select address_id, uprn from gaz where town = 'ALTON' order by case status when '1' then 0 when '8' then 1 else 2 end, address_id limit 50")
portable("w_setops", "select town from gaz union select upper(n_name) from nation")

# -- arrays, JSON, dates, classes ---------------------------------------------------------
portable("x_flags_array", lambda d: f"select doc_id, {d.join(d.filter(d.array(*[f'case when {c} then {d.lit(n)} end' for c, n in (('pc = ' + chr(39) * 2, 'no_postcode'), ('easting is null', 'no_place'), ('length(raw_address) < 10', 'short'))]), 'f', 'f is not null'), '|')} as flags from docs")
portable("x_json", lambda d: "select event_id, " + ("get_json_object(props, '$.k')" if d is SPARK else "json_extract_string(props, '$.k')") + " as k from events")
portable("x_date_parts", "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, day(o_orderdate) as d, case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end as financial_year from orders")
portable("x_ilike_class", "select p_partkey, case when p_name ilike '%cold%' then 'cold' when p_name ilike '%hot%' then 'hot' when p_type ilike '%brass%' then 'brass' else 'other' end as class from part")
portable(
    "s_date_guarded_parse",
    lambda d: f"select doc_id, case when {d.like('date_text', r'^\d{1,2}/\d{1,2}/\d{4}$')} and try_cast(split_part(date_text, '/', 2) as int) <= 12 then " + ("try_to_date(date_text, 'd/M/yyyy')" if d is SPARK else "cast(try_strptime(date_text, '%d/%m/%Y') as date)") + " end as doc_date from docs",
)
portable("s_file_reference", lambda d: f"select doc_id, {d.ext('filepath', r'([^/\\]+)$')} as file_name from docs")
portable("s_union_types", "select doc_id, 'decision' as kind from docs where doc_type = 'decision' union all select doc_id, 'other' as kind from docs where doc_type <> 'decision'")

# -- warehouse and reports ------------------------------------------------------------
portable("r1_fact_build", f"select doc_id, doc_type, address_id, method, confidence, is_matched from {FACT} f")
portable(
    "r3_fact_completeness",
    f"select doc_id, 0.2 * (case when raw_address <> '' then 1 else 0 end + case when pc <> '' then 1 else 0 end + case when easting is not null then 1 else 0 end + case when legacy is not null then 1 else 0 end + case when is_matched then 1 else 0 end) as completeness, "
    f"case when confidence >= 0.85 then 'AUTO_ACCEPT' when confidence >= 0.5 then 'NEEDS_REVIEW' when confidence >= 0.2 then 'LOW_CONFIDENCE' else 'NO_MATCH' end as decision from {FACT} f",
)
portable("d17_ladder", f"select doc_id, case when coalesce(confidence, 0) >= 0.85 then 'AUTO_ACCEPT' when confidence >= 0.5 then 'NEEDS_REVIEW' when confidence >= 0.2 then 'LOW_CONFIDENCE' else 'NO_MATCH' end as decision from {FACT} f")
portable("r5_original_addresses", "select md5(lower(trim(raw_address))) as hash, min(raw_address) as raw_address, count(*) as uses from docs where raw_address <> '' group by md5(lower(trim(raw_address)))")
portable("r6_integrity", f"select 'orphan_uprn' as check_name, count(*) as n from docs d where legacy is not null and not exists (select 1 from gaz g where g.uprn = d.legacy) union all select 'two_places', count(*) from (select uprn as u, count(distinct easting) as c from gaz group by uprn) s where c > 1 union all select 'unmatched', count(*) from {FACT} f where not is_matched")
portable("r7_method_performance", f"select method, count(*) as n, round(avg(confidence), 4) as mean, min(confidence) as low, max(confidence) as high from {FACT} f where is_matched group by method")
portable("r7_unmatched", f"select doc_id, doc_type, raw_address from {FACT} f where not is_matched")
portable("r7_needs_review", f"select doc_id, confidence from {FACT} f where confidence < 0.7")
portable("r7_geographic_summary", f"select g.town, count(*) as n, round(avg(f.confidence), 4) as mean from {FACT} f join gaz g on g.address_id = f.address_id group by g.town")
portable("r8_dashboard", f"select 'all' as band, count(*) as n from {FACT} f union all select 'high', count(*) from {FACT} f where confidence >= 0.85 union all select 'low', count(*) from {FACT} f where confidence < 0.85 union all select 'none', count(*) from {FACT} f where confidence is null")
portable("r9_export_rows", lambda d: f"select doc_id, doc_type, raw_address, case when confidence >= 0.95 then 'High' when confidence >= 0.8 then 'Medium' when confidence > 0 then 'Low' else 'None' end as level from {FACT} f")
portable("r11_uprn_report", "select count(*) as total, count(g.uprn) as in_gazetteer, count(case when d.legacy is not null and g.uprn is null then 1 end) as invalid from docs d left join gaz g on g.uprn = d.legacy")
portable("r13_statistics", f"select doc_type, count(*) as n, count(case when is_matched then 1 end) as matched, round(100.0 * count(case when is_matched then 1 end) / count(*), 2) as rate from {FACT} f group by doc_type")
portable("r17_dedup", "select count(*) as n, count(distinct can) as forms, round(1 - count(distinct can) / cast(count(*) as double), 6) as saved from docs")
portable("q_stats", f"select method, doc_type, count(*) as n from {FACT} f group by method, doc_type")
portable("q_viewport", f"select count(*) as n, count(case when is_matched then 1 end) as matched from {FACT} f where easting between 445000 and 460000 and northing between 105000 and 125000")
portable("q_search", lambda d: f"select address_id, full_address, case when full_address = '1 CHURCH ROAD' then 1 when left(full_address, 6) = 'CHURCH' then 2 else 3 end as rank from gaz where full_address ilike '%church road%' and status = '1'")
portable("q_records", f"select doc_id, doc_type, method from {FACT} f where doc_type = 'decision' and is_matched and confidence between 0.4 and 1.0 and raw_address ilike '%road%'")
portable("k6_export_format", f"select doc_id, doc_type, cast(cast(round(coalesce(confidence, 0), 3) as decimal(8, 3)) as string) as score from {FACT} f")
portable("k1_top_results", f"select doc_id, address_id, rn from (select d.doc_id, g.address_id, row_number() over (partition by d.doc_id order by g.address_id) as rn from docs d join gaz g on g.pc = d.pc) s where rn <= 10")
portable("dd1_spatial_areas", "select road, left(postcode, 4) as sector, round(avg(easting), 3) as e, round(avg(northing), 3) as n, min(easting) as e0, max(easting) as e1, count(*) as uprns from gaz where status = '1' group by road, left(postcode, 4)")
portable("dd2_multi_hit_rank", "select doc_id, address_id from (select d.doc_id, g.address_id, row_number() over (partition by d.doc_id order by case g.status when '1' then 0 when '8' then 1 else 2 end, case when left(g.blpu_class, 1) = 'R' then 0 else 1 end, g.address_id) as rn from docs d join gaz g on g.can = d.can) s where rn = 1")
portable("dd14_review_queue", f"select doc_id, confidence from {FACT} f where confidence between 0.40 and 0.70 order by abs(confidence - 0.55), doc_id")


def st1(spark, sf_dir):  # noqa: ANN001, ANN201
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = recent_counts(events, "ts", "5 minutes", "5 minutes")
    return counted.select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "n")


QUERIES["st1_recent_counts"] = st1
ORACLES["st1_recent_counts"] = "select cast(floor(epoch(ts) / 300) * 300 as bigint) as window_start, event_type, count(*) as n from events group by 1, 2"
