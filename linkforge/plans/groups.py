"""Group consensus as queries; their SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkforge.config import GroupLimits
from linkforge.functions import text as T
from linkforge.functions.dialect import DUCK
from linkforge.operators import groups

from .demo import World
from .registry import register, spark_sql
from .reports import FACT


#: Of each group of four the second and third document have the first one's address; the second is matched as it is, the third not.
GROUPED = (
    "(select f.doc_id, f.app_base, case when f.doc_id % 4 in (1, 2) then l.raw_address else f.raw_address end as raw_address, "
    "case f.doc_id % 4 when 1 then l.address_id when 2 then null else f.address_id end as address_id, "
    "case f.doc_id % 4 when 1 then l.confidence when 2 then null else f.confidence end as confidence, "
    f"case f.doc_id % 4 when 1 then l.method when 2 then null else f.method end as method from {FACT} f join {FACT} l on l.doc_id = f.doc_id - f.doc_id % 4)"
)


def fact(w: World) -> DataFrame:
    return w.stage("grouped", lambda: spark_sql(w, f"select * from {GROUPED} g"))


STRICT = GroupLimits(most_docs=10, real_share=0.7, most_references=2, most_variations=1, prefix=30)


def safe_sql(g: GroupLimits) -> str:
    real = T.is_real_address(DUCK, "raw_address")
    return (
        f"with fact as materialized (select * from {GROUPED} g), voted as (select app_base, address_id, count(*) as votes, max(confidence) as best from fact where confidence > 0.5 group by all), "
        "ranked as (select *, row_number() over (partition by app_base order by votes desc, best desc, address_id) as rn from voted), "
        f"sized as (select app_base, count(*) as n_docs, count(*) filter (where confidence > 0) as n_matched, count(*) filter (where {real}) as n_real, "
        f"count(distinct substring(raw_address, 1, {g.prefix})) filter (where {real}) as n_variations from fact group by app_base), "
        "safe as (select s.app_base, r.address_id, r.votes, s.n_docs, s.n_real from sized s join ranked r on r.app_base = s.app_base and r.rn = 1 "
        f"where n_docs between {g.least_docs} and {g.most_docs} and n_matched > 0 and n_matched < n_docs and n_real >= n_docs * {g.real_share} and n_docs - n_real <= {g.most_references} "
        f"and n_variations <= {g.most_variations} and votes >= {g.least_votes} and votes >= n_matched * {g.vote_share}), "
        "corrected as (select f.doc_id, f.app_base, f.address_id as original, s.address_id as corrected, case when s.votes >= 5 then 0.95 when s.votes >= 3 then 0.90 else 0.85 end as confidence "
        f"from fact f join safe s on s.app_base = f.app_base where {real.replace('raw_address', 'f.raw_address')} and (f.address_id is null or f.confidence < 0.5 or f.address_id <> s.address_id))"
    )


register("g2_safe_groups", lambda w: groups.safe_groups(fact(w)), safe_sql(groups.LIMITS) + " select * from safe")
register("g3_corrections", lambda w: groups.corrections(fact(w)), safe_sql(groups.LIMITS) + " select * from corrected")
register("g4_strict_corrections", lambda w: groups.corrections(fact(w), STRICT), safe_sql(STRICT) + " select * from corrected")
register(
    "g5_ratio_corrections", lambda w: groups.ratio_corrections(fact(w)),
    safe_sql(groups.LIMITS) + ", own as (select app_base, min(address_id) as own from fact where method = 'valid_uprn' group by app_base), n as (select app_base, count(*) as n from fact where address_id is not null group by app_base) "
    "select f.doc_id, coalesce(o.own, r.address_id) as corrected, case when o.own is not null then 1.0 else greatest(0.85, r.votes / n.n) end as confidence, case when o.own is not null then 'source_uprn' else 'group_votes' end as reason "
    "from fact f left join own o on o.app_base = f.app_base left join ranked r on r.app_base = f.app_base and r.rn = 1 left join n on n.app_base = f.app_base where f.address_id is null and (o.own is not null or r.address_id is not null)",
)
register(
    "g6_best_group_match", lambda w: groups.best_group_match(fact(w)),
    safe_sql(groups.LIMITS) + ", every as (select app_base, address_id, 'source_uprn' as source, count(*) as votes, max(confidence) as best from fact where method = 'valid_uprn' group by all union all select app_base, address_id, 'votes', votes, best from voted) "
    "select app_base, address_id, source, votes from (select *, row_number() over (partition by app_base order by case source when 'source_uprn' then 0 else 1 end, votes desc, best desc, address_id) as n from every) e where n = 1",
)
register(
    "g8_effective", lambda w: groups.effective(fact(w), groups.corrections(fact(w))),
    safe_sql(groups.LIMITS) + " select f.doc_id, coalesce(c.corrected, f.address_id) as address_id, c.corrected is not null as is_corrected from fact f left join corrected c on c.doc_id = f.doc_id",
)
