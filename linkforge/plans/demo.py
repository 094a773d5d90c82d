"""An address world derived from plain tables with integer arithmetic and concatenation only.

The same expressions are valid in Spark SQL and in other engines, so results can be
compared row by row. The gazetteer comes from ``part``, documents from ``customer``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions import text as T
from linkforge.functions.dialect import DUCK, SPARK, Dialect
from linkforge.operators.joins import top_k, trigram_join
from linkforge.sources.staging import staged

STREETS = ("CHURCH", "HIGH", "MILL", "STATION", "LONDON", "PARK VIEW", "QUEENS", "VICTORIA", "THORN", "WINCHESTER", "OAK", "SELBORNE")
SUFFIXES = ("ROAD", "STREET", "LANE", "AVENUE", "CLOSE", "DRIVE", "GARDENS", "COURT")
SHORT = ("RD", "ST", "LN", "AVE", "CL", "DR", "GDNS", "CT")
TOWNS = ("ALTON", "PETERSFIELD", "LIPHOOK", "HORNDEAN", "BORDON", "FOUR MARKS", "LISS", "MEDSTEAD", "ROPLEY", "BENTLEY", "CHAWTON")


def _pick(items: tuple[str, ...], index: str) -> str:
    return "case " + f"{index} " + " ".join(f"when {n} then '{t}'" for n, t in enumerate(items)) + " end"


def _text(x: str) -> str:
    return f"cast({x} as string)"


def parts(k: str) -> dict[str, str]:
    number = _text(f"{k} % 199 + 1")
    house = f"case when {k} % 50 = 0 then concat({number}, '-', {_text(f'{k} % 199 + 5')}) when {k} % 7 = 0 then concat({number}, 'A') else {number} end"
    street = _pick(STREETS, f"({k} % 12)")
    inward = f"substring('ABDEFGHJLN', cast({k} % 10 as int) + 1, 1)"
    second = f"substring('PQRSTUWXYZ', cast(floor({k} / 10.0) as int) % 10 + 1, 1)"
    return {
        "uprn": f"concat('1000', lpad({_text(k)}, 8, '0'))",
        "house": house,
        "street": street,
        "suffix": _pick(SUFFIXES, f"({k} % 8)"),
        "short": _pick(SHORT, f"({k} % 8)"),
        "town": _pick(TOWNS, f"({k} % 11)"),
        "postcode": f"concat('GU', {_text(f'30 + {k} % 8')}, ' ', {_text(f'{k} % 9 + 1')}, {inward}, {second})",
        "easting": f"cast(440000 + ({k} * 37) % 40000 as double)",
        "northing": f"cast(100000 + ({k} * 91) % 40000 as double)",
    }


def gazetteer_sql() -> str:
    k = parts("p_partkey")
    full = f"concat({k['house']}, ' ', {k['street']}, ' ', {k['suffix']}, ', ', {k['town']}, ', ', {k['postcode']})"
    return (
        f"select p_partkey as address_id, {k['uprn']} as uprn, {full} as full_address, {k['house']} as house, "
        f"concat({k['street']}, ' ', {k['suffix']}) as road, {k['town']} as town, {k['postcode']} as postcode, "
        f"{k['easting']} as easting, {k['northing']} as northing, case when p_partkey % 10 = 0 then '6' when p_partkey % 10 = 1 then '8' else '1' end as status, "
        f"concat('USRN', {_text('p_partkey % 96')}) as usrn, {_pick(('RD', 'CR', 'LX', 'X'), '(p_partkey % 4)')} as blpu_class, p_partkey % 97 = 0 as is_historic from part"
    )


def documents_sql(n_part: str) -> str:
    """n_part: number of gazetteer rows, a literal or a scalar subquery."""
    keyed = f"select *, (c_custkey * 7) % {n_part} as target_id, (c_custkey * 7 + 13) % {n_part} as other_id from customer"
    k = parts("target_id")
    named = "select *, " + ", ".join(f"{x} as k_{c}" for c, x in k.items()) + f" from ({keyed}) keyed"
    lined = f"select *, concat(k_street, ' ', k_suffix, ', ', k_town) as k_line from ({named}) named"
    # Perturbations: exact, short suffix, no postcode, a letter lost, two letters swapped, other house, land, lower case, reference, blank.
    address = (
        "case (c_custkey % 10) when 0 then concat(k_house, ' ', k_line, ', ', k_postcode) "
        "when 1 then concat(k_house, ' ', k_street, ' ', k_short, ', ', k_town, ' ', k_postcode) "
        "when 2 then concat(k_house, ' ', k_line) when 3 then concat(k_house, ' ', substring(k_line, 1, 2), substring(k_line, 4), ', ', k_postcode) "
        "when 4 then concat(k_house, ' ', substring(k_line, 2, 1), substring(k_line, 1, 1), substring(k_line, 3), ' ', k_postcode) "
        f"when 5 then concat({_text('target_id % 199 + 3')}, ' ', k_line, ', ', k_postcode) when 6 then concat('LAND AT ', k_line) "
        f"when 7 then lower(concat(k_house, ' ', k_line, ', ', k_postcode)) when 8 then concat('AU', {_text('10000 + c_custkey')}) else '' end"
    )
    raw_uprn = "case when c_custkey % 20 = 0 then '99990001' when c_custkey % 8 = 0 then concat(k_uprn, '.00') when c_custkey % 4 = 0 then k_uprn else '' end"
    seen = "c_custkey % 3 <> 2"
    group = _text("20000 + cast(floor(c_custkey / 4.0) as int)")
    return (
        f"select c_custkey as doc_id, {_pick(('decision', 'land_charge', 'enforcement', 'agreement', 'folder'), '(c_custkey % 5)')} as doc_type, "
        f"{address} as raw_address, {raw_uprn} as raw_uprn, case when {seen} then k_easting + c_custkey % 60 end as easting, "
        f"case when {seen} then k_northing + c_custkey % 45 end as northing, target_id, other_id, "
        f"concat({group}, '/00', {_text('c_custkey % 4')}) as planning_ref, {group} as app_base, "
        f"concat({_text('c_custkey % 28 + 1')}, '/', {_text('c_custkey % 14 + 1')}, '/', {_text('1990 + c_custkey % 30')}) as date_text, "
        f"concat('C:', chr(92), 'scans', chr(92), 'batch', {_text('c_custkey % 9')}, chr(92), 'doc_', {_text('c_custkey')}, '.pdf') as filepath, "
        f"c_acctbal as fee, c_nationkey from ({lined}) lined"
    )


def canonical_documents(d: Dialect, source: str) -> str:
    return f"select *, {T.canonical(d, 'raw_address')} as can, {T.postcode(d, 'raw_address')} as pc, {T.uprn_clean(d, 'raw_uprn')} as legacy from {source}"


def canonical_gazetteer(d: Dialect, source: str) -> str:
    return f"select *, {T.canonical(d, 'full_address')} as can, {T.postcode(d, 'full_address')} as pc from {source}"


def component_rows(d: Dialect, source: str, x: str, keep: str) -> str:
    tails = f"select {keep}, pc, {T.v1_house(d, x)} as num, {T.v1_tail(d, f'upper({x})')} as tail from {source}"
    return f"select {keep}, pc, num, {T.v1_town(d, 'tail')} as city, {T.v1_street(d, 'tail')} as way from ({tails}) tails"


def with_clause() -> str:
    return (
        f"with gaz_rows as ({gazetteer_sql()}), gaz as ({canonical_gazetteer(DUCK, 'gaz_rows')}), "
        f"doc_rows as ({documents_sql('(select count(*) from part)')}), docs as ({canonical_documents(DUCK, 'doc_rows')}), "
        f"doc_parts as ({component_rows(DUCK, 'docs', 'raw_address', 'doc_id, target_id')}), gaz_parts as ({component_rows(DUCK, 'gaz', 'full_address', 'address_id')})"
    )


#: The most candidates of a document that any strategy asks for.
MOST_CANDIDATES = 50

#: Staged frames, by application and folder: canonical forms are made once, as a load would.
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def spread(rows: DataFrame) -> DataFrame:
    """Rows in a few partitions a core at least: a small file is one, and so would be all that is staged from it."""
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


@dataclass
class World:
    """The derived frames of one scale-factor folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def stage(self, name: str, make) -> DataFrame:  # noqa: ANN001
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            _STAGED[key] = staged(make(), name)
        return _STAGED[key]

    @property
    def gaz(self) -> DataFrame:
        def make() -> DataFrame:
            rows = self.spark.sql(gazetteer_sql().replace("from part", "from {part}"), part=spread(self.table("part")))
            return self.spark.sql(_escaped(canonical_gazetteer(SPARK, "ROWS")), rows=rows)

        return self.stage("gaz", make)

    @property
    def docs(self) -> DataFrame:
        def make() -> DataFrame:
            n = self.table("part").count()
            rows = self.spark.sql(documents_sql(str(n)).replace("from customer", "from {customer}"), customer=spread(self.table("customer")))
            return self.spark.sql(_escaped(canonical_documents(SPARK, "ROWS")), rows=rows)

        return self.stage("docs", make)

    @property
    def doc_parts(self) -> DataFrame:
        return self.stage("doc_parts", lambda: self.spark.sql(_escaped(component_rows(SPARK, "ROWS", "raw_address", "doc_id, target_id")), rows=self.docs))

    @property
    def gaz_parts(self) -> DataFrame:
        return self.stage("gaz_parts", lambda: self.spark.sql(_escaped(component_rows(SPARK, "ROWS", "full_address", "address_id")), rows=self.gaz))

    def likest(self, threshold: float) -> DataFrame:
        """The best trigram candidate of each document."""
        return self.stage(f"likest_{threshold}", lambda: trigram_join(self.docs.filter("can <> ''"), self.gaz, "doc_id", "can", "address_id", "can", threshold, 1).drop("rank"))

    def candidates(self, threshold: float, k: int) -> DataFrame:
        """The k best trigram candidates of each document; the join is made once for each threshold, with MOST_CANDIDATES of each."""
        every = self.stage(
            f"candidates_{threshold}",
            lambda: trigram_join(self.docs.filter("can <> ''"), self.gaz, "doc_id", "can", "address_id", "can", threshold, MOST_CANDIDATES).drop("rank"),
        )
        if k > MOST_CANDIDATES:
            raise ValueError(f"at most {MOST_CANDIDATES} candidates are staged")
        best = top_k(every, ["doc_id"], [F.desc("similarity"), F.col("address_id")], k)
        return best.select("doc_id", "address_id", "similarity")


def _escaped(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}").replace("from ROWS", "from {rows}")
