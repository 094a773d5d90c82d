"""CSV sources: the gazetteer, the national reference, and the document types.

Every file has a header, maybe with a byte-order mark, quoted commas and back-slashed
paths. All columns are read as strings; rows with another number of fields than the
header are skipped, as are rows without their required columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkforge.functions import text as T
from linkforge.functions.dialect import SPARK

# The gazetteer's and the national reference's columns.
GAZETTEER_COLUMNS = ("ogc_fid", "locaddress", "easting", "northing", "lgcstatusc", "bs7666uprn", "bs7666usrn", "landparcel", "blpuclass", "postal")
NATIONAL_COLUMNS = ("uprn", "x_coordinate", "y_coordinate", "latitude", "longitude")
# For each document type, its columns in order; "adress" is so spelt in the files.
DOCUMENT_COLUMNS = {
    "decision": ("job_number", "filepath", "planning_application_number", "adress", "decision_date", "decision_type", "document_type", "bs7666uprn", "easting", "northing"),
    "land_charge": ("job_number", "filepath", "card_code", "address", "bs7666uprn", "easting", "northing"),
    "enforcement": ("job_number", "filepath", "planning_enforcement_reference_number", "address", "date", "document_type", "bs7666uprn", "easting", "northing"),
    "agreement": ("job_number", "filepath", "address", "date", "bs7666uprn", "easting", "northing"),
    "street_naming": ("job_number", "filepath", "address", "bs7666uprn", "easting", "northing"),
    "microfiche_post_1974": ("job_number", "filepath", "planning_application_reference", "fiche_number"),
    "microfiche_pre_1974": ("job_number", "filepath", "planning_application_reference", "fiche_number"),
    "maps": ("job_number", "filepath", "enlargement_map_number"),
    "folders": ("job_number", "filepath", "address", "bs7666uprn", "easting", "northing"),
}
#: Where a type's address, reference, date and document type stand; a text in brackets is the value itself.
_MAPPED = {
    "decision": ("adress", "planning_application_number", "decision_date", "document_type"),
    "land_charge": ("address", "card_code", None, "(Land Charge Card)"),
    "enforcement": ("address", "planning_enforcement_reference_number", "date", "document_type"),
    "agreement": ("address", "(file)", "date", "(Agreement)"),
    "street_naming": ("address", "(file)", None, "(Street Naming)"),
    "microfiche_post_1974": (None, "planning_application_reference", None, "(Microfiche)"),
    "microfiche_pre_1974": (None, "planning_application_reference", None, "(Microfiche)"),
    "maps": (None, "enlargement_map_number", None, "(Map)"),
    "folders": ("address", "(file)", None, "(Folder)"),
}
_YES = ("Y", "YES", "TRUE", "1")


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV file's rows as strings, names in lower case with underscores, or positional names where columns are given."""
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    header = spark.read.options(**options).csv(path).columns
    names = list(columns) if columns else [c.replace("\ufeff", "").strip().lower().replace(" ", "_") for c in header]
    schema = StructType([StructField(c, StringType()) for c in names])
    return spark.read.options(**options, mode="DROPMALFORMED", columnPruning=False, enforceSchema=True).schema(schema).csv(path)


def _column(df: DataFrame, name: str) -> Column:
    """A column, blank as null, or null where the file has none."""
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Staging rows: columns found by their header, whatever their order; numbers that are none are null."""
    rows = read_strings(spark, path)
    typed = {"ogc_fid": "bigint", "easting": "double", "northing": "double"}
    return rows.select(*[(_column(rows, c).try_cast(typed[c]) if c in typed else _column(rows, c)).alias(c) for c in GAZETTEER_COLUMNS])


def gazetteer_dimension(staging: DataFrame) -> DataFrame:
    """Addresses of rows with a property number, a place and an address, with their canonical form and postcode."""
    whole = staging.filter("bs7666uprn is not null and easting is not null and northing is not null and locaddress is not null")
    return whole.select(
        F.col("bs7666uprn").alias("uprn"), F.col("locaddress").alias("full_address"), "easting", "northing", F.col("bs7666usrn").alias("usrn"),
        F.col("blpuclass").alias("blpu_class"), F.col("lgcstatusc").alias("status"), F.coalesce(F.upper("postal").isin(*_YES), F.lit(False)).alias("postal"),
        F.expr(T.canonical(SPARK, "locaddress")).alias("can"), F.expr(T.postcode(SPARK, "locaddress")).alias("pc"),
    )


def new_addresses(dimension: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locations, addresses) of the newer schema that known(uprn) has not: one location a property number, one address a text."""
    fresh = dimension.join(known.select("uprn"), "uprn", "left_anti")
    locations = fresh.groupBy("uprn").agg(F.min_by(F.struct("easting", "northing", "usrn", "blpu_class", "status"), "full_address").alias("at")).select("uprn", "at.*")
    return locations, fresh.select("uprn", "full_address", "can", "pc").dropDuplicates(["uprn", "full_address"])


def read_national(spark: SparkSession, path: str) -> DataFrame:
    """National places; rows without a number or either coordinate are dropped."""
    rows = read_strings(spark, path)
    typed = rows.select(_column(rows, "uprn").alias("uprn"), *[_column(rows, c).try_cast("double").alias(c) for c in NATIONAL_COLUMNS[1:]])
    return typed.filter("uprn is not null and x_coordinate is not null and y_coordinate is not null")


def parse_date(x: Column | str) -> Column:
    """D/M/YYYY, D/M/YY (with or without noughts) or YYYY-MM-DD; anything else, and days that no month has, null."""
    x = F.trim(F.col(x) if isinstance(x, str) else x)
    forms = ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"))
    return F.coalesce(*[F.when(x.rlike(p), F.to_date(F.try_to_timestamp(x, F.lit(f)))) for p, f in forms])


def read_documents(spark: SparkSession, path: str, kind: str, positional: bool = False) -> DataFrame:
    """Staging rows of one document type, by header or by position."""
    return read_strings(spark, path, DOCUMENT_COLUMNS[kind] if positional else None)


def to_documents(staging: DataFrame, kind: str) -> DataFrame:
    """Unified documents of one type.

    Types that have an address drop rows without one; the others get one made of their
    reference. Types without a reference take the file's name.
    """
    address, reference, date, document_type = _MAPPED[kind]
    named = F.regexp_extract("filepath", r"([^/\\]+)$", 1)
    given = lambda c: F.lit(None).cast("string") if c is None else named if c == "(file)" else F.lit(c[1:-1]) if c[0] == "(" else _column(staging, c)
    ref = given(reference)
    raw = _column(staging, address) if address else F.concat(F.lit(document_type[1:-1] + " "), ref)
    rows = staging.select(
        F.lit(kind).alias("doc_type"), _column(staging, "job_number").alias("job_number"), _column(staging, "filepath").alias("filepath"), ref.alias("external_reference"),
        given(document_type).alias("document_type"), (parse_date(date) if date else F.lit(None).cast("date")).alias("document_date"), raw.alias("raw_address"),
        _column(staging, "bs7666uprn").alias("raw_uprn"), *[_column(staging, c).try_cast("double").alias(c) for c in ("easting", "northing")],
    )
    return rows.filter("raw_address is not null").withColumns({"can": F.expr(T.canonical(SPARK, "raw_address")), "pc": F.expr(T.postcode(SPARK, "raw_address"))})


def read_all_documents(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of several types' documents; paths: file or folder by type."""
    return reduce(DataFrame.unionByName, [to_documents(read_documents(spark, path, kind), kind) for kind, path in paths.items()])


def unmatched(documents: DataFrame, accepted: DataFrame, kind: str | None = None, key: str = "doc_id", after: int | None = None, limit: int | None = None) -> DataFrame:
    """Documents without an accepted match, of one type if given; a page of them in order of the key if limited."""
    rows = documents.join(accepted.select(key).distinct(), key, "left_anti")
    rows = rows if kind is None else rows.filter(F.col("doc_type") == kind)
    rows = rows if after is None else rows.filter(F.col(key) > after)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def eligible(documents: DataFrame, strategy: str) -> DataFrame:
    """The documents that a strategy can use: spatial, postcode, hierarchical, rule or vector."""
    long = lambda n: F.length(F.trim("raw_address")) > n
    told = F.upper(F.trim("raw_address")) != "N A"
    tests = {
        "spatial": (F.col("easting") > 0) & (F.col("northing") > 0),
        "postcode": F.col("pc") != "",
        "hierarchical": long(10) & told,
        "rule": long(10) & told,
        "vector": long(15) & told,
    }
    return documents.filter(tests[strategy])


def located(gazetteer: DataFrame, national: DataFrame) -> DataFrame:
    """Gazetteer rows with the national latitude and longitude, 0 where there is none."""
    places = national.select("uprn", "latitude", "longitude").dropDuplicates(["uprn"])
    return gazetteer.join(places, "uprn", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("latitude", "longitude")})
