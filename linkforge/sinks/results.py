"""Match results, audits and overrides as rows; exports, snapshots and GeoJSON as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions.places import to_latitude_longitude
from linkforge.operators.joins import merge, top_k

#: Rows that one export request may have, alternatives that an audit keeps, candidates that a result keeps, features of a map.
MOST_EXPORTED, ALTERNATIVES, CANDIDATES, FEATURES = 50_000, 5, 10, 10_000
REVIEW_BELOW = 0.70
# The export's columns, and where each comes from.
EXPORT_COLUMNS = (
    ("Source_ID", "doc_id"), ("Job_Number", "job_number"), ("Filepath", "filepath"), ("External_Reference", "external_reference"),
    ("Document_Type", "document_type"), ("Document_Date", "document_date"), ("Original_Address", "raw_address"), ("Canonical_Address", "can"),
    ("Extracted_Postcode", "pc"), ("Source_UPRN", "raw_uprn"), ("Source_Easting", "easting"), ("Source_Northing", "northing"),
    ("Address_Quality", "address_quality"), ("Match_Status", "match_status"), ("Match_Method", "method"), ("Match_Score", "score"),
    ("Coordinate_Distance", "coordinate_distance"), ("Address_Similarity", "address_similarity"), ("Matched_UPRN", "uprn"), ("LLPG_Address", "full_address"),
    ("LLPG_Easting", "gaz_easting"), ("LLPG_Northing", "gaz_northing"), ("Matched_By", "matched_by"), ("Matched_At", "matched_at"),
)


def match_status(uprn: Column, score: Column) -> Column:
    """MATCHED, NEEDS_REVIEW (a score under REVIEW_BELOW) or UNMATCHED."""
    return F.when(F.coalesce(uprn, F.lit("")) == "", "UNMATCHED").when(score < REVIEW_BELOW, "NEEDS_REVIEW").otherwise("MATCHED")


def export_rows(rows: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The export's 24 columns as text, numbers with three decimals; columns that rows lack are empty."""
    kinds = dict(rows.dtypes)

    def text(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        x = F.format_string("%.3f", name) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        return F.coalesce(F.when(F.col(name).isNotNull(), x), F.lit(""))

    return rows.select(*[text(name).alias(title) for title, name in EXPORT_COLUMNS], *keep)


def export_by_type(rows: DataFrame, folder: str, type_col: str = "doc_type") -> None:
    """CSV files with a header, a folder for each document type."""
    typed = rows.withColumn("_type", F.coalesce(F.col(type_col), F.lit("none")))
    export_rows(typed, keep=["_type"]).write.partitionBy("_type").mode("overwrite").options(header=True, quote='"', escape='"').csv(folder)


def guarded(rows: DataFrame, most: int = MOST_EXPORTED) -> DataFrame:
    """rows, if they are at most so many; more are refused before anything is written."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"an export has at most {most} rows; filter further")
    return rows


def write_views(views: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder for each named view."""
    for name, rows in views.items():
        rows.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{folder}/{name}")


def snapshot(rows: DataFrame, folder: str, layer: str) -> None:
    """The whole table as it is after a layer."""
    rows.write.mode("overwrite").parquet(f"{folder}/{layer}")


def compare_snapshots(spark: SparkSession, folder: str, layers: list[str]) -> DataFrame:
    """(layer, documents, matched, mean_confidence) of each layer's snapshot, in order."""
    parts = []
    for n, layer in enumerate(layers):
        rows = spark.read.parquet(f"{folder}/{layer}")
        counted = rows.agg(F.count(F.lit(1)).alias("documents"), F.count("address_id").alias("matched"), F.avg("confidence").alias("mean_confidence"))
        parts.append(counted.select(F.lit(n).alias("at"), F.lit(layer).alias("layer"), "documents", "matched", "mean_confidence"))
    return reduce(DataFrame.union, parts).orderBy("at").drop("at")


def run_started(spark: SparkSession, run_id: int, label: str, started_at: str) -> DataFrame:
    return spark.createDataFrame([(run_id, label, started_at, None, None, None)], "run_id bigint, label string, started_at string, completed_at string, documents bigint, matched bigint")


def run_completed(run: DataFrame, results: DataFrame, completed_at: str) -> DataFrame:
    """The run's row with its counts: documents with any result, and those with an accepted one."""
    counts = results.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("decision") == "auto_accepted", F.col("doc_id"))).alias("matched"))
    return run.drop("documents", "matched", "completed_at").crossJoin(F.broadcast(counts)).select("run_id", "label", "started_at", F.lit(completed_at).alias("completed_at"), "documents", "matched")


def result_rows(candidates: DataFrame, run_id: int, most: int = CANDIDATES) -> DataFrame:
    """The best candidates of each document with their rank, and their features, if any, as JSON."""
    best = top_k(candidates, ["doc_id"], [F.desc("score"), F.col("address_id")], most)
    features = F.to_json("features") if "features" in candidates.columns else F.lit(None).cast("string")
    return best.select(F.lit(run_id).alias("run_id"), "doc_id", "address_id", "method", "score", F.col("rank").alias("tie_rank"), features.alias("features"))


def accept(accepted: DataFrame, results: DataFrame, policy: str = "overwrite") -> DataFrame:
    """accepted with the first result of each document that was accepted; a later one wins unless the policy keeps the older."""
    new = results.filter("decision in ('accepted', 'auto_accepted')").groupBy("doc_id").agg(F.max_by(F.struct("address_id", "method", "score"), F.struct("score", -F.col("address_id"))).alias("r"))
    return merge(accepted.select("doc_id", "address_id", "method", "score"), new.select("doc_id", "r.*"), ["doc_id"], policy)


def audit_rows(candidates: DataFrame, decisions: DataFrame, most: int = ALTERNATIVES) -> DataFrame:
    """The decided row of each document, and its other best candidates as not_selected.

    candidates: (doc_id, address_id, method, score); decisions: (doc_id, address_id, method,
    score, decision, decided_by). Of the best `most` candidates the chosen one is left out
    if it is the first.
    """
    ranked = top_k(candidates, ["doc_id"], [F.desc("score"), F.col("address_id")], most)
    chosen = decisions.select("doc_id", F.col("address_id").alias("_chosen"), "decided_by")
    other = ranked.join(chosen, "doc_id").filter(~((F.col("rank") == 1) & F.col("address_id").eqNullSafe(F.col("_chosen"))))
    detail = F.to_json(F.struct("address_id", "method", "score"))
    first = decisions.select("doc_id", "address_id", "method", "score", F.lit(1).alias("tie_rank"), F.lit(True).alias("decided"), "decision", "decided_by", detail.alias("detail"))
    rest = other.select("doc_id", "address_id", "method", "score", F.col("rank").alias("tie_rank"), F.lit(False).alias("decided"), F.lit("not_selected").alias("decision"), "decided_by", detail.alias("detail"))
    return first.unionByName(rest)


def override(accepted: DataFrame, history: DataFrame, changes: DataFrame, decided_at: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, history) after manual changes(doc_id, address_id, decided_by); a null address rejects the match."""
    told = changes.select("doc_id", "address_id", F.lit("manual").alias("method"), F.lit(1.0).alias("score"), "decided_by", F.lit(decided_at).alias("decided_at"))
    now = merge(accepted.select("doc_id", "address_id", "method", "score"), told.select("doc_id", "address_id", "method", "score"), ["doc_id"]).filter("address_id is not null")
    return now, history.unionByName(told)


def decision_history(audits: DataFrame, history: DataFrame, doc_id: int) -> DataFrame:
    """A document's audited decisions and overrides, chosen ones first."""
    a = audits.filter(F.col("doc_id") == doc_id).select("doc_id", "address_id", "method", "score", "decision", "decided_by", F.when(F.col("decided"), 0).otherwise(1).alias("order"))
    b = history.filter(F.col("doc_id") == doc_id).select("doc_id", "address_id", "method", "score", F.lit("override").alias("decision"), "decided_by", F.lit(0).alias("order"))
    return a.unionByName(b).orderBy("order", F.desc("score"), "address_id").drop("order")


def features(rows: DataFrame, properties: list[str], bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(feature): a GeoJSON feature for each row with a place, in degrees; bounds: least longitude and latitude, most longitude and latitude."""
    latitude, longitude = to_latitude_longitude(F.col("easting"), F.col("northing"))
    placed = rows.filter("easting is not null and northing is not null").withColumns({"_lat": F.round(latitude, 7), "_lng": F.round(longitude, 7)})
    if bounds is not None:
        placed = placed.filter(F.col("_lng").between(bounds[0], bounds[2]) & F.col("_lat").between(bounds[1], bounds[3]))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("_lng", "_lat").alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return placed.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def write_features(rows: DataFrame, path: str, properties: list[str]) -> None:
    """All features, one a line, in as many files as there are tasks."""
    features(rows, properties).write.mode("overwrite").text(path)


def feature_collection(rows: DataFrame, properties: list[str], bounds: tuple[float, float, float, float] | None = None, limit: int = FEATURES) -> str:
    """A FeatureCollection of at most limit features, as a map page asks for."""
    found = [r[0] for r in features(rows, properties, bounds).limit(limit).collect()]
    return '{"type":"FeatureCollection","features":[' + ",".join(found) + "]}"
