"""File sources: feeds of raw records, their lineage columns and partition dates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema_log import RESCUED, SchemaLog, conform, merge
from .sinks import hadoop


@dataclass(frozen=True)
class Feed:
    """A raw feed. Each format is a stream of its own with its own checkpoint; each appends to its part of one table."""

    name: str
    folder: str
    description: str
    formats: tuple[str, ...]
    service_date: str | None = None
    max_files: int = 1000
    options: dict[str, str] = field(default_factory=dict)


# fixed values: the feeds, and the files of each format
GLOBS = {"json": "*.{json,ndjson}", "csv": "*.csv", "parquet": "*.parquet"}
FEEDS = {
    f.name: f
    for f in (
        Feed("ehr_patients", "ehr/patients", "FHIR patients", ("json",)),
        Feed("ehr_encounters", "ehr/encounters", "FHIR encounters", ("json",)),
        Feed("ehr_conditions", "ehr/conditions", "FHIR conditions", ("json", "csv")),
        Feed("ehr_procedures", "ehr/procedures", "FHIR procedures", ("json", "csv")),
        Feed("ehr_observations", "ehr/observations", "FHIR observations", ("json", "csv"), max_files=2000),
        Feed("claims_professional", "claims/professional", "professional claims", ("csv", "parquet"), "service_from_date"),
        Feed("claims_institutional", "claims/institutional", "institutional claims", ("csv", "parquet"), "admission_date"),
        Feed("claims_pharmacy", "claims/pharmacy", "pharmacy claims", ("csv", "parquet"), "fill_date"),
    )
}


def partition_date(column: str, today: Column) -> Column:
    """The service date, or today where it is missing or cannot be read."""
    return F.coalesce(F.try_to_date(F.substring(F.col(column).cast("string"), 1, 10)), today)


def with_lineage(df: DataFrame, feed: Feed, batch_id: str, today: Column | None = None) -> DataFrame:
    """Lineage columns; claims also get the date that they are partitioned by."""
    day = F.current_date() if today is None else today
    added = {
        "_ingestion_timestamp": F.current_timestamp(),
        "_source_file": F.col("_metadata.file_path"),
        "_batch_id": F.lit(batch_id),
        "_source_description": F.lit(feed.description),
        "_ingestion_date": day,
    }
    if feed.service_date:
        known = feed.service_date.lower() in {c.lower() for c in df.columns}
        added["_partition_date"] = partition_date(feed.service_date, day) if known else day
    return df.withColumns(added)


#: Where a feed's bronze table keeps its schemas, and the column that tells which one a row was read with.
SCHEMAS, VERSION = "_schemas", "_schema"
LINEAGE = T.StructType(
    [
        T.StructField("_ingestion_timestamp", T.TimestampType()), T.StructField("_source_file", T.StringType()), T.StructField("_batch_id", T.StringType()),
        T.StructField("_source_description", T.StringType()), T.StructField("_ingestion_date", T.DateType()),
    ]
)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """A bronze table: what each format's stream has committed, with the columns of all its files in their widest
    types. Each version's rows are read with its own schema, so no file's footer is merged."""
    at, fs = hadoop(spark, path)
    parts = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName() != SCHEMAS)
    frames = []
    for kind in parts:
        table, schemas = f"{path}/{kind}", SchemaLog(spark, f"{path}/{SCHEMAS}/{kind}").schemas()
        dated = bool(fs.globStatus(hadoop(spark, f"{table}/{VERSION}=*/_partition_date=*")[0]))
        more = [*LINEAGE, *([T.StructField("_partition_date", T.DateType())] if dated else []), *([T.StructField(RESCUED, T.StringType())] if kind == "json" else [])]
        for version, schema in schemas.items():
            stored = T.StructType([*schema, *more, T.StructField(VERSION, T.IntegerType())])
            frames.append(spark.read.schema(stored).parquet(table).where(F.col(VERSION) == version).drop(VERSION))
    if not frames:
        raise FileNotFoundError(path)
    whole = reduce(merge, [df.schema for df in frames])
    return reduce(DataFrame.unionByName, [conform(df, whole) for df in frames])


def ingest_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Records, batches and days of each bronze table, one pass per table."""
    out = None
    for name, df in tables.items():
        day = "_partition_date" if "_partition_date" in df.columns else "_ingestion_date"
        row = df.agg(
            F.count(F.lit(1)).alias("records"), F.count_distinct("_batch_id").alias("batches"), F.count_distinct(day).alias("partitions"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
        ).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables")
    return out
