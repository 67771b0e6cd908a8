"""The star schema as catalog tables, bucketed and sorted by patient: facts of a patient join without a shuffle, and
one patient's rows are read from one bucket of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .serve import get_patient, patient_details

BUCKETS = 64
#: The children that a patient's detail shows, and the day they are sorted by.
CHILDREN = {
    "diagnoses": ("fact_diagnosis", "diagnosis_date"),
    "treatments": ("fact_treatment_episode", "treatment_start_date"),
    "responses": ("fact_response_assessment", "assessment_date"),
    "biomarkers": ("fact_biomarker_test", "test_date"),
    "trials": ("fact_trial_enrollment", "enrollment_date"),
}


def create(spark: SparkSession, database: str, tables: dict[str, str], key: str = "patient_id", buckets: int = BUCKETS) -> list[str]:
    """Create the database and those tables that it lacks, empty, from their declared schemas; gives these. Tables
    with the key are bucketed and sorted by it."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    made = []
    for name, schema in tables.items():
        if spark.catalog.tableExists(f"{database}.{name}"):
            continue
        empty = spark.createDataFrame([], schema)
        how = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key in empty.columns else ""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet {how}")
        made.append(name)
    return made


def publish(spark: SparkSession, tables: dict[str, DataFrame], database: str, buckets: int = BUCKETS, key: str = "patient_id") -> None:
    """Replace the database's tables by these, bucketed where they have the key, with statistics."""
    create(spark, database, {name: df.schema for name, df in tables.items()}, key, buckets)
    for name, df in tables.items():
        at = f"{database}.{name}"
        if key in df.columns:
            # a bucket is one file, so its order holds
            sinks.write_bucketed(df.repartition(buckets, key), at, key, buckets)
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(at)
        sinks.analyze(spark, at)


def details(spark: SparkSession, database: str, patient_id: object | None = None) -> DataFrame:
    """Patients with their five kinds of records; with an id, of that patient alone: the filter reaches each table's
    scan, where it leaves one bucket."""
    mine = lambda name: spark.table(f"{database}.{name}") if patient_id is None else spark.table(f"{database}.{name}").where(F.col("patient_id") == F.lit(patient_id))
    people = mine("dim_patient")
    if "is_current" in people.columns:
        people = people.where("is_current")
    return patient_details(people, colocated=True, **{child: (mine(table), day) for child, (table, day) in CHILDREN.items()})


def patient(spark: SparkSession, database: str, patient_id: object) -> DataFrame:
    """One patient with all children; NotFound if there is none, ValueError without an id."""
    return get_patient(details(spark, database, patient_id), patient_id)
