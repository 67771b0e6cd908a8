"""Denormalised views over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.relational import latest_per_key


def patient_latest_status(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame, facilities: DataFrame, biomarkers: DataFrame, trials: DataFrame) -> DataFrame:
    """One row per patient: latest diagnosis and treatment, facility, flags."""
    # one combining aggregate a side: the greatest struct is the latest row
    dx = diagnoses.groupBy("patient_id").agg(F.max(F.struct("diagnosis_date", "diagnosis_id", "stage", "facility_id")).alias("d"))
    dx = dx.select("patient_id", F.col("d.diagnosis_date").alias("latest_diagnosis_date"), F.col("d.stage").alias("current_stage"), F.col("d.facility_id").alias("_dx_facility"))
    last = F.struct("treatment_start_date", "line_of_therapy", "treatment_end_date", "regimen_category", "has_io", "facility_id")
    tx = episodes.groupBy("patient_id").agg(F.max(last).alias("t"), F.min("treatment_start_date").alias("_first")).select(
        "patient_id",
        F.col("t.line_of_therapy").alias("current_line_of_therapy"),
        F.col("t.treatment_start_date").alias("latest_treatment_start_date"),
        F.col("t.treatment_end_date").alias("latest_treatment_end_date"),
        F.col("t.regimen_category").alias("current_regimen_category"),
        F.col("t.has_io").alias("on_immunotherapy"),
        F.col("t.facility_id").alias("_tx_facility"),
        "_first",
    )
    flag = lambda df, name: df.select("patient_id").distinct().withColumn(name, F.lit(True))
    rows = patients.join(dx, "patient_id", "left").join(tx, "patient_id", "left")
    rows = rows.join(flag(trials, "enrolled_in_trial"), "patient_id", "left").join(flag(biomarkers, "has_biomarker_test"), "patient_id", "left")
    rows = rows.withColumn("facility_id", F.coalesce("_tx_facility", "_dx_facility")).join(facilities.select("facility_id", "facility_name"), "facility_id", "left")
    return rows.fillna(False, ["enrolled_in_trial", "has_biomarker_test"]).withColumn("days_to_first_treatment", F.datediff("_first", "latest_diagnosis_date")).drop("_first", "_tx_facility", "_dx_facility")


def treatment_timeline(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame, facilities: DataFrame, responses: DataFrame) -> DataFrame:
    """Diagnoses by episodes of each patient, with the facility and the episode's best response.

    Facility and response are joined to the episodes, before these meet the diagnoses, and all by patient: the rows that come out,
    many for each patient, are not shuffled.
    """
    best = latest_per_key(responses.where("episode_id is not null"), ["patient_id", "episode_id"], [exprs.response_rank(F.col("response_type")), F.col("assessment_date").desc(), F.col("assessment_id")])
    told = F.struct("episode_id", F.struct(F.col("assessment_date").alias("response_date"), "response_type"))
    best = best.groupBy("patient_id").agg(F.map_from_entries(F.collect_list(told)).alias("_best"))  # a patient has few
    treated = episodes.join(facilities.select("facility_id", "facility_name"), "facility_id", "left").join(best, "patient_id", "left")
    treated = treated.withColumn("_b", F.col("_best")[F.col("episode_id")]).select(*[c for c in episodes.columns if c != "facility_id"], "facility_id", "facility_name", "_b.*")
    rows = patients.join(diagnoses.select("patient_id", "diagnosis_id", "diagnosis_date", "stage"), "patient_id").join(treated, "patient_id", "left")
    first = ["episode_id", "facility_id"]
    rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    return rows.withColumns(
        {
            "days_from_diagnosis_to_treatment": F.datediff("treatment_start_date", "diagnosis_date"),
            "treatment_duration_days": F.datediff("treatment_end_date", "treatment_start_date"),
        }
    )


def kpi_current(overview: DataFrame) -> DataFrame:
    """The rows of the latest snapshot."""
    latest = overview.agg(F.max("snapshot_date").alias("snapshot_date"))
    return overview.join(F.broadcast(latest), "snapshot_date", "left_semi")
