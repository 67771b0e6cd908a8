"""Metrics computed from rows on request, without published aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


def _one(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, F.lit(True))
    return out


def _share(part: str, whole: str, name: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole) * 100, 1)).otherwise(F.lit(0.0)).alias(name)


def first_line_pairs(diagnoses: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every diagnosis, not only the first, with the patient's first line, and the days between."""
    first = episodes.where("line_of_therapy = 1").select("patient_id", "treatment_start_date", "has_io")
    return diagnoses.join(first, "patient_id").withColumn("days", F.datediff("treatment_start_date", "diagnosis_date"))


def overview(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame, biomarkers: DataFrame, trials: DataFrame, today: Column, stage: str | None = None, state: str | None = None) -> DataFrame:
    """One row of KPIs. A state narrows all of them; a stage narrows diagnoses, days to treatment and the diagnosed
    that the testing rate is of. Uptake counts pairs of first lines and extensive-stage diagnoses."""
    people = patients if state is None else patients.where(F.col("state") == state)
    ids = people.select("patient_id").distinct()
    mine = lambda df: df.join(ids, "patient_id", "left_semi")
    in_stage = F.lit(True) if stage is None else F.col("stage") == stage
    es = F.col("stage") == "ES-SCLC"
    known = mine(diagnoses)
    staged = known.where(in_stage)
    since = lambda period: F.count_if(F.col("diagnosis_date") >= F.trunc(today, period))
    distinct = lambda df, name: mine(df).agg(F.count_distinct("patient_id").alias(name))
    # one pass over the pairs for the wait of the stage and the uptake of extensive disease
    pairs = first_line_pairs(known, episodes).withColumn("_wait", F.when(in_stage & (F.col("days") >= 0), F.col("days")))
    rows = _one(
        ids.agg(F.count(F.lit(1)).alias("total_patients")),
        staged.agg(since("month").alias("new_diagnoses_mtd"), since("quarter").alias("new_diagnoses_qtd"), since("year").alias("new_diagnoses_ytd"), F.count_distinct("patient_id").alias("_diagnosed")),
        pairs.agg(F.round(exprs.upper_median("_wait"), 1).alias("median_time_to_treatment_days"), F.count_if(es).alias("_es"), F.count_if(es & F.col("has_io")).alias("_io")),
        distinct(biomarkers, "_tested"),
        distinct(trials, "_enrolled"),
    )
    return rows.select(
        "total_patients", "new_diagnoses_mtd", "new_diagnoses_qtd", "new_diagnoses_ytd", "median_time_to_treatment_days",
        _share("_tested", "_diagnosed", "biomarker_testing_rate"), _share("_io", "_es", "immunotherapy_uptake_rate"), _share("_enrolled", "total_patients", "clinical_trial_enrollment_rate"),
    )


def time_to_treatment(diagnoses: DataFrame, episodes: DataFrame, target: int = 21) -> DataFrame:
    """Pairs of a diagnosis and a first line that does not begin before it, by stage."""
    rows = first_line_pairs(diagnoses, episodes).where("days >= 0")
    n = F.count(F.lit(1))
    return rows.groupBy("stage").agg(
        n.alias("pairs"), exprs.upper_median("days").alias("median_days"), F.round(F.avg("days"), 4).alias("mean_days"), exprs.rate(F.count_if(F.col("days") <= target), n).alias("within_target_pct")
    )


def sankey(diagnoses: DataFrame, episodes: DataFrame, responses: DataFrame, stage: str | None = None) -> DataFrame:
    """Links of the journey from a patient's last diagnosis over the first line to its last response: (source, target,
    value). The last is by date and id; with a stage, only its diagnoses count."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(F.col(c), F.lit("Unknown")))
    dx = diagnoses if stage is None else diagnoses.where(F.col("stage") == stage)
    dx = dx.groupBy("patient_id").agg(F.max(F.struct("diagnosis_date", "diagnosis_id", "stage")).alias("d")).select("patient_id", named("stage_", "d.stage").alias("a"))
    first = episodes.where("line_of_therapy = 1").select("patient_id", "episode_id", named("1l_", "regimen_category").alias("b"))
    seen = responses.join(first.select("episode_id"), "episode_id", "left_semi").groupBy("episode_id").agg(F.max(F.struct("assessment_date", "assessment_id", "response_type")).alias("r"))
    paths = dx.join(first, "patient_id", "left").join(seen.select("episode_id", named("resp_", "r.response_type").alias("c")), "episode_id", "left")
    step = lambda x, y: F.struct(x.alias("source"), y.alias("target"))
    steps = F.array(step(F.lit("diagnosis"), F.col("a")), step(F.col("a"), F.col("b")), step(F.col("b"), F.col("c")))
    return paths.select(F.explode(steps).alias("s")).select("s.*").where("target is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("value"))
