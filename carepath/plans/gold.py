"""Snapshot aggregates. Each is one pass over its inputs; null in a filter column means "all"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, exprs
from ..operators.relational import cube_with_all, flow_edges, topk_per_group

STAGES = ("LS-SCLC", "ES-SCLC")


def first_diagnosis(diagnoses: DataFrame) -> DataFrame:
    """First day and first known stage of each patient; Unknown where no stage is known."""
    order = F.when(F.col("stage").isin(*STAGES), F.struct("diagnosis_date", "diagnosis_id"))
    return diagnoses.groupBy("patient_id").agg(
        F.min("diagnosis_date").alias("first_diagnosis_date"), F.coalesce(F.min_by("stage", order), F.lit("Unknown")).alias("stage")
    )


def treatments(episodes: DataFrame) -> DataFrame:
    """Per patient, the days on which episodes begin (a patient has few), and whether any holds immunotherapy.
    Episodes are dealt by patient already, so this needs no shuffle, and no diagnoses."""
    return episodes.groupBy("patient_id").agg(F.collect_set("treatment_start_date").alias("_starts"), F.max("has_io").alias("has_io"))


def patient_base(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame, biomarkers: DataFrame, trials: DataFrame, snapshot: Column) -> DataFrame:
    """The cohort: current patients diagnosed by the snapshot, with their first treatment on or after the first
    diagnosis (earlier ones are not its treatment) and flags."""
    dx = first_diagnosis(diagnoses).where(F.col("first_diagnosis_date") <= snapshot)
    flag = lambda df, name: df.select("patient_id").distinct().withColumn(name, F.lit(True))
    base = patients.join(dx, "patient_id").join(treatments(episodes), "patient_id", "left")
    base = base.join(flag(biomarkers, "has_biomarker"), "patient_id", "left").join(flag(trials, "has_trial"), "patient_id", "left")
    first = F.array_min(F.filter("_starts", lambda day: day >= F.col("first_diagnosis_date")))
    base = base.withColumn("first_treatment_date", first).drop("_starts")
    return base.fillna(False, ["has_io", "has_biomarker", "has_trial"]).withColumn("ttt_days", F.datediff("first_treatment_date", "first_diagnosis_date"))


def since(day: str, snapshot: Column, period: str) -> Column:
    """Whether a day lies in the snapshot's month, quarter or year, up to the snapshot."""
    return F.coalesce((F.col(day) >= F.trunc(snapshot, period)) & (F.col(day) <= snapshot), F.lit(False))


def overview(base: DataFrame, snapshot: Column, places: int = 2) -> DataFrame:
    """KPI cube over stage and state."""
    n, es = F.count(F.lit(1)), F.col("_stage") == "ES-SCLC"  # the cube nulls its own columns
    known = {"stage": F.col("stage").isin(*STAGES)}
    out = cube_with_all(
        base.withColumn("_stage", F.col("stage")),
        ["stage", "state"],
        [
            n.alias("total_patients"),
            F.count_if(since("first_diagnosis_date", snapshot, "month")).alias("new_diagnoses_mtd"),
            F.count_if(since("first_diagnosis_date", snapshot, "quarter")).alias("new_diagnoses_qtd"),
            F.count_if(since("first_diagnosis_date", snapshot, "year")).alias("new_diagnoses_ytd"),
            exprs.median("ttt_days").alias("median_time_to_treatment"),
            exprs.rate(F.count_if("has_biomarker"), n, places).alias("biomarker_testing_rate"),
            exprs.rate(F.count_if(es & F.col("has_io")), F.count_if(es), places).alias("immunotherapy_uptake_rate"),
            exprs.rate(F.count_if("has_trial"), n, places).alias("clinical_trial_rate"),
            F.count_if("has_biomarker").alias("biomarker_tested_count"),
            F.count_if(es).alias("es_sclc_patient_count"),
            F.count_if(es & F.col("has_io")).alias("es_sclc_io_count"),
            F.count_if("has_trial").alias("trial_enrolled_count"),
        ],
        known,
    )
    return out.withColumnsRenamed({"stage": "stage_filter", "state": "state_filter"}).select(snapshot.alias("snapshot_date"), "*")


def ttt_summary(base: DataFrame, places: int = 2) -> DataFrame:
    """Statistics of the days to treatment over stage and state."""
    treated = base.where("ttt_days is not null")
    n = F.count(F.lit(1))
    q = lambda p, name: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY ttt_days) AS double)").alias(name)
    out = cube_with_all(
        treated,
        ["stage", "state"],
        [
            n.alias("total_treated"),
            q(0.25, "p25_days"),
            q(0.5, "median_days"),
            q(0.75, "p75_days"),
            F.round(F.avg("ttt_days"), places).alias("mean_days"),
            F.min("ttt_days").alias("min_days"),
            F.max("ttt_days").alias("max_days"),
            F.round(F.stddev("ttt_days"), places).alias("stddev_days"),
            exprs.rate(F.count_if(F.col("ttt_days") <= codes.TARGET_DAYS), n, places).alias("within_target_pct"),
        ],
        {"stage": F.col("stage").isin(*STAGES)},
    )
    return out.withColumnsRenamed({"stage": "stage_filter", "state": "state_filter"})


def ttt_distribution(base: DataFrame, snapshot: Column, places: int = 2, zero_filled: bool = False) -> DataFrame:
    """Buckets of the days to treatment over stage and state, each with its filter's statistics."""
    treated = base.where("ttt_days is not null").withColumn("bucket_label", exprs.ttt_bucket(F.col("ttt_days")))
    counts = [F.count_if(F.col("bucket_label") == label).alias(f"_n{order}") for label, _, _, order in codes.BUCKETS]
    known = {"stage": F.col("stage").isin(*STAGES)}
    n = F.count(F.lit(1))
    wide = cube_with_all(
        treated,
        ["stage", "state"],
        [
            *counts,
            n.alias("_n"),
            exprs.median("ttt_days").alias("median_days"),
            F.round(F.avg("ttt_days"), places).alias("mean_days"),
            exprs.rate(F.count_if(F.col("ttt_days") <= codes.TARGET_DAYS), n, places).alias("within_target_pct"),
        ],
        known,
    )
    buckets = F.array(*[F.struct(F.lit(label).alias("bucket_label"), F.lit(order).alias("bucket_order"), F.col(f"_n{order}").alias("patient_count")) for label, _, _, order in codes.BUCKETS])
    long = wide.select(F.col("stage").alias("stage_filter"), F.col("state").alias("state_filter"), F.explode(buckets).alias("b"), "_n", "median_days", "mean_days", "within_target_pct")
    out = long.select(
        snapshot.alias("snapshot_date"), "stage_filter", "state_filter", "b.bucket_label", "b.bucket_order", "b.patient_count",
        exprs.rate(F.col("b.patient_count"), F.col("_n"), places).alias("percentage"), "median_days", "mean_days", "within_target_pct",
    )
    return out if zero_filled else out.where("patient_count > 0")


def treatment_patterns(episodes: DataFrame, diagnosed: DataFrame, snapshot: Column, places: int = 2) -> DataFrame:
    """Patients per line and regimen category, and their share of the line, for all stages and each. A patient has one
    episode of each line and one stage, so rows are patients."""
    rows = episodes.join(diagnosed.select("patient_id", "stage"), "patient_id")
    marked = rows.withColumn("stage_filter", F.explode(_with_all("stage")))
    counts = marked.groupBy("stage_filter", "line_of_therapy", "regimen_category").agg(F.count(F.lit(1)).alias("patient_count"))
    line = Window.partitionBy("stage_filter", "line_of_therapy")
    shared = counts.withColumn("percentage", exprs.rate(F.col("patient_count"), F.sum("patient_count").over(line), places)).withColumn("line_label", exprs.line_label(F.col("line_of_therapy")))
    return shared.select(snapshot.alias("snapshot_date"), "*")


def regimens_top(episodes: DataFrame, k: int = 10, places: int = 2) -> DataFrame:
    """The k most frequent regimens of each line and category."""
    counts = episodes.groupBy("line_of_therapy", "regimen_category", "regimen_name").agg(F.count(F.lit(1)).alias("patient_count"))
    line = Window.partitionBy("line_of_therapy")
    shared = counts.withColumn("percentage", exprs.rate(F.col("patient_count"), F.sum("patient_count").over(line), places))
    return topk_per_group(shared, ["line_of_therapy", "regimen_category"], [F.col("patient_count").desc(), F.col("regimen_name")], k, "regimen_rank")


def _with_all(dim: str) -> Column:
    everyone = F.lit(None).cast("string")
    return F.when(F.col(dim).isin(*STAGES), F.array(everyone, F.col(dim))).otherwise(F.array(everyone))


def geographic(base: DataFrame, snapshot: Column) -> DataFrame:
    """State metrics, one decimal place; states that are null have no row. Names are null for unknown codes."""
    n, es = F.count(F.lit(1)), F.col("stage") == "ES-SCLC"
    return (
        base.where("state is not null")
        .groupBy("state")
        .agg(
            n.alias("patient_count"),
            F.round(F.avg("ttt_days"), 1).alias("avg_time_to_treatment"),
            exprs.rate(F.count_if(es & F.col("has_io")), F.count_if(es), 1).alias("immunotherapy_rate"),
            exprs.rate(F.count_if("has_trial"), n, 1).alias("trial_enrollment_rate"),
            exprs.rate(F.count_if("has_biomarker"), n, 1).alias("biomarker_rate"),
        )
        .fillna(0.0, ["avg_time_to_treatment"])
        .select(snapshot.alias("snapshot_date"), "*", exprs.state_name(F.col("state")).alias("state_name"))
    )


def journeys(diagnosed: DataFrame, episodes: DataFrame, responses: DataFrame, trials: DataFrame) -> DataFrame:
    """Each patient's path: stage, first-line category, best first-line response, next step."""
    line = lambda k, c: F.max(F.when(F.col("line_of_therapy") == k, c))
    lines = episodes.where("line_of_therapy <= 2").groupBy("patient_id").agg(
        line(1, F.col("regimen_category")).alias("treatment"), line(1, F.col("episode_id")).alias("episode_id"), line(2, F.lit(True)).alias("has_second")
    )
    ranked = F.struct(exprs.response_rank(F.col("response_type")).alias("rank"), "response_type")
    best = responses.select("patient_id", "episode_id", "response_type").join(lines.select("patient_id", "episode_id"), ["patient_id", "episode_id"], "left_semi")
    best = best.groupBy("patient_id").agg(F.min(ranked).alias("b")).select("patient_id", F.col("b.response_type").alias("response"))
    trial = trials.select("patient_id").distinct().withColumn("has_trial", F.lit(True))
    rows = diagnosed.select("patient_id", "stage").join(lines.drop("episode_id"), "patient_id", "left").join(best, "patient_id", "left").join(trial, "patient_id", "left")
    rows = rows.fillna({"treatment": "No Treatment", "response": "Not Assessed", "has_second": False, "has_trial": False})
    step = (
        F.when(F.col("has_trial"), "Clinical Trial")
        .when(F.col("has_second"), "2nd Line Therapy")
        .when(F.col("response").isin("CR", "PR", "SD"), "Continue/Monitor")
        .otherwise("No Further Treatment")
    )
    return rows.withColumn("next_step", step)


ROOT = "SCLC Diagnosis"


def sankey(paths: DataFrame, snapshot: Column) -> DataFrame:
    """Transitions of the journey, for all stages and each: distinct patients per edge."""
    yes = F.lit(True)
    levels = [
        ("diagnosis", F.lit(ROOT), F.col("stage"), yes),
        ("stage", F.col("stage"), F.col("treatment"), yes),
        ("treatment", F.col("treatment"), F.col("response"), F.col("treatment") != "No Treatment"),
        ("response", F.col("response"), F.col("next_step"), F.col("response") != "Not Assessed"),
    ]
    edges = flow_edges(paths, levels, "stage", STAGES, "patient_id", distinct=False)  # a path is a patient
    target = F.element_at(F.array(*[F.lit(x) for x in ("stage", "treatment", "response", "next_step")]), F.col("level"))
    return edges.select(
        snapshot.alias("snapshot_date"), F.col("filter_value").alias("stage_filter"), F.col("source").alias("source_node"), F.col("target").alias("target_node"), "patient_count",
        F.col("category").alias("source_category"), target.alias("target_category"),
    )


def sankey_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the flow and the patients that pass through: into a node, or out of it for the root."""
    into = edges.groupBy("stage_filter", F.col("target_category").alias("category"), F.col("target_node").alias("node")).agg(F.sum("patient_count").alias("patient_count"))
    out = edges.where("source_category = 'diagnosis'").groupBy("stage_filter", F.col("source_category").alias("category"), F.col("source_node").alias("node")).agg(F.sum("patient_count").alias("patient_count"))
    return into.unionByName(out)
