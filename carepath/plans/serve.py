"""What the API serves, as functions over published aggregates and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import apply_filters, latest_per_key, paginate
from .views import kpi_current

# fixed values: columns that a list can be sorted by, and the most rows of a page
SORTABLE = ["patient_id", "state", "insurance_type", "stage", "diagnosis_date", "regimen_category", "days_to_treatment", "created_at"]
RESULT_MEASURES = ["total_patients", "new_diagnoses_mtd", "new_diagnoses_qtd", "new_diagnoses_ytd", "median_time_to_treatment", "biomarker_testing_rate", "immunotherapy_uptake_rate", "clinical_trial_rate"]


class NotFound(LookupError):
    """No such record."""


def _cell(df: DataFrame, **filters: object) -> DataFrame:
    """Rows of the cell that the filters name; a filter that is None asks for the "all" rows."""
    for k, v in filters.items():
        df = df.where(F.col(k).isNull() if v is None else F.col(k) == F.lit(v))
    return df


def overview(agg: DataFrame, stage: str | None = None, state: str | None = None) -> DataFrame:
    """One row; zeros where there is none."""
    row = _cell(kpi_current(agg), stage_filter=stage, state_filter=state).select(*RESULT_MEASURES).limit(1)
    zero = agg.sparkSession.range(1).select()
    kinds = dict(agg.dtypes)
    joined = zero.join(row.withColumn("_hit", F.lit(True)), F.lit(True), "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(0).cast(kinds[c])).alias(c) for c in RESULT_MEASURES])


def time_to_treatment(agg: DataFrame, stage: str | None = None, state: str | None = None) -> DataFrame:
    return _cell(kpi_current(agg), stage_filter=stage, state_filter=state).orderBy("bucket_order")


def treatment_patterns(agg: DataFrame, stage: str | None = None) -> DataFrame:
    """First and second line."""
    return _cell(kpi_current(agg), stage_filter=stage).where("line_of_therapy in (1, 2)").orderBy("line_of_therapy", F.col("patient_count").desc(), "regimen_category")


# fixed values: what states can be ranked by
STATE_METRICS = ["patient_count", "avg_time_to_treatment", "immunotherapy_rate", "trial_enrollment_rate", "biomarker_rate"]


def states(agg: DataFrame, metric_type: str = "patient_count", top: int | None = None) -> DataFrame:
    """States of the latest snapshot by a metric; with `top`, the first ones with their share of the largest."""
    if metric_type not in STATE_METRICS:
        raise ValueError(f"no such metric: {metric_type}")
    rows = kpi_current(agg).orderBy(F.col(metric_type).desc(), "state")
    if top is None:
        return rows
    share = F.round(100.0 * F.col(metric_type) / F.max(metric_type).over(Window.partitionBy()), 1)
    return rows.limit(top).withColumn("bar_share", share)


def sankey(agg: DataFrame, stage: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of the latest snapshot, largest first, and the nodes they touch, each with its first category."""
    links = _cell(kpi_current(agg), stage_filter=stage).select("source_node", "target_node", "patient_count", "source_category", "target_category")
    order = F.struct(-F.col("patient_count"), "source_node", "target_node", "side")
    end = lambda side, k: links.select(F.col(f"{side}_node").alias("node"), F.col(f"{side}_category").alias("category"), F.lit(k).alias("side"), "patient_count", "source_node", "target_node")
    nodes = end("source", 0).unionByName(end("target", 1)).where("node is not null").groupBy("node").agg(F.min_by("category", order).alias("category"))
    return links.orderBy(F.col("patient_count").desc(), "source_node", "target_node"), nodes


def enriched_rows(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame) -> DataFrame:
    """Patients as their table shows them: the first diagnosis, the first line's category or else its name, or those
    of the first episode where there is no first line or it has neither; days between the two."""
    dx = diagnoses.groupBy("patient_id").agg(F.min(F.struct("diagnosis_date", "diagnosis_id", "stage")).alias("d"))
    one = F.struct((F.col("line_of_therapy") != 1).alias("later"), "treatment_start_date", "line_of_therapy", F.coalesce("regimen_category", "regimen_name").alias("treatment"))
    tx = episodes.groupBy("patient_id").agg(F.min(one).alias("t"), F.min(F.when(F.coalesce("regimen_category", "regimen_name").isNotNull(), one)).alias("named"))
    rows = patients.join(dx, "patient_id", "left").join(tx, "patient_id", "left")
    days = F.datediff("t.treatment_start_date", "d.diagnosis_date")
    return rows.withColumns({"stage": F.col("d.stage"), "diagnosis_date": F.col("d.diagnosis_date"), "treatment": F.col("named.treatment"), "days_to_treatment": F.when(days >= 0, days)}).drop("d", "t", "named")


def patient_rows(patients: DataFrame, diagnoses: DataFrame, episodes: DataFrame) -> DataFrame:
    """Patients with their latest diagnosis and treatment, as lists show them."""
    dx = latest_per_key(diagnoses, ["patient_id"], [F.col("diagnosis_date").desc(), F.col("diagnosis_id").desc()]).select("patient_id", "diagnosis_date", "stage")
    tx = latest_per_key(episodes, ["patient_id"], [F.col("treatment_start_date").desc(), F.col("line_of_therapy").desc()]).select("patient_id", "regimen_category", "treatment_start_date")
    days = F.datediff("treatment_start_date", "diagnosis_date")
    rows = patients.join(dx, "patient_id", "left").join(tx, "patient_id", "left")
    return rows.withColumn("days_to_treatment", F.when(days >= 0, days))


def list_patients(rows: DataFrame, page: int = 1, page_size: int = 20, stage: str | None = None, state: str | None = None, insurance_type: str | None = None, sort_by: str = "patient_id", order: str = "asc") -> tuple[DataFrame, DataFrame]:
    """A page of patient_rows in a total order, nulls last, and the count of the same relation with its pages."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by}")
    if sort_by not in rows.columns:  # a column that the source does not fill: all null
        sort_by, order = "patient_id", "asc"
    found = apply_filters(rows, stage=stage, state=state, insurance_type=insurance_type)
    by = F.col(sort_by).desc_nulls_last() if order == "desc" else F.col(sort_by).asc_nulls_last()
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / page_size))
    return paginate(found, [by, F.col("patient_id")], page, page_size), total


def patient_details(patients: DataFrame, colocated: bool = False, **children: tuple[DataFrame, str]) -> DataFrame:
    """Each patient with arrays of their records, newest first. A child is (frame, its date column). With `colocated`
    the joins keep to the buckets that all tables share, even where a side is small enough for a broadcast."""
    out = patients
    for name, (df, day) in children.items():
        cols = [day, *[c for c in df.columns if c not in ("patient_id", day)]]
        rows = df.groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias(name))
        out = out.join(rows.hint("merge") if colocated else rows, "patient_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def get_patient(details: DataFrame, patient_id) -> DataFrame:
    if patient_id is None or patient_id == "":
        raise ValueError("patient_id is required")
    found = details.where(F.col("patient_id") == F.lit(patient_id))
    if found.limit(1).count() == 0:
        raise NotFound(patient_id)
    return found


# fixed values: thresholds of the insights
INSIGHTS = {"within_target_pct": (75, 60), "immunotherapy_uptake_rate": (60, 40), "biomarker_testing_rate": (80, 65), "clinical_trial_rate": (15, 8)}
LATE_SHARE, CHEMO_ONLY_SHARE, STATE_GAP, LOW_STATES, LOW_TESTING = 10, 25, 5, 5, 70
INSIGHT_ORDER = ["action", "caution", "positive", "info"]


def _level(value, good: float, fair: float):
    return F.when(value >= good, "positive").when(value >= fair, "caution").otherwise("action")


def insights(kpi: DataFrame, ttt: DataFrame, patterns: DataFrame, geo: DataFrame) -> DataFrame:
    """Rule-based insights (rule, insight_type, value), in the order action, caution, positive, info. Each input is
    of the cell looked at: `kpi` one row, `ttt` its buckets, `patterns` its lines, `geo` all states. Each rule
    gives one row at most."""
    kinds = F.array(*[F.lit(x) for x in INSIGHT_ORDER])
    rows = []
    one = ttt.agg(F.max("within_target_pct").alias("v"))
    rows.append(one.where("v is not null").select(F.lit("treatment_timeliness").alias("rule"), _level(F.col("v"), *INSIGHTS["within_target_pct"]).alias("insight_type"), F.col("v").cast("double").alias("value")))
    late = ttt.where(F.col("bucket_label") == "31+").agg(F.max("percentage").alias("v")).where(F.col("v") >= LATE_SHARE)
    rows.append(late.select(F.lit("late_treatment"), F.lit("action"), F.col("v").cast("double")))
    for name in ("immunotherapy_uptake_rate", "biomarker_testing_rate", "clinical_trial_rate"):
        rows.append(kpi.limit(1).select(F.lit(name), _level(F.col(name), *INSIGHTS[name]), F.col(name).cast("double")))
    first = patterns.where("line_of_therapy = 1")
    chemo = first.where("regimen_category = 'Chemo Only'").agg(F.max("percentage").alias("v")).where(F.col("v") > CHEMO_ONLY_SHARE)
    rows.append(chemo.select(F.lit("chemo_only_first_line"), F.lit("caution"), F.col("v").cast("double")))
    io = first.where("regimen_category = 'Chemo+IO'").agg(F.max("percentage").alias("v")).where("v > 0")
    rows.append(io.select(F.lit("chemo_io_share"), F.lit("info"), F.col("v").cast("double")))
    second = patterns.where("line_of_therapy = 2").agg(F.max("percentage").alias("v")).where("v is not null")
    rows.append(second.select(F.lit("top_second_line"), F.lit("info"), F.col("v").cast("double")))
    span = geo.where("avg_time_to_treatment > 0").agg((F.max("avg_time_to_treatment") - F.min("avg_time_to_treatment")).alias("v"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("v") > STATE_GAP))
    rows.append(span.select(F.lit("state_gap"), F.lit("caution"), F.round("v", 1)))
    if "biomarker_rate" in geo.columns:
        low = geo.where(F.col("biomarker_rate") < LOW_TESTING).agg(F.count(F.lit(1)).alias("v")).where(F.col("v") >= LOW_STATES)
        rows.append(low.select(F.lit("low_testing_states"), F.lit("action"), F.col("v").cast("double")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("position", F.array_position(kinds, F.col("insight_type")))


def age_today(born, today):
    return F.floor(F.months_between(today, born) / 12).cast("int")


__all__ = ["NotFound", "age_today", "get_patient", "insights", "list_patients", "overview", "enriched_rows", "patient_details", "patient_rows", "sankey", "states", "time_to_treatment", "treatment_patterns"]
