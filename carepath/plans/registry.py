"""The registered queries, each with equal SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import identity, quality
from ..operators.lineage import cut_lineage
from ..operators.relational import apply_filters, asof_join, cube_with_all, gap_dedup, keyed_upsert, latest_per_key, nearest_join, scd2_diff
from . import gold, live, serve, silver, views
from .analogue import PRELUDE, SNAPSHOT, Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Register a function of Frames under its name, with its SQL."""

    def register(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = f"{PRELUDE} {sql}" if prelude else sql
        return f

    return register


_CUBE = """
    , cells AS (
        SELECT stage, state, grouping(stage) AS gs, grouping(state) AS gt, {measures}
        FROM (SELECT CASE WHEN stage <> 'Unknown' THEN stage END AS stage, state, {inputs} FROM base {where}) x
        GROUP BY GROUPING SETS ((stage, state), (stage), (state), ())
    )
    SELECT {columns} FROM cells {join} WHERE (gs = 1 OR stage IS NOT NULL) AND (gt = 1 OR state IS NOT NULL)
"""


def _rate(k: str, n: str, d: int = 2) -> str:
    return f"CASE WHEN {n} > 0 THEN round(CAST(100 AS DOUBLE) * {k} / {n}, {d}) ELSE CAST(0 AS DOUBLE) END"


_OVERVIEW = _CUBE.format(
    inputs="stage AS s, first_diagnosis_date AS d, ttt_days, has_io, has_biomarker, has_trial",
    where="",
    measures=f"""count(*) AS total_patients,
        count(*) FILTER (WHERE d >= DATE '2001-06-01' AND d <= DATE '{SNAPSHOT}') AS new_diagnoses_mtd,
        count(*) FILTER (WHERE d >= DATE '2001-04-01' AND d <= DATE '{SNAPSHOT}') AS new_diagnoses_qtd,
        count(*) FILTER (WHERE d >= DATE '2001-01-01' AND d <= DATE '{SNAPSHOT}') AS new_diagnoses_ytd,
        CAST(quantile_disc(ttt_days, 0.5) AS DOUBLE) AS median_time_to_treatment,
        {_rate("count(*) FILTER (WHERE has_biomarker)", "count(*)")} AS biomarker_testing_rate,
        {_rate("count(*) FILTER (WHERE s = 'ES-SCLC' AND has_io)", "count(*) FILTER (WHERE s = 'ES-SCLC')")} AS immunotherapy_uptake_rate,
        {_rate("count(*) FILTER (WHERE has_trial)", "count(*)")} AS clinical_trial_rate,
        count(*) FILTER (WHERE has_biomarker) AS biomarker_tested_count, count(*) FILTER (WHERE s = 'ES-SCLC') AS es_sclc_patient_count,
        count(*) FILTER (WHERE s = 'ES-SCLC' AND has_io) AS es_sclc_io_count, count(*) FILTER (WHERE has_trial) AS trial_enrolled_count""",
    columns=f"""DATE '{SNAPSHOT}' AS snapshot_date, stage AS stage_filter, state AS state_filter, total_patients, new_diagnoses_mtd, new_diagnoses_qtd,
        new_diagnoses_ytd, median_time_to_treatment, biomarker_testing_rate, immunotherapy_uptake_rate, clinical_trial_rate,
        biomarker_tested_count, es_sclc_patient_count, es_sclc_io_count, trial_enrolled_count""",
    join="",
)


@query(_OVERVIEW)
def kpi_overview_cube(t: Frames) -> DataFrame:
    return gold.overview(t.base, t.snapshot)


@query(_OVERVIEW)
def kpi_current(t: Frames) -> DataFrame:
    # a published table of two snapshots, as the view reads it
    both = F.explode(F.array("snapshot_date", F.date_sub("snapshot_date", 30)))
    return views.kpi_current(cut_lineage(gold.overview(t.base, t.snapshot).withColumn("snapshot_date", both)))


@query(
    f"""SELECT o_custkey AS patient_id,
        count(*) FILTER (WHERE o_orderdate::DATE >= DATE '2001-06-01') AS mtd, count(*) FILTER (WHERE o_orderdate::DATE >= DATE '2001-04-01') AS qtd,
        count(*) FILTER (WHERE o_orderdate::DATE >= DATE '2001-01-01') AS ytd
        FROM orders WHERE o_orderdate::DATE <= DATE '{SNAPSHOT}' GROUP BY o_custkey""",
    prelude=False,
)
def new_diagnoses_periods(t: Frames) -> DataFrame:
    rows = t.diagnoses.where(F.col("diagnosis_date") <= t.snapshot)
    return rows.groupBy("patient_id").agg(*[F.count_if(gold.since("diagnosis_date", t.snapshot, p)).alias(n) for n, p in (("mtd", "month"), ("qtd", "quarter"), ("ytd", "year"))])


_BUCKETS = "(VALUES ('0-7', 0, 7, 1), ('8-14', 8, 14, 2), ('15-21', 15, 21, 3), ('22-30', 22, 30, 4), ('31+', 31, 9999, 5)) b(bucket_label, lo, hi, bucket_order)"


def _ttt(zero: bool) -> str:
    return _CUBE.format(
        inputs="ttt_days",
        where="WHERE ttt_days IS NOT NULL",
        measures=f"""count(*) AS n, list(ttt_days) AS days, CAST(quantile_disc(ttt_days, 0.5) AS DOUBLE) AS median_days, round(avg(ttt_days), 2) AS mean_days,
            {_rate("count(*) FILTER (WHERE ttt_days <= 21)", "count(*)")} AS within_target_pct""",
        columns=f"""DATE '{SNAPSHOT}' AS snapshot_date, stage AS stage_filter, state AS state_filter, bucket_label, bucket_order,
            CAST(len(list_filter(days, lambda x: x BETWEEN lo AND hi)) AS BIGINT) AS patient_count,
            {_rate("len(list_filter(days, lambda x: x BETWEEN lo AND hi))", "n")} AS percentage, median_days, mean_days, within_target_pct""",
        join=f", {_BUCKETS}",
    ) + ("" if zero else " AND len(list_filter(days, lambda x: x BETWEEN lo AND hi)) > 0")


@query(_ttt(False))
def ttt_distribution(t: Frames) -> DataFrame:
    return gold.ttt_distribution(t.base, t.snapshot)


@query(_ttt(True))
def ttt_zero_filled(t: Frames) -> DataFrame:
    return gold.ttt_distribution(t.base, t.snapshot, zero_filled=True)


@query(
    _CUBE.format(
        inputs="ttt_days",
        where="WHERE ttt_days IS NOT NULL",
        measures=f"""count(*) AS total_treated, CAST(quantile_disc(ttt_days, 0.25) AS DOUBLE) AS p25_days, CAST(quantile_disc(ttt_days, 0.5) AS DOUBLE) AS median_days,
            CAST(quantile_disc(ttt_days, 0.75) AS DOUBLE) AS p75_days, round(avg(ttt_days), 2) AS mean_days, CAST(min(ttt_days) AS INTEGER) AS min_days, CAST(max(ttt_days) AS INTEGER) AS max_days,
            round(stddev(ttt_days), 2) AS stddev_days, {_rate("count(*) FILTER (WHERE ttt_days <= 21)", "count(*)")} AS within_target_pct""",
        columns="stage AS stage_filter, state AS state_filter, total_treated, p25_days, median_days, p75_days, mean_days, min_days, max_days, stddev_days, within_target_pct",
        join="",
    )
)
def ttt_summary(t: Frames) -> DataFrame:
    return gold.ttt_summary(t.base)


@query("SELECT stage, CAST(list_sort(list(ttt_days))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) AS median_days FROM base WHERE ttt_days IS NOT NULL GROUP BY stage")
def ttt_upper_median(t: Frames) -> DataFrame:
    return t.base.where("ttt_days is not null").groupBy("stage").agg(exprs.upper_median("ttt_days").alias("median_days"))


@query(
    f"""SELECT d.stage, count(*) AS pairs, CAST(list_sort(list(e.treatment_start_date - d.diagnosis_date))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) AS median_days,
        round(avg(e.treatment_start_date - d.diagnosis_date), 4) AS mean_days,
        {_rate("count(*) FILTER (WHERE e.treatment_start_date - d.diagnosis_date <= 21)", "count(*)")} AS within_target_pct
        FROM diagnoses d JOIN episodes e ON d.patient_id = e.patient_id AND e.line_of_therapy = 1 AND e.treatment_start_date >= d.diagnosis_date GROUP BY d.stage"""
)
def ttt_pairs(t: Frames) -> DataFrame:
    return live.time_to_treatment(t.diagnoses, t.episodes)


_PATTERNS = f"""
    , marked AS (
        SELECT e.patient_id, e.line_of_therapy, e.regimen_category, NULL AS stage_filter FROM episodes e JOIN diagnosed d ON e.patient_id = d.patient_id
        UNION ALL SELECT e.patient_id, e.line_of_therapy, e.regimen_category, d.stage FROM episodes e JOIN diagnosed d ON e.patient_id = d.patient_id WHERE d.stage <> 'Unknown'
    ), counts AS (
        SELECT stage_filter, line_of_therapy, regimen_category, count(DISTINCT patient_id) AS patient_count FROM marked GROUP BY ALL
    ), patterns AS (
        SELECT *, DATE '{SNAPSHOT}' AS snapshot_date, {_rate("patient_count", "sum(patient_count) OVER (PARTITION BY stage_filter, line_of_therapy)")} AS percentage,
               CASE line_of_therapy WHEN 1 THEN '1st line' WHEN 2 THEN '2nd line' ELSE '3rd line+' END AS line_label
        FROM counts
    )
"""


@query(_PATTERNS + "SELECT * FROM patterns")
def treatment_patterns_category(t: Frames) -> DataFrame:
    return gold.treatment_patterns(t.episodes, t.diagnosed, t.snapshot)


@query(
    f"""
    , counts AS (SELECT line_of_therapy, regimen_category, regimen_name, count(DISTINCT patient_id) AS patient_count FROM episodes GROUP BY ALL)
    SELECT *, {_rate("patient_count", "sum(patient_count) OVER (PARTITION BY line_of_therapy)")} AS percentage,
           CAST(row_number() OVER (PARTITION BY line_of_therapy, regimen_category ORDER BY patient_count DESC, regimen_name) AS INTEGER) AS regimen_rank
    FROM counts QUALIFY regimen_rank <= 10"""
)
def treatment_patterns_regimen_top10(t: Frames) -> DataFrame:
    return gold.regimens_top(t.episodes)


@query(_PATTERNS + "SELECT * FROM patterns WHERE stage_filter IS NULL AND line_of_therapy <= 2")
def patterns_first_second_line(t: Frames) -> DataFrame:
    return serve.treatment_patterns(cut_lineage(gold.treatment_patterns(t.episodes, t.diagnosed, t.snapshot)))


_GEO = f"""
    , geo AS (
        SELECT state, count(*) AS patient_count, coalesce(round(avg(ttt_days), 1), 0.0) AS avg_time_to_treatment,
               {_rate("count(*) FILTER (WHERE stage = 'ES-SCLC' AND has_io)", "count(*) FILTER (WHERE stage = 'ES-SCLC')", 1)} AS immunotherapy_rate,
               {_rate("count(*) FILTER (WHERE has_trial)", "count(*)", 1)} AS trial_enrollment_rate,
               {_rate("count(*) FILTER (WHERE has_biomarker)", "count(*)", 1)} AS biomarker_rate, DATE '{SNAPSHOT}' AS snapshot_date, NULL::VARCHAR AS state_name
        FROM base WHERE state IS NOT NULL GROUP BY state
    )
"""


@query(_GEO + "SELECT * FROM geo")
def geographic_metrics(t: Frames) -> DataFrame:
    return gold.geographic(t.base, t.snapshot)


@query("SELECT state, count(*) AS patient_count FROM patients GROUP BY state")
def state_counts(t: Frames) -> DataFrame:
    return t.patients.groupBy("state").agg(F.count(F.lit(1)).alias("patient_count"))


@query(_GEO + "SELECT *, round(100.0 * patient_count / max(patient_count) OVER (), 1) AS bar_share FROM (SELECT * FROM geo ORDER BY patient_count DESC, state LIMIT 15)")
def top15_states(t: Frames) -> DataFrame:
    return serve.states(cut_lineage(gold.geographic(t.base, t.snapshot)), top=15)


_EDGES = """
    , steps AS (
        SELECT patient_id, stage, 'SCLC Diagnosis' AS s, stage AS d, 'diagnosis' AS sc, 'stage' AS dc FROM paths
        UNION ALL SELECT patient_id, stage, stage, treatment, 'stage', 'treatment' FROM paths
        UNION ALL SELECT patient_id, stage, treatment, response, 'treatment', 'response' FROM paths WHERE treatment <> 'No Treatment'
        UNION ALL SELECT patient_id, stage, response, next_step, 'response', 'next_step' FROM paths WHERE response <> 'Not Assessed'
    ), twice AS (
        SELECT NULL AS stage_filter, * FROM steps UNION ALL SELECT stage, * FROM steps WHERE stage <> 'Unknown'
    ), edges AS (
        SELECT stage_filter, s AS source_node, d AS target_node, count(DISTINCT patient_id) AS patient_count, sc AS source_category, dc AS target_category FROM twice GROUP BY ALL
    )
"""
_LINKS = "SELECT source_node, target_node, patient_count, source_category, target_category FROM edges WHERE stage_filter = 'ES-SCLC'"


@query(_EDGES + f"SELECT DATE '{SNAPSHOT}' AS snapshot_date, * FROM edges")
def sankey_transitions(t: Frames) -> DataFrame:
    return gold.sankey(t.paths, t.snapshot)


@query(_EDGES + _LINKS)
def sankey_links(t: Frames) -> DataFrame:
    return serve.sankey(cut_lineage(gold.sankey(t.paths, t.snapshot)), "ES-SCLC")[0]


@query(_EDGES + f"SELECT source_node AS node, source_category AS category FROM ({_LINKS}) UNION SELECT target_node, target_category FROM ({_LINKS})")
def sankey_link_nodes(t: Frames) -> DataFrame:
    return serve.sankey(cut_lineage(gold.sankey(t.paths, t.snapshot)), "ES-SCLC")[1]


@query(
    _EDGES
    + """SELECT stage_filter, target_category AS category, target_node AS node, CAST(sum(patient_count) AS BIGINT) AS patient_count FROM edges GROUP BY ALL
        UNION ALL SELECT stage_filter, source_category, source_node, CAST(sum(patient_count) AS BIGINT) FROM edges WHERE source_category = 'diagnosis' GROUP BY ALL"""
)
def sankey_nodes(t: Frames) -> DataFrame:
    return gold.sankey_nodes(gold.sankey(t.paths, t.snapshot))


@query("SELECT patient_id, line_of_therapy, treatment_start_date, treatment_end_date, claim_count, CAST(treatment_end_date - treatment_start_date AS INTEGER) AS duration_days FROM episodes")
def treatment_episodes(t: Frames) -> DataFrame:
    return t.episodes.select("patient_id", "line_of_therapy", "treatment_start_date", "treatment_end_date", "claim_count", "duration_days")


@query("SELECT patient_id, max(line_of_therapy) AS n_lines, count(*) FILTER (WHERE line_label = '3rd line+') AS later_lines FROM episodes GROUP BY patient_id")
def line_of_therapy(t: Frames) -> DataFrame:
    return t.episodes.groupBy("patient_id").agg(F.max("line_of_therapy").alias("n_lines"), F.count_if(F.col("line_label") == "3rd line+").alias("later_lines"))


@query("SELECT patient_id, line_of_therapy, regimen_name, regimen_category, has_chemo, has_io, has_radiation, line_label FROM episodes")
def regimen_classification(t: Frames) -> DataFrame:
    return t.episodes.select("patient_id", "line_of_therapy", "regimen_name", "regimen_category", "has_chemo", "has_io", "has_radiation", "line_label")


@query("SELECT * FROM diagnoses QUALIFY row_number() OVER (PARTITION BY patient_id, diagnosis_date ORDER BY stage, diagnosis_id DESC) = 1")
def dx_dedup_latest(t: Frames) -> DataFrame:
    return latest_per_key(t.diagnoses, ["patient_id", "diagnosis_date"], [F.col("stage"), F.col("diagnosis_id").desc()])


@query("SELECT assessment_id, patient_id, assessment_date, response_type, episode_id, treatment_start_date FROM responses")
def response_asof_episode(t: Frames) -> DataFrame:
    return t.responses


@query("SELECT assessment_id, episode_id, response_type FROM responses WHERE episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY rank, assessment_date, assessment_id) = 1")
def best_response_per_episode(t: Frames) -> DataFrame:
    rows = silver.best_response(t.responses.where("episode_id is not null"), ["episode_id"], [F.col("assessment_date"), F.col("assessment_id")])
    return rows.where("is_best_response").select("assessment_id", "episode_id", "response_type")


_PD = """
    , pd AS (SELECT patient_id, assessment_date AS progression_date, assessment_id FROM assessments WHERE response_type IN ('PD', 'NE')),
    kept AS (
        SELECT *, progression_date - lag(progression_date) OVER (PARTITION BY patient_id ORDER BY progression_date, assessment_id) AS gap FROM pd
        QUALIFY gap IS NULL OR gap > 30
    )
"""


def _pd(t: Frames) -> DataFrame:
    return t.responses.where("response_type in ('PD', 'NE')").select("patient_id", F.col("assessment_date").alias("progression_date"), "assessment_id")


@query(_PD + "SELECT patient_id, progression_date, assessment_id FROM kept")
def progression_gap_dedup(t: Frames) -> DataFrame:
    return gap_dedup(_pd(t), ["patient_id"], "progression_date", 30, ["assessment_id"])


@query(
    _PD
    + """SELECT k.patient_id, k.progression_date, e.episode_id, CAST(row_number() OVER (PARTITION BY k.patient_id ORDER BY k.progression_date) AS INTEGER) AS progression_number,
        CAST(k.progression_date - f.d AS INTEGER) AS pfs_days_from_diagnosis, CAST(k.progression_date - e.treatment_start_date AS INTEGER) AS pfs_days_from_treatment
        FROM kept k JOIN (SELECT patient_id, min(diagnosis_date) AS d FROM diagnoses GROUP BY patient_id) f ON f.patient_id = k.patient_id
        ASOF LEFT JOIN episodes e ON k.patient_id = e.patient_id AND k.progression_date >= e.treatment_start_date"""
)
def progression_pfs(t: Frames) -> DataFrame:
    rows = _pd(t).select("patient_id", "progression_date", F.col("assessment_id").cast("string").alias("evidence"))
    return silver.progressions(rows, t.diagnoses, t.episodes).drop("evidence")


@query(
    """
    , near AS (
        SELECT d.diagnosis_id, e.episode_id, e.treatment_start_date, abs(d.diagnosis_date - e.treatment_start_date) AS gap
        FROM diagnoses d JOIN episodes e ON d.patient_id = e.patient_id AND abs(d.diagnosis_date - e.treatment_start_date) <= 30
        QUALIFY row_number() OVER (PARTITION BY d.diagnosis_id ORDER BY gap, e.treatment_start_date, e.episode_id) = 1
    )
    SELECT d.diagnosis_id, d.patient_id, d.diagnosis_date, n.episode_id, n.treatment_start_date FROM diagnoses d LEFT JOIN near n ON d.diagnosis_id = n.diagnosis_id"""
)
def trial_nearest_30d(t: Frames) -> DataFrame:
    left = t.diagnoses.drop("stage")
    right = t.episodes.select("patient_id", "episode_id", "treatment_start_date")
    return nearest_join(left, right, ["patient_id"], "diagnosis_date", "treatment_start_date", 30, ["diagnosis_id"], ["treatment_start_date", "episode_id"])


@query(
    """
    , dx AS (SELECT * FROM diagnoses QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY diagnosis_date DESC, diagnosis_id DESC) = 1),
    tx AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY treatment_start_date DESC) = 1)
    SELECT p.patient_id, p.state, p.insurance_type, dx.diagnosis_date AS latest_diagnosis_date, dx.stage AS current_stage, tx.line_of_therapy AS current_line_of_therapy,
           tx.treatment_start_date AS latest_treatment_start_date, tx.treatment_end_date AS latest_treatment_end_date, tx.regimen_category AS current_regimen_category,
           tx.has_io AS on_immunotherapy, tx.facility_id, s_name AS facility_name,
           p.patient_id IN (SELECT patient_id FROM trials) AS enrolled_in_trial, p.patient_id IN (SELECT patient_id FROM biomarkers) AS has_biomarker_test,
           CAST((SELECT min(treatment_start_date) FROM episodes e WHERE e.patient_id = p.patient_id) - dx.diagnosis_date AS INTEGER) AS days_to_first_treatment
    FROM patients p LEFT JOIN dx ON p.patient_id = dx.patient_id LEFT JOIN tx ON p.patient_id = tx.patient_id LEFT JOIN supplier ON s_suppkey = tx.facility_id"""
)
def patient_latest_status(t: Frames) -> DataFrame:
    dx = t.by_patient(t.diagnoses).withColumn("facility_id", F.lit(None).cast("long"))
    return views.patient_latest_status(t.patients, dx, t.episodes, t.facilities, t.biomarkers, t.trials)


@query(
    """
    , best_one AS (SELECT episode_id, assessment_date AS response_date, response_type FROM responses WHERE episode_id IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY rank, assessment_date DESC, assessment_id) = 1)
    SELECT p.patient_id, d.diagnosis_id, d.stage, e.episode_id, e.line_of_therapy, e.regimen_category, s_name AS facility_name, b.response_date, b.response_type,
           CAST(e.treatment_start_date - d.diagnosis_date AS INTEGER) AS days_from_diagnosis_to_treatment,
           CAST(e.treatment_end_date - e.treatment_start_date AS INTEGER) AS treatment_duration_days
    FROM patients p JOIN diagnoses d ON p.patient_id = d.patient_id LEFT JOIN episodes e ON p.patient_id = e.patient_id
    LEFT JOIN supplier ON s_suppkey = e.facility_id LEFT JOIN best_one b ON b.episode_id = e.episode_id"""
)
def treatment_timeline(t: Frames) -> DataFrame:
    rows = views.treatment_timeline(t.patients, t.by_patient(t.diagnoses), t.episodes, t.facilities, t.responses)
    return rows.select(
        "patient_id", "diagnosis_id", "stage", "episode_id", "line_of_therapy", "regimen_category", "facility_name", "response_date", "response_type",
        "days_from_diagnosis_to_treatment", "treatment_duration_days",
    )


_LIST = """
    , dx AS (SELECT * FROM diagnoses QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY diagnosis_date DESC, diagnosis_id DESC) = 1),
    tx AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY treatment_start_date DESC) = 1),
    listed AS (
        SELECT p.*, dx.diagnosis_date, dx.stage, tx.regimen_category, tx.treatment_start_date,
               CASE WHEN tx.treatment_start_date >= dx.diagnosis_date THEN CAST(tx.treatment_start_date - dx.diagnosis_date AS INTEGER) END AS days_to_treatment
        FROM patients p LEFT JOIN dx ON p.patient_id = dx.patient_id LEFT JOIN tx ON p.patient_id = tx.patient_id
    )
"""


def _listed(t: Frames) -> DataFrame:
    return serve.patient_rows(t.patients, t.by_patient(t.diagnoses), t.episodes)


@query(_LIST + "SELECT * FROM listed WHERE stage = 'ES-SCLC' ORDER BY days_to_treatment DESC NULLS LAST, patient_id LIMIT 25 OFFSET 25")
def patient_list_page(t: Frames) -> DataFrame:
    return serve.list_patients(_listed(t), page=2, page_size=25, stage="ES-SCLC", sort_by="days_to_treatment", order="desc")[0]


@query(_LIST + "SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM listed WHERE stage = 'ES-SCLC'")
def patient_count(t: Frames) -> DataFrame:
    return serve.list_patients(_listed(t), page=1, page_size=25, stage="ES-SCLC")[1]


@query(_LIST + "SELECT * FROM listed")
def patient_rows(t: Frames) -> DataFrame:
    return _listed(t)


@query(
    """
    , d AS (SELECT patient_id, string_agg(diagnosis_date || ':' || stage, ';' ORDER BY diagnosis_date DESC, diagnosis_id DESC) AS t, count(*) AS n FROM diagnoses GROUP BY patient_id),
    e AS (SELECT patient_id, string_agg(treatment_start_date || ':' || regimen_category, ';' ORDER BY treatment_start_date DESC) AS t FROM episodes GROUP BY patient_id),
    x AS (SELECT patient_id, count(*) AS n FROM trials GROUP BY patient_id)
    SELECT p.patient_id, coalesce(d.t, '') AS diagnoses, CAST(coalesce(d.n, 0) AS INTEGER) AS n_diagnoses, coalesce(e.t, '') AS episodes, CAST(coalesce(x.n, 0) AS INTEGER) AS n_trials
    FROM patients p LEFT JOIN d ON d.patient_id = p.patient_id LEFT JOIN e ON e.patient_id = p.patient_id LEFT JOIN x ON x.patient_id = p.patient_id"""
)
def patient_detail_text(t: Frames) -> DataFrame:
    """The nested records, newest first, as text."""
    rows = patient_details(t)
    shown = lambda c, day, what: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[day].cast("string"), x[what])), ";").alias(c)
    return rows.select("patient_id", shown("diagnoses", "diagnosis_date", "stage"), F.size("diagnoses").alias("n_diagnoses"), shown("episodes", "treatment_start_date", "regimen_category"), F.size("trials").alias("n_trials"))


def patient_details(t: Frames) -> DataFrame:
    episodes = t.episodes.select("patient_id", "treatment_start_date", "line_of_therapy", "regimen_category")
    return serve.patient_details(t.patients, diagnoses=(t.by_patient(t.diagnoses), "diagnosis_date"), episodes=(episodes, "treatment_start_date"), trials=(t.by_patient(t.trials), "day"))


@query(
    """SELECT p_type, flag_name, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS quantity
       FROM (SELECT p_type, CASE l_returnflag WHEN 'A' THEN 'chemo' WHEN 'R' THEN 'io' ELSE 'other' END AS flag_name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) x GROUP BY ALL""",
    prelude=False,
)
def code_map_join(t: Frames) -> DataFrame:
    from ..operators.relational import code_table

    names = code_table(t.spark, [("A", "chemo"), ("R", "io")], "l_returnflag string, flag_name string")
    rows = t.table("lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(t.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    rows = rows.join(names, "l_returnflag", "left").fillna("other", ["flag_name"])
    return rows.groupBy("p_type", "flag_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query(
    """SELECT l_linestatus, bool_or(l_returnflag = 'A') AS any_a, count(*) FILTER (WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20) AS hits,
       count(*) FILTER (WHERE lower(l_returnflag) SIMILAR TO '(a|n)') AS matched FROM lineitem GROUP BY l_linestatus""",
    prelude=False,
)
def flag_filters(t: Frames) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.table("lineitem").groupBy("l_linestatus").agg(F.max(flag == "A").alias("any_a"), F.count_if(flag.isin("A", "R") & F.col("l_quantity").between(10, 20)).alias("hits"), F.count_if(F.lower(flag).rlike("^(a|n)$")).alias("matched"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS code, CASE WHEN p_size > 10 THEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') END AS confirmed
       FROM part WHERE p_size <= 10 OR p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')""",
    prelude=False,
)
def null_tolerant_filter(t: Frames) -> DataFrame:
    wanted = ["Brand#11", "Brand#12", "Brand#13"]
    rows = t.table("part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("code"))
    return rows.where(F.col("code").isin(wanted) | F.col("code").isNull()).withColumn("confirmed", F.col("code").isin(wanted))


@query("SELECT patient_id, state FROM patients WHERE patient_id NOT IN (SELECT user_id FROM events)")
def anti_join_unmatched(t: Frames) -> DataFrame:
    return t.patients.join(t.table("events").select(F.col("user_id").alias("patient_id")), "patient_id", "left_anti").select("patient_id", "state")


@query("SELECT assessment_id, response_type FROM responses WHERE episode_id IN (SELECT episode_id FROM episodes WHERE line_of_therapy = 1)")
def semi_join_filter(t: Frames) -> DataFrame:
    return t.responses.join(t.episodes.where("line_of_therapy = 1"), "episode_id", "left_semi").select("assessment_id", "response_type")


@query("SELECT patient_id, state, insurance_type FROM patients WHERE insurance_type = 'BUILDING' AND state IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def optional_filters(t: Frames) -> DataFrame:
    region = t.table("nation").where("n_regionkey = 1").select(F.col("n_name").alias("state"))
    rows = apply_filters(t.patients, insurance_type="BUILDING", state=None)
    return rows.join(F.broadcast(region), "state", "left_semi").select("patient_id", "state", "insurance_type")


@query(
    """, old AS (SELECT patient_id, state, insurance_type FROM patients WHERE patient_id % 10 <> 0),
    new AS (SELECT patient_id, state, CASE WHEN patient_id % 7 = 0 THEN 'CHANGED' ELSE insurance_type END AS insurance_type FROM patients WHERE patient_id % 9 <> 0)
    SELECT o.*, DATE '2001-01-01' AS effective_date, CASE WHEN o.insurance_type <> n.insurance_type THEN DATE '2001-06-15' ELSE DATE '9999-12-31' END AS end_date,
           NOT coalesce(o.insurance_type <> n.insurance_type, false) AS is_current FROM old o LEFT JOIN new n ON o.patient_id = n.patient_id
    UNION ALL SELECT n.*, DATE '2001-06-15', DATE '9999-12-31', true FROM new n LEFT JOIN old o ON o.patient_id = n.patient_id
    WHERE o.patient_id IS NULL OR o.insurance_type <> n.insurance_type"""
)
def scd2_apply(t: Frames) -> DataFrame:
    end = F.lit("9999-12-31").cast("date")
    old = t.patients.where("patient_id % 10 <> 0").withColumns({"effective_date": F.lit("2001-01-01").cast("date"), "end_date": end, "is_current": F.lit(True)})
    new = t.patients.where("patient_id % 9 <> 0").withColumn("insurance_type", F.when(F.col("patient_id") % 7 == 0, "CHANGED").otherwise(F.col("insurance_type")))
    return scd2_diff(old, new, "patient_id", ["state", "insurance_type"], t.snapshot)


@query(
    """SELECT patient_id, state, CASE WHEN patient_id % 3 = 0 THEN 'NEW' ELSE insurance_type END AS insurance_type FROM patients WHERE patient_id % 5 <> 0 OR patient_id % 3 = 0"""
)
def keyed_upsert_patients(t: Frames) -> DataFrame:
    return keyed_upsert(t.patients.where("patient_id % 5 <> 0"), t.patients.where("patient_id % 3 = 0").withColumn("insurance_type", F.lit("NEW")), ["patient_id"])


def _raw_people(t: Frames) -> DataFrame:
    """Customers as raw records, with the oddities of raw data."""
    c = F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int") + 1)
    return t.table("customer").select(
        c.alias("patient_id"),
        pick("ca", "New York", "Ontario", " TX ", "nevada").alias("state"),
        pick("M", "female", "nb", "?", "u").alias("gender"),
        pick("Private PPO", "Nevada VA", "Medicaid Plus", "self-pay", "Acme").alias("insurance_type"),
        pick("Caucasian", "asian american", "Not Hispanic", "declined").alias("race_ethnicity"),
        pick("10001", "12345", "90210", "99999", "123", "70012", "22901").alias("zip5"),
        F.date_sub(t.snapshot, (c * 37 % 50000).cast("int")).alias("date_of_birth"),
        F.when(c % 11 == 0, F.lit("")).otherwise(F.lit("ANN")).alias("first_name"),
        F.when(c % 13 != 0, F.lit("LEE")).alias("last_name"),
    )


_PEOPLE = """
    , raw AS (
        SELECT patient_id, ['ca', 'New York', 'Ontario', ' TX ', 'nevada'][patient_id % 5 + 1] AS rs, ['M', 'female', 'nb', '?', 'u'][patient_id % 5 + 1] AS rg,
               ['Private PPO', 'Nevada VA', 'Medicaid Plus', 'self-pay', 'Acme'][patient_id % 5 + 1] AS ri, ['Caucasian', 'asian american', 'Not Hispanic', 'declined'][patient_id % 4 + 1] AS rr,
               ['10001', '12345', '90210', '99999', '123', '70012', '22901'][patient_id % 7 + 1] AS zip5,
               DATE '2001-06-15' - CAST(patient_id * 37 % 50000 AS INTEGER) AS date_of_birth,
               CASE WHEN patient_id % 11 = 0 THEN '' ELSE 'ANN' END AS first_name, CASE WHEN patient_id % 13 <> 0 THEN 'LEE' END AS last_name
        FROM patients
    ), people AS (
        SELECT patient_id, CASE rs WHEN 'ca' THEN 'CA' WHEN 'New York' THEN 'NY' WHEN ' TX ' THEN 'TX' WHEN 'nevada' THEN 'NV' END AS state,
               CASE rg WHEN 'M' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'nb' THEN 'Other' ELSE 'Unknown' END AS gender,
               CASE ri WHEN 'Private PPO' THEN 'Commercial' WHEN 'Nevada VA' THEN 'Other Government' WHEN 'Medicaid Plus' THEN 'Medicaid' WHEN 'self-pay' THEN 'Self-Pay' ELSE 'Other' END AS insurance_type,
               CASE rr WHEN 'Caucasian' THEN 'White' WHEN 'asian american' THEN 'Asian' WHEN 'Not Hispanic' THEN 'Hispanic or Latino' ELSE 'Unknown' END AS race_ethnicity,
               zip5, CASE zip5 WHEN '10001' THEN 'Urban' WHEN '12345' THEN 'Suburban' WHEN '90210' THEN 'Urban' WHEN '99999' THEN 'Rural' WHEN '70012' THEN 'Urban' WHEN '22901' THEN 'Suburban' ELSE 'Unknown' END AS urban_rural,
               CAST(floor((DATE '2001-06-15' - date_of_birth) / 365.25) AS INTEGER) AS age_at_processing, date_of_birth, first_name, last_name
        FROM raw
    )
"""


@query(_PEOPLE + "SELECT * FROM people")
def demographics_standardised(t: Frames) -> DataFrame:
    return silver.standardise_demographics(_raw_people(t), t.snapshot)


@query(_PEOPLE + "SELECT urban_rural, count(*) AS n FROM people GROUP BY urban_rural")
def urban_rural(t: Frames) -> DataFrame:
    return silver.standardise_demographics(_raw_people(t), t.snapshot).groupBy("urban_rural").agg(F.count(F.lit(1)).alias("n"))


@query(
    _PEOPLE
    + """SELECT patient_id, NOT (first_name = '' OR last_name IS NULL) AND age_at_processing BETWEEN 0 AND 120 AS valid,
        concat_ws(',', CASE WHEN first_name = '' OR last_name IS NULL THEN 'missing_name' END, CASE WHEN age_at_processing NOT BETWEEN 0 AND 120 THEN 'invalid_age' END,
                  CASE WHEN gender = 'Unknown' THEN 'unknown_gender' END, CASE WHEN state IS NULL THEN 'missing_state' END, CASE WHEN zip5 = '123' THEN 'invalid_zip' END) AS issues FROM people"""
)
def dq_flags(t: Frames) -> DataFrame:
    rows = quality.flag_patients(silver.standardise_demographics(_raw_people(t), t.snapshot))
    return rows.select("patient_id", F.col("_dq_valid").alias("valid"), F.array_join("_dq_issues", ",").alias("issues"))


def _two_sources(t: Frames) -> DataFrame:
    c = F.col("c_custkey")
    rows = t.table("customer").select(
        F.when(c % 2 == 0, "EHR").otherwise("CLAIMS").alias("source_system"),
        c.cast("string").alias("source_patient_id"),
        F.element_at(F.array(F.lit("Robert"), F.lit("Rupert"), F.lit("Anna")), (F.floor(c / 2) % 3).cast("int") + 1).alias("first_name"),
        F.concat(F.lit("Name"), F.element_at(F.array(*[F.lit(x) for x in "abcdefg"]), (F.floor(c / 6) % 7).cast("int") + 1)).alias("last_name"),
        F.date_sub(t.snapshot, F.floor(c / 4).cast("int")).alias("date_of_birth"),
        F.lpad((F.floor(c / 2) % 90000).cast("string"), 5, "0").alias("zip5"),
    )
    return rows.withColumn("_ingestion_timestamp", F.lit("2001-01-01").cast("timestamp"))


@query(
    """SELECT upper('Name' || ['a', 'b', 'c', 'd', 'e', 'f', 'g'][CAST(floor(c_custkey / 6) AS BIGINT) % 7 + 1]) AS last_name, DATE '2001-06-15' - CAST(floor(c_custkey / 4) AS INTEGER) AS date_of_birth,
       lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 90000 AS VARCHAR), 5, '0') AS zip5, count(*) AS records, count(DISTINCT c_custkey % 2) AS systems FROM customer GROUP BY ALL""",
    prelude=False,
)
def identity_exact_key(t: Frames) -> DataFrame:
    groups = identity.resolve(_two_sources(t)).groupBy("match_group")
    of_group = [F.upper(F.min("last_name")).alias("last_name"), F.min("date_of_birth").alias("date_of_birth"), F.min("zip5").alias("zip5")]
    return groups.agg(*of_group, F.count(F.lit(1)).alias("records"), F.count_distinct("source_system").alias("systems")).drop("match_group")


_SOUNDS = "translate(regexp_replace(upper(first_name), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUY', '111122222222334556000000')"
for _code in "0123456":  # letters of one code in a row count once
    _SOUNDS = f"regexp_replace({_SOUNDS}, '{_code}+', '{_code}', 'g')"


@query(
    f"""WITH RECURSIVE people AS (
            SELECT CASE WHEN c_custkey % 2 = 0 THEN 'EHR' ELSE 'CLAIMS' END AS source_system, CAST(c_custkey AS VARCHAR) AS source_patient_id,
                   ['Robert', 'Rupert', 'Anna'][CAST(floor(c_custkey / 2) AS BIGINT) % 3 + 1] AS first_name,
                   'Name' || ['a', 'b', 'c', 'd', 'e', 'f', 'g'][CAST(floor(c_custkey / 6) AS BIGINT) % 7 + 1] AS last_name,
                   DATE '2001-06-15' - CAST(floor(c_custkey / 4) AS INTEGER) AS date_of_birth,
                   lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 90000 AS VARCHAR), 5, '0') AS zip5
            FROM customer
        ), keyed AS (
            SELECT *, sha256(source_system || '|' || source_patient_id) AS own,
                   concat_ws('|', upper(last_name), date_of_birth, zip5) AS match_group,
                   concat_ws('|', left(upper(first_name), 1) || left(replace(substr({_SOUNDS}, 2), '0', '') || '000', 3), upper(last_name), date_of_birth) AS sound
            FROM people
        ), links AS (
            SELECT a.own AS a, b.own AS b FROM keyed a JOIN keyed b ON a.match_group = b.match_group
            UNION SELECT a.own, b.own FROM keyed a JOIN keyed b ON a.sound = b.sound
        ), reached AS (
            SELECT own AS a, own AS b FROM keyed
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), labels AS (SELECT a AS own, min(b) AS patient_id FROM reached GROUP BY a)
        SELECT source_system, source_patient_id, first_name, last_name, date_of_birth, zip5, patient_id, match_group
        FROM keyed JOIN labels USING (own)
        QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY source_system <> 'EHR', source_patient_id) = 1""",
    prelude=False,
)
def identity_fuzzy(t: Frames) -> DataFrame:
    return identity.golden_records(identity.resolve(_two_sources(t))).drop("_ingestion_timestamp")


@query(
    """SELECT o_custkey AS patient_id, o_orderdate::DATE AS day, 'order' AS source, o_orderpriority AS note, NULL::DOUBLE AS amount FROM orders
       UNION ALL SELECT user_id, ts::DATE, 'event', NULL, value FROM events""",
    prelude=False,
)
def union_by_name_sources(t: Frames) -> DataFrame:
    a = t.table("orders").select(F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("day"), F.lit("order").alias("source"), F.col("o_orderpriority").alias("note"))
    b = t.table("events").select(F.col("user_id").alias("patient_id"), F.to_date("ts").alias("day"), F.lit("event").alias("source"), F.col("value").alias("amount"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d::DATE AS full_date, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
       CAST(quarter(d) AS INTEGER) AS quarter, dayofweek(d) IN (0, 6) AS is_weekend, d::DATE = last_day(d::DATE) AS is_month_end, monthname(d) AS month_name, dayname(d) AS day_name
       FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders) s""",
    prelude=False,
)
def dim_date(t: Frames) -> DataFrame:
    bounds = t.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return silver.dim_date(bounds).select("date_key", "full_date", "day_of_week", "week_of_year", "quarter", "is_weekend", "is_month_end", "month_name", "day_name")


_SHARE = "CASE WHEN {1} > 0 THEN round(CAST({0} AS DOUBLE) / {1} * 100, 1) ELSE CAST(0 AS DOUBLE) END"


def _live(stage: str) -> str:
    return f"""
        , staged AS (SELECT * FROM diagnoses WHERE {stage} AND patient_id IN (SELECT patient_id FROM patients)),
        lines AS (SELECT patient_id, treatment_start_date, has_io FROM episodes WHERE line_of_therapy = 1),
        pairs AS (SELECT treatment_start_date - diagnosis_date AS days FROM staged JOIN lines USING (patient_id) WHERE treatment_start_date >= diagnosis_date),
        es AS (SELECT has_io FROM diagnoses JOIN lines USING (patient_id) JOIN patients USING (patient_id) WHERE stage = 'ES-SCLC'),
        n AS (SELECT (SELECT count(*) FROM patients) AS people, (SELECT count(DISTINCT patient_id) FROM staged) AS diagnosed,
              (SELECT count(DISTINCT patient_id) FROM biomarkers JOIN patients USING (patient_id)) AS tested, (SELECT count(DISTINCT patient_id) FROM trials JOIN patients USING (patient_id)) AS enrolled,
              (SELECT count(*) FROM es) AS es, (SELECT count(*) FROM es WHERE has_io) AS io)
        SELECT people AS total_patients, (SELECT count(*) FROM staged WHERE diagnosis_date >= DATE '2001-06-01') AS new_diagnoses_mtd,
               (SELECT count(*) FROM staged WHERE diagnosis_date >= DATE '2001-04-01') AS new_diagnoses_qtd, (SELECT count(*) FROM staged WHERE diagnosis_date >= DATE '2001-01-01') AS new_diagnoses_ytd,
               (SELECT CAST(list_sort(list(days))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) FROM pairs) AS median_time_to_treatment_days,
               {_SHARE.format("tested", "diagnosed")} AS biomarker_testing_rate, {_SHARE.format("io", "es")} AS immunotherapy_uptake_rate, {_SHARE.format("enrolled", "people")} AS clinical_trial_enrollment_rate
        FROM n"""


@query(_live("true"))
def overview_live(t: Frames) -> DataFrame:
    return live.overview(t.patients, t.diagnoses, t.episodes, t.biomarkers, t.trials, t.snapshot)


@query(_live("stage = 'LS-SCLC'"))
def overview_live_stage(t: Frames) -> DataFrame:
    return live.overview(t.patients, t.diagnoses, t.episodes, t.biomarkers, t.trials, t.snapshot, stage="LS-SCLC")


@query(
    """, dx AS (SELECT patient_id, 'stage_' || last(stage ORDER BY diagnosis_date, diagnosis_id) AS a FROM diagnoses GROUP BY patient_id),
    tx AS (SELECT patient_id, episode_id, '1l_' || regimen_category AS b FROM episodes WHERE line_of_therapy = 1),
    ra AS (SELECT episode_id, 'resp_' || last(response_type ORDER BY assessment_date, assessment_id) AS c FROM responses GROUP BY episode_id),
    journey AS (SELECT a, b, c FROM dx LEFT JOIN tx USING (patient_id) LEFT JOIN ra USING (episode_id))
    SELECT 'diagnosis' AS source, a AS target, count(*) AS value FROM journey GROUP BY ALL
    UNION ALL SELECT a, b, count(*) FROM journey WHERE b IS NOT NULL GROUP BY ALL UNION ALL SELECT b, c, count(*) FROM journey WHERE c IS NOT NULL GROUP BY ALL"""
)
def sankey_live(t: Frames) -> DataFrame:
    return live.sankey(t.diagnoses, t.episodes, t.responses)


@query(
    """, dx AS (SELECT patient_id, min(diagnosis_date) AS diagnosis_date, first(stage ORDER BY diagnosis_date, diagnosis_id) AS stage FROM diagnoses GROUP BY patient_id),
    tx AS (SELECT patient_id, first(treatment_start_date ORDER BY line_of_therapy <> 1, treatment_start_date) AS start, first(regimen_category ORDER BY line_of_therapy <> 1, treatment_start_date) AS treatment FROM episodes GROUP BY patient_id)
    SELECT p.*, dx.stage, dx.diagnosis_date, tx.treatment, CASE WHEN start >= diagnosis_date THEN CAST(start - diagnosis_date AS INTEGER) END AS days_to_treatment
    FROM patients p LEFT JOIN dx USING (patient_id) LEFT JOIN tx USING (patient_id)"""
)
def patient_rows_enriched(t: Frames) -> DataFrame:
    return serve.enriched_rows(t.patients, t.by_patient(t.diagnoses), t.episodes)


def _raw_orders(t: Frames, **columns: str) -> DataFrame:
    """Orders as raw records of a feed."""
    return t.table("orders").selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _xref(t: Frames) -> DataFrame:
    ids = t.patients.select(F.col("patient_id").cast("string").alias("source_patient_id"), "patient_id")
    return ids.withColumn("source_system", F.explode(F.array(F.lit("EHR"), F.lit("CLAIMS"))))


@query(
    """, raw AS (
        SELECT o_custkey AS patient_id, o_orderdate::DATE AS diagnosis_date, left(o_orderpriority, 1) AS p, o_orderstatus AS s FROM orders
    ), rows AS (
        SELECT patient_id, diagnosis_date, 'EHR' AS source_system, CASE p WHEN '1' THEN 'C34.10' ELSE 'C34.90' END AS icd10_code, CASE s WHEN 'F' THEN '8041' END AS morphology_code,
               CASE s WHEN 'F' THEN 'LS-SCLC' WHEN 'O' THEN 'ES-SCLC' END AS stage FROM raw WHERE p IN ('1', '2') AND s <> 'P'
        UNION ALL SELECT patient_id, diagnosis_date, 'CLAIMS', 'C34.2', NULL, 'Unknown' FROM raw WHERE p = '3'
    )
    SELECT patient_id, diagnosis_date, CAST(strftime(diagnosis_date, '%Y%m%d') AS INTEGER) AS diagnosis_date_key, stage, icd10_code, morphology_code,
           CASE WHEN morphology_code = '8041' THEN true END AS is_confirmed_sclc, source_system
    FROM rows WHERE patient_id IN (SELECT patient_id FROM patients)
    QUALIFY row_number() OVER (PARTITION BY patient_id, diagnosis_date ORDER BY source_system DESC, icd10_code, stage) = 1"""
)
def fact_diagnosis(t: Frames) -> DataFrame:
    priority = "CASE left(o_orderpriority, 1) WHEN '{0}' THEN '{1}' WHEN '{2}' THEN '{3}' ELSE 'I10' END"
    conditions = _raw_orders(
        t, subject_id="string(o_custkey)", code=priority.format(1, "C34.10", 2, "C34.90"), morphology_code="CASE o_orderstatus WHEN 'F' THEN '8041' WHEN 'P' THEN '8140' END",
        onsetDateTime="string(to_date(o_orderdate))", stage="CASE o_orderstatus WHEN 'F' THEN 'Limited disease' ELSE 'extensive stage' END",
    )
    claims = _raw_orders(
        t, subscriber_id="string(o_custkey)", primary_diagnosis_code="'Z51.11'", secondary_diagnosis_code_1=priority.format(3, "C34.2", "-", "-"), service_from_date="string(to_date(o_orderdate))"
    )
    return silver.fact_diagnosis(conditions, claims, _xref(t)).drop("diagnosis_id")


@query(
    """, daily AS (
        SELECT patient_id, assessment_date, first(response_type ORDER BY CASE response_type WHEN 'CR' THEN 1 WHEN 'PR' THEN 2 WHEN 'SD' THEN 3 WHEN 'PD' THEN 4 ELSE 5 END) AS response_type
        FROM assessments WHERE patient_id IN (SELECT patient_id FROM patients) GROUP BY ALL
    ), linked AS (
        SELECT d.*, e.episode_id, e.treatment_start_date, CASE response_type WHEN 'CR' THEN 1 WHEN 'PR' THEN 2 WHEN 'SD' THEN 3 WHEN 'PD' THEN 4 ELSE 5 END AS rank
        FROM daily d ASOF LEFT JOIN episodes e ON d.patient_id = e.patient_id AND d.assessment_date >= e.treatment_start_date
    )
    SELECT patient_id, assessment_date, response_type, episode_id, treatment_start_date, row_number() OVER (PARTITION BY patient_id, episode_id ORDER BY rank, assessment_date) = 1 AS is_best_response FROM linked"""
)
def fact_response_assessment(t: Frames) -> DataFrame:
    said = "element_at(array('Complete Response', 'partial', 'SD', 'cannot say', 'progression seen'), int(left(o_orderpriority, 1)))"
    observations = _raw_orders(t, subject_id="string(o_custkey)", category="'Imaging'", valueString=said, effectiveDateTime="string(to_date(o_orderdate))")
    return silver.fact_response_assessment(observations, t.episodes, _xref(t), t.parts).drop("assessment_id")


@query(
    """, met AS (
        SELECT user_id AS patient_id, 'NCT' || (event_id % 3) AS trial_identifier, ts::DATE AS enrollment_date FROM events WHERE event_type = 'signup'
        UNION ALL SELECT o_custkey, NULL, o_orderdate::DATE FROM orders WHERE left(o_orderpriority, 1) = '1'
    ), rows AS (
        SELECT patient_id, trial_identifier, min(enrollment_date) AS enrollment_date FROM met WHERE patient_id IN (SELECT patient_id FROM patients) GROUP BY ALL
    ), near AS (
        SELECT r.patient_id, r.trial_identifier, e.episode_id, e.treatment_start_date
        FROM rows r JOIN episodes e ON r.patient_id = e.patient_id AND abs(r.enrollment_date - e.treatment_start_date) <= 30
        QUALIFY row_number() OVER (PARTITION BY r.patient_id, r.trial_identifier ORDER BY abs(r.enrollment_date - e.treatment_start_date), e.treatment_start_date) = 1
    )
    SELECT r.*, 'enrolled' AS trial_status, n.episode_id, n.treatment_start_date FROM rows r LEFT JOIN near n ON r.patient_id = n.patient_id AND r.trial_identifier IS NOT DISTINCT FROM n.trial_identifier"""
)
def fact_trial_enrollment(t: Frames) -> DataFrame:
    encounters = t.table("events").selectExpr("string(user_id) AS subject_id", "CASE event_type WHEN 'signup' THEN concat('NCT', event_id % 3) END AS clinical_trial_id", "event_type AS type", "string(to_date(ts)) AS encounter_date")
    procedures = _raw_orders(t, subject_id="string(o_custkey)", code="CASE left(o_orderpriority, 1) WHEN '1' THEN '0075T' ELSE '99213' END", procedure_date="string(to_date(o_orderdate))")
    return silver.fact_trial_enrollment(encounters, procedures, t.episodes, _xref(t)).drop("enrollment_id", "trial_name", "trial_phase")


@query(
    """SELECT insurance_type, state, count(*) AS n, CAST(grouping(insurance_type) AS INTEGER) + 2 * CAST(grouping(state) AS INTEGER) AS level
       FROM patients GROUP BY CUBE (insurance_type, state)"""
)
def cube_all(t: Frames) -> DataFrame:
    out = cube_with_all(t.patients, ["insurance_type", "state"], [F.count(F.lit(1)).alias("n")])
    return out.withColumn("level", F.col("insurance_type").isNull().cast("int") + 2 * F.col("state").isNull().cast("int"))


@query(
    """SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e
       ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    prelude=False,
)
def event_asof(t: Frames) -> DataFrame:
    e = t.table("events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
    return asof_join(left, right, ["user_id"], "ts", "bought", ["purchase_id"]).select("event_id", "user_id", "purchase_id")


@query(
    """, dates AS (SELECT patient_id, service_date, count(*) AS n FROM claims GROUP BY ALL)
    SELECT patient_id, service_date, n, CAST(sum(n) OVER (PARTITION BY patient_id ORDER BY service_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM dates"""
)
def running_claims(t: Frames) -> DataFrame:
    w = Window.partitionBy("patient_id").orderBy("service_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.claims.groupBy("patient_id", "service_date").agg(F.count(F.lit(1)).alias("n")).withColumn("running", F.sum("n").over(w))


_LEVEL = "CASE WHEN v >= {0} THEN 'positive' WHEN v >= {1} THEN 'caution' ELSE 'action' END"


def _kpi_rule(name: str, value: str) -> str:
    return f"SELECT '{name}' AS rule, {_LEVEL.format(*serve.INSIGHTS[name])} AS insight_type, v AS value FROM (SELECT {value} AS v FROM base)"


@query(
    _PATTERNS
    + _GEO
    + f""", rules AS (
        SELECT 'treatment_timeliness' AS rule, {_LEVEL.format(75, 60)} AS insight_type, v AS value
        FROM (SELECT {_rate("count(*) FILTER (WHERE ttt_days <= 21)", "count(ttt_days)")} AS v FROM base)
        UNION ALL SELECT 'late_treatment', 'action', v FROM (SELECT {_rate("count(*) FILTER (WHERE ttt_days >= 31)", "count(ttt_days)")} AS v FROM base) WHERE v >= 10
        UNION ALL {_kpi_rule("immunotherapy_uptake_rate", _rate("count(*) FILTER (WHERE stage = 'ES-SCLC' AND has_io)", "count(*) FILTER (WHERE stage = 'ES-SCLC')"))}
        UNION ALL {_kpi_rule("biomarker_testing_rate", _rate("count(*) FILTER (WHERE has_biomarker)", "count(*)"))}
        UNION ALL {_kpi_rule("clinical_trial_rate", _rate("count(*) FILTER (WHERE has_trial)", "count(*)"))}
        UNION ALL SELECT 'chemo_only_first_line', 'caution', percentage FROM patterns WHERE stage_filter IS NULL AND line_of_therapy = 1 AND regimen_category = 'Chemo Only' AND percentage > 25
        UNION ALL SELECT 'chemo_io_share', 'info', percentage FROM patterns WHERE stage_filter IS NULL AND line_of_therapy = 1 AND regimen_category = 'Chemo+IO' AND percentage > 0
        UNION ALL SELECT 'top_second_line', 'info', max(percentage) FROM patterns WHERE stage_filter IS NULL AND line_of_therapy = 2 HAVING count(*) > 0
        UNION ALL SELECT 'state_gap', 'caution', round(max(avg_time_to_treatment) - min(avg_time_to_treatment), 1) FROM geo WHERE avg_time_to_treatment > 0
                  HAVING count(*) > 1 AND max(avg_time_to_treatment) - min(avg_time_to_treatment) > 5
        UNION ALL SELECT 'low_testing_states', 'action', CAST(count(*) AS DOUBLE) FROM geo WHERE biomarker_rate < 70 HAVING count(*) >= 5
    )
    SELECT *, CAST(list_position(['action', 'caution', 'positive', 'info'], insight_type) AS BIGINT) AS position FROM rules"""
)
def insights_rules(t: Frames) -> DataFrame:
    t = t.published()
    kpi = cut_lineage(serve.overview(cut_lineage(gold.overview(t.base, t.snapshot))))
    ttt = cut_lineage(serve.time_to_treatment(cut_lineage(gold.ttt_distribution(t.base, t.snapshot, zero_filled=True))))
    patterns = cut_lineage(serve.treatment_patterns(cut_lineage(gold.treatment_patterns(t.episodes, t.diagnosed, t.snapshot))))
    return serve.insights(kpi, ttt, patterns, cut_lineage(gold.geographic(t.base, t.snapshot)))


from . import registry_raw  # noqa: E402, F401 registers its queries too
