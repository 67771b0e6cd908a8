"""The star schema's frames, from order-processing tables that play their roles: customers are patients,
nations states, orders diagnoses and assessments, line items treatment claims, suppliers facilities, events
biomarker tests, enrollments and notes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from ..operators.relational import dealt, parts_of
from . import gold, silver

SNAPSHOT = "2001-06-15"


@dataclass
class Frames:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def snapshot(self):
        return F.lit(SNAPSHOT).cast("date")

    @cached_property
    def parts(self) -> int | None:
        """Partitions of what is dealt by patient or order, for the largest table's rows (Parquet's footers count them)."""
        return parts_of(self.table("lineitem").count())

    def by_patient(self, df: DataFrame) -> DataFrame:
        return dealt(df, ["patient_id"], self.parts)

    @cached_property
    def patients(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
        # 25 nations, a fixed table
        return self.table("customer").join(F.broadcast(nation), "c_nationkey").select(F.col("c_custkey").alias("patient_id"), "state", F.col("c_mktsegment").alias("insurance_type"))

    @cached_property
    def diagnoses(self) -> DataFrame:
        stage = F.when(F.col("o_orderstatus") == "F", "LS-SCLC").when(F.col("o_orderstatus") == "O", "ES-SCLC").otherwise("Unknown")
        return self.table("orders").select(F.col("o_orderkey").alias("diagnosis_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("diagnosis_date"), stage.alias("stage"))

    @cached_property
    def claims(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("service_date"))
        owners = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient_id"))
        category = F.when(F.col("l_returnflag") == "A", "chemo").when(F.col("l_returnflag") == "R", "io").otherwise("radiation")
        drug = F.concat_ws("-", "l_returnflag", "l_linestatus")
        rows = dealt(lines, ["l_orderkey"], self.parts).join(owners, "l_orderkey")
        return self.by_patient(rows.select("patient_id", "service_date", category.alias("category"), drug.alias("drug"), F.col("l_suppkey").alias("facility_id")))

    @cached_property
    def episodes(self) -> DataFrame:
        out = silver.episodes(self.claims, carried=[F.min("facility_id").alias("facility_id")])
        return out.withColumn("episode_id", F.concat_ws("-", F.col("patient_id").cast("string"), F.col("line_of_therapy").cast("string")))

    @cached_property
    def facilities(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("facility_name"))

    def _events(self, *kinds: str) -> DataFrame:
        rows = self.table("events").where(F.col("event_type").isin(*kinds))
        return rows.select(F.col("event_id"), F.col("user_id").alias("patient_id"), F.to_date("ts").alias("day"), "event_type")

    @cached_property
    def biomarkers(self) -> DataFrame:
        return self._events("click", "view")

    @cached_property
    def trials(self) -> DataFrame:
        return self._events("signup")

    @cached_property
    def responses(self) -> DataFrame:
        """Orders as assessments, each with the latest episode begun by then."""
        kind = F.element_at(F.create_map(*[F.lit(x) for p in (("1", "CR"), ("2", "PR"), ("3", "SD"), ("4", "NE"), ("5", "PD")) for x in p]), F.substring("o_orderpriority", 1, 1))
        rows = self.table("orders").select(F.col("o_orderkey").alias("assessment_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("assessment_date"), kind.alias("response_type"))
        return silver.asof_join(self.by_patient(rows), self.episodes.select("patient_id", "episode_id", "treatment_start_date"), ["patient_id"], "assessment_date", "treatment_start_date", ["episode_id"])

    @cached_property
    def diagnosed(self) -> DataFrame:
        return gold.first_diagnosis(self.by_patient(self.diagnoses)).where(F.col("first_diagnosis_date") <= self.snapshot)

    @cached_property
    def base(self) -> DataFrame:
        return gold.patient_base(self.patients, self.by_patient(self.diagnoses), self.episodes, self.biomarkers, self.trials, self.snapshot)

    def published(self) -> Frames:
        """The same frames over written episodes and cohort, for queries that read these several times."""
        out = Frames(self.spark, self.sf_dir)
        out.__dict__["episodes"] = cut_lineage(self.episodes)
        out.__dict__["base"] = cut_lineage(out.base)
        return out

    @cached_property
    def paths(self) -> DataFrame:
        return gold.journeys(self.diagnosed, self.episodes, self.responses, self.trials)


#: The same frames in SQL.
PRELUDE = """
WITH patients AS (
    SELECT c_custkey AS patient_id, n_name AS state, c_mktsegment AS insurance_type FROM customer JOIN nation ON c_nationkey = n_nationkey
), diagnoses AS (
    SELECT o_orderkey AS diagnosis_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS diagnosis_date,
           CASE o_orderstatus WHEN 'F' THEN 'LS-SCLC' WHEN 'O' THEN 'ES-SCLC' ELSE 'Unknown' END AS stage
    FROM orders
), claims AS (
    SELECT o_custkey AS patient_id, CAST(l_shipdate AS DATE) AS service_date, l_returnflag AS flag, l_returnflag || '-' || l_linestatus AS drug, l_suppkey AS facility_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), gaps AS (
    SELECT *, CASE WHEN service_date - lag(service_date) OVER (PARTITION BY patient_id ORDER BY service_date) <= 28 THEN 0 ELSE 1 END AS fresh FROM claims
), sessions AS (
    SELECT *, sum(fresh) OVER (PARTITION BY patient_id ORDER BY service_date) AS seq FROM gaps
), grouped AS (
    SELECT patient_id, CAST(seq AS INTEGER) AS line_of_therapy, min(service_date) AS treatment_start_date, max(service_date) AS treatment_end_date,
           list_sort(list(DISTINCT drug)) AS drugs, bool_or(flag = 'A') AS has_chemo, bool_or(flag = 'R') AS has_io, bool_or(flag = 'N') AS has_radiation,
           count(*) AS claim_count, min(facility_id) AS facility_id
    FROM sessions GROUP BY patient_id, seq
), episodes AS (
    SELECT *, patient_id || '-' || line_of_therapy AS episode_id, array_to_string(drugs, ' + ') AS regimen_name,
           CASE WHEN has_chemo AND has_io THEN 'Chemo+IO' WHEN has_io THEN 'IO Monotherapy' WHEN has_chemo THEN 'Chemo Only' WHEN has_radiation THEN 'Radiation' ELSE 'Other' END AS regimen_category,
           CASE line_of_therapy WHEN 1 THEN '1st line' WHEN 2 THEN '2nd line' ELSE '3rd line+' END AS line_label
    FROM grouped
), biomarkers AS (
    SELECT event_id, user_id AS patient_id, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('click', 'view')
), trials AS (
    SELECT event_id, user_id AS patient_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'
), assessments AS (
    SELECT o_orderkey AS assessment_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS assessment_date,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 'CR' WHEN '2' THEN 'PR' WHEN '3' THEN 'SD' WHEN '4' THEN 'NE' WHEN '5' THEN 'PD' END AS response_type
    FROM orders
), responses AS (
    SELECT a.*, e.episode_id, e.treatment_start_date,
           CASE a.response_type WHEN 'CR' THEN 1 WHEN 'PR' THEN 2 WHEN 'SD' THEN 3 WHEN 'PD' THEN 4 ELSE 5 END AS rank
    FROM assessments a ASOF LEFT JOIN episodes e ON a.patient_id = e.patient_id AND a.assessment_date >= e.treatment_start_date
), diagnosed AS (
    SELECT patient_id, min(diagnosis_date) AS first_diagnosis_date,
           coalesce(first(stage ORDER BY diagnosis_date, diagnosis_id) FILTER (WHERE stage <> 'Unknown'), 'Unknown') AS stage
    FROM diagnoses GROUP BY patient_id HAVING min(diagnosis_date) <= DATE '2001-06-15'
), base AS (
    SELECT p.patient_id, p.state, p.insurance_type, d.first_diagnosis_date, d.stage,
           (SELECT min(treatment_start_date) FROM episodes e WHERE e.patient_id = p.patient_id AND e.treatment_start_date >= d.first_diagnosis_date) - d.first_diagnosis_date AS ttt_days,
           coalesce((SELECT bool_or(has_io) FROM episodes e WHERE e.patient_id = p.patient_id), false) AS has_io,
           p.patient_id IN (SELECT patient_id FROM biomarkers) AS has_biomarker,
           p.patient_id IN (SELECT patient_id FROM trials) AS has_trial
    FROM patients p JOIN diagnosed d ON p.patient_id = d.patient_id
), best AS (
    SELECT r.patient_id, first(response_type ORDER BY rank, response_type) AS response
    FROM responses r JOIN episodes e ON r.episode_id = e.episode_id WHERE e.line_of_therapy = 1 GROUP BY r.patient_id
), paths AS (
    SELECT d.patient_id, d.stage, coalesce(e.regimen_category, 'No Treatment') AS treatment, coalesce(b.response, 'Not Assessed') AS response,
           CASE WHEN d.patient_id IN (SELECT patient_id FROM trials) THEN 'Clinical Trial'
                WHEN d.patient_id IN (SELECT patient_id FROM episodes WHERE line_of_therapy = 2) THEN '2nd Line Therapy'
                WHEN b.response IN ('CR', 'PR', 'SD') THEN 'Continue/Monitor' ELSE 'No Further Treatment' END AS next_step
    FROM diagnosed d LEFT JOIN episodes e ON e.patient_id = d.patient_id AND e.line_of_therapy = 1 LEFT JOIN best b ON b.patient_id = d.patient_id
)
"""
