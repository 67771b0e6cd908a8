"""Registered queries over raw frames and over loads: feeds to people and facts, identities and facts that a second
load brings up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity, lineage
from ..operators.relational import scd2_diff, scd2_end
from ..sources import buckets, files
from . import serve, silver
from .analogue import Frames
from .registry import _SOUNDS, _raw_orders, _two_sources, _xref, query

# people


@query(
    """SELECT 'EHR' AS source_system, CAST(c_custkey AS VARCHAR) AS source_patient_id, c_mktsegment AS first_name, upper(c_name) AS last_name,
        CASE WHEN c_custkey % 9 <> 0 THEN DATE '1940-01-01' + CAST(c_custkey % 20000 AS INTEGER) END AS date_of_birth, 'm' AS gender,
        CASE WHEN c_custkey % 2 = 0 THEN 'NY' END AS state, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') END AS zip5, 'medicare' AS insurance_type
       FROM customer""",
    prelude=False,
)
def ehr_patients_raw(t: Frames) -> DataFrame:
    """Patients of the FHIR feed: arrays of names and of addresses, of which the first counts; unreadable dates."""
    born = F.when(F.col("c_custkey") % 9 != 0, F.date_add(F.lit("1940-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int")).cast("string")).otherwise("unknown")
    name = F.struct(F.array(F.lower("c_mktsegment"), F.lit("Q")).alias("given"), F.col("c_name").alias("family"))
    home = F.struct(F.concat(F.lpad((F.col("c_custkey") % 90000).cast("string"), 5, "0"), F.lit("-1234")).alias("postalCode"), F.lit("NY").alias("state"))
    raw = t.table("customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.array(name, F.struct(F.array(F.lit("old")).alias("given"), F.lit("old").alias("family"))).alias("name"),
        born.alias("birthDate"),
        F.lit("m").alias("gender"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(home)).otherwise(F.array().cast("array<struct<postalCode:string,state:string>>")).alias("address"),
        F.lit("medicare").alias("insurance_type"),
    )
    return silver.ehr_patients(raw).drop("race_ethnicity", "_ingestion_timestamp")


@query(
    """SELECT 'CLAIMS' AS source_system, CAST(o_custkey AS VARCHAR) AS source_patient_id, 'ANN' AS first_name, upper(o_orderpriority) AS last_name, o_orderdate::DATE AS date_of_birth,
        'NY' AS state, CAST(10000 + o_orderkey % 9 AS VARCHAR) AS zip5, o_orderstatus AS insurance_type
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1""",
    prelude=False,
)
def claims_patients_newest(t: Frames) -> DataFrame:
    """Subscribers as their newest claims tell them."""
    raw = _raw_orders(
        t, claim_id="string(o_orderkey)", subscriber_id="string(o_custkey)", subscriber_first_name="' Ann '", subscriber_last_name="o_orderpriority", subscriber_dob="string(to_date(o_orderdate))",
        subscriber_state="'NY'", subscriber_zip="concat(10000 + o_orderkey % 9, '-0001')", payer_name="o_orderstatus", _ingestion_timestamp="timestamp(to_date(o_orderdate))",
    )
    return silver.claims_patients(raw).drop("gender", "race_ethnicity", "_ingestion_timestamp")


# facts from raw frames


@query(
    """, raw AS (
        SELECT o_custkey AS patient_id, left(o_orderpriority, 1) AS p, o_orderdate::DATE AS test_date, CAST(floor(o_totalprice) AS BIGINT) % 20 AS n, o_orderstatus AS s FROM orders
    ), tests AS (
        SELECT patient_id, test_date, CASE p WHEN '1' THEN '88360' WHEN '2' THEN '81479' ELSE 'zz' END AS test_code,
               CASE p WHEN '1' THEN 'PD-L1' WHEN '2' THEN 'TMB' WHEN '3' THEN 'NGS' ELSE 'PD-L1' END AS biomarker_type,
               CASE WHEN p IN ('1', '2') THEN CAST(n AS DOUBLE) END AS result_numeric, CASE WHEN p = '3' THEN CASE s WHEN 'F' THEN 'pathogenic' ELSE 'benign' END WHEN p = '5' THEN 'high' END AS result_text,
               CASE p WHEN '1' THEN n >= 1 WHEN '2' THEN n >= 10 WHEN '3' THEN s = 'F' ELSE true END AS result_positive
        FROM raw WHERE p <> '4' AND patient_id IN (SELECT patient_id FROM patients)
    )
    SELECT DISTINCT *, CASE WHEN biomarker_type = 'PD-L1' THEN result_numeric END AS pdl1_tps_score, CASE WHEN biomarker_type = 'TMB' THEN result_numeric END AS tmb_score FROM tests"""
)
def fact_biomarker_test(t: Frames) -> DataFrame:
    kind = "element_at(array('{0}', '{1}', '{2}', '{3}', '{4}'), int(left(o_orderpriority, 1)))"
    observations = _raw_orders(
        t, subject_id="string(o_custkey)", code=kind.format("88360", "81479", "zz", "zz", "zz"), category=kind.format("lab", "lab", "NGS panel", "vitals", "PDL1 stain"),
        observation_date="string(to_date(o_orderdate))", value_numeric="CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN double(bigint(floor(o_totalprice)) % 20) END",
        value_text="CASE left(o_orderpriority, 1) WHEN '3' THEN CASE o_orderstatus WHEN 'F' THEN 'pathogenic' ELSE 'benign' END WHEN '5' THEN 'high' END",
    )
    return silver.fact_biomarker_test(t.spark, observations, _xref(t)).drop("test_id", "result_unit", "interpretation")


@query(
    """, given AS (
        SELECT o_custkey AS patient_id, o_orderdate::DATE AS service_date, ['chemo', 'io', 'radiation', 'targeted'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS category,
               ['Cisplatin', 'Pembrolizumab', 'Radiation', 'Bevacizumab'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS drug FROM orders WHERE left(o_orderpriority, 1) <> '5'
        UNION ALL SELECT o_custkey, o_orderdate::DATE + 10, 'chemo', 'Carboplatin' FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_custkey, o_orderdate::DATE + 28, 'io', 'Nivolumab' FROM orders WHERE o_orderstatus = 'P'
    ), fresh AS (
        SELECT *, CASE WHEN service_date - lag(service_date) OVER (PARTITION BY patient_id ORDER BY service_date) <= 28 THEN 0 ELSE 1 END AS f FROM given WHERE patient_id IN (SELECT patient_id FROM patients)
    ), numbered AS (SELECT *, sum(f) OVER (PARTITION BY patient_id ORDER BY service_date) AS k FROM fresh)
    SELECT patient_id, CAST(k AS INTEGER) AS line_of_therapy, min(service_date) AS treatment_start_date, max(service_date) AS treatment_end_date, CAST(max(service_date) - min(service_date) AS INTEGER) AS duration_days,
           array_to_string(list_sort(list(DISTINCT drug)), ' + ') AS regimen_name, count(*) AS claim_count,
           CASE WHEN bool_or(category = 'chemo') AND bool_or(category = 'io') THEN 'Chemo+IO' WHEN bool_or(category = 'io') THEN 'IO Monotherapy' WHEN bool_or(category = 'targeted') THEN 'Targeted Therapy'
                WHEN bool_or(category = 'chemo') THEN 'Chemo Only' ELSE 'Radiation' END AS regimen_category
    FROM numbered GROUP BY patient_id, k"""
)
def fact_treatment_episode(t: Frames) -> DataFrame:
    code = "element_at(array('J9060', 'J9271', '77385', 'J9035', 'XX'), int(left(o_orderpriority, 1)))"
    procedures = _raw_orders(t, subject_id="string(o_custkey)", code=code, performedDateTime="string(to_date(o_orderdate))")
    professional = _raw_orders(t, subscriber_id="string(o_custkey)", procedure_code="CASE o_orderstatus WHEN 'F' THEN 'J9045' END", service_from_date="string(date_add(to_date(o_orderdate), 10))")
    institutional = _raw_orders(t, subscriber_id="string(o_custkey)", procedure_code="CASE o_orderstatus WHEN 'P' THEN 'J9299' END", admission_date="string(date_add(to_date(o_orderdate), 28))")
    found = silver.fact_treatment_episode(t.spark, procedures, professional, institutional, _xref(t))
    return found.select("patient_id", "line_of_therapy", "treatment_start_date", "treatment_end_date", "duration_days", "regimen_name", "claim_count", "regimen_category")


@query(
    """, told AS (
        SELECT patient_id, assessment_date AS progression_date, 'assessment' AS evidence FROM assessments WHERE response_type = 'PD'
        UNION ALL SELECT user_id, ts::DATE, 'note' FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT patient_id FROM patients)
    ), kept AS (
        SELECT *, progression_date - lag(progression_date) OVER (PARTITION BY patient_id ORDER BY progression_date, evidence) AS gap FROM told QUALIFY gap IS NULL OR gap > 30
    )
    SELECT k.patient_id, k.progression_date, k.evidence, e.episode_id, CAST(row_number() OVER (PARTITION BY k.patient_id ORDER BY k.progression_date, k.evidence) AS INTEGER) AS progression_number,
           CAST(k.progression_date - f.d AS INTEGER) AS pfs_days_from_diagnosis, CAST(k.progression_date - e.treatment_start_date AS INTEGER) AS pfs_days_from_treatment
    FROM kept k LEFT JOIN (SELECT patient_id, min(diagnosis_date) AS d FROM diagnoses GROUP BY patient_id) f ON f.patient_id = k.patient_id
    ASOF LEFT JOIN episodes e ON k.patient_id = e.patient_id AND k.progression_date >= e.treatment_start_date"""
)
def fact_progression_event(t: Frames) -> DataFrame:
    notes = t.table("events").selectExpr("string(user_id) AS subject_id", "CASE event_type WHEN 'purchase' THEN 'Disease has PROGRESSED' ELSE 'stable' END AS valueString", "string(to_date(ts)) AS observation_date")
    return silver.fact_progression_event(t.responses, notes, t.diagnoses, t.episodes, _xref(t)).drop("progression_id")


# details


def _child(name: str, source: str, day: str, columns: list[str]) -> str:
    fields = ", ".join(f"{c} := {c}" for c in [day, *columns])
    order = ", ".join(f"{c} DESC" for c in [day, *columns])
    return f"{name} AS (SELECT patient_id, CAST(to_json(list(struct_pack({fields}) ORDER BY {order})) AS VARCHAR) AS {name} FROM {source} GROUP BY patient_id)"


_CHILDREN = {
    "diagnoses": ("diagnoses", "diagnosis_date", ["diagnosis_id", "stage"]),
    "treatments": ("episodes", "treatment_start_date", ["line_of_therapy", "regimen_category"]),
    "responses": ("responses", "assessment_date", ["assessment_id", "response_type"]),
    "biomarkers": ("biomarkers", "day", ["event_id"]),
    "trials": ("trials", "day", ["event_id"]),
}


@query(
    ", " + ", ".join(_child(f"{c}_json", *how) for c, how in _CHILDREN.items())
    + " SELECT p.patient_id, p.state, p.insurance_type, " + ", ".join(f"coalesce({c}_json, '[]') AS {c}" for c in _CHILDREN) + " FROM patients p "
    + " ".join(f"LEFT JOIN {c}_json ON {c}_json.patient_id = p.patient_id" for c in _CHILDREN)
)
def patient_detail_nested(t: Frames) -> DataFrame:
    """Patients with their five kinds of records, newest first, as JSON."""
    dealt = {c: t.by_patient(getattr(t, c)) for c in ("diagnoses", "biomarkers", "trials")}  # the others are already
    children = {c: (dealt.get(source, getattr(t, source)).select("patient_id", day, *columns), day) for c, (source, day, columns) in _CHILDREN.items()}
    shown = [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in _CHILDREN]
    return serve.patient_details(t.patients.select("patient_id", "state", "insurance_type"), **children).select("patient_id", "state", "insurance_type", *shown)


@query(
    """SELECT 'events' AS "table", count(*) AS records, count(DISTINCT user_id % 7) AS batches, count(DISTINCT ts::DATE) AS partitions, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day FROM events
       UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey % 5), count(DISTINCT o_orderdate::DATE), min(o_orderdate::DATE), max(o_orderdate::DATE) FROM orders""",
    prelude=False,
)
def ingest_summary(t: Frames) -> DataFrame:
    """Records, batches and days of two bronze tables."""
    events = t.table("events").select(F.concat(F.lit("b"), F.col("user_id") % 7).alias("_batch_id"), F.to_date("ts").alias("_ingestion_date"))
    orders = t.table("orders").select((F.col("o_custkey") % 5).cast("string").alias("_batch_id"), F.to_date("o_orderdate").alias("_partition_date"))
    return files.ingest_summary({"events": events, "orders": orders})


# loads


def _loads(t: Frames) -> tuple[DataFrame, DataFrame]:
    """The EHR's records, then those of claims, of which each has the ZIP of one person and the first name of the next."""
    people = _two_sources(t)
    name = F.element_at(F.array(F.lit("Robert"), F.lit("Rupert"), F.lit("Anna")), ((F.floor(F.col("source_patient_id").cast("long") / 2) + 1) % 3).cast("int") + 1)
    return people.where("source_system = 'EHR'"), people.where("source_system = 'CLAIMS'").withColumn("first_name", name)


_LOADS = f"""
    WITH RECURSIVE people AS (
        SELECT CASE WHEN c_custkey % 2 = 0 THEN 'EHR' ELSE 'CLAIMS' END AS source_system, CAST(c_custkey AS VARCHAR) AS source_patient_id, CAST(1 + c_custkey % 2 AS INTEGER) AS load,
               ['Robert', 'Rupert', 'Anna'][(CAST(floor(c_custkey / 2) AS BIGINT) + c_custkey % 2) % 3 + 1] AS first_name,
               'Name' || ['a', 'b', 'c', 'd', 'e', 'f', 'g'][CAST(floor(c_custkey / 6) AS BIGINT) % 7 + 1] AS last_name,
               DATE '2001-06-15' - CAST(floor(c_custkey / 4) AS INTEGER) AS date_of_birth,
               lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 90000 AS VARCHAR), 5, '0') AS zip5
        FROM customer
    ), keyed AS (
        SELECT *, sha256(source_system || '|' || source_patient_id) AS own, concat_ws('|', upper(last_name), date_of_birth, zip5) AS exact,
               concat_ws('|', left(upper(first_name), 1) || left(replace(substr({_SOUNDS}, 2), '0', '') || '000', 3), upper(last_name), date_of_birth) AS sound
        FROM people
    ), links AS (
        SELECT a.own AS a, b.own AS b, greatest(a.load, b.load) AS load FROM keyed a JOIN keyed b ON a.exact = b.exact
        UNION SELECT a.own, b.own, greatest(a.load, b.load) FROM keyed a JOIN keyed b ON a.sound = b.sound
    ), one AS (
        SELECT own AS a, own AS b FROM keyed WHERE load = 1
        UNION SELECT r.a, l.b FROM one r JOIN links l ON r.b = l.a WHERE l.load = 1
    ), two AS (
        SELECT own AS a, own AS b FROM keyed
        UNION SELECT r.a, l.b FROM two r JOIN links l ON r.b = l.a
    ), first_ids AS (SELECT a AS own, min(b) AS first_id FROM one GROUP BY a),
    ids AS (
        SELECT a AS own, coalesce(min(f.first_id), min(b)) AS patient_id FROM two LEFT JOIN first_ids f ON f.own = two.b GROUP BY a
    ), known AS (SELECT k.*, f.first_id, i.patient_id FROM keyed k JOIN ids i USING (own) LEFT JOIN first_ids f USING (own))
"""


def _linked(t: Frames) -> tuple[identity.Linked, identity.Linked]:
    one, two = _loads(t)
    first = identity.link(one, identity.no_keys(t.spark), identity.no_redirects(t.spark), 1)
    second = identity.link(two, lineage.cut_lineage(first.keys), first.redirects, 2)
    second.redirects = lineage.cut_lineage(second.redirects)
    return first, second


@query(_LOADS + "SELECT source_system, source_patient_id, load, first_id, patient_id FROM known", prelude=False)
def identity_two_loads(t: Frames) -> DataFrame:
    """Each record's person after the load that it came with, if that was the first, and after the second one."""
    first, second = _linked(t)
    records = first.records.withColumn("first_id", F.col("patient_id")).unionByName(second.records, allowMissingColumns=True)
    return identity.current_ids(records, second.redirects)


@query(
    _LOADS
    + """, golden1 AS (SELECT first_id AS patient_id, zip5 FROM known WHERE load = 1 QUALIFY row_number() OVER (PARTITION BY first_id ORDER BY source_patient_id) = 1),
    golden2 AS (SELECT patient_id, zip5 FROM known QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY source_system <> 'EHR', source_patient_id) = 1),
    ended AS (SELECT g.patient_id, g.zip5, n.zip5 IS DISTINCT FROM g.zip5 AS over FROM golden1 g LEFT JOIN golden2 n USING (patient_id))
    SELECT patient_id, zip5, DATE '2001-01-01' AS effective_date, CASE WHEN over THEN DATE '2001-06-15' ELSE DATE '9999-12-31' END AS end_date, NOT over AS is_current FROM ended
    UNION ALL SELECT n.patient_id, n.zip5, DATE '2001-06-15', DATE '9999-12-31', true FROM golden2 n LEFT JOIN golden1 g USING (patient_id) WHERE g.zip5 IS DISTINCT FROM n.zip5""",
    prelude=False,
)
def dim_patient_two_loads(t: Frames) -> DataFrame:
    """The type-2 dimension after both loads: one current version of each person, none of ids that have given way."""
    first, second = _linked(t)
    people = _loads(t)[0].unionByName(_loads(t)[1])
    source = ["source_system", "source_patient_id"]
    golden = lambda records: identity.golden_records(people.join(records.select(*source, "patient_id"), source)).select("patient_id", "zip5")
    end = F.lit("9999-12-31").cast("date")
    dim = golden(first.records).withColumns({"effective_date": F.lit("2001-01-01").cast("date"), "end_date": end, "is_current": F.lit(True)})
    gone = second.redirects.select(F.col("old_id").alias("patient_id"))
    now = identity.current_ids(first.records.unionByName(second.records), second.redirects)
    return scd2_diff(scd2_end(dim, gone, "patient_id", t.snapshot), golden(now), "patient_id", ["zip5"], t.snapshot)


@query("SELECT patient_id, line_of_therapy, treatment_start_date, treatment_end_date, regimen_name, regimen_category, claim_count FROM episodes")
def episodes_by_merge(t: Frames) -> DataFrame:
    """Episodes after two nights: the second one brings claims of 2000 and later, and rewrites the buckets of their
    patients only."""
    path = f"{lineage.shared_dir(t.spark)}/carepath/merge-{uuid.uuid4().hex}"
    columns = ["patient_id", "line_of_therapy", "treatment_start_date", "treatment_end_date", "regimen_name", "regimen_category", "claim_count"]
    late = F.col("service_date") >= "2000-01-01"
    with lineage.scratch(t.spark):
        night1 = lineage.written(silver.episodes(t.claims.where(~late)).select(*columns), "episodes")
        buckets.merge(night1, path, "patient_id", buckets=16)
        touched = lineage.written(t.claims.where(late).select("patient_id").distinct(), "touched")
        night2 = lineage.written(silver.episodes(t.claims.join(touched, "patient_id", "left_semi")).select(*columns), "episodes")
        buckets.merge(night2, path, "patient_id", touched)
    return buckets.read(t.spark, path)
