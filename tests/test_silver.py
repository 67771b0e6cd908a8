from datetime import date

import pytest
from pyspark.sql import functions as F

from carepath.plans import gold, serve, silver

D = date.fromisoformat
def today():
    return F.lit("2024-12-31").cast("date")


@pytest.fixture(scope="module")
def xref(spark):
    rows = [("EHR", "e1", "p1"), ("CLAIMS", "c1", "p1"), ("EHR", "e2", "p2")]
    return spark.createDataFrame(rows, "source_system string, source_patient_id string, patient_id string")


def test_names_as_struct_or_string(spark):
    struct = spark.createDataFrame([("1", (["Ann"], "Lee"), "1950-02-03", "f", ("10001-22", "NY"))], "id string, name struct<given:array<string>,family:string>, birthDate string, gender string, address struct<postalCode:string,state:string>")
    flat = spark.createDataFrame([("1", "Ann Lee", "bad", "NY")], "id string, name string, birthDate string, address string")
    a, b = silver.ehr_patients(struct).first(), silver.ehr_patients(flat).first()
    assert (a.first_name, a.last_name, a.date_of_birth, a.zip5, a.state) == ("ANN", "LEE", D("1950-02-03"), "10001", "NY")
    assert (b.first_name, b.last_name, b.date_of_birth, b.zip5, b.state) == ("ANN", "LEE", None, None, "NY")


def test_claims_patients_keep_the_newest(spark):
    df = spark.createDataFrame([("s", "old", "2024-01-01", "a"), ("s", "new", "2024-01-02", "b"), (None, "x", "2024-01-02", "c")], "subscriber_id string, subscriber_last_name string, _ingestion_timestamp string, claim_id string")
    assert [x.last_name for x in silver.claims_patients(df.withColumn("_ingestion_timestamp", F.col("_ingestion_timestamp").cast("timestamp"))).collect()] == ["NEW"]


def test_dim_patient_first_and_second_load(spark):
    cols = "patient_id string, source_patient_id string, source_system string, first_name string, last_name string, date_of_birth date, gender string, race_ethnicity string, state string, zip5 string, insurance_type string"
    one = spark.createDataFrame([("p", "1", "EHR", "A", "B", D("1950-01-01"), "m", "white", "ny", "10001", "medicare")], cols)
    first = silver.dim_patient(None, one, today())
    moved = silver.dim_patient(first, one.withColumn("state", F.lit("TX")), F.lit("2025-01-01").cast("date"))
    assert first.first().gender == "Male" and first.first()._dq_valid
    assert sorted((x.state, x.is_current) for x in moved.collect()) == [("NY", False), ("TX", True)]


def test_diagnoses(spark, xref):
    cond = spark.createDataFrame(
        [("e1", "C34.1", "8041", "2024-01-01T00:00:00Z", "IV"), ("e1", "C34.9", "8070", "2024-02-01", "I"), ("e2", "C50.1", None, "2024-01-01", "I"), ("e2", "C34.2", None, "2024-03-01", None), ("zz", "C34.1", "8041", "2024-01-01", "I")],
        "subject_id string, code string, morphology_code string, onsetDateTime string, stage string",
    )
    claims = spark.createDataFrame([("c1", "I10", "C34.3", "2024-01-01"), ("c1", "I10", "C34.3", "2024-05-01"), ("c1", "C34.1", None, "n/a")], "subscriber_id string, primary_diagnosis_code string, secondary_diagnosis_code_1 string, service_from_date string")
    got = sorted((x.patient_id, x.diagnosis_date.isoformat(), x.icd10_code, x.stage, x.is_confirmed_sclc, x.source_system) for x in silver.fact_diagnosis(cond, claims, xref).collect())
    assert got == [
        ("p1", "2024-01-01", "C34.1", "ES-SCLC", True, "EHR"),
        ("p1", "2024-05-01", "C34.3", "Unknown", None, "CLAIMS"),
        ("p2", "2024-03-01", "C34.2", "Unknown", None, "EHR"),
    ]


@pytest.fixture(scope="module")
def tx(spark, xref):
    proc = spark.createDataFrame([("e1", "J9060", "2024-01-01"), ("e1", "J9271", "2024-01-29"), ("e1", "J9228", "2024-02-27"), ("e2", "77385", "2024-01-05"), ("e2", "XX", "2024-01-06"), ("e2", "J9060", None)], "subject_id string, code string, performedDateTime string")
    prof = spark.createDataFrame([("c1", "J9060", "2024-01-01")], "subscriber_id string, procedure_code string, service_from_date string")
    inst = spark.createDataFrame([("c1", "J9305", "2024-06-01")], "subscriber_id string, procedure_code string, admission_date string")
    return silver.fact_treatment_episode(spark, proc, prof, inst, xref)


def test_episodes(tx):
    got = sorted((x.patient_id, x.line_of_therapy, x.treatment_start_date.isoformat(), x.regimen_category, x.regimen_name, x.claim_count) for x in tx.collect())
    assert got == [
        ("p1", 1, "2024-01-01", "Chemo+IO", "Cisplatin + Pembrolizumab", 3),
        ("p1", 2, "2024-02-27", "IO Monotherapy", "Ipilimumab", 1),
        ("p1", 3, "2024-06-01", "Targeted Therapy", "Temozolomide", 1),
        ("p2", 1, "2024-01-05", "Radiation", "Radiation", 1),
    ]


def test_responses_progressions_trials(spark, xref, tx):
    obs = spark.createDataFrame(
        [("e1", "imaging", "2024-01-10", "Partial response"), ("e1", "imaging", "2024-01-10", "CR"), ("e1", "RECIST", "2024-03-01", "PD"), ("e1", "imaging", "2023-12-01", "SD"), ("e1", "vitals", "2024-03-02", "CR"), ("e2", "response", None, "CR")],
        "subject_id string, category string, observation_date string, value string",
    )
    ra = silver.fact_response_assessment(obs, tx, xref)
    got = sorted((x.assessment_date.isoformat(), x.response_type, x.treatment_start_date and x.treatment_start_date.isoformat()) for x in ra.collect())
    assert got == [("2023-12-01", "SD", None), ("2024-01-10", "CR", "2024-01-01"), ("2024-03-01", "PD", "2024-02-27")]
    notes = spark.createDataFrame([("e1", "disease recurrence", "2024-03-31"), ("e1", "relapse", "2024-05-01"), ("e1", "fine", "2024-09-01")], "subject_id string, value_text string, observation_date string")
    dx = spark.createDataFrame([("p1", D("2023-12-31"))], "patient_id string, diagnosis_date date")
    pe = sorted((x.progression_date.isoformat(), x.progression_number, x.pfs_days_from_diagnosis, x.pfs_days_from_treatment) for x in silver.fact_progression_event(ra, notes, dx, tx, xref).collect())
    assert pe == [("2024-03-01", 1, 61, 3), ("2024-05-01", 2, 122, 64)]
    enc = spark.createDataFrame([("e1", "research", "NCT1", "2024-01-31", None), ("e1", "visit", "NCT1", "2024-02-02", "Active"), ("e1", "study", None, "2024-04-30", None), ("e2", "visit", None, "2024-01-01", None)], "subject_id string, type string, clinical_trial_id string, period_start string, trial_status string")
    none = spark.createDataFrame([("e2", "0074T", "x", "2024-01-01"), ("e2", "99199", "x", "2024-02-04")], "subject_id string, code string, category string, performedDateTime string")
    for legacy, day in ((False, "2024-01-01"), (True, "2024-02-04")):  # the legacy rule misses the T codes
        te = sorted((x.patient_id, x.trial_identifier or "", x.enrollment_date.isoformat(), x.trial_status, x.treatment_start_date and x.treatment_start_date.isoformat()) for x in silver.fact_trial_enrollment(enc, none, tx, xref, legacy).collect())
        assert te == [("p1", "", "2024-04-30", "enrolled", None), ("p1", "NCT1", "2024-01-31", "enrolled", "2024-02-27"), ("p2", "", day, "enrolled", "2024-01-05")]


def test_biomarkers(spark, xref):
    obs = spark.createDataFrame([("e1", "88360", "lab", 0.9, None), ("e1", "81479", None, 12.0, None), ("e1", "zz", "NGS panel", None, "pathogenic"), ("e1", "zz", "vitals", 1.0, None)], "subject_id string, code string, category string, value_numeric double, interpretation string")
    got = sorted((x.biomarker_type, x.result_positive) for x in silver.fact_biomarker_test(spark, obs, xref).collect())
    assert got == [("NGS", True), ("PD-L1", False), ("TMB", True)]


def test_dims(spark):
    days = silver.dim_date(spark.sql("SELECT date'2024-02-28' AS first_day, date'2024-03-02' AS last_day"), fiscal_start_month=10).collect()
    assert [d.date_key for d in days] == [20240228, 20240229, 20240301, 20240302]
    assert [(d.is_month_end, d.is_weekend, d.fiscal_quarter) for d in days] == [(False, False, 2), (True, False, 2), (False, False, 2), (False, True, 2)]
    f = spark.createDataFrame([("f", "texas"), ("f", "texas")], "facility_id string, state string")
    assert [tuple(x) for x in silver.dim_facility(f).collect()] == [("f", None, None, "TX", None)]


def test_journey_order_of_next_steps(spark):
    dx = spark.createDataFrame([("a", "LS-SCLC"), ("b", "ES-SCLC"), ("c", "Unknown"), ("d", "LS-SCLC")], "patient_id string, stage string")
    ep = spark.createDataFrame([("a", 1, "Chemo Only", "a1"), ("a", 2, "Chemo Only", "a2"), ("b", 1, "Chemo+IO", "b1"), ("d", 1, "Radiation", "d1")], "patient_id string, line_of_therapy int, regimen_category string, episode_id string")
    ra = spark.createDataFrame([("a", "a1", "CR"), ("b", "b1", "PD")], "patient_id string, episode_id string, response_type string")
    tr = spark.createDataFrame([("a",)], "patient_id string")
    got = {x.patient_id: (x.treatment, x.response, x.next_step) for x in gold.journeys(dx, ep, ra, tr).collect()}
    assert got == {"a": ("Chemo Only", "CR", "Clinical Trial"), "b": ("Chemo+IO", "PD", "No Further Treatment"), "c": ("No Treatment", "Not Assessed", "No Further Treatment"), "d": ("Radiation", "Not Assessed", "No Further Treatment")}
    edges = gold.sankey(gold.journeys(dx, ep, ra, tr), F.lit(None).cast("date"))
    n = {(x.source_node, x.target_node): x.patient_count for x in edges.where("stage_filter is null").collect()}
    assert n["SCLC Diagnosis", "Unknown"] == 1 and n["Unknown", "No Treatment"] == 1 and ("No Treatment", "Not Assessed") not in n and ("Not Assessed", "No Further Treatment") not in n


def test_serving(spark):
    cols = "snapshot_date date, stage_filter string, state_filter string, total_patients long, new_diagnoses_mtd long, new_diagnoses_qtd long, new_diagnoses_ytd long, median_time_to_treatment double, biomarker_testing_rate double, immunotherapy_uptake_rate double, clinical_trial_rate double"
    agg = spark.createDataFrame([(D("2024-01-01"), None, None, 9, 1, 1, 1, 0.0, 1.0, 1.0, 1.0), (D("2024-02-01"), None, None, 7, 1, 1, 1, 0.0, 1.0, 1.0, 1.0)], cols)
    assert serve.overview(agg).first().total_patients == 7 and serve.overview(agg).first().median_time_to_treatment == 0.0
    assert serve.overview(agg, stage="LS-SCLC").first().total_patients == 0
    people = spark.createDataFrame([("p1", "NY")], "patient_id string, state string")
    kids = spark.createDataFrame([("p1", D("2024-01-01"), "a"), ("p1", D("2024-02-01"), "b")], "patient_id string, day date, v string")
    details = serve.patient_details(people, tests=(kids, "day"), none=(kids.where("false"), "day"))
    row = serve.get_patient(details, "p1").first()
    assert [x.v for x in row.tests] == ["b", "a"] and row.none == []
    with pytest.raises(serve.NotFound):
        serve.get_patient(details, "p9")
    with pytest.raises(ValueError):
        serve.get_patient(details, None)
    with pytest.raises(ValueError):
        serve.list_patients(people, sort_by="drop table")
    assert serve.list_patients(people, sort_by="created_at")[0].count() == 1
    old, new = D("2024-01-01"), D("2024-02-01")
    edges = spark.createDataFrame([(old, None, "a", "b", 9, "x", "y"), (new, None, "a", "b", 1, "x", "y"), (new, None, "b", "c", 2, "y", "z"), (new, "LS-SCLC", "a", "c", 5, "x", "z")], "snapshot_date date, stage_filter string, source_node string, target_node string, patient_count long, source_category string, target_category string")
    links, nodes = serve.sankey(edges)
    assert [(r.source_node, r.patient_count) for r in links.collect()] == [("b", 2), ("a", 1)]
    assert sorted(map(tuple, nodes.collect())) == [("a", "x"), ("b", "y"), ("c", "z")]
    geo = spark.createDataFrame([(old, "NY", 9, 1.0), (new, "NY", 3, 50.0), (new, "TX", 4, 60.0)], "snapshot_date date, state string, patient_count long, biomarker_rate double")
    assert [r.state for r in serve.states(geo).collect()] == ["TX", "NY"] and serve.states(geo, "biomarker_rate", top=1).first().bar_share == 100.0
    with pytest.raises(ValueError):
        serve.states(geo, "state")


def test_insights(spark):
    kpi = spark.createDataFrame([(59.9, 80.0, 7.9)], "immunotherapy_uptake_rate double, biomarker_testing_rate double, clinical_trial_rate double")
    ttt = spark.createDataFrame([("0-7", 90.0, 75.0), ("31+", 10.0, 75.0)], "bucket_label string, percentage double, within_target_pct double")
    pat = spark.createDataFrame([(1, "Chemo Only", 25.0), (1, "Chemo+IO", 60.0), (2, "Radiation", 100.0)], "line_of_therapy int, regimen_category string, percentage double")
    geo = spark.createDataFrame([("NY", 10.0), ("TX", 15.1)], "state string, avg_time_to_treatment double")
    got = {x.rule: x.insight_type for x in serve.insights(kpi, ttt, pat, geo).collect()}
    assert got == {"treatment_timeliness": "positive", "late_treatment": "action", "immunotherapy_uptake_rate": "caution", "biomarker_testing_rate": "positive", "clinical_trial_rate": "action", "chemo_io_share": "info", "top_second_line": "info", "state_gap": "caution"}


def test_cohort_rules(spark):
    """Unknown stages count in totals only; treatment before diagnosis is none; the snapshot day counts; a median of 0 stays 0."""
    people = spark.createDataFrame([("a", "NY"), ("b", None), ("c", "NY"), ("late", "NY")], "patient_id string, state string")
    dx = spark.createDataFrame(
        [("1", "a", D("2024-06-15"), "Unknown"), ("2", "a", D("2024-07-01"), "ES-SCLC"), ("3", "b", D("2024-04-01"), "LS-SCLC"), ("4", "c", D("2024-01-01"), "Unknown"), ("5", "late", D("2024-06-16"), "LS-SCLC")],
        "diagnosis_id string, patient_id string, diagnosis_date date, stage string",
    )
    ep = spark.createDataFrame([("a", D("2024-06-15"), True), ("b", D("2024-03-31"), True), ("b", D("2024-04-09"), False), ("c", D("2023-12-31"), False)], "patient_id string, treatment_start_date date, has_io boolean")
    none = spark.createDataFrame([], "patient_id string")
    snap = F.lit("2024-06-15").cast("date")
    base = gold.patient_base(people, dx, ep, spark.createDataFrame([("a",), ("a",)], "patient_id string"), none, snap)
    assert {r.patient_id: (r.stage, r.ttt_days) for r in base.collect()} == {"a": ("ES-SCLC", 0), "b": ("LS-SCLC", 8), "c": ("Unknown", None)}
    cube = {(r.stage_filter, r.state_filter): r for r in gold.overview(base, snap).collect()}
    assert set(cube) == {(None, None), ("ES-SCLC", None), ("LS-SCLC", None), (None, "NY"), ("ES-SCLC", "NY")}
    r = cube[None, None]
    assert (r.total_patients, r.new_diagnoses_mtd, r.new_diagnoses_qtd, r.new_diagnoses_ytd) == (3, 1, 2, 3)
    assert (r.biomarker_testing_rate, r.immunotherapy_uptake_rate, r.clinical_trial_rate) == (33.33, 100.0, 0.0)
    assert cube["ES-SCLC", None].median_time_to_treatment == 0.0 and cube["LS-SCLC", None].immunotherapy_uptake_rate == 0.0
    buckets = {r.bucket_label: r.patient_count for r in gold.ttt_distribution(base, snap, zero_filled=True).where("stage_filter is null and state_filter is null").collect()}
    assert buckets == {"0-7": 1, "8-14": 1, "15-21": 0, "22-30": 0, "31+": 0}
    r = gold.geographic(base, snap).collect()
    assert [(x.snapshot_date, x.state, x.state_name, x.biomarker_rate) for x in r] == [(D("2024-06-15"), "NY", "New York", 50.0)]
    assert (cube[None, None].biomarker_tested_count, cube[None, None].es_sclc_patient_count, cube[None, None].es_sclc_io_count, cube[None, None].trial_enrolled_count) == (1, 1, 1, 0)


def test_names_and_addresses_as_arrays(spark):
    """As FHIR has them: the first counts, an empty array is none."""
    raw = spark.createDataFrame([("1", [(["Ann", "B"], "Lee"), (["Old"], "Name")], [("10001-22", "NY")]), ("2", [], [])], "id string, name array<struct<given:array<string>,family:string>>, address array<struct<postalCode:string,state:string>>")
    a, b = silver.ehr_patients(raw).orderBy("source_patient_id").collect()
    assert (a.first_name, a.last_name, a.zip5, a.state) == ("ANN", "LEE", "10001", "NY") and (b.first_name, b.last_name, b.zip5, b.state) == (None, None, None, None)


def test_the_newest_record_of_a_facility(spark):
    df = spark.createDataFrame([("f", "old", "NY", "2024-01-01"), ("f", "new", "texas", "2024-02-01"), ("g", None, None, None)], "facility_id string, facility_name string, state string, t string")
    got = silver.dim_facility(df.withColumn("_ingestion_timestamp", F.col("t").cast("timestamp"))).collect()
    assert sorted((r.facility_id, r.facility_name, r.state) for r in got) == [("f", "new", "TX"), ("g", None, None)]
