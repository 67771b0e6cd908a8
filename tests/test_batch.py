"""The batch from raw files to exported tables."""

import csv
import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from carepath.plans import batch, serve, star
from carepath.sources import buckets


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    if name.endswith(".csv"):
        with open(folder / name, "w", newline="") as f:
            out = csv.DictWriter(f, rows[0])
            out.writeheader()
            out.writerows(rows)
    else:
        (folder / name).write_text("\n".join(map(json.dumps, rows)))


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    people = [{"id": f"e{k}", "name": {"given": [g], "family": f}, "birthDate": f"195{k}-01-02", "gender": "male", "address": {"state": s, "postalCode": "10001"}} for k, (g, f, s) in enumerate([("Ann", "Lee", "NY"), ("Bob", "Ray", "TX"), ("Cy", "Fox", "NY")])]
    put(at / "ehr/patients", "a.json", people)
    put(at / "ehr/conditions", "a.csv", [{"subject_id": f"e{k}", "code": "C34.1", "morphology_code": "8041", "diagnosis_date": "2024-01-10", "stage": s} for k, s in enumerate(("extensive", "limited stage"))])
    put(at / "ehr/procedures", "a.csv", [{"subject_id": "e0", "code": "J9271", "procedure_date": "2024-01-20", "category": "x"}, {"subject_id": "e0", "code": "J9271", "procedure_date": "2024-06-01", "category": "x"}])
    put(at / "ehr/observations", "a.csv", [
        {"subject_id": "e0", "category": "imaging", "code": "r", "value": "PD", "value_numeric": "", "observation_date": "2024-03-01"},
        {"subject_id": "e1", "category": "biomarker", "code": "88360", "value": "positive", "value_numeric": "60", "observation_date": "2024-02-01"},
    ])
    put(at / "ehr/encounters", "a.json", [{"subject_id": "e1", "type": "research visit", "clinical_trial_id": "NCT1", "encounter_date": "2024-02-03"}])
    put(at / "claims/professional", "a.csv", [{"claim_id": "c1", "subscriber_id": "s9", "subscriber_first_name": "Anne", "subscriber_last_name": "Lee", "subscriber_dob": "1950-01-02", "subscriber_zip": "10001", "subscriber_state": "NY", "procedure_code": "J9023", "primary_diagnosis_code": "C34.9", "service_from_date": "2024-01-25", "facility_id": "f1", "facility_name": "F"}])
    return at


def stamps(root, table):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/silver/{table}/data/**/*.parquet", recursive=True)}


def content(spark, root, layer="silver", names=batch.CORE):
    hidden = {"_ingestion_timestamp"}
    out = {}
    for name in names:
        df = buckets.read(spark, f"{root}/{layer}/{name}")
        out[name] = sorted(map(str, df.select(*[c for c in sorted(df.columns) if c not in hidden]).collect()))
    return out


def test_batch_from_files_to_export(spark, raw, tmp_path):
    root = str(tmp_path)
    status = {r.table: (r.status, r.row_count, r.metrics) for r in batch.run(spark, str(raw), root, "b1", "2024-06-15", n_buckets=16, database="night").collect()}
    assert list(status) == batch.CORE + batch.ANALYTICS and all(s[0] == "success" for s in status.values())
    read = lambda t: spark.read.parquet(f"{root}/gold/{t}")
    k = serve.overview(read("agg_overview_metrics")).first()
    # the claims record of Ann Lee is the EHR's; Cy Fox has no diagnosis
    assert (k.total_patients, k.median_time_to_treatment, k.biomarker_testing_rate, k.immunotherapy_uptake_rate, k.clinical_trial_rate) == (2, 10.0, 50.0, 100.0, 50.0)
    assert status["dim_patient"][:2] == ("success", 3) and status["fact_treatment_episode"][:2] == ("success", 2)
    told = json.loads(status["fact_diagnosis"][2])
    assert told["rows"] == 3 and told["violated:odd_stage"] == 0 and told["values:stage"] == 3
    links, _ = serve.sankey(read("agg_sankey_journey"))
    assert {(r.source_node, r.target_node) for r in links.collect()} >= {("SCLC Diagnosis", "ES-SCLC"), ("ES-SCLC", "IO Monotherapy"), ("IO Monotherapy", "PD")}
    assert [(r.state, r.state_name) for r in serve.states(read("agg_geographic_metrics")).collect()] == [("NY", "New York"), ("TX", "Texas")]
    lines = [x for f in glob.glob(f"{root}/export/fact_diagnosis/*.csv.gz") for x in gzip.open(f, "rt").read().splitlines()]
    assert len([x for x in lines if "C34" in x]) == status["fact_diagnosis"][1] and not glob.glob(f"{root}/export/*.next")
    assert set(spark.catalog.listTables("night")[k].name for k in range(len(batch.CORE))) == set(batch.CORE)

    # a night with one new file: a claim of Ann Lee's by another card, and a person who joins nobody
    ids = {r.first_name: r.patient_id for r in buckets.read(spark, f"{root}/silver/dim_patient").collect()}
    pinned, before = batch.open_views(spark, root), {t: stamps(root, t) for t in batch.CORE}
    card = {"claim_id": "c2", "subscriber_id": "s10", "subscriber_first_name": "Ann", "subscriber_last_name": "LEE", "subscriber_dob": "1950-01-02", "subscriber_zip": "99999", "subscriber_state": "NV", "procedure_code": "J9035", "primary_diagnosis_code": "C34.8", "service_from_date": "2024-09-05", "facility_id": "f1", "facility_name": "New F"}
    put(raw / "claims/professional", "b.csv", [card, card | {"claim_id": "c3", "subscriber_id": "s11", "subscriber_last_name": "Oak"}])
    batch.run(spark, str(raw), root, "b2", "2024-10-15", n_buckets=16)
    after = buckets.read(spark, f"{root}/silver/dim_patient").where("is_current").collect()
    now = {r.first_name + r.last_name: r.patient_id for r in after}
    assert len(after) == 4 and {now["ANNLEE"], now["BOBRAY"], now["CYFOX"]} == set(ids.values())
    new = {now["ANNLEE"], now["ANNOAK"]}
    mine = {r[0] for r in spark.createDataFrame([(x,) for x in new], "patient_id string").select(buckets.bucket_of("patient_id", 16)).collect()}
    for table in ("dim_patient", "fact_diagnosis", "fact_treatment_episode"):
        m = buckets.manifest(spark, f"{root}/silver/{table}")
        assert {b for b, v in m.parts.items() if v == m.version} <= mine and {b for b, v in m.parts.items() if v < m.version}.isdisjoint(mine)
        kept = stamps(root, table)
        assert all(kept[f] == t for f, t in before[table].items() if f in kept) and all(int(f.split("bucket=")[1].split("/")[0]) in mine for f in kept if f not in before[table])
    assert [r.facility_name for r in buckets.read(spark, f"{root}/silver/dim_facility").collect()] == ["New F"]
    # the views: readers keep what they opened, and find the new rows when they open again
    assert pinned["patient_latest_status"].count() == 3 and spark.table("v_patient_latest_status").count() == 3
    opened = batch.open_views(spark, root)
    status = {r.patient_id: r for r in spark.table("v_patient_latest_status").collect()}
    assert len(status) == 4 and str(status[now["ANNLEE"]].latest_diagnosis_date) == "2024-09-05"
    assert {r.snapshot_date.isoformat() for r in opened["kpi_current"].collect()} == {"2024-10-15"} and pinned["kpi_current"].count()
    assert {r.snapshot_date.isoformat() for r in read("agg_overview_metrics").collect()} == {"2024-06-15", "2024-10-15"}
    # the same as if all had been computed anew, and nothing of the way is left
    one, two = content(spark, root), content(spark, root, "views", batch.VIEWS)
    batch.run(spark, str(raw), root, "b2", "2024-10-15", n_buckets=16, full=True)
    assert content(spark, root) == one and content(spark, root, "views", batch.VIEWS) == two
    assert spark.table("night.fact_diagnosis").count() == 3
    spark.sql("DROP DATABASE night CASCADE")


def test_detail_reads_one_bucket_of_each_table(spark):
    people = spark.range(50).selectExpr("string(id) AS patient_id", "'NY' AS state", "true AS is_current")
    facts = {table: people.selectExpr("patient_id", f"date'2024-01-01' AS {day}", f"'{child}' AS note") for child, (table, day) in star.CHILDREN.items()}
    facts["fact_diagnosis"] = facts["fact_diagnosis"].unionByName(facts["fact_diagnosis"].withColumn("diagnosis_date", F.lit("2025-01-01").cast("date")))
    star.publish(spark, {"dim_patient": people, **facts, "dim_facility": spark.range(3)}, "shop", buckets=8)
    one = star.patient(spark, "shop", "7")
    row = one.first()
    assert [len(row[c]) for c in star.CHILDREN] == [2, 1, 1, 1, 1] and str(row.diagnoses[0].diagnosis_date) == "2025-01-01"
    plan = one._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("SelectedBucketsCount: 1 out of 8") == 6 and "hashpartitioning" not in plan
    every = star.details(spark, "shop")
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString() and every.count() == 50
    with pytest.raises(serve.NotFound):
        star.patient(spark, "shop", "99")
    with pytest.raises(ValueError):
        star.patient(spark, "shop", "")
    assert star.create(spark, "shop", {"dim_patient": "patient_id string", "fact_new": "patient_id string, v int"}) == ["fact_new"]
    assert spark.table("shop.fact_new").columns == ["patient_id", "v"] and spark.table("shop.dim_patient").count() == 50
    spark.sql("DROP DATABASE shop CASCADE")
