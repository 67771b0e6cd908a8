import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from carepath.sources import schema_log, seed, sinks
from carepath.sources.files import FEEDS, ingest_summary, read_bronze
from carepath.streaming.ingest import ingest, session_episodes


def test_ingest_is_exactly_once_and_takes_new_columns(spark, tmp_path):
    src = tmp_path / "raw/ehr/conditions"
    src.mkdir(parents=True)
    (src / "a.json").write_text(json.dumps({"subject_id": "1", "code": "C34.1"}) + "\n")
    (src / "b.csv").write_text("subject_id,code\n2,C34.2\n")
    (src / "ignored.txt").write_text("x")
    args = (f"{tmp_path}/raw", f"{tmp_path}/bronze", f"{tmp_path}/checkpoints")
    read = lambda: read_bronze(spark, f"{tmp_path}/bronze/ehr_conditions")
    for batch in ("b1", "b2"):
        ingest(spark, "ehr_conditions", *args, batch)
        assert read().count() == 2
    (src / "c.ndjson").write_text(json.dumps({"subject_id": "3", "code": "C34.3", "stage": "IV"}) + "\n")
    ingest(spark, "ehr_conditions", *args, "b3")
    rows = {x.subject_id: (x.code, x.stage, x._batch_id) for x in read().collect()}
    assert rows == {"1": ("C34.1", None, "b1"), "2": ("C34.2", None, "b1"), "3": ("C34.3", "IV", "b3")}
    assert {"_ingestion_timestamp", "_source_file", "_source_description", "_ingestion_date"} <= set(read().columns)


def test_claims_are_partitioned_by_service_date(spark, tmp_path):
    src = tmp_path / "raw/claims/pharmacy"
    src.mkdir(parents=True)
    (src / "a.csv").write_text("claim_id,fill_date\n1,2024-01-02\n2,nonsense\n3,\n")
    ingest(spark, FEEDS["claims_pharmacy"], f"{tmp_path}/raw", f"{tmp_path}/bronze", f"{tmp_path}/checkpoints", "b")
    df = read_bronze(spark, f"{tmp_path}/bronze/claims_pharmacy")
    days = {int(x.claim_id): x._partition_date for x in df.collect()}
    assert days[1] == date(2024, 1, 2) and days[2] == days[3] != days[1]
    assert ingest_summary({"claims_pharmacy": df}).first()[:3] == ("claims_pharmacy", 3, 1)


def test_session_windows_agree_with_the_gap(spark, tmp_path):
    rows = [(1, "2024-01-01"), (1, "2024-01-29"), (1, "2024-02-27"), (2, "2024-01-01")]
    df = spark.createDataFrame(rows, "patient_id int, d string").select("patient_id", F.col("d").cast("timestamp").alias("service_ts"), F.lit("chemo").alias("category"))
    df.write.parquet(f"{tmp_path}/claims")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/claims")
    q = session_episodes(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((x.patient_id, x.claim_count) for x in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_snapshots_replace_only_their_partition(spark, tmp_path):
    path = f"{tmp_path}/agg"
    a = spark.createDataFrame([("2024-01-01", 1), ("2024-02-01", 2)], "snapshot_date string, n int")
    sinks.replace_snapshot(a, path)
    for _ in range(2):
        sinks.replace_snapshot(spark.createDataFrame([("2024-02-01", 9)], "snapshot_date string, n int"), path)
    assert sorted(x.n for x in spark.read.parquet(path).collect()) == [1, 9]


def test_versions_and_upserts(spark, tmp_path):
    path = f"{tmp_path}/fact"
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert sinks.read_version(spark, path) is None
    assert sinks.upsert(df([(1, "a"), (2, "b")]), path, ["k"]) == 1
    assert sinks.upsert(df([(2, "B"), (3, "c")]), path, ["k"]) == 2
    assert sorted(tuple(x) for x in sinks.read_version(spark, path).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sinks.read_version(spark, path, 1).count() == 2
    assert sorted(tuple(x) for x in sinks.run_log(spark, path).collect()) == [(1, 2), (2, 3)]
    assert sinks.write_version(df([(1, "a")]), path, ["k"], 1) == 3


def test_export_reports_each_table(spark, tmp_path):
    good = spark.createDataFrame([(1, ["a"])], "k int, v array<string>")
    status = {x.table: (x.status, x.row_count) for x in sinks.export(spark, {"good": good, "empty": good.where("false")}, f"{tmp_path}/out").collect()}
    assert status == {"good": ("success", 1), "empty": ("skipped", 0)}
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out/good").first().v == '["a"]'
    with pytest.raises(sinks.ExportError, match="bad"):
        sinks.export(spark, {"bad": good.select(F.raise_error(F.lit("no")).alias("x")), "good": good}, f"{tmp_path}/out2")


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("patient_id"), F.col("id").alias("v"))
    for name in ("fact_a", "fact_b"):
        sinks.write_bucketed(df, name, "patient_id", 4)
        sinks.analyze(spark, name)
    joined = spark.table("fact_a").join(spark.table("fact_b").hint("merge"), "patient_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    sinks.publish_view(joined, "joined")
    assert spark.table("joined").count() == 2000
    for name in ("fact_a", "fact_b"):
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture(scope="module")
def tables(spark):
    return {name: df.cache() for name, df in seed.generate(spark, 4000).items()}


def ids(df, column="patient_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_seed_counts_and_keys(tables):
    people = ids(tables["patients"])
    assert len(set(people)) == 4000 and tables["facilities"].count() == 200
    assert ids(tables["diagnoses"]) == people == ids(tables["treatment_episodes"].where("line_of_therapy = 1"))
    known = set(ids(tables["facilities"], "facility_id"))
    assert set(ids(tables["diagnoses"], "diagnosing_facility_id")) <= known
    for name, key in (("diagnoses", "diagnosis_id"), ("biomarker_tests", "test_id"), ("treatment_episodes", "episode_id"), ("response_assessments", "assessment_id"), ("progression_events", "progression_id"), ("trial_enrollments", "enrollment_id")):
        assert len(set(ids(tables[name], key))) == tables[name].count() > 0
    assert set(ids(tables["response_assessments"], "episode_id")) == set(ids(tables["treatment_episodes"], "episode_id"))
    assert set(ids(tables["trial_enrollments"])) == set(ids(tables["treatment_episodes"].where("regimen_name = 'Clinical Trial'")))


@pytest.mark.parametrize(
    "table, column, weights, where",
    [
        ("patients", "state", seed.STATES, "true"), ("patients", "insurance_type", seed.INSURANCE, "true"), ("patients", "race_ethnicity", seed.RACE, "true"), ("diagnoses", "stage", seed.STAGE, "true"),
        ("diagnoses", "ecog_status", seed.ECOG, "true"), ("diagnoses", "smoking_status", seed.SMOKING, "true"), ("treatment_episodes", "regimen_name", seed.SECOND, "line_of_therapy = 2"),
    ],
)
def test_seed_weights_hold(tables, table, column, weights, where):
    got = {r[0]: r[1] for r in tables[table].where(where).groupBy(column).count().collect()}
    n, total = sum(got.values()), sum(weights.values())
    assert set(got) <= set(weights)
    squares = sum((got.get(k, 0) - n * w / total) ** 2 / (n * w / total) for k, w in weights.items())
    free = len(weights) - 1
    assert squares < free + 4 * (2 * free) ** 0.5 + 4  # chi-square, far above its 0.999 quantile


def test_seed_follows_the_stage(spark, tables):
    first = tables["treatment_episodes"].where("line_of_therapy = 1").join(tables["diagnoses"], "patient_id")
    got = {(r.stage, r.regimen_name): r["count"] for r in first.groupBy("stage", "regimen_name").count().collect()}
    assert {k for s, k in got if s == "LS-SCLC"} == set(seed.LIMITED) and {k for s, k in got if s == "ES-SCLC"} == set(seed.EXTENSIVE)
    share = tables["progression_events"].join(tables["diagnoses"], "patient_id").groupBy("stage").count().collect()
    staged = {r.stage: r["count"] for r in tables["diagnoses"].groupBy("stage").count().collect()}
    assert all(abs(r["count"] / staged[r.stage] - seed.PROGRESSES[r.stage]) < 0.05 for r in share)
    ages = tables["patients"].selectExpr("2026 - year(date_of_birth) AS age").agg(F.min("age"), F.max("age"), F.median("age")).first()
    assert 45 <= ages[0] and ages[1] <= 86 and 68 <= ages[2] <= 72


def test_seed_is_the_same_at_any_partitioning_and_is_json(spark, tmp_path):
    one, two = seed.generate(spark, 60, partitions=1), seed.generate(spark, 60, partitions=7)
    for name in one:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect())), name
    doc = json.loads(seed.to_json(one))
    assert len(doc["patients"]) == 60 and doc["diagnoses"][0]["diagnosis_date"][:3] == "202"
    seed.write_json(one, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/patients").count() == 60
    with pytest.raises(ValueError, match="write_json"):
        seed.to_json(one, most=5)
    assert sorted(map(str, seed.generate(spark, 60, seed=7)["patients"].collect())) != sorted(map(str, one["patients"].collect()))


def test_types_widen_and_nothing_is_lost(spark):
    kind = lambda s: spark.createDataFrame([], f"x {s}").schema[0].dataType
    wide = lambda a, b: schema_log.widen(kind(a), kind(b)).simpleString()
    assert [wide(*p) for p in (("int", "bigint"), ("bigint", "double"), ("double", "string"), ("date", "timestamp"), ("boolean", "int"), ("struct<a:int>", "string"))] == ["bigint", "double", "string", "timestamp", "string", "string"]
    assert wide("struct<a:int,b:array<int>>", "struct<b:array<double>,C:string,A:bigint>") == "struct<a:bigint,b:array<double>,C:string>"
    old = spark.createDataFrame([(1, (2, [3])), (None, None)], "k int, s struct<a:int,b:array<int>>")
    new = schema_log.merge(old.schema, spark.createDataFrame([], "k string, s struct<a:double,c:string>, more date").schema)
    rows = schema_log.conform(old, new).collect()
    assert (rows[0].k, rows[0].s.a, rows[0].s.b, rows[0].s.c, rows[0].more) == ("1", 2.0, [3], None, None) and rows[1].s is None


def test_drops_with_added_widened_and_broken_columns(spark, tmp_path):
    src = tmp_path / "raw/ehr/observations"
    src.mkdir(parents=True)
    args = (f"{tmp_path}/raw", f"{tmp_path}/bronze", f"{tmp_path}/checkpoints")
    drops = [
        [{"subject_id": "1", "value": 3, "code": {"id": 1}}],
        [{"subject_id": "2", "value": 2.5, "unit": "mg", "code": {"id": 2, "name": "n"}}],
        [{"subject_id": "3", "value": "high", "code": {"id": "x"}}, {"subject_id": "4", "value": None, "unit": ["a"]}],
    ]
    for k, rows in enumerate(drops):
        (src / f"d{k}.json").write_text("\n".join(map(json.dumps, rows)) + ("\n{broken\n" if k == 2 else ""))
        os.utime(src / f"d{k}.json", (1000 + k, 1000 + k))
        ingest(spark, "ehr_observations", *args, f"b{k}")
    ingest(spark, "ehr_observations", *args, "again")
    df = read_bronze(spark, f"{tmp_path}/bronze/ehr_observations")
    kinds = dict(df.dtypes)
    assert (kinds["value"], kinds["unit"], kinds["code"]) == ("string", "string", "struct<id:string,name:string>")
    got = {r.subject_id: (r.value, r.unit, r.code and r.code.id, r._batch_id) for r in df.where("subject_id is not null").collect()}
    assert got == {"1": ("3", None, "1", "b0"), "2": ("2.5", "mg", "2", "b1"), "3": ("high", None, "x", "b2"), "4": (None, '["a"]', None, "b2")}
    assert [r._rescued for r in df.where("_rescued is not null").collect()] == ["{broken"] and df.count() == 5
    assert len(schema_log.SchemaLog(spark, f"{tmp_path}/bronze/ehr_observations/_schemas/json").versions()) == 3
    assert "mergeSchema" not in df._jdf.queryExecution().toString()


def test_csv_columns_keep_their_places(spark, tmp_path):
    src = tmp_path / "raw/ehr/conditions"
    src.mkdir(parents=True)
    args = (f"{tmp_path}/raw", f"{tmp_path}/bronze", f"{tmp_path}/checkpoints")
    for k, text in enumerate(("subject_id,code\n1,a\n", "subject_id,code,stage\n2,b,IV\n", "subject_id\n3\n")):
        (src / f"{k}.csv").write_text(text)
        os.utime(src / f"{k}.csv", (1000 + k, 1000 + k))
        ingest(spark, "ehr_conditions", *args, f"b{k}")
    rows = {r.subject_id: (r.code, r.stage) for r in read_bronze(spark, f"{tmp_path}/bronze/ehr_conditions").collect()}
    assert rows == {"1": ("a", None), "2": ("b", "IV"), "3": (None, None)}
    (src / "bad.csv").write_text("code,subject_id\nx,4\n")
    with pytest.raises(ValueError, match="bad.csv"):
        ingest(spark, "ehr_conditions", *args, "b9")
