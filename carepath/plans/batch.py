"""The nightly batch: ingest, identity, facts, snapshots, views and export, over written tables.

A night's work is that of the patients whom it touches. New rows (told by `_batch_id`) name them; their facts are
computed from all that is known of them, and the hash buckets that they fall in are rewritten. Every table is published whole or not at
all, when its rows have passed their checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, lineage
from ..operators.quality import Expectation
from ..operators.relational import ensure_columns, pick, scd2_end
from ..sources import buckets, sinks
from ..sources.files import FEEDS, read_bronze
from ..streaming.ingest import ingest
from . import gold, silver, star, views

# fixed values: the tables that are exported, by layer, and the views that are refreshed
CORE = ["dim_patient", "dim_facility", "fact_diagnosis", "fact_treatment_episode", "fact_response_assessment", "fact_biomarker_test", "fact_progression_event", "fact_trial_enrollment"]
ANALYTICS = ["agg_overview_metrics", "agg_time_to_treatment", "agg_treatment_patterns", "agg_geographic_metrics", "agg_sankey_journey"]
VIEWS = ["patient_latest_status", "treatment_timeline", "kpi_current"]


#: What each table's rows must keep to before a version is published: the name and, in SQL, what violates it.
CHECKS = {
    "dim_patient": {"no_patient": "patient_id IS NULL", "no_version": "is_current IS NULL OR effective_date IS NULL OR end_date IS NULL", "ends_early": "end_date < effective_date"},
    "dim_facility": {"no_facility": "facility_id IS NULL"},
    "fact_diagnosis": {"no_key": "diagnosis_id IS NULL OR patient_id IS NULL", "no_day": "diagnosis_date IS NULL", "odd_stage": "stage NOT IN ('LS-SCLC', 'ES-SCLC', 'Unknown')", "odd_code": "NOT startswith(icd10_code, 'C34')"},
    "fact_treatment_episode": {"no_key": "episode_id IS NULL OR patient_id IS NULL", "no_day": "treatment_start_date IS NULL", "ends_early": "duration_days < 0", "odd_line": "line_of_therapy < 1"},
    "fact_response_assessment": {"no_key": "assessment_id IS NULL OR patient_id IS NULL", "no_day": "assessment_date IS NULL", "odd_response": "response_type NOT IN ('CR', 'PR', 'SD', 'PD', 'NE')"},
    "fact_biomarker_test": {"no_key": "test_id IS NULL OR patient_id IS NULL", "no_type": "biomarker_type IS NULL"},
    "fact_progression_event": {"no_key": "progression_id IS NULL OR patient_id IS NULL", "no_day": "progression_date IS NULL", "odd_number": "progression_number < 1"},
    "fact_trial_enrollment": {"no_key": "enrollment_id IS NULL OR patient_id IS NULL", "no_day": "enrollment_date IS NULL"},
}
CATEGORIES = {
    "dim_patient": ["gender", "race_ethnicity", "state", "insurance_type"],
    "fact_diagnosis": ["stage", "icd10_code"],
    "fact_treatment_episode": ["regimen_category", "regimen_name"],
    "fact_response_assessment": ["response_type"],
    "fact_biomarker_test": ["biomarker_type"],
}


@dataclass
class Load:
    """One night: its tables' folder, day and number; whom it touches (None: all), and what was observed."""

    spark: SparkSession
    root: str
    today: object
    batch_id: str
    number: int
    buckets: int = buckets.BUCKETS
    changed: DataFrame | None = None
    metrics: dict[str, dict] = field(default_factory=dict)

    def keep(self, name: str, rows: DataFrame, key: str = "patient_id", changed: DataFrame | None = None, layer: str = "silver") -> DataFrame:
        """Publish the touched keys' rows; gives these rows, written."""
        rows = lineage.written(rows, name)
        checks = [Expectation(n, F.expr(sql)) for n, sql in CHECKS.get(name, {}).items()]
        m = buckets.merge(rows, f"{self.root}/{layer}/{name}", key, self.changed if changed is None else changed, self.buckets, checks, CATEGORIES.get(name, ()))
        self.metrics[name] = m.metrics
        return rows

    def read(self, name: str, layer: str = "silver") -> DataFrame:
        return buckets.read(self.spark, f"{self.root}/{layer}/{name}")


def bronze(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The bronze table of each feed; an empty one where nothing was ingested yet."""
    none = spark.createDataFrame([], "_ingestion_timestamp timestamp, _batch_id string")

    def read(name: str) -> DataFrame:
        at, fs = sinks.hadoop(spark, f"{root}/{name}")
        return read_bronze(spark, f"{root}/{name}") if fs.exists(at) else none

    return {name: read(name) for name in FEEDS}


def _claims(raw: dict[str, DataFrame]) -> DataFrame:
    return raw["claims_professional"].unionByName(raw["claims_institutional"], allowMissingColumns=True)


def people_of(raw: dict[str, DataFrame]) -> DataFrame:
    claims = _claims(raw).unionByName(raw["claims_pharmacy"], allowMissingColumns=True)
    return silver.ehr_patients(raw["ehr_patients"]).unionByName(silver.claims_patients(claims), allowMissingColumns=True)


def load_number(spark: SparkSession, root: str, batch_id: str) -> int:
    """The number of this batch: the one it had when it ran before, else the next."""
    at, fs = sinks.hadoop(spark, f"{root}/identity/records/load=*/batch_id=*")
    known = {}
    for status in fs.globStatus(at) or []:
        part = status.getPath()
        known[part.getName().split("=", 1)[1]] = int(part.getParent().getName().split("=")[1])
    return known.get(batch_id, max(known.values(), default=0) + 1)


def identify(load: Load, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link a load's people; gives who every source id belongs to by now, and the redirects that the load has made.
    Records and keys are added in partitions of the load, so running it again replaces them."""
    spark, root = load.spark, f"{load.root}/identity"

    def earlier(name: str, schema: str) -> DataFrame:
        at, fs = sinks.hadoop(spark, f"{root}/{name}")
        return spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("load") < load.number) if fs.exists(at) else spark.createDataFrame([], schema)

    keys = earlier("keys", identity.KEYS)
    redirects = sinks.read_version(spark, f"{root}/redirects")
    redirects = identity.no_redirects(spark) if redirects is None else redirects.where(F.col("load") < load.number)
    found = identity.link(people, keys, redirects, load.number)
    sinks.replace_snapshot(found.keys, f"{root}/keys", "load")
    records = found.records.withColumn("batch_id", F.lit(load.batch_id))
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "batch_id").parquet(f"{root}/records")
    made = lineage.written(found.redirects, "redirects")
    sinks.write_version(identity.add_redirects(redirects, made), f"{root}/redirects")
    sinks.drop_versions(spark, f"{root}/redirects", keep=2)
    schema = "source_system string, source_patient_id string, patient_id string, load int"
    at, fs = sinks.hadoop(spark, f"{root}/records")
    every = spark.read.schema(schema + ", batch_id string").parquet(f"{root}/records").where(F.col("load") <= load.number) if fs.exists(at) else spark.createDataFrame([], schema)
    xref = identity.current_ids(every.select("source_system", "source_patient_id", "patient_id"), sinks.read_version(spark, f"{root}/redirects")).distinct()
    return lineage.written(xref, "xref"), made


def touched(raw: dict[str, DataFrame], load: Load, xref: DataFrame, redirects: DataFrame) -> DataFrame:
    """The patients that new rows are about, and those whose id has given way or taken over."""
    ids = None
    for name, df in raw.items():
        system, own = ("EHR", pick(df, "subject_id", "patient_id", "id")) if name.startswith("ehr") else ("CLAIMS", pick(df, "subscriber_id", "patient_id"))
        new = df.where(F.col("_batch_id") == load.batch_id).select(F.lit(system).alias("source_system"), own.alias("source_patient_id")).where("source_patient_id is not null").distinct()
        ids = new if ids is None else ids.unionByName(new)
    known = ids.distinct().join(xref, ["source_system", "source_patient_id"]).select("patient_id")
    merged = redirects.select(F.explode(F.array("old_id", "patient_id")).alias("patient_id"))
    return lineage.written(known.unionByName(merged).distinct(), "touched")


def build_core(load: Load, raw: dict[str, DataFrame], full: bool = False) -> dict[str, DataFrame]:
    """People first, then the facts in the order in which they need each other, of the patients that the load touches
    (of all with `full`). Gives the touched patients' rows."""
    spark, batch = load.spark, F.col("_batch_id") == load.batch_id
    new = {name: df.where(batch) for name, df in raw.items()}
    xref, redirects = identify(load, people_of(new))
    load.changed = None if full else touched(raw, load, xref, redirects)
    mine = xref if full else xref.join(load.changed, "patient_id", "left_semi")
    keep = load.keep

    people = people_of(raw).join(mine, ["source_system", "source_patient_id"])
    current = load.read("dim_patient")
    if current is not None:
        current = current if full else current.join(load.changed, "patient_id", "left_semi")
        gone = sinks.read_version(spark, f"{load.root}/identity/redirects").withColumn("patient_id", F.col("old_id"))
        current = scd2_end(current, gone, "patient_id", load.today)
    out = {"dim_patient": keep("dim_patient", silver.dim_patient(current, identity.golden_records(people), load.today))}
    claims = _claims(raw if full else new)
    told = {"facility_id": ("facility_id", "billing_facility_id"), "facility_name": ("facility_name",), "facility_type": ("facility_type",), "state": ("facility_state",)}
    places = claims.select(*[pick(claims, *names).alias(c) for c, names in told.items()], pick(claims, "_ingestion_timestamp", kind="timestamp").alias("_ingestion_timestamp"))
    places = lineage.written(silver.dim_facility(places.where("facility_id is not null")), "places")
    out["dim_facility"] = keep("dim_facility", places, "facility_id", None if full else places)

    professional, institutional = raw["claims_professional"], raw["claims_institutional"]
    diagnosis = out["fact_diagnosis"] = keep("fact_diagnosis", silver.fact_diagnosis(raw["ehr_conditions"], _claims(raw), mine))
    episode = out["fact_treatment_episode"] = keep("fact_treatment_episode", silver.fact_treatment_episode(spark, raw["ehr_procedures"], professional, institutional, mine))
    seen = raw["ehr_observations"]
    response = out["fact_response_assessment"] = keep("fact_response_assessment", silver.fact_response_assessment(seen, episode, mine))
    out["fact_biomarker_test"] = keep("fact_biomarker_test", silver.fact_biomarker_test(spark, seen, mine))
    out["fact_progression_event"] = keep("fact_progression_event", silver.fact_progression_event(response, seen, diagnosis, episode, mine))
    out["fact_trial_enrollment"] = keep("fact_trial_enrollment", silver.fact_trial_enrollment(raw["ehr_encounters"], raw["ehr_procedures"], episode, mine))
    return out


def build_analytics(load: Load, core: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The snapshot's partition of each aggregate, over a cohort that is written once."""
    spark, snapshot = load.spark, load.today
    people = core["dim_patient"].where("is_current")
    diagnosis, episode, trial = core["fact_diagnosis"], core["fact_treatment_episode"], core["fact_trial_enrollment"]
    base = lineage.written(gold.patient_base(people.select("patient_id", "state"), diagnosis, episode, core["fact_biomarker_test"], trial, snapshot), "base")
    diagnosed = base.select("patient_id", "stage")
    made = {
        "agg_overview_metrics": gold.overview(base, snapshot),
        "agg_time_to_treatment": gold.ttt_distribution(base, snapshot),
        "agg_treatment_patterns": gold.treatment_patterns(episode, diagnosed, snapshot),
        "agg_geographic_metrics": gold.geographic(base, snapshot),
        "agg_sankey_journey": gold.sankey(gold.journeys(diagnosed, episode, core["fact_response_assessment"], trial), snapshot),
    }
    for name, df in made.items():
        sinks.replace_snapshot(df, f"{load.root}/gold/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{load.root}/gold/{name}") for name, df in made.items()}


def refresh_views(load: Load, fresh: dict[str, DataFrame], analytics: dict[str, DataFrame]) -> None:
    """The patients' views for those that the load touches, and the latest snapshot's KPIs. Views are read by
    `open_views`, which pins a version."""
    placed = {n: ensure_columns(fresh[n], {"facility_id": "string"}) for n in ("fact_diagnosis", "fact_treatment_episode")}
    people = fresh["dim_patient"].where("is_current").select("patient_id", "state", "insurance_type", "gender", "date_of_birth")
    facilities, dx, tx = load.read("dim_facility"), placed["fact_diagnosis"], placed["fact_treatment_episode"]
    status = views.patient_latest_status(people, dx, tx, facilities, fresh["fact_biomarker_test"], fresh["fact_trial_enrollment"])
    load.keep("patient_latest_status", status, layer="views")
    load.keep("treatment_timeline", views.treatment_timeline(people, dx, tx, facilities, fresh["fact_response_assessment"]), layer="views")
    kpi = lineage.written(views.kpi_current(analytics["agg_overview_metrics"]), "kpi")
    buckets.merge(kpi, f"{load.root}/views/kpi_current", "snapshot_date", buckets=1)


def open_views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The views as they are now, also under their names in SQL. A frame keeps its version while the next night's
    batch refreshes the view; the names lead to the new version when this is called again."""
    out = {name: buckets.read(spark, f"{root}/views/{name}") for name in VIEWS}
    for name, df in out.items():
        if df is not None:
            sinks.publish_view(df, f"v_{name}")
    return out


def run(
    spark: SparkSession, source: str, root: str, batch_id: str, snapshot: str, jdbc: dict[str, str] | None = None, n_buckets: int = buckets.BUCKETS, full: bool = False, database: str | None = None
) -> DataFrame:
    """Ingest what is new under `source`, bring the touched patients' facts and views up to date and the snapshot's aggregates
    under `root`, export both layers, and return the export's status rows with what was observed of the rows written.
    Running it again for the same batch and day changes nothing. `full` recomputes the facts of all patients, after a change of
    rules, say. With `database` the tables are also published to that catalog database, bucketed by patient."""
    for feed in FEEDS:
        ingest(spark, feed, source, f"{root}/bronze", f"{root}/checkpoints", batch_id)
    load = Load(spark, root, F.lit(snapshot).cast("date"), batch_id, load_number(spark, root, batch_id), n_buckets)
    with lineage.scratch(spark):
        fresh = build_core(load, bronze(spark, f"{root}/bronze"), full)
        core = {name: load.read(name) for name in CORE}
        analytics = build_analytics(load, core)
        refresh_views(load, fresh, analytics)
        tables = {name: core[name] for name in CORE} | {name: analytics[name] for name in ANALYTICS}
        status = sinks.export(spark, tables, f"{root}/export", jdbc)
        if database:
            star.publish(spark, core, database)
    for name in CORE:
        buckets.vacuum(spark, f"{root}/silver/{name}")
    for name in VIEWS:
        buckets.vacuum(spark, f"{root}/views/{name}")
    told = F.create_map(*[F.lit(x) for name, m in load.metrics.items() for x in (name, json.dumps(m))])
    return status.withColumn("metrics", F.try_element_at(told, F.col("table")))
