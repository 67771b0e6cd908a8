"""Facts and dimensions from bronze frames. Every function maps DataFrames to a DataFrame, lazily.

`xref` is (source_system, source_patient_id, patient_id); `today` is always a parameter. Raw frames may lack
columns: alternatives are picked by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, exprs
from ..operators.quality import flag_patients
from ..operators.relational import asof_join, code_table, dealt, ensure_columns, gap_dedup, latest_per_key, nearest_join, pick, scd2_diff, sessionize

GAP_DAYS, PROGRESSION_DAYS, TRIAL_DAYS = 28, 30, 30

# fixed values: the names that a field of a raw record may have, the first that is filled counts
FIELDS = {
    "subject": ("subject_id", "patient_id", "subscriber_id"),
    "code": ("code", "procedure_code"),
    "test_code": ("code", "observation_code"),
    "category": ("category",),
    "observed": ("effectiveDateTime", "observation_date"),
    "performed": ("performedDateTime", "procedure_date"),
    "met": ("period_start", "encounter_date"),
    "number": ("valueQuantity_value", "value_numeric"),
    "text": ("valueString", "value", "value_text"),
    "unit": ("valueQuantity_unit", "unit"),
    "interpretation": ("interpretation", "result_interpretation"),
    "trial": ("clinical_trial_id", "study_id", "protocol_number"),
    "trial_name": ("trial_name", "study_name"),
    "trial_phase": ("trial_phase", "study_phase"),
    "trial_status": ("trial_status", "enrollment_status"),
    "type": ("type", "encounter_type"),
    "service": ("serviceType", "service_type"),
}
# fixed values: what tells records of interest, held against lower-cased text (codes against upper-cased)
PATTERNS = {
    "lung": "^C34\\.",
    "response_category": "imaging|assessment|response|recist",
    "response_code": "recist|response|tumor.*assessment",
    "biomarker_category": "pd-l1|pdl1|tmb|ngs|biomarker|genomic",
    "progression": "progression|progressive|progressed|recurrence|relapse",
    "trial_type": "research|trial|study|investigational|protocol",
    "trial_service": "clinical.?trial|research",
    "trial_category": "research|trial|investigational",
    "trial_code": "0074T|0075T|99199",
}
# fixed values: the kind of a biomarker test without a known code, by its category; the first that fits counts
TEST_KINDS = {"pd-?l1": "PD-L1", "tmb": "TMB", "ngs|genomic": "NGS"}

TRACKED = ["gender", "race_ethnicity", "state", "zip5", "urban_rural", "insurance_type"]


def _date(df: DataFrame, *names: str) -> Column:
    return F.try_to_date(F.substring(pick(df, *names), 1, 10))


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return pick(df, *FIELDS[name], kind=kind)


def _says(text: Column, pattern: str) -> Column:
    """Whether text fits a pattern; null does not."""
    return F.coalesce(text.rlike(PATTERNS[pattern]), F.lit(False))


def _of_ehr(df: DataFrame, **columns: Column) -> DataFrame:
    """Raw records of the EHR with their subject and the given columns."""
    return df.select(F.lit("EHR").alias("source_system"), _ids(df).alias("source_patient_id"), *[c.alias(n) for n, c in columns.items()])


def _ids(df: DataFrame) -> Column:
    return _field(df, "subject")


def _linked(df: DataFrame, xref: DataFrame) -> DataFrame:
    return df.join(xref, ["source_system", "source_patient_id"])


# patients


def ehr_patients(raw: DataFrame) -> DataFrame:
    """FHIR (struct, or an array of them, of which the first counts) or flat (string) names and addresses, by the frame's
    schema."""
    for c, t in raw.dtypes:
        if c in ("name", "address") and t.startswith("array<struct"):
            raw = raw.withColumn(c, F.get(F.col(c), 0))
    kinds = dict(raw.dtypes)
    struct = lambda c: kinds.get(c, "").startswith("struct")
    first = F.get(F.col("name.given"), 0) if struct("name") else F.split_part(pick(raw, "name"), F.lit(" "), F.lit(1))
    last = F.col("name.family") if struct("name") else F.element_at(F.split(pick(raw, "name"), " "), -1)
    zip_code, state = (F.col("address.postalCode"), F.col("address.state")) if struct("address") else (pick(raw, "zip", "postalCode"), pick(raw, "state", "address"))
    return raw.select(
        F.lit("EHR").alias("source_system"),
        pick(raw, "id").alias("source_patient_id"),
        F.upper(F.trim(first)).alias("first_name"),
        F.upper(F.trim(last)).alias("last_name"),
        _date(raw, "birthDate").alias("date_of_birth"),
        pick(raw, "gender").alias("gender"),
        pick(raw, "race").alias("race_ethnicity"),
        state.alias("state"),
        F.substring(F.trim(zip_code), 1, 5).alias("zip5"),
        pick(raw, "insurance_type").alias("insurance_type"),
        pick(raw, "_ingestion_timestamp", kind="timestamp").alias("_ingestion_timestamp"),
    )


def claims_patients(raw: DataFrame) -> DataFrame:
    """The newest record of each subscriber."""
    rows = raw.select(
        F.lit("CLAIMS").alias("source_system"),
        pick(raw, "subscriber_id").alias("source_patient_id"),
        F.upper(F.trim(pick(raw, "subscriber_first_name"))).alias("first_name"),
        F.upper(F.trim(pick(raw, "subscriber_last_name"))).alias("last_name"),
        _date(raw, "subscriber_dob").alias("date_of_birth"),
        pick(raw, "subscriber_gender").alias("gender"),
        pick(raw, "subscriber_race").alias("race_ethnicity"),
        pick(raw, "subscriber_state").alias("state"),
        F.substring(F.trim(pick(raw, "subscriber_zip")), 1, 5).alias("zip5"),
        pick(raw, "payer_name").alias("insurance_type"),
        pick(raw, "_ingestion_timestamp", kind="timestamp").alias("_ingestion_timestamp"),
        pick(raw, "claim_id").alias("_claim"),
    )
    return latest_per_key(rows.where("source_patient_id is not null"), ["source_patient_id"], [F.col("_ingestion_timestamp").desc(), F.col("_claim").desc()]).drop("_claim")


def standardise_demographics(people: DataFrame, today: Column) -> DataFrame:
    return people.withColumns(
        {
            "state": exprs.state_code(F.col("state")),
            "gender": exprs.gender(F.col("gender")),
            "insurance_type": exprs.insurance_type(F.col("insurance_type")),
            "race_ethnicity": exprs.race_ethnicity(F.col("race_ethnicity")),
            "urban_rural": exprs.urban_rural(F.col("zip5")),
            "age_at_processing": exprs.age(F.col("date_of_birth"), today),
        }
    )


def dim_patient(current: DataFrame | None, golden: DataFrame, today: Column) -> DataFrame:
    """The type-2 patient dimension after a load of golden records."""
    new = flag_patients(standardise_demographics(golden, today))
    keep = [
        "patient_id", "source_patient_id", "source_system", "first_name", "last_name", "date_of_birth", "age_at_processing", "gender",
        "race_ethnicity", "state", "zip5", "urban_rural", "insurance_type", "_dq_valid", "_dq_issues",
    ]
    new = new.select(*keep)
    if current is None:
        return new.withColumns({"effective_date": today, "end_date": F.lit("9999-12-31").cast("date"), "is_current": F.lit(True)})
    return scd2_diff(current, new, "patient_id", TRACKED, today)


def dim_facility(facilities: DataFrame) -> DataFrame:
    """The newest record of each facility."""
    rows = ensure_columns(facilities, {"facility_name": "string", "facility_type": "string", "state": "string", "city": "string", "_ingestion_timestamp": "timestamp"})
    told = ["facility_name", "facility_type", "state", "city"]
    newest = latest_per_key(rows, ["facility_id"], [F.col("_ingestion_timestamp").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in told]])
    return newest.select("facility_id", "facility_name", "facility_type", exprs.state_code(F.col("state")).alias("state"), "city")


def dim_date(bounds: DataFrame, fiscal_start_month: int = 1) -> DataFrame:
    """One row per day from `first_day` to `last_day` of a frame of one row; weeks start on Sunday (day_of_week 1)."""
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("d"))
    shifted = F.add_months("d", (13 - fiscal_start_month) % 12)
    return days.select(
        exprs.date_key(F.col("d")).alias("date_key"),
        F.col("d").alias("full_date"),
        F.year("d").alias("year"),
        F.quarter("d").alias("quarter"),
        F.month("d").alias("month"),
        F.dayofmonth("d").alias("day"),
        F.dayofweek("d").alias("day_of_week"),
        F.weekofyear("d").alias("week_of_year"),
        F.date_format("d", "MMMM").alias("month_name"),
        F.date_format("d", "EEEE").alias("day_name"),
        F.dayofweek("d").isin(1, 7).alias("is_weekend"),
        (F.col("d") == F.last_day("d")).alias("is_month_end"),
        F.year(shifted).alias("fiscal_year"),
        F.quarter(shifted).alias("fiscal_quarter"),
    )


# facts


def fact_diagnosis(conditions: DataFrame, claims: DataFrame, xref: DataFrame) -> DataFrame:
    """Lung-cancer diagnoses of small-cell or unknown morphology, one per patient and day, EHR first."""
    lung = PATTERNS["lung"]
    code = pick(conditions, "code", "icd10_code")
    ehr = conditions.select(
        F.lit("EHR").alias("source_system"),
        _ids(conditions).alias("source_patient_id"),
        F.when(pick(conditions, "code").rlike(lung), pick(conditions, "code")).otherwise(F.coalesce(pick(conditions, "icd10_code"), code)).alias("icd10_code"),
        pick(conditions, "morphology_code").alias("morphology_code"),
        _date(conditions, "onsetDateTime", "diagnosis_date", "recordedDate").alias("diagnosis_date"),
        exprs.stage(pick(conditions, "stage", "clinical_stage")).alias("stage"),
        pick(conditions, "_ingestion_timestamp", kind="timestamp").alias("_ts"),
    )
    first, second = pick(claims, "primary_diagnosis_code"), pick(claims, "secondary_diagnosis_code_1")
    paid = claims.select(
        F.lit("CLAIMS").alias("source_system"),
        _ids(claims).alias("source_patient_id"),
        F.when(first.rlike(lung), first).otherwise(second).alias("icd10_code"),
        F.lit(None).cast("string").alias("morphology_code"),
        _date(claims, "service_from_date").alias("diagnosis_date"),
        F.lit("Unknown").alias("stage"),
        pick(claims, "_ingestion_timestamp", kind="timestamp").alias("_ts"),
    )
    rows = ehr.unionByName(paid).where(F.col("icd10_code").rlike(lung) & F.col("diagnosis_date").isNotNull())
    rows = rows.where(F.col("morphology_code").isin(codes.MORPHOLOGY) | F.col("morphology_code").isNull())
    rows = _linked(rows.withColumn("is_confirmed_sclc", F.col("morphology_code").isin(codes.MORPHOLOGY)), xref)
    order = [F.when(F.col("source_system") == "EHR", 0).otherwise(1), F.col("_ts").desc(), F.col("icd10_code"), F.col("stage"), F.col("source_patient_id")]
    best = latest_per_key(rows, ["patient_id", "diagnosis_date"], order)
    return best.select(
        exprs.key(F.lit("dx"), F.col("patient_id"), F.col("diagnosis_date")).alias("diagnosis_id"),
        "patient_id", "diagnosis_date", exprs.date_key(F.col("diagnosis_date")).alias("diagnosis_date_key"), "stage", "icd10_code", "morphology_code", "is_confirmed_sclc", "source_system",
    )


def treatment_codes(spark: SparkSession) -> DataFrame:
    rows = [(c, n, "chemo") for c, n in codes.CHEMO.items()] + [(c, n, "io") for c, n in codes.IMMUNO.items()]
    rows += [(c, n, "targeted") for c, n in codes.TARGETED.items()] + [(c, "Radiation", "radiation") for c in codes.RADIATION]
    return code_table(spark, rows, "code string, drug string, category string")


def episodes(claims: DataFrame, gap_days: int = GAP_DAYS, carried: Sequence[Column] = ()) -> DataFrame:
    """Treatment claims (patient_id, service_date, drug, category) to episodes: claims of a patient at most
    `gap_days` apart are one, numbered as lines of therapy."""
    has = lambda c: F.coalesce(F.max(F.col("category") == c), F.lit(False))
    rows = sessionize(claims.where("service_date is not null"), ["patient_id"], "service_date", gap_days, "line_of_therapy")
    out = rows.groupBy("patient_id", "line_of_therapy").agg(
        F.min("service_date").alias("treatment_start_date"),
        F.max("service_date").alias("treatment_end_date"),
        F.array_sort(F.collect_set("drug")).alias("drugs_used"),
        has("chemo").alias("has_chemo"),
        has("io").alias("has_io"),
        has("targeted").alias("has_targeted"),
        has("radiation").alias("has_radiation"),
        F.count(F.lit(1)).alias("claim_count"),
        *carried,
    )
    flags = [F.col(f"has_{c}") for c in ("chemo", "io", "targeted", "radiation")]
    return out.withColumns(
        {
            "duration_days": F.datediff("treatment_end_date", "treatment_start_date"),
            "line_label": exprs.line_label(F.col("line_of_therapy")),
            "regimen_name": F.array_join("drugs_used", " + "),
            "regimen_category": exprs.regimen_category(*flags),
        }
    )


def fact_treatment_episode(spark: SparkSession, procedures: DataFrame, professional: DataFrame, institutional: DataFrame, xref: DataFrame) -> DataFrame:
    def rows(df: DataFrame, system: str, *dates: str) -> DataFrame:
        return df.select(F.lit(system).alias("source_system"), _ids(df).alias("source_patient_id"), pick(df, "code", "procedure_code").alias("code"), _date(df, *dates).alias("service_date"))

    raw = rows(procedures, "EHR", "performedDateTime", "procedure_date").unionByName(rows(professional, "CLAIMS", "service_from_date")).unionByName(rows(institutional, "CLAIMS", "admission_date"))
    known = _linked(raw.join(treatment_codes(spark), "code"), xref)
    found = episodes(known)
    return found.withColumn("episode_id", exprs.key(F.lit("tx"), F.col("patient_id"), F.col("treatment_start_date")))


def best_response(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Marks the best response of each key: CR, PR, SD, PD, others; ties by the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(exprs.response_rank(F.col("response_type")), *order)
    return df.withColumn("is_best_response", F.row_number().over(w) == 1)


def fact_response_assessment(observations: DataFrame, episode: DataFrame, xref: DataFrame, parts: int | None = None) -> DataFrame:
    """Assessments with the latest episode that began on or before their day; one per patient and day. `parts`: what
    the episodes are dealt to."""
    hit = _says(F.lower(_field(observations, "category")), "response_category") | _says(F.lower(_field(observations, "test_code")), "response_code")
    rows = _of_ehr(observations.where(hit), assessment_date=_date(observations, *FIELDS["observed"]), response_type=exprs.response(_field(observations, "text")))
    rows = dealt(_linked(rows.where("assessment_date is not null"), xref), ["patient_id"], parts)
    rows = latest_per_key(rows, ["patient_id", "assessment_date"], [exprs.response_rank(F.col("response_type")), F.col("source_patient_id")])
    linked = asof_join(rows, episode.select("patient_id", "episode_id", "treatment_start_date"), ["patient_id"], "assessment_date", "treatment_start_date", ["episode_id"])
    marked = best_response(linked, ["patient_id", "episode_id"], [F.col("assessment_date")])
    return marked.withColumn("assessment_id", exprs.key(F.lit("ra"), F.col("patient_id"), F.col("assessment_date"))).drop("source_system", "source_patient_id")


def fact_biomarker_test(spark: SparkSession, observations: DataFrame, xref: DataFrame) -> DataFrame:
    """Tests with a known code or a telling category, equal ones once."""
    kinds = code_table(spark, [(c, k) for k, cs in codes.BIOMARKERS.items() for c in cs], "test_code string, known string")
    category = F.lower(_field(observations, "category"))
    named = F.coalesce(*[F.when(category.rlike(p), F.lit(k)) for p, k in TEST_KINDS.items()], F.lit("Other"))
    taken = {"test_code": "test_code", "result_text": "text", "result_unit": "unit", "interpretation": "interpretation"}
    told = _of_ehr(
        observations, **{out: _field(observations, field) for out, field in taken.items()}, test_date=_date(observations, *FIELDS["observed"]),
        result_numeric=_field(observations, "number", "double"), named=named, telling=_says(category, "biomarker_category"),
    )
    rows = _linked(told.join(kinds, "test_code", "left").where(F.col("known").isNotNull() | F.col("telling")), xref)
    kind, number = F.coalesce("known", "named"), F.col("result_numeric")
    rows = rows.withColumn("biomarker_type", kind).select(
        "test_code", "test_date", "result_numeric", "result_text", "result_unit", "interpretation", "patient_id", "biomarker_type",
        exprs.biomarker_positive(F.col("biomarker_type"), number, F.concat_ws(" ", "interpretation", "result_text")).alias("result_positive"),
        F.when(F.col("biomarker_type") == "PD-L1", number).alias("pdl1_tps_score"), F.when(F.col("biomarker_type") == "TMB", number).alias("tmb_score"),
        exprs.key(*[F.col(c) for c in ("patient_id", "test_code", "test_date", "result_numeric", "result_text")]).alias("test_id"),
    )
    return rows.dropDuplicates(["test_id"])


def fact_progression_event(responses: DataFrame, notes: DataFrame, diagnoses: DataFrame, episode: DataFrame, xref: DataFrame) -> DataFrame:
    """Progressions from PD assessments and from notes, more than 30 days after the event before, with the days
    since the first diagnosis and since the latest treatment start."""
    seen = responses.where("response_type = 'PD'").select("patient_id", F.col("assessment_date").alias("progression_date"), F.lit("assessment").alias("evidence"))
    text = F.lower(F.concat_ws(" ", pick(notes, "valueString"), pick(notes, "value"), pick(notes, "value_text"), pick(notes, "code"), pick(notes, "category")))
    said = _of_ehr(notes.where(_says(text, "progression")), progression_date=_date(notes, *FIELDS["observed"]), evidence=F.lit("note"))
    rows = seen.unionByName(_linked(said, xref).select("patient_id", "progression_date", "evidence")).where("progression_date is not null")
    return progressions(rows, diagnoses, episode).withColumn("progression_id", exprs.key(F.lit("pe"), F.col("patient_id"), F.col("progression_date")))


def progressions(rows: DataFrame, diagnoses: DataFrame, episode: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    kept = gap_dedup(rows, ["patient_id"], "progression_date", PROGRESSION_DAYS, ["evidence"])
    first = diagnoses.groupBy("patient_id").agg(F.min("diagnosis_date").alias("first_diagnosis_date"))
    with_tx = asof_join(kept.join(first, "patient_id", "left"), episode.select("patient_id", "episode_id", "treatment_start_date"), ["patient_id"], "progression_date", "treatment_start_date", ["episode_id"])
    w = Window.partitionBy("patient_id").orderBy("progression_date", "evidence")
    return with_tx.select(
        "patient_id", "progression_date", "evidence", "episode_id",
        F.row_number().over(w).alias("progression_number"),
        F.datediff("progression_date", "first_diagnosis_date").alias("pfs_days_from_diagnosis"),
        F.datediff("progression_date", "treatment_start_date").alias("pfs_days_from_treatment"),
    )


def fact_trial_enrollment(encounters: DataFrame, procedures: DataFrame, episode: DataFrame, xref: DataFrame, legacy_codes: bool = False) -> DataFrame:
    """Enrollments, one per patient and trial (rows without a trial id are one trial), each with the episode that
    begins nearest, within 30 days."""
    trial, code = _field(encounters, "trial"), _field(procedures, "code")
    visits = _says(F.lower(_field(encounters, "type")), "trial_type") | _says(F.lower(_field(encounters, "service")), "trial_service") | trial.isNotNull()
    # the legacy rule held the codes against the lower-cased code, so of these only the numeric one could match
    done = _says(F.lower(code) if legacy_codes else F.upper(code), "trial_code") | _says(F.lower(_field(procedures, "category")), "trial_category")
    enrolled = F.lit("enrolled")
    met = _of_ehr(
        encounters.where(visits), trial_identifier=trial, trial_name=_field(encounters, "trial_name"), trial_phase=_field(encounters, "trial_phase"),
        trial_status=F.coalesce(F.lower(_field(encounters, "trial_status")), enrolled), enrollment_date=_date(encounters, *FIELDS["met"]),
    )
    unnamed = dict.fromkeys(("trial_identifier", "trial_name", "trial_phase"), F.lit(None).cast("string"))
    other = _of_ehr(procedures.where(done), **unnamed, trial_status=enrolled, enrollment_date=_date(procedures, *FIELDS["performed"]))
    rows = _linked(met.unionByName(other).where("enrollment_date is not null"), xref)
    rows = latest_per_key(rows, ["patient_id", "trial_identifier"], [F.col("enrollment_date"), F.col("trial_status"), F.col("source_patient_id")])
    rows = rows.withColumn("enrollment_id", exprs.key(F.lit("te"), F.col("patient_id"), F.col("trial_identifier")))
    found = nearest_join(rows, episode.select("patient_id", "episode_id", "treatment_start_date"), ["patient_id"], "enrollment_date", "treatment_start_date", TRIAL_DAYS, ["enrollment_id"], ["treatment_start_date", "episode_id"])
    return found.drop("source_system", "source_patient_id")
