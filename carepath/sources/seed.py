"""A seeded generator of patients and their records, made by Spark tasks: every draw is a hash of the seed, the
patient's number and the draw's name, so rows are the same however they are dealt, and any number can be made."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what is drawn from, with weights
STATES = {
    "CA": 12, "TX": 9, "FL": 7, "NY": 6, "PA": 4, "IL": 4, "OH": 4, "GA": 3, "NC": 3, "MI": 3, "NJ": 3, "VA": 3, "WA": 2, "AZ": 2, "MA": 2, "TN": 2, "IN": 2, "MO": 2, "MD": 2,
    "WI": 2, "CO": 2, "MN": 2, "SC": 2, "AL": 2, "LA": 2, "KY": 2, "OR": 1, "OK": 1, "CT": 1, "IA": 1, "MS": 1, "AR": 1, "KS": 1, "NV": 1, "UT": 1, "NE": 1, "NM": 1, "WV": 1,
    "ID": 1, "HI": 1, "ME": 1, "NH": 1, "RI": 1, "MT": 1, "DE": 1, "SD": 1, "ND": 1, "AK": 1, "VT": 1, "WY": 1,
}
INSURANCE = {"Medicare": 55, "Commercial": 25, "Medicaid": 15, "Uninsured": 5}
RACE = {"White": 70, "Black": 15, "Hispanic": 8, "Asian": 4, "Other": 3}
SMOKING = {"Current Smoker": 40, "Former Smoker": 55, "Never Smoker": 5}
FACILITY = {"Academic": 30, "Community": 50, "Veterans": 10, "Rural": 10}
STAGE, ECOG, PLACE = {"LS-SCLC": 30, "ES-SCLC": 70}, {0: 10, 1: 35, 2: 30, 3: 20, 4: 5}, {"Urban": 75, "Rural": 25}
EXTENSIVE = {"Carboplatin/Etoposide + Atezolizumab": 30, "Carboplatin/Etoposide + Durvalumab": 20, "Carboplatin/Etoposide": 25, "Cisplatin/Etoposide": 15, "Clinical Trial": 10}
LIMITED = {"Cisplatin/Etoposide + Concurrent RT": 50, "Carboplatin/Etoposide + Concurrent RT": 40, "Clinical Trial": 10}
SECOND = {"Topotecan": 30, "Lurbinectedin": 25, "Platinum Re-challenge": 15, "Clinical Trial": 15, "Nivolumab": 15}
#: Category of a regimen, and whether it holds immunotherapy; others are chemotherapy only.
CATEGORY = {
    "Carboplatin/Etoposide + Atezolizumab": "Chemo+IO", "Carboplatin/Etoposide + Durvalumab": "Chemo+IO", "Cisplatin/Etoposide + Concurrent RT": "Chemo+RT",
    "Carboplatin/Etoposide + Concurrent RT": "Chemo+RT", "Clinical Trial": "Clinical Trial", "Nivolumab": "IO Only",
}
IMMUNE = ["Chemo+IO", "IO Only"]
RESPONSE = {"ES-SCLC": {"CR": 5, "PR": 45, "SD": 20, "PD": 30}, "LS-SCLC": {"CR": 15, "PR": 50, "SD": 15, "PD": 20}, "second": {"CR": 2, "PR": 25, "SD": 25, "PD": 48}}
METHOD, SITES = {"CT": 50, "PET-CT": 35, "Clinical": 15}, ["Brain", "Liver", "Bone", "Adrenal", "Lung", "Lymph Nodes"]
PHASE = {1: {"Phase I": 20, "Phase II": 40, "Phase III": 40}, 2: {"Phase I": 30, "Phase II": 40, "Phase III": 30}}
TESTED = {"PD-L1": 0.8, "TMB": 0.4}
PROGRESSES, GOES_ON = {"ES-SCLC": 0.7, "LS-SCLC": 0.5}, 0.8
#: Parts of keys.
KEYS = {"patient": "pat", "diagnosis": "dx", "test": "bm", "episode": "tx", "assessment": "ra", "progression": "pe", "enrollment": "te"}


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """Of each place how likely it stands for itself, and for which other one else: one uniform draw picks any place
    by its weight in constant time."""
    n, total = len(weights), sum(weights)
    share = [w * n / total for w in weights]
    own, other = [1.0] * n, list(range(n))
    small, large = [k for k in range(n) if share[k] < 1], [k for k in range(n) if share[k] >= 1]
    while small and large:
        a, b = small.pop(), large[-1]
        own[a], other[a] = share[a], b
        share[b] -= 1 - share[a]
        if share[b] < 1:
            small.append(large.pop())
    return own, other


class Draws:
    """Draws for the rows of a frame that has `k`, the patient's number."""

    def __init__(self, seed: int):
        self.seed = seed

    def unit(self, name: str) -> Column:
        """From 0 to below 1."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(name), F.col("k")), 11) / F.lit(float(1 << 53))

    def whole(self, name: str, low: int, high: int) -> Column:
        """Each whole number from low to high alike."""
        return (F.floor(self.unit(name) * (high - low + 1)) + low).cast("int")

    def normal(self, name: str, mean: float, deviation: float) -> Column:
        far = F.sqrt(-2 * F.log(1 - self.unit(f"{name}/1")))
        return mean + deviation * far * F.cos(self.unit(f"{name}/2") * 6.283185307179586)

    def pick(self, name: str, weights: dict) -> Column:
        """One of the keys, by its weight."""
        own, other = alias_table(list(weights.values()))
        at = self.unit(name) * len(weights)
        place = F.floor(at).cast("int") + 1
        table = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place)
        taken = F.when(at - F.floor(at) < table(own), place).otherwise(table([o + 1 for o in other]))
        return F.element_at(F.array(*[F.lit(v) for v in weights]), taken)


def generate(spark: SparkSession, n: int = 500, seed: int = 42, partitions: int | None = None) -> dict[str, DataFrame]:
    """The eight tables of `n` patients. Every patient has one diagnosis and a first-line episode with its response;
    regimens, responses and the chance to progress depend on the stage, and who progresses may have a second line."""
    d = Draws(seed)
    key = lambda kind, more="": F.concat(F.lit(f"{KEYS[kind]}-"), F.lpad("k", 9, "0"), F.lit(more))
    days = lambda since, count: F.date_add(since, count.cast("int"))
    place = lambda state, kind: F.concat_ws("-", F.lit("fac"), state, F.lower(kind))
    extensive = F.col("stage") == "ES-SCLC"
    age = F.greatest(F.lit(45), F.least(F.lit(85), F.floor(d.normal("age", 70, 8)).cast("int")))
    people = spark.range(1, n + 1, numPartitions=partitions).withColumnRenamed("id", "k")
    drawn = people.withColumns({"patient_id": key("patient"), "state": d.pick("state", STATES), "stage": d.pick("stage", STAGE), "dx": days(F.lit("2025-01-01").cast("date"), d.whole("dx", 0, 400))})
    drawn = drawn.withColumns(
        {
            "facility": place(F.col("state"), d.pick("facility", FACILITY)),
            "tx": days(F.col("dx"), F.greatest(F.lit(1), F.floor(d.normal("wait", 18, 8)))),
            "regimen": F.when(extensive, d.pick("first/es", EXTENSIVE)).otherwise(d.pick("first/ls", LIMITED)),
            "progresses": d.unit("progresses") < F.when(extensive, PROGRESSES["ES-SCLC"]).otherwise(PROGRESSES["LS-SCLC"]),
            "pfs": F.when(extensive, d.whole("pfs/es", 90, 250)).otherwise(d.whole("pfs/ls", 150, 400)),
        }
    )
    drawn = drawn.withColumn("progressed", days(F.col("tx"), F.col("pfs")))
    drawn = drawn.withColumns({"second": F.col("progresses") & (d.unit("second") < GOES_ON), "tx2": days(F.col("progressed"), d.whole("wait2", 7, 28)), "regimen2": d.pick("regimen2", SECOND)})
    category = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORY.items() for x in p]), F.col(c)), F.lit("Chemo Only"))

    def tested(kind: str, day: Column, result: Column, **values: Column) -> DataFrame:
        rows = drawn.where(d.unit(f"tested/{kind}") < TESTED[kind]).select("k", "patient_id", "facility", day.alias("test_date"))
        cols = {"pdl1_percentage": F.lit(None).cast("double"), "tmb_score": F.lit(None).cast("double")} | values
        told = F.concat(next(iter(values.values())).cast("string"), F.lit("%" if kind == "PD-L1" else " mut/Mb"))
        return rows.select(key("test", f"-{kind.lower()}").alias("test_id"), "patient_id", "test_date", days(F.col("test_date"), result).alias("result_date"), F.lit(kind).alias("biomarker_type"), told.alias("test_result"), *[v.alias(c) for c, v in cols.items()], F.col("facility").alias("testing_facility_id"))

    def line(number: int, start: str, regimen: str, length: Column) -> DataFrame:
        kind = category(regimen)
        return (drawn if number == 1 else drawn.where("second")).select(
            key("episode", f"-{number}").alias("episode_id"), "patient_id", F.lit(number).alias("line_of_therapy"), F.col(start).alias("treatment_start_date"), days(F.col(start), length).alias("treatment_end_date"),
            F.col(regimen).alias("regimen_name"), kind.alias("regimen_category"), kind.isin(IMMUNE).alias("includes_immunotherapy"), F.col("facility").alias("treating_facility_id"),
        )

    def assessed(number: int, day: Column, response: Column, method: Column) -> DataFrame:
        rows = drawn if number == 1 else drawn.where("second")
        return rows.select(key("assessment", f"-{number}").alias("assessment_id"), key("episode", f"-{number}").alias("episode_id"), day.alias("assessment_date"), response.alias("response_type"), method.alias("assessment_method"))

    def enrolled(number: int, start: str, regimen: str, most: int) -> DataFrame:
        rows = (drawn if number == 1 else drawn.where("second")).where(F.col(regimen) == "Clinical Trial")
        trial = F.concat(F.lit("NCT"), d.whole(f"trial/{number}", 10_000_000, 99_999_999).cast("string"))
        day = days(F.col(start), -d.whole(f"enrolled/{number}", 7, most))
        return rows.select(key("enrollment", f"-{number}").alias("enrollment_id"), "patient_id", trial.alias("trial_id"), d.pick(f"phase/{number}", PHASE[number]).alias("trial_phase"), day.alias("enrollment_date"), F.lit("Active").alias("trial_status"))

    states = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state"))
    facilities = states.select("state", F.explode(F.array(*[F.lit(x) for x in FACILITY])).alias("facility_type"))
    born = F.date_sub(F.add_months(F.lit("2026-01-01").cast("date"), -12 * age), d.whole("born", 0, 364))
    pdl1, tmb = F.round(d.unit("pdl1") * 100, 1), F.round(2 + d.unit("tmb") * 28, 1)
    first_response = F.when(extensive, d.pick("response/es", RESPONSE["ES-SCLC"])).otherwise(d.pick("response/ls", RESPONSE["LS-SCLC"]))
    return {
        "facilities": facilities.select(
            place(F.col("state"), F.col("facility_type")).alias("facility_id"), F.concat_ws(" ", "state", "facility_type", F.lit("Medical Center")).alias("facility_name"), "facility_type", "state", F.concat_ws(" ", "state", F.lit("City")).alias("city")
        ),
        "patients": drawn.select(
            "patient_id", F.concat(F.lit("SCLC-"), F.lpad("k", 5, "0") if n < 100_000 else F.col("k").cast("string")).alias("external_id"), born.alias("date_of_birth"), d.pick("gender", {"Male": 1, "Female": 1}).alias("gender"),
            d.pick("race", RACE).alias("race_ethnicity"), "state", F.concat_ws(" ", "state", F.lit("County")).alias("county"), d.whole("zip", 10_000, 99_999).cast("string").alias("zip_code"),
            d.pick("insurance", INSURANCE).alias("insurance_type"), d.pick("place", PLACE).alias("urban_rural"),
        ),
        "diagnoses": drawn.select(
            key("diagnosis").alias("diagnosis_id"), "patient_id", F.col("dx").alias("diagnosis_date"), "stage", F.lit("Small Cell Carcinoma").alias("histology"), d.pick("ecog", ECOG).alias("ecog_status"),
            d.pick("smoking", SMOKING).alias("smoking_status"), F.col("facility").alias("diagnosing_facility_id"),
        ),
        "biomarker_tests": tested("PD-L1", days(F.col("dx"), d.whole("pdl1/day", 1, 7)), d.whole("pdl1/result", 3, 14), pdl1_percentage=pdl1).unionByName(
            tested("TMB", days(F.col("dx"), d.whole("tmb/day", 1, 10)), d.whole("tmb/result", 7, 21), tmb_score=tmb)
        ),
        "treatment_episodes": line(1, "tx", "regimen", d.whole("length/1", 60, 150)).unionByName(line(2, "tx2", "regimen2", d.whole("length/2", 42, 120))),
        "response_assessments": assessed(1, days(F.col("tx"), d.whole("seen/1", 56, 84)), first_response, d.pick("method", METHOD)).unionByName(
            assessed(2, days(F.col("tx2"), d.whole("seen/2", 42, 70)), d.pick("response/2", RESPONSE["second"]), F.lit("CT"))
        ),
        "progression_events": drawn.where("progresses").select(
            key("progression").alias("progression_id"), "patient_id", F.col("progressed").alias("progression_date"), F.lit(1).alias("line_before_progression"), F.col("pfs").alias("pfs_days"), d.pick("site", dict.fromkeys(SITES, 1)).alias("progression_site")
        ),
        "trial_enrollments": enrolled(1, "tx", "regimen", 21).unionByName(enrolled(2, "tx2", "regimen2", 14)),
    }


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines per table, dates as ISO strings."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def to_json(tables: dict[str, DataFrame], most: int = 100_000) -> str:
    """One document for a demonstration: at most so many rows a table may have."""
    out = {}
    for name, df in tables.items():
        rows = [r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: use write_json")
        out[name] = [json.loads(r) for r in rows]
    return json.dumps(out)
