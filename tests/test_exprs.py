from datetime import date

import pytest
from pyspark.sql import functions as F

from carepath.functions import exprs
from carepath.operators.quality import flag_patients


def one(spark, column, *values):
    names = [f"v{k}" for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (exprs.state_code, "ca", "CA"), (exprs.state_code, " New York", "NY"), (exprs.state_code, "Ontario", None), (exprs.state_code, None, None),
    (exprs.gender, "NB", "Other"), (exprs.gender, None, "Unknown"), (exprs.gender, "?", "Unknown"),
    (exprs.insurance_type, "private", "Commercial"), (exprs.insurance_type, "Nevada VA", "Other Government"), (exprs.insurance_type, None, "Unknown"), (exprs.insurance_type, "Acme", "Other"),
    (exprs.race_ethnicity, "caucasian", "White"), (exprs.race_ethnicity, "Not Hispanic", "Hispanic or Latino"), (exprs.race_ethnicity, "asian american", "Asian"), (exprs.race_ethnicity, "zz", "Unknown"),
    (exprs.urban_rural, "10001", "Urban"), (exprs.urban_rural, "12345", "Suburban"), (exprs.urban_rural, "99999", "Rural"), (exprs.urban_rural, "123", "Unknown"), (exprs.urban_rural, None, "Unknown"),
    (exprs.stage, "I", "LS-SCLC"), (exprs.stage, "iii", "LS-SCLC"), (exprs.stage, "IIIB", "LS-SCLC"), (exprs.stage, "IV", "ES-SCLC"), (exprs.stage, "Limited stage", "LS-SCLC"),
    (exprs.stage, "extensive", "ES-SCLC"), (exprs.stage, "false", "Unknown"), (exprs.stage, "yes", "Unknown"), (exprs.stage, None, "Unknown"),
    (exprs.stage_legacy, "false", "LS-SCLC"), (exprs.stage_legacy, "yes", "ES-SCLC"), (exprs.stage_legacy, "IIIB", "Unknown"),
    (exprs.response, "Complete Response", "CR"), (exprs.response, "pd", "PD"), (exprs.response, "disease progressed", "PD"), (exprs.response, "stable", "SD"), (exprs.response, None, "NE"),
])
def test_codes(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("days", "want"), [(0, "0-7"), (7, "0-7"), (8, "8-14"), (21, "15-21"), (22, "22-30"), (30, "22-30"), (31, "31+"), (-1, None)])
def test_buckets(spark, days, want):
    assert one(spark, exprs.ttt_bucket, days) == want


@pytest.mark.parametrize(("kind", "number", "note", "want"), [
    ("PD-L1", 0.9, "high", False), ("PD-L1", 1.0, None, True), ("TMB", 9.9, None, False), ("TMB", 10.0, None, True),
    ("TMB", None, "High", True), ("NGS", None, "mutation was detected", True), ("NGS", None, None, False), ("Other", 5.0, "high", None),
])
def test_biomarkers(spark, kind, number, note, want):
    df = spark.createDataFrame([(kind, number, note)], "k string, n double, t string")
    assert df.select(exprs.biomarker_positive(F.col("k"), F.col("n"), F.col("t"))).first()[0] is want


def test_regimens(spark):
    df = spark.createDataFrame([(True, True, True, True), (False, True, True, False), (True, False, True, True), (True, False, False, True), (False, False, False, True), (False,) * 4], "c boolean, i boolean, t boolean, r boolean")
    got = [x[0] for x in df.select(exprs.regimen_category(*map(F.col, "citr"))).collect()]
    assert got == ["Chemo+IO", "IO Monotherapy", "Targeted Therapy", "Chemo Only", "Radiation", "Other"]


def test_medians_and_rates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert tuple(df.select(exprs.median("x"), exprs.upper_median("x")).first()) == (2.0, 3.0)
    assert one(spark, lambda a, b: exprs.rate(a, b), 1, 0) == 0.0
    assert one(spark, lambda a, b: exprs.rate(a, b, 1), 1, 3) == 33.3


def test_flags_never_drop(spark):
    rows = [("A", "B", date(1950, 1, 1), 74, "Male", "NY", "10001"), ("", "B", None, None, "Unknown", None, "1"), ("A", "B", date(1850, 1, 1), 174, "Male", "NY", "10001")]
    df = spark.createDataFrame(rows, "first_name string, last_name string, date_of_birth date, age_at_processing int, gender string, state string, zip5 string")
    got = [(x._dq_valid, x._dq_issues) for x in flag_patients(df).collect()]
    assert got == [(True, []), (False, ["missing_name", "missing_dob", "unknown_gender", "missing_state", "invalid_zip"]), (False, ["invalid_age"])]


def test_keys_are_deterministic_and_tell_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    got = [r[0] for r in df.select(exprs.key(F.col("x"), F.col("y"))).collect()]
    assert got[0] == got[2] != got[1]
