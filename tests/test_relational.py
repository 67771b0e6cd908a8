from datetime import date

import pytest
from pyspark.sql import functions as F

from carepath.operators import identity
from carepath.operators import relational as r
from carepath.operators.identity import golden_records, patient_xref, resolve
from carepath.operators.quality import Expectation, ExpectationError, expect

D = date.fromisoformat


def test_sessionize_gap_of_28_and_29_days(spark):
    df = spark.createDataFrame([(1, D("2024-01-01")), (1, D("2024-01-29")), (1, D("2024-01-29")), (1, D("2024-02-27")), (2, D("2024-01-01"))], "p int, d date")
    got = sorted((x.p, x.d.isoformat(), x.s) for x in r.sessionize(df, ["p"], "d", 28, "s").collect())
    assert [s for _, _, s in got] == [1, 1, 1, 2, 1]


def test_gap_dedup_compares_with_the_event_before(spark):
    df = spark.createDataFrame([(1, D("2024-01-01")), (1, D("2024-01-21")), (1, D("2024-02-10")), (1, D("2024-03-12"))], "p int, d date")
    assert sorted(x.d.isoformat() for x in r.gap_dedup(df, ["p"], "d", 30).collect()) == ["2024-01-01", "2024-03-12"]


def test_asof_takes_latest_not_after_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 1, D("2024-01-05")), (2, 1, D("2023-12-31")), (3, None, D("2024-01-05")), (4, 1, None), (5, 1, D("2024-02-01"))], "id int, k int, t date")
    right = spark.createDataFrame([(1, "a", D("2024-01-01")), (1, "b", D("2024-01-05")), (1, "c", D("2024-01-05")), (None, "n", D("2024-01-01")), (1, "z", None)], "k int, v string, rt date")
    got = {x.id: x.v for x in r.asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {1: "c", 2: None, 3: None, 4: None, 5: "c"}


def test_nearest_within_30_days_either_way(spark):
    left = spark.createDataFrame([(1, 1, D("2024-03-01")), (2, 1, D("2024-06-30")), (3, 2, D("2024-03-01")), (4, 1, None)], "id int, k int, t date")
    right = spark.createDataFrame([(1, D("2024-01-31")), (1, D("2024-03-31")), (1, D("2024-07-30")), (1, D("2024-05-30"))], "k int, rt date")
    got = {x.id: x.rt and x.rt.isoformat() for x in r.nearest_join(left, right, ["k"], "t", "rt", 30, ["id"], ["rt"]).collect()}
    assert got == {1: "2024-01-31", 2: "2024-07-30", 3: None, 4: None}


def test_cube_all_rows_do_not_come_from_null_data(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("a", None), ("Unknown", "y")], "s string, t string")
    got = {(x.s, x.t): x.n for x in r.cube_with_all(df, ["s", "t"], [F.count(F.lit(1)).alias("n")], {"s": F.col("s") != "Unknown"}).collect()}
    assert got == {(None, None): 4, ("a", None): 2, (None, "x"): 2, (None, "y"): 1, ("a", "x"): 1}


def test_scd2_over_days(spark):
    day = lambda d: F.lit(d).cast("date")
    cols = "k string, state string"
    first = spark.createDataFrame([("same", "NY"), ("moves", "NY"), ("absent", "CA")], cols)
    dim = first.withColumns({"effective_date": day("2024-01-01"), "end_date": day("9999-12-31"), "is_current": F.lit(True)})
    second = spark.createDataFrame([("same", "NY"), ("moves", "TX"), ("new", None)], cols)
    dim2 = r.scd2_diff(dim, second, "k", ["state"], day("2024-01-02"))
    again = r.scd2_diff(dim2, second, "k", ["state"], day("2024-01-02"))
    rows = lambda df: sorted((x.k, x.state or "", x.effective_date.isoformat(), x.end_date.isoformat(), x.is_current) for x in df.collect())
    assert rows(dim2) == rows(again)
    assert ("moves", "NY", "2024-01-01", "2024-01-02", False) in rows(dim2) and ("moves", "TX", "2024-01-02", "9999-12-31", True) in rows(dim2)
    dim3 = r.scd2_diff(dim2, spark.createDataFrame([("moves", "NY")], cols), "k", ["state"], day("2024-01-03"))
    current = [x for x in rows(dim3) if x[4]]
    assert len(rows(dim3)) == 6 and sorted(x[0] for x in current) == ["absent", "moves", "new", "same"]


def test_upsert_topk_filters_pages(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(tuple(x) for x in r.keyed_upsert(a, b, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert r.apply_filters(a, k=None, v="b").count() == 1
    assert [x.k for x in r.paginate(b, [F.col("k")], 2, 1).collect()] == [3]
    with pytest.raises(ValueError):
        r.paginate(b, [F.col("k")], 0, 10)


def test_pick_tolerates_absent_columns(spark):
    df = spark.createDataFrame([(None, "b")], "x string, y string")
    assert df.select(r.pick(df, "w", "x", "y").alias("v"), r.pick(df, "none").alias("n")).first() == ("b", None)


def test_identity_merges_exact_and_fuzzy_but_not_incomplete(spark):
    rows = [
        ("EHR", "1", "Robert", "Smith", D("1950-01-01"), "10001"),
        ("CLAIMS", "2", "ROBERT", "smith", D("1950-01-01"), "10001"),
        ("CLAIMS", "3", "Rupert", "Smith", D("1950-01-01"), "99999"),  # other ZIP, same soundex
        ("CLAIMS", "4", "Anna", "Smith", D("1950-01-01"), "99999"),  # by exact key with 3
        ("EHR", "5", "Robert", None, D("1950-01-01"), "10001"),
        ("EHR", "6", "Robert", None, D("1950-01-01"), "10001"),
    ]
    df = spark.createDataFrame(rows, "source_system string, source_patient_id string, first_name string, last_name string, date_of_birth date, zip5 string").withColumn("_ingestion_timestamp", F.current_timestamp())
    got = resolve(df)
    ids = {x.source_patient_id: x.patient_id for x in got.collect()}
    assert len({ids[k] for k in "1234"}) == 1 and len({ids["1"], ids["5"], ids["6"]}) == 3
    gold = {x.patient_id: x for x in golden_records(got).collect()}
    assert gold[ids["1"]].source_system == "EHR" and len(gold) == 3
    assert patient_xref(got).count() == 6


def test_expectations_fire(spark):
    df = spark.range(3)
    assert expect(df, Expectation("negative", F.col("id") < 0)) is df
    with pytest.raises(ExpectationError, match="big"):
        expect(df, Expectation("big", F.col("id") > 1))


def test_identity_merges_long_chains(spark):
    n = 40  # each record shares the ZIP with the one before or the sound of the first name
    rows = [("A", f"{k:02}", "BCDFGHKLMNPQRSTVWXZJ"[(k + 1) // 2 % 20] + "a" + "bdlmr"[(k + 1) // 2 % 5], "Long", "1980-01-01", f"{k // 2:05}") for k in range(n)]
    df = spark.createDataFrame(rows, "source_system string, source_patient_id string, first_name string, last_name string, date_of_birth string, zip5 string")
    got = resolve(df).collect()
    assert len(got) == n and len({r.patient_id for r in got}) == 1


PEOPLE = "source_system string, source_patient_id string, first_name string, last_name string, date_of_birth string, zip5 string"


class Loads:
    """Loads one after another, as the batch keeps their state."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0
        self.keys, self.redirects = identity.no_keys(spark), identity.no_redirects(spark)
        self.records = spark.createDataFrame([], "source_system string, source_patient_id string, patient_id string, load int")

    def __call__(self, *rows):
        self.n += 1
        out = identity.link(self.spark.createDataFrame(list(rows), PEOPLE), self.keys, self.redirects, self.n)
        self.keys = self.spark.createDataFrame(self.keys.unionByName(out.keys).collect(), identity.KEYS)
        self.redirects = self.spark.createDataFrame(identity.add_redirects(self.redirects, out.redirects).collect(), identity.REDIRECTS)
        self.records = self.spark.createDataFrame(self.records.unionByName(out.records).collect(), self.records.schema)
        return {(r[0], r[1]): r[2] for r in identity.current_ids(self.records, self.redirects).collect()}


def test_ids_hold_over_loads_and_the_oldest_survives(spark):
    load = Loads(spark)
    ann, bea, cy = ("EHR", "1", "Ann", "Lee", "1950-01-01", "10001"), ("EHR", "2", "Bea", "Lee", "1950-01-01", "20002"), ("EHR", "3", "Cy", "Ray", "1960-01-01", None)
    one = load(ann, bea, cy)
    assert len(set(one.values())) == 3
    # records that match keep the ids of the first load, whatever their own hashes are
    two = load(*[("CLAIMS", str(k), "Anne", "LEE", "1950-01-01", "99999") for k in range(12)])
    assert {k: v for k, v in two.items() if k in one} == one and {two["CLAIMS", str(k)] for k in range(12)} == {one["EHR", "1"]}
    # a record that was seen keeps its person though nothing else matches
    three = load(("EHR", "3", "Cyrus", "Roy", "1961-01-01", "30003"), ("CLAIMS", "new", "Dee", "Fox", "1970-01-01", "1"))
    assert three["EHR", "3"] == one["EHR", "3"] and three["CLAIMS", "new"] not in one.values()
    # a record joins two persons: the older, or of one load the lesser, stays
    four = load(("CLAIMS", "x", "Ann", "Lee", "1950-01-01", "20002"))
    stays = min(one["EHR", "1"], one["EHR", "2"])
    assert {four[k] for k in four if k[1] in ("1", "2", "x") and k[0] == "EHR"} == {stays} == {four["CLAIMS", "x"]}
    five = load(("CLAIMS", "y", "Dee", "Fox", "1970-01-01", "9"), ("CLAIMS", "z", "Cyrus", "Roy", "1961-01-01", "9"), ("EHR", "9", "Dee", "Roy", "1961-01-01", "9"))
    assert five["CLAIMS", "y"] == three["CLAIMS", "new"] and five["CLAIMS", "z"] == one["EHR", "3"] == five["EHR", "9"]
    # a chain of mergers over loads leads straight to the last one
    six = load(("CLAIMS", "q", "Ann", "Lee", "1950-01-01", "777"), ("CLAIMS", "q", "Cy", "Ray", "1960-01-01", None))
    assert len({six["EHR", "1"], six["EHR", "2"], six["EHR", "3"], six["CLAIMS", "q"]}) == 1
    assert not {r.patient_id for r in load.redirects.collect()} & {r.old_id for r in load.redirects.collect()}
    assert load(ann, bea, cy) == six  # the same records again change nothing


def test_a_merged_person_has_one_current_version(spark):
    end = "date'9999-12-31'"
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int").selectExpr("*", "date'2024-01-01' AS effective_date", f"{end} AS end_date", "true AS is_current")
    gone = spark.createDataFrame([("b", "a"), ("b", "a"), ("zz", "a")], "k string, into string")
    got = {x.k: (x.is_current, str(x.end_date)) for x in r.scd2_end(dim, gone, "k", F.lit("2024-05-01").cast("date")).collect()}
    assert got == {"a": (True, "9999-12-31"), "b": (False, "2024-05-01"), "c": (True, "9999-12-31")}
