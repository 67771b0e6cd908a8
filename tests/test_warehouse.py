import glob
import time
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from carepath.operators import curve
from carepath.sources import sinks, warehouse

SLOW = "SELECT sum(hash(a.id, b.id)) AS s FROM range(3000000) a CROSS JOIN range(3000000) b WHERE a.id % :k = 0"


def test_statements_have_parameters_plain_values_and_a_limit(spark):
    sql = "SELECT :n AS n, date'2024-01-02' AS d, 1.50 AS x, array(named_struct('a', 1)) AS s, X'0a' AS b, null AS nothing"
    assert warehouse.execute(spark, sql, {"n": "it's"}) == [{"n": "it's", "d": "2024-01-02", "x": 1.5, "s": [{"a": 1}], "b": "0a", "nothing": None}]
    with pytest.raises(warehouse.TooManyRows):
        warehouse.execute(spark, "SELECT * FROM range(11)", most=10)
    assert len(warehouse.execute(spark, "SELECT * FROM range(10)", most=10)) == 10


def test_a_statement_is_stopped_at_its_deadline(spark):
    began = time.time()
    with pytest.raises(warehouse.StatementTimeout):
        warehouse.execute(spark, SLOW, {"k": 1}, seconds=2)
    assert time.time() - began < 20
    # other statements are not touched, nor are errors hidden
    assert warehouse.execute(spark, "SELECT 1 AS one", seconds=20) == [{"one": 1}]
    with pytest.raises(Exception, match="no such thing"):
        warehouse.execute(spark, "SELECT raise_error('no such thing')", seconds=20)


def test_pages_give_all_rows_once(spark):
    rows = [(date(2024, 1, 1 + k % 5), f"p{k:03d}", k) for k in range(53)]
    df = spark.createDataFrame(rows, "day date, id string, v int").repartition(4)
    for size in (1, 10, 53, 100):
        got = list(warehouse.pages(df, ["day", "id"], size))
        assert [r["v"] for page in got for r in page] == [r[2] for r in sorted(rows)] and all(len(p) == size for p in got[:-1])
    rest = list(warehouse.pages(df, ["day", "id"], 50, after=[date(2024, 1, 4), "p999"]))
    assert {r["day"] for page in rest for r in page} == {"2024-01-05"}
    with pytest.raises(ValueError, match="null"):
        list(warehouse.pages(df.withColumn("id", F.when(F.col("v") > 5, F.col("id"))), ["id"], 5))
    seen = []
    df.createOrReplaceTempView("paged")
    assert warehouse.serve_pages(spark, "SELECT * FROM paged WHERE v >= :low", ["id"], seen.append, {"low": 50}, size=2) == 3 and len(seen) == 2
    assert list(warehouse.pages(df.where("false"), ["id"])) == []


def ranges(path, column):
    """Least and greatest value of each file."""
    out = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def test_the_curve_prunes_by_each_column_alone(spark, tmp_path):
    df = spark.range(20000).selectExpr("concat('p', lpad(id, 6, '0')) AS patient_id", "element_at(array('AL','CA','CO','FL','GA','IL','MA','MI','NC','NJ','NY','OH','PA','TX','VA','WA'), int(pmod(xxhash64(id), 16)) + 1) AS state", "id AS v")
    sinks.write_version(df, f"{tmp_path}/curve", ["patient_id", "state"], 16)
    sinks.write_version(df.repartitionByRange(16, "patient_id", "state"), f"{tmp_path}/line")
    read = lambda kind, column, value: sum(a <= value <= b for a, b in ranges(f"{tmp_path}/{kind}/v=1", column))
    assert read("line", "state", "NJ") == 16  # all files, where rows lie by patient
    for column, values in (("state", ["AL", "IL", "NJ", "WA"]), ("patient_id", ["p000007", "p010000", "p019999"])):
        assert all(1 <= read("curve", column, v) <= 8 for v in values), column
    assert sinks.read_version(spark, f"{tmp_path}/curve").agg(F.sum("v")).first()[0] == 19999 * 10000
    # nulls, one value, no rows
    odd = spark.createDataFrame([(None, 1), ("a", None), ("a", 1)], "a string, b int")
    assert curve.cluster(odd, ["a", "b"], 2).count() == 3 and curve.cluster(odd.where("false"), ["a", "b"], 2).count() == 0
