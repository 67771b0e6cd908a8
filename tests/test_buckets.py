import glob
import os

import pytest
from pyspark.sql import functions as F

from carepath.operators.quality import Expectation, ExpectationError
from carepath.sources import buckets


def table(spark, rows, kind="k long, v string"):
    return spark.createDataFrame(rows, kind)


def content(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(k, f"a{k}") for k in range(60)]
    assert buckets.read(spark, path) is None and buckets.manifest(spark, path) is None
    buckets.merge(table(spark, rows), path, "k", buckets=8)
    first, pinned = files(path), buckets.read(spark, path)
    m = buckets.merge(table(spark, [(7, "new"), (7, "twice"), (99, "more")]), path, "k", table(spark, [(7, None), (99, None), (11, None), (7, None)]))
    want = sorted([r for r in rows if r[0] not in (7, 11)] + [(7, "new"), (7, "twice"), (99, "more")])
    assert content(buckets.read(spark, path)) == want and m.metrics["rows"] < len(want)
    touched = {r[0] for r in table(spark, [(7, None), (11, None), (99, None)]).select(buckets.bucket_of("k", 8)).collect()}
    fresh = {f for f in files(path) if f not in first}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} <= touched and len(touched) < 8
    assert {b for b, v in m.parts.items() if v == 2} <= touched and all(files(path)[f] == t for f, t in first.items())
    # a reader of the first version still sees it whole, by itself and by number
    assert content(pinned) == content(buckets.read(spark, path, 1)) == rows
    assert content(buckets.read_key(spark, path, 7)) == [(7, "new"), (7, "twice")]
    assert len(buckets.read_key(spark, path, 7).inputFiles()) == 1


def test_a_bad_load_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    checks = [Expectation("no_value", F.col("v").isNull()), Expectation("odd_key", F.col("k") < 0)]
    m = buckets.merge(table(spark, [(1, "a"), (2, "b"), (3, "b")]), path, "k", buckets=4, checks=checks, categories=["v"])
    assert m.metrics == {"rows": 3, "violated:no_value": 0, "violated:odd_key": 0, "values:v": 2} == buckets.manifest(spark, path).metrics
    before = files(path)
    with pytest.raises(ExpectationError, match="no_value"):
        buckets.merge(table(spark, [(2, None)]), path, "k", table(spark, [(2, "")]), checks=checks)
    assert content(buckets.read(spark, path)) == [(1, "a"), (2, "b"), (3, "b")] and files(path) == before and buckets.versions(spark, path) == [1]


def test_empty_loads_new_columns_and_vacuum(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.merge(table(spark, []), path, "k", buckets=4)
    assert content(buckets.read(spark, path)) == []
    for n in range(3):
        buckets.merge(table(spark, [(n, f"v{n}")]), path, "k", table(spark, [(n, "")]))
    buckets.merge(table(spark, [(0, "w", 1)], "k long, v string, more int"), path, "k", table(spark, [(0, "")]))
    assert content(buckets.read(spark, path)) == [(0, "w", 1), (1, "v1", None), (2, "v2", None)]
    buckets.merge(table(spark, []).withColumn("more", F.lit(1)), path, "k", table(spark, [(1, "")]))
    buckets.vacuum(spark, path, keep=2)
    assert buckets.versions(spark, path) == [5, 6]
    assert content(buckets.read(spark, path)) == [(0, "w", 1), (2, "v2", None)] and len(buckets.read(spark, path, 5).collect()) == 3
    assert not [f for f in files(path) if "v=2/" in f]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = f"{tmp_path}/t"
    m = buckets.merge(table(spark, [(1, "a")]), path, "k", buckets=2)
    with pytest.raises(RuntimeError, match="another writer"):
        buckets._publish(spark, path, m)
    assert buckets.read(spark, path).count() == 1
