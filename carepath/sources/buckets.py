"""Tables in hash buckets of a key: a load rewrites the buckets that its keys fall in and no others.

A table's folder holds `data/v=<version>/bucket=<n>/` and a manifest per version, which names the version that each
bucket is of. A manifest is put in place by a rename, and only when the version's rows are written and have passed
their checks: a reader sees the old version or the new one, and a failed load leaves the old one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import Expectation, ExpectationError
from .sinks import hadoop

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """One version of a table."""

    version: int
    key: str
    buckets: int
    schema: str
    #: Of each bucket that holds rows, the version that wrote it.
    parts: dict[int, int] = field(default_factory=dict)
    #: What was observed of the rows as they were written.
    metrics: dict[str, object] = field(default_factory=dict)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = hadoop(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """A version of the table, the latest by default; None if there is none."""
    if version is None:
        found = versions(spark, path)
        if not found:
            return None
        version = found[-1]
    # one short line, read without a job
    at, fs = hadoop(spark, f"{path}/manifest/{version}.json")
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    raw = json.loads(text)
    return Manifest(raw["version"], raw["key"], raw["buckets"], raw["schema"], {int(k): v for k, v in raw["parts"].items()}, raw["metrics"])


def _publish(spark: SparkSession, path: str, new: Manifest) -> None:
    at, fs = hadoop(spark, f"{path}/manifest/.{new.version}.next")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps(new.__dict__, default=str).encode()))
    finally:
        stream.close()
    to, _ = hadoop(spark, f"{path}/manifest/{new.version}.json")
    if fs.exists(to) or not fs.rename(at, to):
        raise RuntimeError(f"{path}: another writer made version {new.version}")


def read(spark: SparkSession, path: str, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame | None:
    """The rows of a version (the latest now), or of some of its buckets. What is read stays that version's whatever is
    published later, until `vacuum` drops it. None if there is no version."""
    m = manifest(spark, path, version)
    if m is None:
        return None
    wanted = m.parts if only is None else {b: m.parts[b] for b in only if b in m.parts}
    schema = StructType.fromJson(json.loads(m.schema))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v={v}/bucket={b}" for b, v in sorted(wanted.items())])


def read_key(spark: SparkSession, path: str, value: object) -> DataFrame | None:
    """The rows of one key: one bucket is read."""
    m = manifest(spark, path)
    if m is None:
        return None
    one = spark.range(1).select(F.lit(value).cast("string").alias(m.key)).select(bucket_of(m.key, m.buckets)).first()[0]
    return read(spark, path, m.version, [one]).where(F.col(m.key) == F.lit(value))


def merge(
    rows: DataFrame, path: str, key: str, changed: DataFrame | None = None, buckets: int = BUCKETS, checks: Sequence[Expectation] = (), categories: Sequence[str] = ()
) -> Manifest:
    """Publish a version in which the keys of `changed` (a column `key`; it may repeat) have the given rows and no
    others, and all other keys what they had. Only the buckets that changed keys fall in are read and written. Without
    `changed` the whole table is replaced. Rows of keys that are not in `changed` must not be given.

    `rows` and `changed` must be cheap to read twice. `checks` are counted on the rows of the buckets as they are
    written, with the number of rows and how many values each of `categories` has (approximately, in bounded memory);
    if any is violated nothing is published and ExpectationError is raised. One writer at a time: a second one fails.
    """
    spark = rows.sparkSession
    before = manifest(spark, path)
    version = (before.version if before else 0) + 1
    if before:
        buckets, key = before.buckets, before.key
    parts: dict[int, int] = {}
    if changed is not None and before:
        ids = changed.select(key).distinct()
        touched = sorted(r[0] for r in ids.select(bucket_of(key, buckets).alias("b")).distinct().collect())  # at most `buckets`
        parts = {b: v for b, v in before.parts.items() if b not in touched}
        kept = read(spark, path, before.version, touched).join(ids, key, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    schema = rows.schema.json()
    data = f"{path}/data/v={version}"
    counted = {"rows": F.count(F.lit(1))} | {f"violated:{c.name}": F.count_if(c.violated) for c in checks} | {f"values:{c}": F.approx_count_distinct(c) for c in categories}
    metrics: dict[str, object] = dict.fromkeys(counted, 0)
    at, fs = hadoop(spark, data)
    if rows.isEmpty():  # no metrics are observed of a plan that is known to be empty
        fs.mkdirs(at)
    else:
        seen = Observation()
        dealt = rows.observe(seen, *[c.alias(n) for n, c in counted.items()]).withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(data)
        metrics = dict(seen.get)
    broken = {k.split(":", 1)[1]: v for k, v in metrics.items() if k.startswith("violated:") and v}
    if broken:
        fs.delete(at, True)
        raise ExpectationError(f"{path}: violated: {broken}")
    made = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    parts |= {int(n.split("=")[1]): version for n in made if n.startswith("bucket=")}
    new = Manifest(version, key, buckets, schema, parts, metrics)
    _publish(spark, path, new)
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all versions but the last `keep`, and the files that none of these needs. Readers of older ones fail."""
    found = versions(spark, path)
    kept = [manifest(spark, path, v) for v in found[-keep:]]
    needed = {(b, v) for m in kept for b, v in m.parts.items()}
    for v in found[:-keep]:
        at, fs = hadoop(spark, f"{path}/manifest/{v}.json")
        fs.delete(at, False)
    at, fs = hadoop(spark, f"{path}/data")
    if not fs.exists(at):
        return
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        v = int(name.split("=")[1])
        # a version beyond the last manifest is being written
        if kept and v > kept[-1].version:
            continue
        inside = [s.getPath() for s in fs.listStatus(folder.getPath())]
        mine = [p for p in inside if p.getName().startswith("bucket=")]
        live = [p for p in mine if (int(p.getName().split("=")[1]), v) in needed]
        for p in mine:
            if p not in live:
                fs.delete(p, True)
        if not live:
            fs.delete(folder.getPath(), True)
