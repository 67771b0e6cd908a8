"""Sinks: snapshot partitions, versioned tables, keyed upserts, exports with status rows."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import curve
from ..operators.relational import keyed_upsert


def replace_snapshot(df: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """Write the partitions that the frame holds in place of those of the same date; others stay. Running it
    again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = hadoop(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    done = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of a table, the latest by default; older ones are the table's history. None if there is none."""
    found = versions(spark, path)
    if not found:
        return None
    return spark.read.parquet(f"{path}/v={found[-1] if version is None else version}")


def write_version(df: DataFrame, path: str, cluster_by: Sequence[str] = (), files: int | None = None) -> int:
    """A new version beside the old ones, so that the frame may read the latest. One writer at a time. Rows are
    clustered and sorted by `cluster_by` for file statistics to prune by: by several columns and a number of files
    along a curve, so that each of the columns alone prunes."""
    version = (versions(df.sparkSession, path) or [0])[-1] + 1
    if len(cluster_by) > 1 and files:
        df = curve.cluster(df, cluster_by, files)
    elif cluster_by:
        dealt = df.repartition(files, *cluster_by) if files else df.repartition(*cluster_by)
        df = dealt.sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all versions but the last `keep`."""
    for version in versions(spark, path)[:-keep]:
        at, fs = hadoop(spark, f"{path}/v={version}")
        fs.delete(at, True)


def upsert(df: DataFrame, path: str, key: Sequence[str]) -> int:
    """Merge by key into the latest version."""
    current = read_version(df.sparkSession, path)
    return write_version(df if current is None else keyed_upsert(current, df, key), path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table whose joins and aggregations by the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of the table, and of its columns but nested ones, which have none."""
    flat = [f"`{c}`" for c, t in spark.table(table).dtypes if not t.startswith(("array", "map", "struct"))]
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(flat)}")


class ExportError(RuntimeError):
    """One or more tables failed."""


def export(spark: SparkSession, tables: dict[str, DataFrame], target: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Replace each table at the target: over JDBC (truncate and insert) or as gzip CSV folders. Returns a status
    row per table; an empty table is skipped. All are tried before a failure is raised."""
    rows = []
    for name, df in tables.items():
        began = time.time()
        try:
            n = _replace_jdbc(df, name, jdbc) if jdbc else _replace_csv(df, f"{target}/{name}")
            rows.append((name, "success" if n else "skipped", n, round(time.time() - began, 3), None))
        except Exception as e:  # the other tables are still exported; the failure is raised below
            rows.append((name, "failed", 0, round(time.time() - began, 3), str(e)[:500]))
    status = spark.createDataFrame(rows, "table string, status string, row_count long, seconds double, error string")
    failed = [r[0] for r in rows if r[1] == "failed"]
    if failed:
        raise ExportError(f"failed: {', '.join(failed)}: {rows[[r[0] for r in rows].index(failed[0])][4]}")
    return status


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows are counted as they are written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _replace_jdbc(df: DataFrame, name: str, jdbc: dict[str, str]) -> int:
    if df.isEmpty():
        return 0
    rows, seen = _counted(df)
    rows.write.mode("overwrite").option("truncate", "true").options(**jdbc).format("jdbc").option("dbtable", name).save()
    return seen.get["n"]


def _replace_csv(df: DataFrame, path: str) -> int:
    """Into a new folder, which takes the place of the old one once it is whole; an empty table leaves the old one."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    rows, seen = _counted(flat)
    rows.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(f"{path}.next")
    new, fs = hadoop(df.sparkSession, f"{path}.next")
    n = seen.get["n"]
    if not n:
        fs.delete(new, True)
        return 0
    # aside, in, away: a crash leaves the old folder or the new one, if under its name for the way
    old, _ = hadoop(df.sparkSession, path)
    aside, _ = hadoop(df.sparkSession, f"{path}.last")
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"cannot rename {path}")
    if not fs.rename(new, old):
        raise OSError(f"cannot rename to {path}")
    fs.delete(aside, True)
    return n


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """What each version of a table holds: version and rows."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], "version int, n long")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/v={v}" for v in found])
    return rows.groupBy(F.col("v").cast("int").alias("version")).agg(F.count(F.lit(1)).alias("n"))


def publish_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
