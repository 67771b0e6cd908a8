"""Tables written on the way: they cut a plan that is used several times or would grow round by round."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The list that the paths of written tables go to, for their owner to delete.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a temporary one, but only if
    driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="carepath-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, so that a lost executor costs no recomputation, and read back. The
    table stays until its owner (`owned`, `scratch`) deletes it or the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/carepath/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    mine = _owner.get()
    if mine is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    return written(df, "cut")


@contextmanager
def owned(paths: list[str]) -> Iterator[list[str]]:
    """Within this, the paths of written tables are added to `paths`. DataFrames made from them read them when they
    run, so the owner deletes them, with `delete`, only when these have been written or are no longer needed."""
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within this are deleted at its end: write or collect what reads them before."""
    paths: list[str] = []
    try:
        with owned(paths):
            yield paths
    finally:
        delete(spark, paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
