"""Incremental ingest: each run drains the files that are new, exactly once, into a bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import FEEDS, GLOBS, SCHEMAS, VERSION, Feed, with_lineage
from ..sources.schema_log import RESCUED, SchemaLog


def stream(spark: SparkSession, feed: Feed, source: str, kind: str, schema: T.StructType) -> DataFrame:
    """The feed's files of one format, read with a schema of its log; values stay strings in CSV, and lines that
    are no JSON are kept whole in RESCUED."""
    reader = spark.readStream.format(kind).option("maxFilesPerTrigger", feed.max_files).option("pathGlobFilter", GLOBS[kind]).options(**feed.options)
    if kind == "csv":
        reader = reader.option("header", "true")
    if kind == "json":
        schema = T.StructType([*schema, T.StructField(RESCUED, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", RESCUED)
    return reader.schema(schema).load(f"{source}/{feed.folder}")


def ingest(spark: SparkSession, feed: Feed | str, source: str, bronze: str, checkpoints: str, batch_id: str, kinds: tuple[str, ...] | None = None) -> list[StreamingQuery]:
    """Append what is new to bronze/<feed>/<format>; a sink's commit log serves one stream only. A run over the same files adds nothing. Formats whose folder
    has had no file of theirs are passed by. Each run looks at the new files first, and its rows are stored under the version of the
    feed's schema that these led to."""
    feed = FEEDS[feed] if isinstance(feed, str) else feed
    out = []
    for kind in kinds or feed.formats:
        log = SchemaLog(spark, f"{bronze}/{feed.name}/{SCHEMAS}/{kind}")
        version = log.look(f"{source}/{feed.folder}", kind, GLOBS[kind])
        if version is None:
            continue
        rows = with_lineage(stream(spark, feed, source, kind, log.schemas()[version]), feed, batch_id).withColumn(VERSION, F.lit(version))
        by = [VERSION, "_partition_date"] if feed.service_date else [VERSION]
        writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoints}/{feed.name}/{kind}").trigger(availableNow=True)
        query = writer.partitionBy(*by).start(f"{bronze}/{feed.name}/{kind}")
        query.awaitTermination()
        out.append(query)
    return out


def session_episodes(claims: DataFrame, gap_days: int = 28, late_days: int = 60) -> DataFrame:
    """Treatment episodes of a stream of claims (patient_id, service_ts, category) as session windows: the
    streaming form of gap-based sessions. A session ends one gap after its last claim, and is final once the
    watermark passes that."""
    rows = claims.withWatermark("service_ts", f"{late_days} days")
    # a gap of exactly gap_days still joins, so the window is a second wider
    window = F.session_window("service_ts", f"{gap_days * 86400 + 1} seconds")
    return rows.groupBy("patient_id", window).agg(F.min("service_ts").alias("started"), F.max("service_ts").alias("ended"), F.count(F.lit(1)).alias("claim_count"), F.array_sort(F.collect_set("category")).alias("categories"))
