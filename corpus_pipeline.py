"""The corpus pipeline: documents through five of the training-data operators, each stage's output written
as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carepath.llm import common, exact_dedup, ngram_join, packing, quality, substring_dedup


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go. Null and empty texts have a score like any
    other, rows that repeat have the same one, rows without an id are scored too, and long texts are read whole."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays: the longest, then the one with the smallest id. Null, empty and
    blank texts are equal; rows without an id, and those that repeat a row that stays, stay."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-gram Jaccard similarity of 0.8 or more one stays, that with the smallest
    id. Texts without words are linked to nothing, and rows without an id stay."""
    return ngram_join.ngram_dedup(docs, similarity=0.8, n=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents share stay in the one with the smallest id; a document that loses all its text goes. Null and
    empty texts, and rows without an id, stay as they are; rows that share an id are one document."""
    return substring_dedup.substring_dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document. Null and empty texts are one token, the end
    id; rows that repeat are packed one by one, and long texts cut freely."""
    return packing.pack_documents(docs, tokens=1024, segments=128, end_id=0).drop("n_loss")


# Every stage gives an empty table for an empty one, and keeps columns of other names as they are, whatever these names.
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Scratch tables of the stages called so far, by application: the stage's place in STAGES and its paths.
_made: dict[str, list[tuple[int, list[str]]]] = {}


def _step(place: int, stage: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the pipeline's earlier stages, whose output
    is written by then, and no others."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _made.setdefault(spark.sparkContext.applicationId, [])
        for k, paths in made:
            if k < place:
                common.delete(spark, paths)
        made[:] = [(k, paths) for k, paths in made if paths]
        paths: list[str] = []
        made.append((place, paths))
        with common.owned(paths):
            return stage(spark, docs, sf_dir)

    run_stage.__doc__ = stage.__doc__
    return run_stage


FUNCTIONS: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]
STAGES: list[tuple[str, Stage]] = [(name, _step(k, stage)) for k, (name, stage) in enumerate(FUNCTIONS)]

#: No stage but exact dedup can be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's scratch tables, and its predecessor's output, are deleted once
    its own output is written; what the last stage reads stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in FUNCTIONS[:-1]:
        after: list[str] = []
        with common.scratch(spark):
            result = stage(spark, docs, sf_dir)
            with common.owned(after):
                docs = common.written(result, f"stage-{name}")
        common.delete(spark, before)
        before = after
    return FUNCTIONS[-1][1](spark, docs, sf_dir)
