"""Identity resolution: exact and phonetic keys, merged transitively; one golden record per person.

`resolve` looks at all records at once. `link` takes a load's records alone and joins them to the persons that earlier
loads found, whose ids stay: of persons that a load finds to be one, the oldest keeps its id, and the others are
redirected to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .lineage import written

#: What the loads leave behind: which person each key belongs to since it was first seen, and which ids have given
#: way to which. `since` is the load that the person came with.
KEYS = "key string, patient_id string, since int, load int"
REDIRECTS = "old_id string, patient_id string, since int, load int"


def _keyed(people: DataFrame) -> DataFrame:
    """With the record's own key and its matching keys; a row that lacks a part of a key has no such key."""
    norm = lambda c: F.regexp_replace(F.upper(F.trim(c)), "[^A-Z]", "")
    filled = lambda c: F.when(F.length(c) > 0, c)
    last, first = filled(norm(F.col("last_name"))), filled(norm(F.col("first_name")))
    born = F.col("date_of_birth").cast("string")
    exact = F.when(last.isNotNull() & born.isNotNull() & F.col("zip5").isNotNull(), F.concat_ws("|", last, born, F.col("zip5")))
    fuzzy = F.when(last.isNotNull() & born.isNotNull() & first.isNotNull(), F.concat_ws("|", F.soundex(first), last, born))
    return people.withColumns({"_own": exprs.key(F.col("source_system"), F.col("source_patient_id")), "_exact": exact, "_fuzzy": fuzzy})


def _nodes(people: DataFrame) -> DataFrame:
    """The records numbered (node, source_system, source_patient_id), with their keys as hashes: the matching ones, and their own one, which
    tells a record that comes twice. The table is written, as numbers are to hold wherever it is read."""
    kinds = [(0, "_exact"), (1, "_fuzzy"), (2, "_own")]
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.unhex(F.sha2(F.concat_ws("|", F.lit(str(k)), c), 256))) for k, c in kinds]))
    return written(_keyed(people).select(F.monotonically_increasing_id().alias("node"), "source_system", "source_patient_id", keys.alias("keys")), "nodes")


def _own() -> Column:
    return F.unhex(exprs.key(F.col("source_system"), F.col("source_patient_id")))


def _hex(c: str | Column) -> Column:
    return F.lower(F.hex(c))


def resolve(people: DataFrame) -> DataFrame:
    """`people` (source_system, source_patient_id, first_name, last_name, date_of_birth, zip5) with patient_id and
    match_group.

    Rows with the same last name, birth date and ZIP are one person, and so are rows with the same soundex of
    the first name, last name and birth date; groups that share either key are merged. A row that lacks a part
    of a key has no such key, so incomplete rows never collapse.
    """
    nodes = _nodes(people)
    labels = _settle(nodes.select("node", F.lit(0).alias("since"), _own().alias("id"), "keys"))
    found = nodes.select("node", _own().alias("_key")).join(labels.select("node", "id"), "node").select("_key", "id").distinct()
    rows = _keyed(people).withColumn("_key", F.unhex("_own")).drop("_own").join(found, "_key", "left")
    own = _hex("_key")
    return rows.withColumns({"patient_id": F.coalesce(_hex("id"), own), "match_group": F.coalesce("_exact", own)}).drop("_key", "id", "_exact", "_fuzzy")


def _settle(nodes: DataFrame) -> DataFrame:
    """Nodes (node, since, id, keys) to (node, since, id): the least since and id among the nodes that keys connect. Nodes that
    share no key are not listed.

    Hashes are shuffled once to find the least node of each key. From there on links are pairs of numbers, and hashes come in
    again once for the labels, so no round carries them.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("least"))
    links = _stars(keyed.join(least, "key").where("least < node").select("node", "least").distinct())
    members = links.unionByName(links.select(F.col("least").alias("node"), "least").distinct())
    label = nodes.select("node", F.struct("since", "id").alias("label")).join(members, "node").groupBy("least").agg(F.min("label").alias("label"))
    return written(members.join(label, "least").select("node", "label.since", "label.id"), "labels")


def _stars(links: DataFrame) -> DataFrame:
    """Links (node, least), each to a lesser node, to one link of each node to the least that can be reached.

    A round links each node to the least neighbour of those that it is linked to, then those to each other's least: paths
    get shorter by half or more. Each round is written; rounds go on until links are stars. A node with many links is joined to its
    least, never gathered.
    """
    links = written(links, "links")
    while True:
        ends = links.unionByName(links.select(F.col("least").alias("node"), F.lit(None).cast("long").alias("least")))
        several = ends.groupBy("node").agg(F.min("least").alias("a"), F.max("least").alias("b"), F.count(F.lit(1)).alias("n"), F.count("least").alias("up"))
        if several.where("a < b or (up > 0 and up < n)").isEmpty():
            return links
        low = links.groupBy("node").agg(F.min("least").alias("low"))
        far = links.join(low.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("low", "least").alias("least"))
        low = far.groupBy("node").agg(F.min("least").alias("low"))
        rest = far.join(low, "node").where("low < least").select(F.col("least").alias("node"), F.col("low").alias("least"))
        links = written(rest.unionByName(low.withColumnRenamed("low", "least")).distinct(), "links")


@dataclass
class Linked:
    """What a load adds: `records` (source_system, source_patient_id, patient_id, load), `keys` and `redirects`."""

    records: DataFrame
    keys: DataFrame
    redirects: DataFrame


def no_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KEYS).limit(0)  # by which plans know that it is empty


def no_redirects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REDIRECTS).limit(0)


def link(people: DataFrame, keys: DataFrame, redirects: DataFrame, load: int) -> Linked:
    """The persons of a load's records (as for `resolve`), given the keys and redirects that earlier loads left.

    Records that share a key with a known person belong to it, and so does a record that was seen before, whatever has
    changed in it. Records that match no known person are a new one, named by their least own hash. Where records join several
    known persons, the one of the earliest load (then the least id) keeps its id and the others are redirected to it.
    Nothing is taken apart again: a person keeps the keys that its records once had.

    The work grows with the load: of the known keys only those that it touches are joined, and labels are settled among its
    records and the persons touched.
    """
    rows = _nodes(people)
    touched = keys.select(F.unhex("key").alias("key"), F.unhex("patient_id").alias("id"), "since").join(rows.select(F.explode("keys").alias("key")), "key", "left_semi")
    touched = touched.select("key", _hex("id").alias("patient_id"), "since")
    # a known key is a node of its own, and the person that all of its person's keys have in common
    person = F.unhex(F.concat(F.lit("00"), "patient_id"))
    known = current_ids(touched, redirects).select((-1 - F.monotonically_increasing_id()).alias("node"), "since", F.unhex("patient_id").alias("id"), F.array("key", person).alias("keys"))
    known = written(known, "known")
    labels = _settle(rows.select("node", F.lit(load).alias("since"), _own().alias("id"), "keys").unionByName(known))
    own = {"id": F.coalesce("id", _own()), "since": F.coalesce("since", F.lit(load))}
    found = rows.join(labels, "node", "left").withColumns(own)
    records = found.select("source_system", "source_patient_id", "id").distinct()
    fresh = found.select(F.explode("keys").alias("key"), "id", "since").dropDuplicates(["key"]).join(known.select(F.col("keys")[0].alias("key")), "key", "left_anti")
    moved = known.select("node", F.col("id").alias("old")).join(labels, "node").where("old <> id").select("old", "id", "since").distinct()
    return Linked(
        records.select("source_system", "source_patient_id", _hex("id").alias("patient_id"), F.lit(load).alias("load")),
        fresh.select(_hex("key").alias("key"), _hex("id").alias("patient_id"), "since", F.lit(load).alias("load")),
        moved.select(_hex("old").alias("old_id"), _hex("id").alias("patient_id"), "since", F.lit(load).alias("load")),
    )


def add_redirects(redirects: DataFrame, more: DataFrame) -> DataFrame:
    """All redirects after a load, each straight to a person that is current."""
    step = more.select(F.col("old_id").alias("patient_id"), F.col("patient_id").alias("_to"), F.col("since").alias("_since"))
    kept = redirects.join(step, "patient_id", "left").select("old_id", F.coalesce("_to", "patient_id").alias("patient_id"), F.coalesce("_since", "since").alias("since"), "load")
    return kept.unionByName(more)


def current_ids(df: DataFrame, redirects: DataFrame) -> DataFrame:
    """`df` with each patient_id (and `since`, if it has it) that has given way replaced by the current one."""
    to = redirects.select(F.col("old_id").alias("patient_id"), F.col("patient_id").alias("_to"), F.col("since").alias("_since"))
    found = df.join(to, "patient_id", "left")
    swapped = {"patient_id": F.coalesce("_to", "patient_id")} | ({"since": F.coalesce("_since", "since")} if "since" in df.columns else {})
    return found.withColumns(swapped).select(*df.columns)


def golden_records(resolved: DataFrame) -> DataFrame:
    """One row per patient_id: the EHR's newest record, else the newest."""
    w = Window.partitionBy("patient_id").orderBy(F.when(F.col("source_system") == "EHR", 0).otherwise(1), F.col("_ingestion_timestamp").desc(), "source_system", "source_patient_id")
    return resolved.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def patient_xref(resolved: DataFrame) -> DataFrame:
    """Which person each source's id belongs to; facts of any source find their patient through it."""
    return resolved.select("source_system", "source_patient_id", "patient_id").distinct()
