"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Shards of (lang, term) rows are counted by DuckDB inside the tasks; Spark shuffles the shards and merges their sums
and rankings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, partitions, slices, tidy, written

#: What a term is made of, and the letters that are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probabilities are integers of this unit; ADD is added to each count.
UNIT, ADD = 1_000_000_000, 5
#: Code points of text and rows of counts that DuckDB gets at a time.
CHARS, ROWS = 1 << 22, 200_000
#: Sources of a block: a task compares two blocks of a language's sources.
BLOCK = 256
NOT_TERM = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _connect() -> duckdb.DuckDBPyConnection:
    """In memory, in this task's thread, without files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def _cut(text: str, chars: int) -> Iterator[str]:
    """Pieces of about so many code points that split no term (a longer term stays whole)."""
    start = 0
    while len(text) - start > chars:
        found = NOT_TERM.search(text, start + chars)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _count(most_chars: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, text) rows to (lang, term, source, n, docs), summed over many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        con.execute("CREATE TABLE seen (row BIGINT, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        held: list[tuple] = []
        row = chars = 0

        def read() -> None:
            nonlocal held, chars
            part = pa.table(list(map(pa.array, zip(*held))), names=["row", "lang", "source", "text"])
            con.register("part", part)
            con.execute(
                f"""INSERT INTO seen
                SELECT row, lang, source, term, count(*) FROM (
                    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM part
                ) GROUP BY ALL"""
            )
            con.unregister("part")
            held, chars = [], 0

        def flush() -> pa.Table:
            # a long text was read in pieces
            found = con.sql("SELECT lang, term, source, sum(n)::BIGINT AS n, count(DISTINCT row) AS docs FROM seen GROUP BY ALL").to_arrow_table()
            con.execute("TRUNCATE seen")
            return found

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    row += 1
                    for piece in _cut(text, most_chars):
                        held.append((row, lang, source, piece))
                        chars += len(piece)
                        if chars >= most_chars or len(held) >= most_rows:
                            read()
                    if chars == 0 and con.execute("SELECT count(*) FROM seen").fetchall()[0][0] > 2 * most_rows:
                        yield from flush().to_batches()
        if held:
            read()
        yield from flush().to_batches()
        con.close()
        tidy()

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch], key: list[str], rows: int, split: bool = True) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of about so many rows of sorted batches; all but the last end where the key changes, unless one key has
    more rows than that and may be split. With each, whether its last key may go on in the next."""
    held: list[pa.RecordBatch] = []
    n, schema = 0, None
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            same = None
            for name in key:
                column = table.column(name)
                last = column[-1]
                now = pc.fill_null(pc.equal(column, last), False) if last.is_valid else pc.is_null(column)
                same = now if same is None else pc.and_(same, now)
            rest = pc.sum(same).as_py()
            if rest < table.num_rows:
                yield table.slice(0, table.num_rows - rest), False
                table = table.slice(table.num_rows - rest)
            if split and table.num_rows >= rows:
                yield table, True
                table = table.slice(0, 0)
            held, n, schema = table.to_batches(), table.num_rows, table.schema
    if held or schema is not None:  # what went on ends here
        yield pa.Table.from_batches(held, schema), False


def _merge(least: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A shard's rows (lang, term, source, n, docs), sorted, to those of the kept terms: lang, term, source, n, the
    language's total, and for one row of each term lead = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        carried: pa.Table | None = None  # of a key with very many rows
        for table, goes_on in _whole_keys(batches, ["lang", "term"], most_rows):
            if carried is not None:
                table = pa.concat_tables([carried.cast(table.schema), table])
            con.register("part", table)
            sums = con.sql("SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL").to_arrow_table()
            con.unregister("part")
            carried = sums if goes_on else None
            if not goes_on:
                con.register("sums", sums)
                yield from con.sql(
                    f"""SELECT lang, term, source, n, sum(n) OVER w::BIGINT AS total,
                               (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INT AS lead
                        FROM sums WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {least}"""
                ).to_arrow_table().to_batches()
                con.unregister("sums")
        con.close()
        tidy()

    return run


def _compare(ranks: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards of two blocks of sources and a part of the terms, sorted, to partial sums of pairs and leading terms.

    The sum over terms of |p_a - p_b| is taken apart so that absent terms cost nothing: each source's terms are
    first held against the other's probability of an absent term, then the terms that both have are set right; Spark
    adds the terms that neither has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        shard = ["lang", "part", "i", "j"]
        known: pa.Table | None = None
        for table, _ in _whole_keys(batches, [*shard, "kind", "term"], most_rows, split=False):  # a term has no more rows than two blocks have sources
            if not table.num_rows:
                continue
            if known is not None:
                table = pa.concat_tables([known, table])
            con.register("part_rows", table)
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE g AS
                SELECT lang, i, j, part, source, block, n, x AS v, y AS all_n,
                       1 + ({UNIT * ADD}::HUGEINT // (n + {ADD}::HUGEINT * x))::BIGINT AS p0
                FROM part_rows WHERE kind = 0 AND x > 0"""
            )
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE p AS
                SELECT r.lang, r.i, r.j, r.part, r.term, r.source, r.block, g.p0,
                       1 + ({UNIT}::HUGEINT * (r.n + {ADD}) // (g.n + {ADD}::HUGEINT * g.v))::BIGINT AS p,
                       1 + ({UNIT}::HUGEINT * (r.x + {ADD}) // (g.all_n + {ADD}::HUGEINT * g.v))::BIGINT AS q
                FROM part_rows r JOIN g USING (lang, i, j, part, source) WHERE r.kind = 1"""
            )
            yield from con.sql(
                """SELECT 'pair' AS kind, lang, least(a, b) AS a, greatest(a, b) AS b, sum(s)::BIGINT AS value, sum(common)::BIGINT AS common FROM (
                    SELECT p.lang, p.source AS a, g.source AS b, sum(abs(p.p - g.p0)) AS s, 0 AS common
                    FROM p JOIN g USING (lang, i, j, part) WHERE p.source <> g.source AND (p.i = p.j OR p.block <> g.block) GROUP BY ALL
                    UNION ALL
                    SELECT x.lang, x.source, y.source, sum(abs(x.p - y.p) - abs(x.p - y.p0) - abs(y.p - x.p0)), count(*)
                    FROM p x JOIN p y USING (lang, i, j, part, term) WHERE x.source < y.source AND (x.i = x.j OR x.block <> y.block) GROUP BY ALL
                ) GROUP BY ALL"""
            ).to_arrow_table().to_batches()
            yield from con.sql(
                f"""SELECT 'term' AS kind, lang, source AS a, term AS b, p - q AS value, 0::BIGINT AS common FROM p
                WHERE i = j AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {ranks}"""
            ).to_arrow_table().to_batches()
            # the totals of the last shard, which may go on
            last = [table.column(c)[-1].as_py() for c in shard]
            known = con.sql("SELECT * FROM part_rows WHERE kind = 0 AND lang = ? AND part = ? AND i = ? AND j = ?", params=last).to_arrow_table().cast(table.schema)
            con.unregister("part_rows")
        con.close()
        tidy()

    return run


def _block_pairs(mine: Column, blocks: Column) -> Column:
    """The pairs of blocks that a row of block `mine` takes part in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(other, mine).alias("i"), F.greatest(other, mine).alias("j")))


def source_divergence(
    docs: DataFrame, least_docs: int = 30, ranks: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    block: int = BLOCK, chars: int = CHARS, rows: int = ROWS,
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of a language and a source the distances to the other
    sources of the language (part `pair`) and the terms that it has more of than its language (part `term`).

    Null text, language and source count as ''. Terms are what TERM matches, A-Z lower-cased; a language keeps the
    terms that occur in at least `least_docs` of its documents (rows: a repeated row counts again). With n the count
    of a kept term, N their sum and V the number of the language's kept terms, p = 1 + floor(UNIT * (n + ADD) /
    (N + ADD * V)), in whole numbers. A pair's value is the sum of |p - q| over all kept terms (0 if there are none),
    a term's value p of the group less p of the language. Ranks go by value, largest first, then by the item's
    UTF-8 bytes; pairs have all ranks, terms the first `ranks`. A group without terms has pairs; a language's
    only source has no pair; an empty table gives an empty table. Long texts are read in pieces that split no term.
    Columns of `docs` other than the three are not read, whatever their names.

    Counts are summed in each task, then per shard, a hash of language and term, so neither a large source nor a
    frequent term meets one task unsummed. Distances are sums per pair of blocks of about `block` sources and part of
    the terms. A task gives DuckDB about `chars` code points or `rows` counts at a time, and no files.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = texts.mapInArrow(_count(chars, rows), "lang string, term string, source string, n long, docs long")
    shards = counts.repartition(p, "lang", "term").sortWithinPartitions("lang", "term")
    terms = written(shards.mapInArrow(_merge(least_docs, rows), "lang string, term string, source string, n long, total long, lead int"), "audit-terms")

    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("own"), F.sum("lead").alias("lead"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "own", "lead"])
    groups = written(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(
        F.sum("n").alias("all_n"), F.sum("lead").alias("v"), F.sum("own").alias("rows"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    langs = written(langs.coalesce(p), "audit-langs")
    whole = groups.join(langs, "lang")
    mine = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    kept = join_sized(terms, langs.select("lang", "blocks", "rows"), ["lang"], "rows")
    present = kept.withColumn("block", mine).select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(p)).cast("int").alias("part"), F.explode(_block_pairs(F.col("block"), F.col("blocks"))).alias("ij"),
        F.lit(1).alias("kind"), "term", "source", "block", "n", F.col("total").alias("x"), F.lit(0).cast("long").alias("y"),
    )
    everywhere = whole.withColumn("block", mine).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    totals = everywhere.select(
        "lang", "part", F.explode(_block_pairs(F.col("block"), F.col("blocks"))).alias("ij"),
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), "source", "block", "n", F.col("v").alias("x"), F.col("all_n").alias("y"),
    )
    dealt = present.unionByName(totals).select("lang", "part", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "kind", "term", "source", "block", "n", "x", "y")
    dealt = dealt.repartition(p, "lang", "part", "i", "j").sortWithinPartitions("lang", "part", "i", "j", "kind", "term")
    found = written(dealt.mapInArrow(_compare(ranks, rows), "kind string, lang string, a string, b string, value long, common long"), "audit-sums")

    # the pairs themselves, one side dealt to PARTS so that a language of many sources is not one task
    parts = 16
    p0 = F.when(F.col("v") > 0, 1 + F.expr(f"{UNIT * ADD}L div (n + {ADD}L * v)")).otherwise(0)
    one = whole.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), "v", p0.alias("p_a"), F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int").alias("part"))
    two = whole.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), p0.alias("p_b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    partial = found.where("kind = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("common").alias("common"))
    pairs = one.join(two, ["lang", "part"]).where("a < b").join(partial, ["lang", "a", "b"], "left")
    absent = F.col("v") - F.col("own_a") - F.col("own_b") + F.coalesce("common", F.lit(0))
    pairs = pairs.select("lang", "a", "b", (F.coalesce("value", F.lit(0)) + absent * F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.select("lang", sides, "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    lead = found.where("kind = 'term'").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("b").alias("item"), "value")
    lead = lead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(lead)
