"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup as exact
from . import edit_fingerprint, html_extract, ngram_join, packing, prefix_bpe, quality, repair, simhash, source_audit, substring_dedup, token_counts, vector_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(documents(spark, sf_dir), labels, threshold=0.3)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokens=1024, segments=128, end_id=0).drop("n_loss")


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_spans(documents(spark, sf_dir))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_decode(documents(spark, sf_dir), "word_bpe_49k.json")


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(documents(spark, sf_dir), "byte_bpe_50k.json", end_id=2))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), similarity=0.8, n=5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), "byte_bpe_50k.json", limit=512)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(documents(spark, sf_dir), least_docs=30, ranks=50)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)


def op13_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), n=4, most=4)


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The Lloyd rounds one after another, over a row per component."""
    nearest = """codes{r} AS MATERIALIZED (
            SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
                SELECT x.row, x.part, b.entry, coalesce(sum((x.v - b.v) ** 2)::BIGINT, 0) AS d
                FROM cells x JOIN books{r} b USING (part, place) GROUP BY ALL
            ) GROUP BY ALL
        )"""
    update = """books{n} AS MATERIALIZED (
            SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM books{r} b LEFT JOIN (
                SELECT x.part, c.entry, x.place, sum(x.v) AS s, count(*) AS n,
                       (sum(x.v) // count(*) - (sum(x.v) % count(*) < 0)::INT)::BIGINT AS v
                FROM cells x JOIN codes{r} c USING (row, part) GROUP BY ALL
            ) m USING (part, entry, place)
        )"""
    steps = [(nearest if k % 2 == 0 else update).format(r=k // 2, n=k // 2 + 1) for k in range(2 * rounds + 1)]
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS MATERIALIZED (
            SELECT row, (i - 1) // (dim // {parts}) AS part, (i - 1) % (dim // {parts}) AS place, floor({4096} * embedding[i]::DOUBLE)::BIGINT AS v
            FROM (SELECT row, embedding, len(embedding) AS dim, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
        ), books0 AS MATERIALIZED (
            SELECT part, row - 1 AS entry, place, v FROM cells WHERE row <= {entries}
        ), {", ".join(steps)}, coded AS (
            SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM codes{rounds} GROUP BY row
        ), digest AS (
            SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books{rounds}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (row), digest
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_edit_fingerprints": op5_edit_fingerprints,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_repair_token_files": op8_repair_token_files,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash_components": op13_simhash_components,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), ranked AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM rows
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """,
    "op11_source_divergence": r"""
        WITH rows AS (
            SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), words AS (
            SELECT row, lang, source, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
        ), kept AS (
            SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
        ), vocabulary AS (
            SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.lang = r.lang AND c.source = r.source) AS n
            FROM (SELECT DISTINCT lang, source FROM rows) r
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n::HUGEINT + 5 * v.v) AS p,
                   1 + 1000000000::HUGEINT * (k.total + 5) // (v.all_n::HUGEINT + 5 * v.v) AS q
            FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN counts c USING (lang, source, term)
        ), distances AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL
        ), pairs AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(d.value, 0) AS value
            FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN distances d ON d.lang = x.lang AND d.source = x.source AND d.item = y.source
        ), lead AS (
            SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM lead)
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_vector_codes": _vector_codes_sql(),
}
