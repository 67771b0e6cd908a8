"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_ids, map_batches, pieces, texts_of, written
from .near import jaccard_verifier, near_links
from .shingles import SHINGLE, band_keys, choose_bands, shingles

SIMILARITY, RECALL = 0.8, 0.9995


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text").where("id is not null")


def signatures(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    """(id, text) to (id, same, bands): a 128-bit digest of the set of n-grams, and its MinHash band keys."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            same, keys = [], []
            for a, b in pieces(texts, 1 << 18):
                hashes, sizes = shingles(texts[a:b], n)
                ends = np.cumsum(sizes)
                for s, e in zip((ends - sizes).tolist(), ends.tolist()):
                    same.append(xxhash.xxh3_128_digest(np.unique(hashes[s:e]).tobytes()))
                found = band_keys(hashes, sizes, bands, band_rows).view(np.int64)
                keys += [row if size else row[:0] for row, size in zip(found, sizes.tolist())]
            flat = pa.array(np.concatenate(keys), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), lists], names=["id", "same", "bands"])

        return f

    return map_batches(rows, make, "id long, same binary, bands array<long>")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, text) to (id, payload): the sorted set of 64-bit n-gram hashes."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingles([t], n)[0]).tobytes() for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "payload"])

        return f

    return map_batches(rows, make, "id long, payload binary")


def jaccard_links(rows: DataFrame, similarity: float, recall: float, n: int) -> DataFrame:
    """near_links of (id, text) rows, of which ids are unique."""
    bands, band_rows = choose_bands(similarity, recall)
    items = written(signatures(rows, n, bands, band_rows), "signatures")
    return near_links(items, lambda ids: shingle_sets(join_ids(rows, ids, "id", "left_semi"), n), "binary", jaccard_verifier(similarity))


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs` with an id: doc_id, class_id, class_size, copies, n_links.

    Words are what white space separates, in lower case, without characters at their ends that are neither
    letters nor digits; a text of fewer than n words has one n-gram, of all its words. Two documents are
    linked when the Jaccard similarity of their sets of n-grams is at least `similarity`; the bands are
    chosen so that a pair at that similarity collides with probability `recall`, and colliding pairs are
    verified on the full sets of 64-bit hashes. n_links counts the documents linked to one, class_id is the
    smallest doc_id of its connected component. Documents with equal sets (`copies`) are linked to each
    other and have the same links. Null and empty texts and texts without words are linked to nothing. Rows without an
    id are left out; rows that share an id count as copies only if their texts' sets are equal. An empty
    table gives an empty table. Texts are read whole, and columns of `docs` other than the two are not read, whatever
    their names.
    """
    return jaccard_links(_rows(docs, id_col, text_col), similarity, recall, n).withColumnRenamed("id", "doc_id")


def ngram_dedup(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each class the one with the smallest id. Rows without an id stay; of rows
    that share an id all stay unless each is of a class that another leads, so no class loses its last text. No column
    is added, so no name clashes."""
    classes = ngram_join(docs, similarity, recall, n, id_col, text_col)
    gone = written(classes.groupBy(F.col("doc_id").alias(id_col)).agg(F.max(F.col("class_id") == F.col("doc_id")).alias("leads")).where("not leads").select(id_col), "near-gone")
    return join_ids(docs, gone, id_col, "left_anti")

