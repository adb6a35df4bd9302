"""The counted terms of chunks: one row per term and chunk, from a dirty term index."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrow import map_distinct


def fold(term: str) -> str | None:
    """NFKC, full case folding, trimming; None for what is blank then."""
    return unicodedata.normalize("NFKC", term).casefold().strip() or None


@F.arrow_udf(T.StringType())
def folded(term: pa.Array) -> pa.Array:
    return map_distinct(term, fold)


#: Up to so many ids of chunks (32 MB) are sent to all executors; more are joined by a shuffle.
SMALL_IDS = 4_000_000


def usable_rows(chunk_terms: DataFrame, chunks: DataFrame, small_ids: int = SMALL_IDS) -> DataFrame:
    """Rows (form, term, chunk_id, n_occ, repo, n) that count: term folded and not blank, chunk_id in chunks, null n_occ as 1.

    ``form`` is the written form where it differs from the folded one, else null: with term it still tells all forms apart.
    Repeated rows are still there. Only the named columns are read, so further columns do not matter. The ids of chunks
    are broadcast only if counted to be few enough; beyond that both sides are shuffled, with the same result.
    """
    ids = chunks.select("chunk_id").where(F.col("chunk_id").isNotNull())
    few = ids.count() <= small_ids
    rows = chunk_terms.select(F.col("term").alias("raw"), folded("term").alias("term"), "chunk_id", "n_occ", "repo").where(F.col("term").isNotNull())
    known = rows.join(F.broadcast(ids.distinct()) if few else ids, "chunk_id", "left_semi")
    return known.select(
        F.when(F.col("raw") != F.col("term"), F.col("raw")).alias("form"), "term", "chunk_id", "n_occ", "repo", F.coalesce(F.col("n_occ").cast("long"), F.lit(1)).alias("n")
    )


def counted_terms(chunk_terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf): exact repetitions of a row count once, then the forms of a term in a chunk are added up.

    One shuffle on (term, chunk_id) serves both steps; no key holds more than the forms of one term in one chunk.
    """
    rows = usable_rows(chunk_terms, chunks).drop("n").repartition("term", "chunk_id").distinct()
    return rows.groupBy("term", "chunk_id").agg(F.sum(F.coalesce(F.col("n_occ").cast("long"), F.lit(1))).alias("tf"))
