"""Registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import distinctive, encoding, frequency, handwritten, mixing, secrets, sentences, splitting, syntax, terms
from plumbline.llm.sql import SQL  # noqa: F401
from plumbline.session import shared_dir, ship, table, write_out


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    shared_dir(spark)
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "upstream_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_reasons(spark, sf_dir).select("file_id")


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The counted terms, used twice and therefore written out, and the number of chunks."""
    ship(spark)
    chunks = table(spark, sf_dir, "chunks")
    return write_out(terms.counted_terms(table(spark, sf_dir, "chunk_terms"), chunks)), chunks.select(F.count_distinct("chunk_id")).first()[0]


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.score_terms(*_counted(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, records = _counted(spark, sf_dir)
    return distinctive.dominated(counted, distinctive.score_counts(counted, records))


def p4_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return syntax.parse_files(table(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken(p4_parsed(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(p4_parsed(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return splitting.split_regions(table(spark, sf_dir, "regions"), table(spark, sf_dir, "files"), table(spark, sf_dir, "parse_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("region_id")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return frequency.term_frequencies(table(spark, sf_dir, "chunk_terms"), table(spark, sf_dir, "chunks"), shared_dir(spark))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_frequencies(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_fragments(table(spark, sf_dir, "preview_fragments"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_spans(p7_redacted(spark, sf_dir))


def p7_preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.preview_counts(p7_redacted(spark, sf_dir), table(spark, sf_dir, "send_previews"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoding.encode_documents(table(spark, sf_dir, "documents"), offsets=True)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    shared_dir(spark)
    targets = table(spark, sf_dir, "mix_targets")
    texts = write_out(mixing.countable(table(spark, sf_dir, "documents"), targets))  # counted once, used five times
    return mixing.mix_sources(texts, targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentences.prose_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_reasons, p2_found, p3_scores, p3_found, p4_parsed, p4_found, p4_rates, p5_pieces, p5_found, p6_frequencies, p6_found, p7_redacted, p7_found, p7_preview_counts, p8_ids, p8_offsets, p9_mix, p9_shares, p10_found)}
