"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import BY_SUFFIX
from plumbline.llm.grammars import check

#: Languages that are checked, by suffix.
CHECKED = {s: x for s, x in BY_SUFFIX.items() if x in ("python", "javascript", "typescript", "go", "java", "rust", "c", "cpp") and s not in ("jsx", "tsx")}
CHECKED |= {"json": "json", "toml": "toml"}


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, state, position) of every file that has a text and the suffix of a checked language.

    state is ``ok``, ``token`` (the derivative by the token at ``position`` is empty) or ``end`` (the text stops too early).
    Only syntax counts. An empty text is ok. Whole texts are parsed, in one pass and without a shuffle; the derivatives
    found are kept for all files of a worker. Repeated rows come out repeatedly; null texts and ids come out never.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in CHECKED.items() for x in pair])
    rows = files.select("file_id", "repo", known[suffix].alias("language"), "text").where("language IS NOT NULL AND text IS NOT NULL AND file_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [check(x, t) for x, t in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("file_id", "repo", "language")},
                    "state": pa.array([s for s, _ in got], pa.string()),
                    "position": pa.array([i for _, i in got], pa.int32()),
                }
            )

    return rows.mapInArrow(run, f"file_id {dict(rows.dtypes)['file_id']}, repo string, language string, state string, position int")


def broken(parsed: DataFrame) -> DataFrame:
    """The ids of files that do not parse, each once."""
    return parsed.where("state <> 'ok'").select("file_id").distinct()


def rates(parsed: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, rate) over the distinct files."""
    each = parsed.groupBy("file_id", "repo", "language").agg(F.max((F.col("state") != "ok").cast("long")).alias("bad"))
    out = each.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bad").alias("n_broken"))
    return out.withColumn("rate", F.col("n_broken") / F.col("n_files"))
