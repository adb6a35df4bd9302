"""Frequency of every distinct term by recursive radix spilling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.terms import usable_rows
from plumbline.session import passing

#: Rows that one aggregation holds in memory; beyond it a partition is spilled and split by the next bits of its hash.
BLOCK_ROWS = 400_000
BITS = 4
#: Beyond this depth rows share nearly their whole hash, so they are few keys: DuckDB aggregates them as they are read.
DEPTH = 12
MEMORY = "256MB"


class RadixAggregator:
    """Runs ``sql`` (over a view named rows) on each radix class of the rows, as deep as needed; column ``h`` is the hash.

    Spilled files lie in a folder of their own below ``shared``, on whatever file system that is.
    """

    def __init__(self, sql: str, shared: str, block_rows: int = BLOCK_ROWS) -> None:
        self.sql, self.block_rows = sql, block_rows
        self.fs, root = pa.fs.FileSystem.from_uri(shared) if "://" in shared or shared.startswith("file:") else (pa.fs.LocalFileSystem(), shared)
        self.folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self.spilled = False

    def _query(self, rows: pa.Table | pa.RecordBatchReader) -> Iterator[pa.RecordBatch]:
        import duckdb

        # DuckDB spills what is beyond its memory only into the shared folder, or not at all where that is no path.
        spill = f"{self.folder}/duckdb" if isinstance(self.fs, pa.fs.LocalFileSystem) else ""
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as con:
            con.register("rows", rows)
            yield from con.sql(self.sql).to_arrow_reader(50_000)

    def run(self, batches: Iterator[pa.RecordBatch], depth: int = 0) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n > self.block_rows:
                yield from self._split(held, batches, depth)
                return
        if held:
            yield from self._query(pa.Table.from_batches(held))

    def _split(self, held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
        where = f"{self.folder}/{uuid.uuid4().hex}"
        self.fs.create_dir(where, recursive=True)
        self.spilled = True
        files: dict[int, pq.ParquetWriter] = {}

        def spill(table: pa.Table) -> None:
            radix = (table["h"].to_numpy() >> (BITS * depth)) & (2**BITS - 1)
            for r in range(2**BITS):
                if len(part := table.filter(pa.array(radix == r))):
                    if r not in files:
                        files[r] = pq.ParquetWriter(f"{where}/{r}.parquet", table.schema, compression="lz4", filesystem=self.fs)
                    files[r].write_table(part)

        spill(pa.Table.from_batches(held))
        held.clear()
        n = 0
        for batch in rest:
            held.append(batch)
            n += batch.num_rows
            if n >= self.block_rows // 4:
                spill(pa.Table.from_batches(held))
                held.clear()
                n = 0
        if held:
            spill(pa.Table.from_batches(held))
        for f in files.values():
            f.close()
        for r in sorted(files):
            path = f"{where}/{r}.parquet"
            with pq.ParquetFile(path, filesystem=self.fs) as f:
                if depth + 1 >= DEPTH:
                    yield from self._query(pa.RecordBatchReader.from_batches(f.schema_arrow, f.iter_batches(65_536)))
                else:
                    yield from self.run(f.iter_batches(65_536), depth + 1)
            self.fs.delete_file(path)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.run(batches)
        finally:
            if self.spilled:
                self.fs.delete_dir(self.folder)


def radix_aggregate(rows: DataFrame, key: list[Column], sql: str, schema: str, shared: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Partitions rows by the hash of ``key`` and aggregates each partition with ``sql`` through the radix aggregator."""
    hashed = rows.withColumn("h", F.xxhash64(*key)).repartition("h")
    shared = passing(rows.sparkSession, f"{shared.rstrip('/')}/radix-{uuid.uuid4().hex}")  # also what a lost worker leaves behind
    return hashed.mapInArrow(lambda batches: RadixAggregator(sql, shared, block_rows)(batches), schema)


#: By (term, chunk): repeated rows once, forms added up; then this partition's part of each term.
PARTS = """
SELECT term, count(*) AS n_chunks, sum(n)::BIGINT AS n_occ FROM (
  SELECT term, chunk_id, sum(n) AS n FROM (SELECT DISTINCT term, form, chunk_id, n_occ, repo, coalesce(n_occ, 1) AS n FROM rows) GROUP BY ALL) GROUP BY term
"""
TOTALS = "SELECT term, sum(n_chunks)::BIGINT AS n_chunks, sum(n_occ)::BIGINT AS n_occ FROM rows GROUP BY term"
SCHEMA = "term string, n_chunks long, n_occ long"


def term_frequencies(chunk_terms: DataFrame, chunks: DataFrame, shared: str, rare: int = 3, common: float = 0.2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(term, n_occ, n_chunks, mark) of every distinct term; mark is ``rare`` (in fewer than ``rare`` chunks), ``common`` (in
    more than the share ``common`` of all chunks) or null.

    Rows are first spread by (term, chunk), so a hot term is counted in all partitions; only its parts, one for each
    partition, meet. Null and blank terms and chunks not in ``chunks`` do not count, null n_occ counts 1, repeated rows
    once. Without chunks there are no terms.
    """
    rows = usable_rows(chunk_terms, chunks).drop("n")
    parts = radix_aggregate(rows, [F.col("term"), F.col("chunk_id")], PARTS, SCHEMA, shared, block_rows)
    totals = radix_aggregate(parts, [F.col("term")], TOTALS, SCHEMA, shared, block_rows)
    n = chunks.select(F.count_distinct("chunk_id")).scalar()  # a subquery of one value
    mark = F.when(F.col("n_chunks") < rare, "rare").when(F.col("n_chunks") > n * common, "common")
    return totals.select("term", "n_occ", "n_chunks", mark.alias("mark"))
