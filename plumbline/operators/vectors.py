"""Nearest vectors of a stated set of queries, exactly and in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.windows import top_k

#: Rows and queries of one block.
ROWS, QUERIES = 20_000, 2_000


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block_rows: int = ROWS, block_queries: int = QUERIES) -> DataFrame:
    """(qid, id, score, rank): the k rows of greatest cosine for each query, without the query itself.

    Every block of queries meets every block of rows in one matrix product, whose k best of each query go on; so no task
    holds more than a block of each, whatever the tables' sizes, and no pair leaves a block but for the best. Repeated rows
    count once, null vectors give nothing, a zero vector has cosine 0, ties go to the lower id.
    """
    clean = lambda df: df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    r, q = clean(rows), clean(queries)
    n_r, n_q = max(1, ceil(r.count() / block_rows)), max(1, ceil(q.count() / block_queries))
    blocks = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = blocks(q, "_q", n_q, "_r", n_r), blocks(r, "_r", n_r, "_q", n_q)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        b = b.sort_values("id")
        ids, asked = b["id"].to_numpy(), a["id"].to_numpy()
        score = np.round(_unit(a["v"]) @ _unit(b["v"]).T, 6) + 0.0
        score[asked[:, None] == ids[None, :]] = -2.0
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"qid": np.repeat(asked, top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})
        return out[out["score"] > -2.0]

    pairs = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(best, "qid long, id long, score double")
    return top_k(pairs, ["qid"], [F.desc("score"), F.col("id")], k).select("qid", "id", "score", "rank")
