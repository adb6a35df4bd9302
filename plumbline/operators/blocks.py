"""The best rows of many questions by sums over shared terms, exactly and in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import write_out

#: Rows and questions of one block.
ROWS, QUESTIONS = 20_000, 20_000
#: What a question's term is for: its parts are added, its rows are counted, or its group must be there.
PART, COUNT, LITERAL = 0, 1, 2


def _scorer(k: int, gated: bool):
    def best(asked: pa.Table, posts: pa.Table) -> pa.Table:
        key, ids = posts["key"].to_numpy(), posts["id"].to_numpy()
        place = key < 0
        if place.any():
            at = posts.filter(pa.array(place)).combine_chunks()
            inside = at["id"].to_numpy()[pc.sort_indices(at, [("path", "ascending"), ("part", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()]
        else:
            inside = np.unique(ids)
        by_id = np.argsort(inside, kind="stable")
        order = np.argsort(np.where(place, -1, key), kind="stable")[place.sum() :]
        column = by_id[np.searchsorted(inside, ids[order], sorter=by_id)]
        part, (keys, first) = posts["part"].to_numpy()[order], np.unique(key[order], return_index=True)
        rows = {t: (column[i:j], part[i:j]) for t, i, j in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(order)])}

        def scored(terms: tuple) -> tuple[np.ndarray, np.ndarray]:
            added, counted = np.zeros(len(inside)), np.zeros(len(inside))
            groups: dict[int, list[np.ndarray]] = {}
            for kind, t, group, _ in terms:
                if kind == LITERAL:
                    groups.setdefault(group, []).append(rows[t][0])
            if gated:
                seen = np.zeros(len(inside), np.int32)
                for x in groups.values():
                    seen[np.concatenate(x)] += 1  # once for each group, also where several of its terms are
                need = max(x[3] for x in terms)
                if not groups or not (seen >= need).any():
                    return np.empty(0, int), np.empty(0)
            for kind, t, *_ in terms:
                if kind == PART:
                    added[rows[t][0]] += rows[t][1]
                elif kind == COUNT:
                    counted[rows[t][0]] += 1
            hit = (added > 0) | (counted > 0)
            found = np.flatnonzero(hit & (seen >= need) if gated else hit)
            score = np.maximum(np.round(added[found], 6), counted[found])
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                more = np.flatnonzero(score > least)
                kept = np.concatenate([more, np.flatnonzero(score == least)[: k - len(more)]])
                found, score = found[kept], score[kept]
            return found, score

        asked = asked.sort_by([("qid", "ascending"), ("kind", "ascending"), ("key", "ascending"), ("grp", "ascending")])
        held = np.isin(asked["key"].to_numpy(), keys)
        q = asked["qid"].to_numpy()[held]
        terms = list(zip(*[asked[c].to_numpy()[held].tolist() for c in ("kind", "key", "grp", "need")]))
        qs, start = np.unique(q, return_index=True)
        known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # questions that say the same of this block have the same rows
        out = []
        for a, i, j in zip(qs.tolist(), start.tolist(), [*start[1:].tolist(), len(q)]):
            said = tuple(terms[i:j])
            if said not in known:
                known[said] = scored(said)
            if len(known[said][0]):
                out.append((a, *known[said]))
        if not out:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"qid": np.repeat([a for a, *_ in out], [len(x) for _, x, _ in out]), "id": inside[np.concatenate([x for _, x, _ in out])], "score": np.concatenate([s for *_, s in out])})

    return best


def best_sums(asked: DataFrame, posts: DataFrame, k: int, n_rows: int, places: DataFrame | None = None, block_rows: int = ROWS, block_questions: int = QUESTIONS) -> DataFrame:
    """(qid, id, score): at least the k best rows of each question, and k at most of each block; a window over them finds the k best.

    ``asked`` (qid, kind, term, grp, need) and ``posts`` (id, kind, term, part), once for each id, kind and term. The score is the
    greater of the sum of parts, rounded to six digits, and the count of terms. With ``places`` (id, path, line) ties go by path, line and id, and
    only rows come out that have literal terms of ``need`` groups; without, ties go to the lower id. Every block of questions meets every block
    of rows, as for nearest vectors, so pairs of a question and a row never leave a task but for the best.
    """
    spark = asked.sparkSession
    asked = write_out(asked)
    of = F.when(F.col("kind") == LITERAL, COUNT).otherwise(F.col("kind"))
    keys = write_out(asked.select(of.alias("kind"), "term").distinct().withColumn("key", F.monotonically_increasing_id()))
    n_r, n_q = max(1, ceil(n_rows / block_rows)), max(1, ceil(asked.select("qid").distinct().count() / block_questions))
    left = asked.withColumn("of", of).join(keys.withColumnRenamed("kind", "of"), ["of", "term"]).select("qid", "kind", (F.col("key") + F.lit(0)).alias("key"), "grp", "need")  # a column of its own, as one plan holds both sides
    right = posts.join(F.broadcast(keys), ["kind", "term"]).select("id", "key", F.col("part").cast("double").alias("part"), F.lit(None).cast("string").alias("path"))
    if places is not None:
        right = right.unionByName(places.select("id", F.lit(-1).cast("long").alias("key"), F.col("line").cast("double").alias("part"), "path"))
    blocks = lambda df, by, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = blocks(left, "qid", "_q", n_q, "_r", n_r), blocks(right, "id", "_r", n_r, "_q", n_q)
    scorer = _scorer(k, places is not None)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            a, b = a.slice(0, 0), b.slice(0, 0)
        return scorer(a, b)

    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(best, "qid long, id long, score double")
