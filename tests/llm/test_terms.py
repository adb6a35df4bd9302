"""Counted terms, frequencies and distinctive terms against brute force."""

from __future__ import annotations

import os
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import distinctive, frequency, queries, terms
from plumbline.llm.frequency import PARTS, RadixAggregator

SCHEMA = "term string, chunk_id long, n_occ int, repo string, extra string"


def rows_of(seed: int, n: int = 600):
    rng = random.Random(seed)
    words = ["alpha", "Alpha", "ALPHA ", "straße", "STRASSE", "ﬁne", "fine", "  ", "", None, "beta", "rare", "Ångström", "hot", "hot", "hot"]
    rows = [(rng.choice(words), rng.choice([1, 2, 3, 4, 5, 99, None]), rng.choice([None, 1, 2, 7]), "r", "x") for _ in range(n)]
    return rows + rows[:40]  # exact repetitions


def brute(rows, chunks):
    seen, tf = set(), Counter()
    for term, chunk, n, repo, _ in rows:
        if term is None or chunk not in chunks or (term, chunk, n, repo) in seen:
            continue
        seen.add((term, chunk, n, repo))
        t = unicodedata.normalize("NFKC", term).casefold().strip()
        if t:
            tf[t, chunk] += 1 if n is None else n
    return tf


@pytest.mark.parametrize("seed", [1, 2])
def test_counted_terms_match_brute_force(spark, seed):
    rows, chunks = rows_of(seed), {1, 2, 3, 4, 5}
    got = terms.counted_terms(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c, "x") for c in [*chunks, 5]], "chunk_id long, extra string"))
    assert {(r.term, r.chunk_id): r.tf for r in got.collect()} == dict(brute(rows, chunks))


@pytest.mark.parametrize("block_rows", [1_000_000, 50])
def test_frequencies_match_brute_force_with_and_without_spilling(spark, tmp_path, block_rows):
    rows, chunks = rows_of(3), {1, 2, 3, 4, 5}
    ids = spark.createDataFrame([(c,) for c in chunks], "chunk_id long")
    got = frequency.term_frequencies(spark.createDataFrame(rows, SCHEMA), ids, str(tmp_path), block_rows=block_rows)
    n_occ, n_chunks = Counter(), Counter()
    for (t, _), n in brute(rows, chunks).items():
        n_occ[t] += n
        n_chunks[t] += 1
    want = {t: (n_occ[t], n_chunks[t], "rare" if n_chunks[t] < 3 else "common" if n_chunks[t] > 1 else None) for t in n_occ}
    assert {r.term: (r.n_occ, r.n_chunks, r.mark) for r in got.collect()} == want
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]  # spilled files are gone


def test_radix_recursion_reaches_its_end_for_one_hash(tmp_path):
    n = 500
    table = pa.table({"term": ["t"] * n, "form": [None] * n, "chunk_id": list(range(n)), "n_occ": [1] * n, "repo": ["r"] * n, "h": [7] * n})
    out = pa.Table.from_batches(list(RadixAggregator(PARTS, str(tmp_path), block_rows=10)(iter(table.to_batches(20)))))
    assert out.to_pylist() == [{"term": "t", "n_chunks": n, "n_occ": n}]


def test_empty_tables(spark, tmp_path):
    none, ids = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "chunk_id long")
    assert frequency.term_frequencies(none, ids, str(tmp_path)).count() == 0
    assert distinctive.score_terms(terms.counted_terms(none, ids), 0).count() == 0


def test_two_poisson_separates_its_components():
    rng = np.random.default_rng(5)
    sample = np.concatenate([rng.poisson(9.0, 300), rng.poisson(0.3, 2700)])
    values, counts = np.unique(sample[sample > 0], return_counts=True)
    share, elite, base = distinctive.fit_two_poisson(values.astype(float), counts.astype(float), np.zeros(len(values), int), 1, 3000, 200)[0]
    assert abs(share - 0.1) < 0.02 and abs(elite - 9) < 0.6 and abs(base - 0.3) < 0.1


def test_dominated_terms_match_brute_force(spark):
    rows, chunks = rows_of(4), {1, 2, 3, 4, 5}
    tf = brute(rows, chunks)
    total, df = Counter(), defaultdict(int)
    for (t, _), n in tf.items():
        total[t] += n
        df[t] += 1
    want = {(c, t) for (t, c), n in tf.items() if n >= 3 and df[t] >= 2 and 2 * n >= total[t]}
    counted = terms.counted_terms(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c,) for c in chunks], "chunk_id long")).cache()
    scored = distinctive.score_terms(counted, 5)
    scores = distinctive.score_counts(counted, 5)
    assert {(r.chunk_id, r.term) for r in distinctive.dominated(counted, scores, elite=0.0).collect()} == want
    elite = {(r.chunk_id, r.term) for r in scored.where("score >= 0.5").collect()}
    assert {(r.chunk_id, r.term) for r in distinctive.dominated(counted, scores).collect()} == want & elite
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0
    assert scored.count() == len(tf)


def test_found_terms_come_from_the_fitted_model(spark, sf, monkeypatch):
    found = queries.p3_found(spark, sf)
    assert "fitted(" in found._jdf.queryExecution().optimizedPlan().toString()
    scored = queries.p3_scores(spark, sf)
    mostly = "tf >= 3 AND n_chunks >= 2 AND 2 * tf >= n_total"
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in scored.where(mostly).select("chunk_id", "term").collect()}
    assert scored.where(mostly + " AND score < 0.9").count() == 0  # far above the bound of an elite count

    def broken(*_):
        raise ZeroDivisionError

    monkeypatch.setattr(distinctive, "posterior_elite", broken)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        queries.p3_found(spark, sf).collect()


def test_many_ids_of_chunks_are_joined_by_a_shuffle(spark):
    rows = spark.createDataFrame(rows_of(6), SCHEMA)
    ids = spark.createDataFrame([(c,) for c in (1, 2, 3, 3)], "chunk_id long")
    few, many = terms.usable_rows(rows, ids), terms.usable_rows(rows, ids, small_ids=1)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "ResolvedHint" not in many._jdf.queryExecution().analyzed().toString()


def test_the_fit_goes_on_until_it_has_converged():
    def likelihood(fit, values, counts, records):
        share, elite, base = fit
        rate = lambda k: np.log(share * np.exp(-elite) * elite**k + (1 - share) * np.exp(-base) * base**k)
        return (counts * rate(values)).sum() + (records - counts.sum()) * rate(0.0)

    cases = [([1, 2, 3], [378, 17, 1]), ([1, 2], [152, 6]), ([1, 2], [52, 1]), ([1], [1]), ([1, 2, 9], [40, 12, 3])]
    values, counts = np.concatenate([np.array(v, float) for v, _ in cases]), np.concatenate([np.array(c, float) for _, c in cases])
    owner = np.repeat(np.arange(len(cases)), [len(v) for v, _ in cases])
    fits = distinctive.fit_two_poisson(values, counts, owner, len(cases), 5484)
    longer = distinctive.fit_two_poisson(values, counts, owner, len(cases), 5484, 400)
    for i, fit in enumerate(fits):
        v, c = values[owner == i], counts[owner == i]
        assert likelihood(fit, v, c, 5484) >= likelihood(longer[i], v, c, 5484) - 1e-6
        alone = distinctive.fit_two_poisson(v, c, np.zeros(len(v), int), 1, 5484)[0]
        assert abs(likelihood(fit, v, c, 5484) - likelihood(alone, v, c, 5484)) < 1e-5  # the other terms of the batch do not matter
