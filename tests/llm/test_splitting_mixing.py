from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import mixing
from plumbline.llm.splitting import PIECE, UNEVEN, cut_profile, split_lines, split_regions


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 90), st.integers(0, 30), st.integers(-2, 40), st.randoms())
def test_pieces_cover_the_region_within_the_limit(n, overlap, limit, rng):
    pieces = split_lines(5, 4 + n, limit, overlap, np.array([rng.random() * 30 for _ in range(n)]))
    limit, lap = max(1, limit), max(0, min(overlap, max(1, limit) - 1))
    assert pieces[0][0] == 5 and pieces[-1][1] == 4 + n
    assert all(1 <= b - a + 1 <= limit for a, b in pieces)
    assert all(y[0] == x[1] - lap + 1 and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    n, limit, lap = 11, 5, 1
    price = rng.integers(0, 40, n).astype(float)
    wanted = (n - lap) / -(-(n - lap) // (limit - lap))

    def cost(ends):
        at, total = lap, 0.0
        for e in ends:
            if not 0 < e - at <= limit - lap:
                return np.inf
            total += PIECE + UNEVEN * ((e - at - wanted) / wanted) ** 2 + (price[e - 1] if e < n else 0)
            at = e
        return total

    best = min(cost((*c, n)) for k in range(5) for c in itertools.combinations(range(lap + 1, n), k))
    assert cost([b for _, b in split_lines(1, n, limit, lap, price)]) == pytest.approx(best)


def test_profile_prefers_blank_lines_and_little_indentation():
    p = cut_profile("def a():\n    x\n\ndef b():\n    y\n        z\n")
    assert len(p) == 6 and p[2] < p[0] < p[4] + 1 and cut_profile("") == b"" and len(cut_profile("a\n\n")) == 2


def test_regions(spark):
    text = "\n".join(f"l{i}" for i in range(30)) + "\n"
    files = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", "a")], "file_id long, text string, repo string")
    regions = spark.createDataFrame(
        [(1, 1, "r", "a.py", None, 1, 999), (1, 1, "r", "a.py", None, 1, 999), (2, 1, "r", "a.py", "python", 0, 9), (3, 1, "r", "a.py", "python", 9, 3), (4, 1, "r", "a.py", "python", None, 9), (5, 2, "r", "a.py", "python", 1, 99), (6, 3, "r", "a.py", "python", 1, 99), (7, 1, "s", "a.py", "python", 1, 30), (8, 1, "r", "a.zz", None, 1, 30), (9, 9, "r", "a.py", "python", 1, 30)],
        "region_id long, file_id long, repo string, file_path string, language string, start_line int, end_line int",
    )
    limits = spark.createDataFrame([("python", None, 10, 2), ("python", "s", 40, 0)], "language string, repo string, max_chunk_lines int, overlap_lines int")
    got = split_regions(regions, files, limits).orderBy("piece_no").collect()
    assert {r.region_id for r in got} == {1} and [r.piece_no for r in got] == list(range(1, got[0].n_pieces + 1))
    assert got[0].start_line == 1 and got[-1].end_line == 30 and all(r.end_line - r.start_line < 10 for r in got)
    assert split_regions(regions.limit(0), files, limits).count() == 0 == split_regions(regions, files.limit(0), limits).count()


def texts_of(spark, sizes):
    return spark.createDataFrame([(s, f"{s}{i}", i, n) for s, ns in sizes.items() for i, n in enumerate(ns)], "source string, text_key string, doc_id long, n_tokens long")


def test_mix_reaches_its_shares_and_keeps_to_max_repeats(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": rng.integers(20, 400, 900).tolist(), "b": rng.integers(20, 400, 300).tolist(), "c": [100] * 40}
    targets = spark.createDataFrame([(" A", 0.5, 1), ("b", 0.3, 2), ("C ", 0.2, 5), ("none", 0.0001, 3)], "source string, target_share double, max_repeats int")
    texts = texts_of(spark, sizes)
    mix = mixing.mix_sources(texts, targets).toPandas()
    tokens = (mix.n_tokens * mix.copies).groupby(mix.source).sum()
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert tokens[s] / tokens.sum() == pytest.approx(share, abs=0.01)
    assert (mix.groupby("source").copies.max() <= pd.Series({"a": 1, "b": 2, "c": 5})).all() and (mix.copies >= 1).all() and not mix.duplicated(["source", "doc_id"]).any()
    again = mixing.mix_sources(texts, targets).toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, mix.values))  # the seed decides
    shares = {r.source: r for r in mixing.reached_shares(mixing.mix_sources(texts, targets), targets).collect()}
    assert shares["none"].n_tokens == 0 and sum(r.reached_share for r in shares.values()) == pytest.approx(1)


def test_longer_texts_are_drawn_more_often():
    tokens, mean = pd.Series([1000.0, 1000.0]), pd.Series([4.0, 400.0])
    p = mixing.solved_inclusion(600.0, tokens, mean)
    assert p[1] > p[0] and (p * tokens).sum() == pytest.approx(600, rel=1e-6)


def test_countable_and_empty(spark):
    docs = spark.createDataFrame([(1, "hi you", " A "), (2, "hi you", "a"), (3, "", "a"), (4, None, "a"), (5, "x", None), (6, "y", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    got = mixing.countable(docs, targets).collect()
    assert [(r.source, r.doc_id, r.n_tokens) for r in got] == [("a", 1, 2)]
    empty = mixing.countable(docs.limit(0), targets)
    assert mixing.mix_sources(empty, targets).count() == 0 and mixing.reached_shares(mixing.mix_sources(empty, targets), targets).collect()[0].reached_share == 0


@pytest.mark.parametrize("share", [1.0, 0.3, 0.7])
def test_the_cap_is_exact_at_any_size(spark, share):
    n = 25_000_000_000_001
    texts = texts_of(spark, {"a": [n, 40, 7], "b": [n * 3] * 9})
    targets = spark.createDataFrame([("a", share, 4), ("b", 1 - share, 4)], "source string, target_share double, max_repeats int")
    mix = {(r.source, r.doc_id): r.copies for r in mixing.mix_sources(texts, targets).collect()}
    assert max(mix.values()) <= 4 and {mix["a", i] for i in range(3)} == {4}
