"""Best rows by blocks against all pairs, and plans in which no pair of a question and a chunk is a row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import blocks, retrieval
from plumbline.operators.windows import top_k


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["load", "config", "the", "record", "parse", "配置文件", "parsed", "policies"]
    text = lambda n: rng.choice(["_", " "]).join(rng.choice(words + [f"w{rng.randrange(40)}x"]) for _ in range(n))
    rows = [(i, "r", f"p/{rng.randrange(30)}.py", 0, rng.randrange(3), 9, text(12), "python", text(rng.randrange(1, 4))) for i in range(1, 301)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo string, file_path string, ordinal int, start_line int, end_line int, content string, language string, symbol string")
    qs = spark.createDataFrame([(i, rows[i % 40][8], "python") for i in range(120)], "qid long, question string, q_language string")  # each text three times
    return qs, chunks, chunks.where("chunk_id % 7 <> 0").select("chunk_id")


@pytest.fixture(params=[(20_000, 20_000), (50, 9)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(blocks.best_sums, "__defaults__", (None, *request.param))


def same(got, want, columns):
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_bm25_top_is_that_of_all_pairs(spark, texts, sizes):
    qs, chunks, fresh = texts
    want = top_k(retrieval.bm25(qs, chunks, fresh=fresh), ["qid"], [F.desc("score"), F.col("chunk_id")], 5)
    same(retrieval.bm25_top(qs, chunks, 5, fresh=fresh), want, ["qid", "chunk_id", "score", "rank"])


def flow(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graded_ndcg_has_no_rows_of_pairs(spark, sf):
    assert "FlatMapCoGroupsInArrow" in flow(entry.queries()["graded_ndcg"](spark, sf))


def test_term_top_is_that_of_all_pairs(spark, texts, sizes):
    qs, chunks, _ = texts
    index = retrieval.chunk_terms(chunks)
    want = top_k(retrieval.term_matches(qs, index), ["qid"], [F.desc("matches"), F.col("chunk_id")], 5)
    same(retrieval.term_top(qs, index, 5, chunks.count()), want, ["qid", "chunk_id", "matches", "rank"])


def test_term_postings_topk_has_no_rows_of_pairs(spark, sf):
    assert "FlatMapCoGroupsInArrow" in flow(entry.queries()["term_postings_topk"](spark, sf))


def test_lexical_is_that_of_all_pairs(spark, texts, sizes):
    qs, chunks, fresh = texts
    live = chunks.join(fresh, "chunk_id", "left_semi")
    index = retrieval.chunk_terms(live)
    pairs = retrieval.bm25(qs, chunks, fresh=fresh).unionByName(retrieval.term_matches(qs, index).select("qid", "chunk_id", F.col("matches").cast("double").alias("score")))
    pairs = pairs.groupBy("qid", "chunk_id").agg(F.max("score").alias("strength")).join(retrieval.covered(qs, index), ["qid", "chunk_id"], "left_semi").join(live, "chunk_id")
    want = top_k(pairs, ["qid"], [F.desc("strength"), F.col("file_path"), F.col("start_line"), F.col("chunk_id")], 6, "position")
    same(retrieval.lexical(qs, chunks, 6, fresh), want, ["qid", "chunk_id", "strength", "position"])


def test_lexical_merge_has_no_rows_of_pairs(spark, sf):
    assert "FlatMapCoGroupsInArrow" in flow(entry.queries()["lexical_merge"](spark, sf))


def test_symbol_matches_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["load", "parse", "config", "record", "ids", "x", "policies"]
    name = lambda: rng.choice(["_", ""]).join(rng.choice(words).capitalize() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 4)))
    symbols = spark.createDataFrame([(i, "r", f"p{rng.randrange(9)}.py", name(), rng.randrange(50), 99) for i in range(300)], "symbol_id long, repo string, path string, name string, start_line int, end_line int")
    asked = [name() for _ in range(30)] + ["parsing configs", "id", "no such name", " Load "]
    qs = spark.createDataFrame([(i, asked[i % 34]) for i in range(68)], "qid long, question string")
    got = {}
    for r in retrieval.symbol_matches(qs, symbols, 10).collect():
        got.setdefault(r.qid, {})[r.symbol_id] = r.priority
    rows = symbols.collect()
    terms = qs.select("qid", "question", retrieval.T.query_terms(F.col("question")).alias("said"), retrieval.T.expansions(F.col("question")).alias("more")).collect()
    for q in terms:
        whole = q.question.strip(" ").lower()
        found = []
        for s in rows:
            low = s.name.lower()
            p = [0] * (low in [whole, *q.said]) + [1] * (low in q.more) + [2] * any(len(t) > 3 and t in low for t in q.more) + [3] * any(t in low for t in [whole, *[t for t in q.said if len(t) > 3]])
            if p:
                found.append((min(p), low, s.path, s.start_line, s.symbol_id))
        assert got.get(q.qid, {}) == {f[4]: f[0] for f in sorted(found)[:10]}, q


def test_symbol_match_cuts_names_before_questions(spark, sf):
    assert flow(entry.queries()["symbol_match"](spark, sf)).count("WindowGroupLimit") >= 6  # of each part, each question's names, each name


def test_hybrid_search_asks_each_text_once(spark, sf):
    assert "asked#" in flow(entry.queries()["hybrid_search"](spark, sf))


def test_answer_confidence_asks_each_text_once(spark, sf):
    assert "asked#" in flow(entry.queries()["answer_confidence"](spark, sf))
