"""Mixing sources to target shares of tokens by Pareto order sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.encoding import RANKS, token_counts
from plumbline.session import write_out

#: Classes of lengths for each doubling, and classes of ranks in which the cut of a source is looked up.
PER_DOUBLING, RANK_CLASSES = 16, 65_536


def solved_inclusion(need: float, tokens: pd.Series, mean: pd.Series) -> pd.Series:
    """Inclusion probabilities proportional to the square root of length, at most 1, whose expected tokens are ``need``."""
    weight = mean.clip(lower=1e-9) ** 0.5
    low, high = 0.0, 1.0 / weight.min()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if ((mid * weight).clip(upper=1.0) * tokens).sum() < need else (low, mid)
    return (high * weight).clip(upper=1.0)


def countable(documents: DataFrame, targets: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """(source, text_key, doc_id, n_tokens): the distinct texts of each source that has a target, without empty ones.

    Sources are compared trimmed and in lower case. A text under several ids of a source is one text (the least id).
    """
    named = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source"))
    wanted = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    rows = named.join(wanted, "source", "left_semi").where(F.length("text") > 0).withColumn("text_key", F.sha2("text", 256))
    counts = token_counts(rows, ["source", "text_key", "doc_id"], ranks_file)
    return counts.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def mix_sources(texts: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None) -> DataFrame:
    """(source, doc_id, n_tokens, copies) of a mix in which each source has its target share of the tokens.

    ``texts`` has (source, text_key, doc_id, n_tokens), one row per text. ``total_tokens`` is the size wanted; by default
    the largest at which no source with texts needs more than max_repeats copies of a text. A source's need is filled
    with whole copies of all its texts first. The rest is drawn by Pareto order sampling: each text has an inclusion
    probability p (proportional to the root of its length) and the rank (u / (1 - u)) / (p / (1 - p)), u uniform by seed,
    source and text; ranks are taken in order until the tokens are reached. A source that cannot reach its need gets
    max_repeats copies of all; a source without texts gets none; without targets or texts the mix is empty.

    No source is ordered in one task: a histogram of ranks (with map-side combining) finds the class in which its cut
    lies, and only that class, 1 / 65536 of the texts, is ordered exactly.
    """
    plan = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("target_share > 0 AND max_repeats > 0")
    plan = plan.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("have")).join(plan, "source")
    if total_tokens is None:
        total_tokens = have.select(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    # Whole numbers from here on: a source at its cap is exactly there, whatever its size, and then nothing is drawn from it.
    cap = (F.col("have") * F.col("max_repeats")).cast("long")
    sized = have.withColumn("need", F.least(F.round(F.lit(float(total_tokens)) * F.col("target_share")).cast("long"), cap))
    sources = sized.withColumn("whole", F.expr("need div have")).withColumn("rest", F.expr("need % have"))

    length_class = F.floor(F.log2("n_tokens") * PER_DOUBLING).cast("int")
    rows = texts.select("source", "text_key", "doc_id", "n_tokens", length_class.alias("k"))
    bars = rows.groupBy("source", "k").agg(F.sum("n_tokens").alias("tokens"), F.avg("n_tokens").alias("mean")).join(sources.select("source", "rest"), "source")

    def solve(bars: pd.DataFrame) -> pd.DataFrame:
        rest = float(bars["rest"].iloc[0])
        p = solved_inclusion(rest, bars["tokens"], bars["mean"]) if rest > 0 else bars["mean"] * 0.0
        return bars[["source", "k"]].assign(p=p, left=rest - bars["tokens"][p >= 1].sum())

    # At most 16 * 63 rows of a source meet here, whatever the number of texts. Texts that are certain (p = 1) need no order.
    chance = write_out(bars.groupBy("source").applyInPandas(solve, "source string, k int, p double, left double"))
    left = chance.groupBy("source").agg(F.max("left").alias("left"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "source", "text_key"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = u / (1 - u) / (F.col("p") / (1 - F.col("p")))
    drawable = rows.join(chance.select("source", "k", "p"), ["source", "k"])
    ranked = drawable.where("p > 0 AND p < 1").withColumn("rank", odds / (1 + odds))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("rank") * RANK_CLASSES), F.lit(RANK_CLASSES - 1)).cast("int"))

    classes = ranked.groupBy("source", "g").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("g")  # at most 65536 rows of a source
    cum = classes.withColumn("before", F.sum("t").over(upto) - F.col("t")).join(left, "source")
    edge = cum.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("t") >= F.col("left"))).select("source", F.col("g").alias("edge"), "before")
    marked = ranked.join(left, "source").join(edge, "source", "left")
    within = Window.partitionBy("source", "g").orderBy("rank", "text_key")
    on_edge = marked.where("g = edge").withColumn("done", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    on_edge = on_edge.withColumn("drawn", (F.col("done") + F.col("n_tokens") / 2 <= F.col("left")).cast("long"))
    # Without an edge the ranked texts of a source fall short of what is left, so all are drawn, or nothing is left.
    others = marked.where("edge IS NULL OR g <> edge").withColumn("drawn", F.coalesce(F.col("g") < F.col("edge"), F.col("left") > 0).cast("long"))
    settled = drawable.where("p <= 0 OR p >= 1").withColumn("drawn", (F.col("p") >= 1).cast("long"))
    keep = ["source", "doc_id", "n_tokens", "drawn"]
    drawn = on_edge.select(*keep).unionByName(others.select(*keep)).unionByName(settled.select(*keep)).join(sources.select("source", "whole"), "source")
    copies = F.col("whole") + F.col("drawn")
    return drawn.select("source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_tokens, n_texts, n_copies) of every target; 0 where the mix has nothing."""
    plan = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").distinct()
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_copies"))
    rows = plan.join(got, "source", "left").fillna(0, ["n_tokens", "n_texts", "n_copies"])
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    share = F.when(all_tokens > 0, F.col("n_tokens") / all_tokens).otherwise(F.lit(0.0))
    return rows.select("source", "target_share", share.alias("reached_share"), "n_tokens", "n_texts", "n_copies", "max_repeats")
