"""Module graph, project reports and evaluation as small results of distributed aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.operators.windows import top_k


def module_nodes(files: DataFrame, k: int = 20) -> DataFrame:
    """The k groups of each repository with the most files."""
    g = files.select("repo", X.module_group(F.col("path")).alias("label"), "path").groupBy("repo", "label").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("witness"))
    return top_k(g, ["repo"], [F.desc("n_files"), F.col("label")], k).select("repo", "label", X.node_id(F.col("label")).alias("node_id"), "n_files", "witness")


def module_edges(targets: DataFrame, k: int = 40) -> DataFrame:
    """Imports between groups with their number and the first of them as evidence, the k largest of each repository.

    ``targets`` has (repo, source_path, line, target, target_path)."""
    rows = targets.select("repo", X.module_group(F.col("source_path")).alias("source"), X.module_group(F.col("target_path")).alias("to"), "source_path", "line", F.col("target").alias("import_target"))
    g = rows.where("source <> to").groupBy("repo", "source", F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("n_edges"), F.min(F.struct("source_path", "line", "import_target")).alias("w"))
    out = top_k(g, ["repo"], [F.desc("n_edges"), F.col("source"), F.col("target")], k)
    return out.select("repo", "source", "target", "n_edges", F.col("w.source_path").alias("witness"), F.col("w.line").cast("long").alias("line"), F.col("w.import_target").alias("import_target"))


def layout(files: DataFrame) -> DataFrame:
    """Per top-level group: files, up to three main languages (ties: first path), and the first path as witness."""
    rows = files.select("repo", X.top_group(F.col("path")).alias("area"), "language", "path")
    langs = rows.where(F.col("language").isNotNull()).groupBy("repo", "area", "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p"))
    three = top_k(langs, ["repo", "area"], [F.desc("n"), F.col("p"), F.col("language")], 3)
    names = three.groupBy("repo", "area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda x: x["language"]), ", ").alias("languages"))
    return rows.groupBy("repo", "area").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("witness")).join(names, ["repo", "area"], "left").fillna("", ["languages"])


def core_modules(files: DataFrame, regions: DataFrame, k: int = 12) -> DataFrame:
    """The k largest areas of each repository with their symbols; the witness has most symbols, then the shortest path."""
    n = regions.dropDuplicates(["region_id"]).where(F.col("symbol").isNotNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    rows = files.select("file_id", "repo", X.top_group(F.col("path")).alias("area"), "path").join(n, "file_id", "left").fillna(0, ["n_symbols"])
    best = F.min(F.struct(-F.col("n_symbols"), F.length("path"), F.col("path").alias("path")))
    g = rows.groupBy("repo", "area").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_symbols").alias("n_symbols"), best.alias("w"))
    return top_k(g, ["repo"], [F.desc("n_files"), F.col("area")], k).select("repo", "area", "n_files", "n_symbols", F.col("w.path").alias("witness"))


def external_dependencies(deps: DataFrame, files: DataFrame, stdlib: list[str], k: int = 20) -> DataFrame:
    """The k most imported targets of each repository that are neither relative, nor its own roots, nor the standard library."""
    parts = F.split("path", "/")
    root = F.when(parts[0].isin("src", "lib") & (F.size(parts) > 1), parts[1]).otherwise(F.regexp_replace(parts[0], r"(.)\.[^.]*$", "$1"))
    own = files.select("repo", F.lower(root).alias("root")).distinct()
    rows = deps.withColumn("root", F.lower(F.regexp_extract("target", r"^([^./]*)", 1))).where((F.col("root") != "") & ~F.col("root").isin(*stdlib))
    rows = rows.join(own, ["repo", "root"], "left_anti")
    g = rows.groupBy("repo", "target").agg(F.count(F.lit(1)).alias("n_refs"), F.min(F.struct("source_path", "line")).alias("w"))
    return top_k(g, ["repo"], [F.desc("n_refs"), F.col("target")], k).select("repo", "target", "n_refs", F.concat("w.source_path", F.lit(":"), F.col("w.line").cast("string")).alias("witness"))


def reading_order(files: DataFrame, regions: DataFrame, k: int = 12) -> DataFrame:
    """What to read first in each repository: readmes, configuration, entry points, then what has most symbols."""
    n = regions.dropDuplicates(["region_id"]).where(F.col("symbol").isNotNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    name = F.lower(X.base_name(F.col("path")))
    step = F.when(name.startswith("readme"), 0).when(name.isin(*X.CONFIG_NAMES), 1).when(F.coalesce("is_entry_point", F.lit(False)), 2).when(~X.is_test(F.col("path")) & ~X.is_config(F.col("path")), 3)
    rows = files.join(n, "file_id", "left").fillna(0, ["n_symbols"]).withColumn("step", step).where("step IS NOT NULL")
    rows = rows.withColumn("order_symbols", F.when(F.col("step") == 3, -F.col("n_symbols")).otherwise(F.lit(0)))
    return top_k(rows, ["repo"], [F.col("step"), F.col("order_symbols"), F.col("path"), F.col("file_id")], k).select("repo", "rank", "path", F.col("step").cast("long").alias("step"))


def retrieval_metrics(results: DataFrame, qs: DataFrame, k: int = 5) -> DataFrame:
    """(qid, hit, recall, mrr, ndcg) at k for questions whose only right answer is the chunk they come from (grade 1)."""
    right = results.where((F.col("rank") <= k) & (F.col("chunk_id") == F.col("qid"))).groupBy("qid").agg(F.min("rank").alias("r"))
    gain = F.coalesce(1 / F.col("r"), F.lit(0.0))
    ndcg = F.coalesce(1 / F.log2(F.col("r") + 1), F.lit(0.0))
    return qs.join(right, "qid", "left").select("qid", "q_language", F.col("r").isNotNull().cast("long").alias("hit"), F.round(gain, 6).alias("mrr"), F.round(ndcg, 6).alias("ndcg"))


def grades(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id, grade): 3 for the chunk a question (qid, question, repo, file_path) comes from, 2 for others of its file, 1 for
    others with the symbol asked for. Equality joins, one for each reason."""
    own = questions.join(chunks.select(F.col("chunk_id").alias("qid")), "qid").select("qid", F.col("qid").alias("chunk_id"), F.lit(3).alias("grade"))
    near = questions.join(chunks.select("chunk_id", "repo", "file_path"), ["repo", "file_path"]).select("qid", "chunk_id", F.lit(2).alias("grade"))
    same = questions.join(chunks.select("chunk_id", F.col("symbol").alias("question")), "question").select("qid", "chunk_id", F.lit(1).alias("grade"))
    return own.unionByName(near).unionByName(same).groupBy("qid", "chunk_id").agg(F.max("grade").alias("grade"))


def graded_ndcg(results: DataFrame, graded: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, ndcg) at k with gains of 2^grade - 1; 0 for a question without a graded chunk."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(rank + 1)
    got = results.where(F.col("rank") <= k).join(graded, ["qid", "chunk_id"]).groupBy("qid").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    best = top_k(graded, ["qid"], [F.desc("grade"), F.col("chunk_id")], k, "place").groupBy("qid").agg(F.sum(gain(F.col("place"))).alias("ideal"))
    return questions.join(got, "qid", "left").join(best, "qid", "left").select("qid", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def metric_buckets(metrics: DataFrame) -> DataFrame:
    """Means by language and over all (language ``*``), in one pass with grouping sets."""
    g = metrics.cube("q_language").agg(F.count(F.lit(1)).alias("n_questions"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.grouping("q_language").alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "*").otherwise(F.coalesce("q_language", F.lit("?"))).alias("bucket"), "n_questions", "hit_rate", "mrr", "ndcg")


def confusion(answered: Column, answerable: Column) -> list[Column]:
    """Counts and rates of the no-answer decision; rates without cases are null."""
    tp = F.sum((~answered & ~answerable).cast("long"))
    fp = F.sum((~answered & answerable).cast("long"))
    fn = F.sum((answered & ~answerable).cast("long"))
    tn = F.sum((answered & answerable).cast("long"))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def last_turns(rows: DataFrame, group: str, order: list[Column], text: str, turns: int = 3, cut: int = 600) -> DataFrame:
    """Each row's text with those of the turns before it in its (small) group, each cut, oldest first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(turns - 1), 0)
    return rows.withColumn("context", F.array_join(F.collect_list(F.substring(text, 1, cut)).over(w), " | "))
