"""Facts of files, chunks and regions: clean views, counts, lines, sections, dependencies, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.functions.languages import language_of
from plumbline.operators.windows import max_before


def clean_files(files: DataFrame) -> DataFrame:
    """Each file once, with its language settled. Repeated rows are exact, so any of them stands for all."""
    return files.dropDuplicates(["file_id"]).withColumn("language", language_of(F.col("language"), F.col("path")))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["chunk_id"])


def clean_regions(regions: DataFrame) -> DataFrame:
    """Each region with usable bounds once."""
    return regions.dropDuplicates(["region_id"]).where("start_line >= 1 AND end_line >= start_line")


def fresh(rows: DataFrame) -> DataFrame:
    """What retrieval may read: from source and not stale."""
    return rows.where((F.col("provenance") == "source") & ~F.col("stale"))


def manifest(files: DataFrame, chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Metadata of each file without its text, with the numbers of its chunks and regions."""
    c = clean_chunks(chunks).groupBy("repo", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_chunks"))
    r = regions.dropDuplicates(["region_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_regions"))
    base = clean_files(files).select("file_id", "repo", "path", "language", "size_bytes", "sha256")
    return base.join(c, ["repo", "path"], "left").join(r, "file_id", "left").fillna(0, ["n_chunks", "n_regions"])


def totals(files: DataFrame, chunks: DataFrame, regions: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of table totals: one aggregate for each input, laid under each other and then side by side."""
    f = files.dropDuplicates(["file_id"])
    parts = [f.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_files")), f.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("v")).withColumn("k", F.lit("total_bytes"))]
    for df, name, keys in ((chunks, "n_chunks", ["chunk_id"]), (regions, "n_regions", ["region_id"]), (terms, "n_pairs", ["term", "chunk_id"])):
        parts.append(df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit(name)))
    names = ["n_files", "total_bytes", "n_chunks", "n_regions", "n_pairs"]
    return reduce(DataFrame.unionByName, parts).agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])


def line_rows(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line: the kept columns, line (1-based) and content."""
    return files.select(*keep, F.posexplode(X.lines(F.col("text"))).alias("_i", "content")).select(*keep, (F.col("_i") + 1).alias("line"), "content")


def section_ranges(files: DataFrame) -> DataFrame:
    """Sections of Markdown files: they end before the next heading of their level or above, else with the file."""
    md = files.where((F.col("language") == "markdown") & F.col("text").isNotNull())
    rows = line_rows(md.withColumn("n_lines", X.line_count(F.col("text"))), "file_id", "n_lines")
    heads = rows.where(F.col("content").rlike(r"^#{1,6}[ \t]+[^ \t]")).withColumn("level", F.length(F.regexp_extract("content", "^(#+)", 1)))
    heads = heads.withColumn("title", F.trim(F.regexp_replace("content", r"^#+[ \t]+|[ \t]+#*[ \t]*$", "")))
    after = Window.partitionBy("file_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)  # a file's headings
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)]
    nxt = F.element_at(F.array(*nexts), F.col("level"))
    return heads.select("file_id", "title", "level", F.col("line").alias("start_line"), F.coalesce(nxt - 1, F.col("n_lines")).alias("end_line"))


def config_keys(files: DataFrame) -> DataFrame:
    """Keys and sections of configuration files; each ends before the next one."""
    cfg = files.where((F.col("language") == "config") & F.col("text").isNotNull())
    rows = line_rows(cfg.withColumn("n_lines", X.line_count(F.col("text"))), "file_id", "n_lines")
    name = F.regexp_extract("content", r"""^[ \t]*(?:\[+([^\[\]]+)\]+|["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*[:=])""", 1)
    key = F.regexp_extract("content", r"""^[ \t]*(?:\[+([^\[\]]+)\]+|["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*[:=])""", 2)
    found = rows.withColumn("name", F.when(name != "", name).otherwise(key)).where("name <> ''").withColumn("kind", F.when(name != "", "section").otherwise("key"))
    nxt = F.lead("line").over(Window.partitionBy("file_id").orderBy("line"))
    return found.select("file_id", "name", "kind", F.col("line").alias("start_line"), F.coalesce(nxt - 1, F.col("n_lines")).alias("end_line"))


def gaps(regions: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of files that no region covers, as anonymous ranges, also after the last region."""
    sized = files.where(F.col("text").isNotNull()).select("file_id", X.line_count(F.col("text")).alias("n_lines"))
    r = clean_regions(regions).join(sized, "file_id").select("file_id", "n_lines", "start_line", F.least("end_line", "n_lines").alias("end_line")).where("start_line <= n_lines")
    marks = r.unionByName(r.select("file_id", "n_lines", (F.col("n_lines") + 1).alias("start_line"), (F.col("n_lines") + 1).alias("end_line")).distinct())
    done = F.coalesce(max_before(F.col("end_line"), ["file_id"], [F.col("start_line"), F.col("end_line")]), F.lit(0))
    return marks.withColumn("gap_start", done + 1).withColumn("gap_end", F.col("start_line") - 1).where("gap_start <= gap_end").select("file_id", "gap_start", "gap_end")


def fixed_chunks(files: DataFrame, max_lines: int = 160) -> DataFrame:
    """Chunks of at most max_lines lines of every text."""
    n = X.line_count(F.col("text"))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / max_lines).cast("int"))
    sized = files.where(F.length("text") > 0).select("file_id", n.alias("n_lines"), F.explode(starts).alias("ordinal"))
    first = F.col("ordinal") * max_lines + 1
    return sized.select("file_id", "ordinal", first.alias("start_line"), F.least(first + max_lines - 1, F.col("n_lines")).alias("end_line"))


def crossing_regions(regions: DataFrame) -> DataFrame:
    """Pairs of a file's regions that overlap without nesting. An equality join on the file; only crossing pairs come out."""
    r = clean_regions(regions).select("file_id", "region_id", "start_line", "end_line")
    a, b = r.alias("a"), r.alias("b")
    cross = (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.start_line") < F.col("b.start_line")) & (F.col("b.start_line") <= F.col("a.end_line")) & (F.col("a.end_line") < F.col("b.end_line"))
    return a.join(b, cross).select("a.file_id", F.col("a.region_id").alias("first_id"), F.col("b.region_id").alias("second_id"))


#: Import statements by language, over several lines where the language allows it, plain enough for every regular-expression engine.
STATEMENTS = {
    "python": r"(?m)^[ \t]*(?:from[ \t]+[.A-Za-z_][A-Za-z0-9_.]*[ \t]+import[ \t]*(?:\([^()]*\)|[^()\n#;]+)|import[ \t]+[A-Za-z_][^\n#;]*)",
    "javascript": r"""(?m)^[ \t]*(?:(?:import|export)[ \t{*][^'";()]*from[ \t]*["'][^"'\n]+["']|import[ \t]*["'][^"'\n]+["']|[^\n'"]*\b(?:require|import)\([ \t]*["'][^"'\n]+["'])""",
    "go": r"""(?m)^import[ \t]*(?:\([^()]*\)|(?:[A-Za-z_.][A-Za-z0-9_.]*[ \t]+)?"[^"\n]+")""",
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?(?:use[ \t]+[A-Za-z_][A-Za-z0-9_:]*[A-Za-z0-9_]|mod[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*;)",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_]",
    "c": r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"][^>"\n]+[>"]""",
}
STATEMENTS["typescript"], STATEMENTS["cpp"] = STATEMENTS["javascript"], STATEMENTS["c"]
#: Where the target stands in a statement that has one or more of one form.
TARGETS = {
    "javascript": r"""["']([^"']+)["']""", "go": r'"([^"]+)"', "rust": r"(?:use|mod)[ \t]+([A-Za-z_][A-Za-z0-9_:]*)", "java": r"import[ \t]+(?:static[ \t]+)?([A-Za-z_][A-Za-z0-9_.]*)", "c": r"""[<"]([^>"]+)[>"]""",
}
TARGETS["typescript"], TARGETS["cpp"] = TARGETS["javascript"], TARGETS["c"]


def import_targets(statement: Column, language: Column) -> Column:
    """What an import statement names: several modules of a list, each name imported from a package by dots alone, or its target."""
    flat = F.regexp_replace(F.regexp_replace(statement, r"#[^\n]*", ""), r"[\s\\()]+", " ")
    origin = F.regexp_extract(flat, r"^ *from ([.A-Za-z_][A-Za-z0-9_.]*) import", 1)
    names = F.filter(F.transform(F.split(F.regexp_replace(flat, "^ *(?:from [^ ]+ )?import", ""), ","), lambda x: F.regexp_extract(x, r"^ *([A-Za-z_*][A-Za-z0-9_.]*)", 1)), lambda x: x != "")
    python = F.when(origin == "", names).when(origin.rlike(r"^\.+$"), F.transform(names, lambda x: F.concat(origin, x))).otherwise(F.array(origin))
    others = F.coalesce(*[F.when(language == x, F.regexp_extract_all(statement, F.lit(p), F.lit(1))) for x, p in TARGETS.items()])
    return F.when(language == "python", python).otherwise(others)


def dependencies(files: DataFrame) -> DataFrame:
    """(repo, source_path, language, line, target) of every import, with the line on which its statement begins.

    Statements are found in whole texts, so they may go over several lines; one statement gives a row for each target.
    """
    known = F.col("language")
    rows = files.where(known.isin(*STATEMENTS) & F.col("text").isNotNull()).select("repo", F.col("path").alias("source_path"), "language", "text")
    marked = F.coalesce(*[F.when(known == x, F.regexp_replace("text", p, "\u0001$0\u0002")) for x, p in STATEMENTS.items()])
    parts = F.split(marked, "\u0001", -1)
    # The line of a statement: line feeds in all parts before it.
    feeds = F.transform(parts, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    before = F.aggregate(feeds, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    found = rows.select("repo", "source_path", "language", F.posexplode(parts).alias("i", "part"), before.alias("before")).where("i > 0")
    statement = F.substring_index("part", "\u0002", 1)
    each = found.select("repo", "source_path", "language", (F.get("before", F.col("i")) + 1).alias("line"), F.explode(import_targets(statement, known)).alias("target"))
    return each.where("target <> ''")


def entry_points(files: DataFrame) -> DataFrame:
    """Files that start a program by the conventions of their language."""
    t, name, lang = F.col("text"), F.lower(X.base_name(F.col("path"))), F.col("language")
    rule = (
        F.when(lang == "python", t.rlike(r"""(?m)^if[ \t]+__name__[ \t]*==[ \t]*["']__main__["']""") | name.isin("__main__.py", "main.py", "manage.py", "app.py", "cli.py"))
        .when(lang.isin("javascript", "typescript"), name.rlike(r"^(index|main|server|app|cli)\.(js|mjs|ts|mts)$"))
        .when(lang == "go", t.rlike(r"(?m)^package[ \t]+main[ \t]*$") & t.rlike(r"(?m)^func[ \t]+main\("))
        .when(lang == "rust", t.rlike(r"(?m)^[ \t]*(pub[ \t]+)?(async[ \t]+)?fn[ \t]+main[ \t]*\("))
        .when(lang == "java", t.rlike(r"public[ \t]+static[ \t]+void[ \t]+main[ \t]*\("))
        .when(lang.isin("c", "cpp"), t.rlike(r"(?m)^[A-Za-z_][A-Za-z0-9_ \t*]*[ \t]main[ \t]*\("))
        .otherwise(F.lit(False))
    )
    return files.select("file_id", "path", F.coalesce(rule, F.lit(False)).alias("is_entry")).where("is_entry").select("file_id", "path")


def scan_digest(files: DataFrame) -> DataFrame:
    """One digest per repository over sorted path and sha256 pairs."""
    pair = F.concat_ws("|", "path", F.lower("sha256"))
    # A digest over sorted members needs them together: they are hashed first, in 4096 classes, so no list outgrows a task.
    classes = files.select("repo", F.sha2(pair, 256).alias("h")).withColumn("k", F.substring("h", 1, 3))
    inner = classes.groupBy("repo", "k").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("h")), ""), 256).alias("d"))
    return inner.groupBy("repo").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("k", "d"))), ""), 256).alias("digest"))


def fact_digest(files: DataFrame, regions: DataFrame) -> DataFrame:
    """One digest per file over what retrieval sees of it: path, content hash and regions, not times or staleness."""
    item = F.concat_ws(":", F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.coalesce("symbol", F.lit("")))
    r = clean_regions(regions).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("facts"))
    base = files.select("file_id", "path", "sha256").join(r, "file_id", "left")
    return base.select("file_id", F.sha2(F.concat_ws("|", "path", F.lower("sha256"), F.coalesce("facts", F.lit(""))), 256).alias("digest"))
