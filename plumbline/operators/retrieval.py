"""Ranked retrieval for batches of questions: every rank and window is partitioned by the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import terms as T
from plumbline.functions import text as X
from plumbline.operators import blocks
from plumbline.operators.windows import top_k
from plumbline.session import write_out

K1, B = 1.2, 0.75
#: Weights of the columns of a chunk.
WEIGHTS = {"file_path": 2.0, "symbol": 5.0, "content": 1.0}


def questions(chunks: DataFrame, every: int = 20) -> DataFrame:
    """The stated query set: the symbol of each chunk whose id is divisible by ``every`` asks for that symbol."""
    rows = chunks.where((F.col("chunk_id") % every == 0) & (F.col("symbol") != ""))
    return rows.select(F.col("chunk_id").alias("qid"), F.col("symbol").alias("question"), F.col("language").alias("q_language"))


def distinct_questions(qs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text that is asked once, under the least of its qids, and (qid, asked): the qid under which each question's text is.
    What a text has for an answer, all its questions have."""
    qs = write_out(qs.select("qid", "question"))
    texts = qs.groupBy("question").agg(F.min("qid").alias("asked"))
    return texts.select(F.col("asked").alias("qid"), "question"), qs.join(texts, "question").select("qid", "asked")


def for_all(rows: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of distinct questions, given to every question with the same text."""
    return rows.withColumnRenamed("qid", "asked").join(same, "asked").drop("asked")


def question_tokens(qs: DataFrame) -> DataFrame:
    return qs.select("qid", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("token"))


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with what retrieval needs of their texts: the tokens of each column (_t_...) and the distinct terms of all (_terms).
    Chunks that have them already are taken as they are, so an index may be written out once and used by all operators."""
    if "_terms" in chunks.columns:
        return chunks
    tokens = {f"_t_{c}": T.tokens(F.coalesce(c, F.lit(""))) for c in WEIGHTS}
    return chunks.withColumns({**tokens, "_terms": T.document_terms(F.col("file_path"), F.col("symbol"), F.col("content"))})


def written_index(chunks: DataFrame) -> DataFrame:
    """The index of chunks as a table of the shared folder, without their contents: each text is tokenised once."""
    kept = [c for c in ("chunk_id", "repo", "file_path", "ordinal", "start_line", "end_line", "symbol") if c in chunks.columns]
    return write_out(indexed(chunks).select(*kept, *[f"_t_{c}" for c in WEIGHTS], "_terms"))


def _weighed(weights: dict[str, float] | None) -> list[Column]:
    """The tokens of each column as (token, w)."""

    def weighed(column: str, w: float) -> Column:
        return F.transform(f"_t_{column}", lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))

    return [weighed(c, w) for c, w in (weights or WEIGHTS).items()]


def postings(chunks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(chunk_id, token, f, d): weighted occurrences of a token in a chunk and the chunk's number of tokens."""
    rows = indexed(chunks).select("chunk_id", F.flatten(F.array(*_weighed(weights))).alias("e")).select("chunk_id", F.size("e").cast("long").alias("d"), F.explode("e").alias("e"))
    return rows.groupBy("chunk_id", F.col("e.token").alias("token")).agg(F.sum("e.w").alias("f"), F.max("d").alias("d"))


def corpus_stats(chunks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(n, avg_d): one row, the number of chunks and their mean number of tokens."""
    n = sum((F.size(f"_t_{c}") for c in (weights or WEIGHTS)), F.lit(0))
    return indexed(chunks).select(n.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg_d"))


def bm25(qs: DataFrame, chunks: DataFrame, weights: dict[str, float] | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score) of every chunk that has a token of the question; higher is better. With ``fresh`` (chunk_id) only these
    come out, while the statistics are those of all chunks.

    Postings are cut to the questions' tokens before their document frequencies are counted; the corpus statistics are
    subqueries of one value. A token in more than half of all chunks counts almost nothing, as in the usual full-text
    engines. Tokens that many questions ask for and many chunks hold are joined where they lie.
    """
    asked = question_tokens(qs)
    posts = postings(chunks, weights)
    some = posts.join(asked.select("token").distinct(), "token", "left_semi")
    df = some.groupBy("token").agg(F.count(F.lit(1)).alias("n_p"))
    part = _part(corpus_stats(chunks, weights))
    some = some if fresh is None else some.join(fresh, "chunk_id", "left_semi")
    scored = asked.join(df, "token").join(some, "token").select("qid", "chunk_id", part.alias("part"))
    return scored.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))


def asked_parts(qs: DataFrame, chunks: DataFrame, weights: dict[str, float] | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(chunk_id, token, part): what a token that is asked for adds to the BM25 of a chunk, which does not depend on the question.
    Texts are tokenised once: the postings of these tokens are written out, with an empty token for each chunk that holds its length."""
    entries = [*_weighed(weights), F.array(F.struct(F.lit("").alias("token"), F.lit(0.0).alias("w")))]
    rows = indexed(chunks).select("chunk_id", F.flatten(F.array(*entries)).alias("e")).select("chunk_id", (F.size("e") - 1).cast("long").alias("d"), F.explode("e").alias("e")).select("chunk_id", "d", "e.token", "e.w")
    wanted = question_tokens(qs).select("token").unionByName(qs.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    posts = write_out(rows.join(F.broadcast(wanted), "token", "left_semi").groupBy("chunk_id", "token").agg(F.sum("w").alias("f"), F.max("d").alias("d")))
    some, stats = posts.where("token <> ''"), posts.where("token = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg_d"))
    part = _part(stats)
    df = some.groupBy("token").agg(F.count(F.lit(1)).alias("n_p"))
    some = some if fresh is None else some.join(fresh, "chunk_id", "left_semi")
    return some.join(F.broadcast(df), "token").select("chunk_id", "token", part.alias("part"))


def _part(stats: DataFrame) -> Column:
    """BM25 of one token in one chunk, from n_p, f and d; the corpus statistics (n, avg_d) are subqueries of one value."""
    n, avg_d = stats.select("n").scalar(), F.coalesce(stats.select("avg_d").scalar(), F.lit(1.0))
    raw = F.log((n - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    return idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / avg_d))


def _asked(rows: DataFrame, kind: int, term: str, group: Column | None = None, need: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return rows.select("qid", F.lit(kind).alias("kind"), F.col(term).alias("term"), (zero if group is None else group).cast("int").alias("grp"), (zero if need is None else need).cast("int").alias("need"))


def _posts(rows: DataFrame, kind: int, term: str, part: Column) -> DataFrame:
    return rows.select(F.col("chunk_id").alias("id"), F.lit(kind).alias("kind"), F.col(term).alias("term"), part.cast("double").alias("part"))


def bm25_top(qs: DataFrame, chunks: DataFrame, k: int, weights: dict[str, float] | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the k chunks of highest BM25 of each question, ties to the lower id. Scores are those of ``bm25``, whose
    pairs of questions and chunks are never rows here. Uses the shared folder."""
    texts, same = distinct_questions(qs)
    posts = _posts(asked_parts(texts, chunks, weights, fresh), blocks.PART, "token", F.col("part"))
    found = blocks.best_sums(_asked(question_tokens(texts), blocks.PART, "token"), posts, k, chunks.select("chunk_id").count())
    top = top_k(found.withColumnRenamed("id", "chunk_id"), ["qid"], [F.desc("score"), F.col("chunk_id")], k)
    return for_all(top, same).select("qid", "chunk_id", "score", "rank")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term): the inverted index of path, symbol and content."""
    return indexed(chunks).select("chunk_id", F.explode("_terms").alias("term"))


Synonyms = dict[str, list[str]]


def question_terms(qs: DataFrame, synonyms: Synonyms | None = None) -> DataFrame:
    """(qid, term): the terms of each question, said or expanded."""
    question = F.col("question")
    return qs.select("qid", F.explode(F.concat(T.query_terms(question), T.expansions(question, synonyms))).alias("term"))


def term_matches(qs: DataFrame, index: DataFrame, synonyms: Synonyms | None = None) -> DataFrame:
    """(qid, chunk_id, matches): how many terms of the question, said or expanded, a chunk has."""
    return question_terms(qs, synonyms).join(index, "term").groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("matches"))


def term_top(qs: DataFrame, index: DataFrame, k: int, n_chunks: int) -> DataFrame:
    """(qid, chunk_id, matches, rank): the k chunks of most matching terms of each question, ties to the lower id. Uses the shared folder."""
    texts, same = distinct_questions(qs)
    found = blocks.best_sums(_asked(question_terms(texts), blocks.COUNT, "term"), _posts(index, blocks.COUNT, "term", F.lit(1.0)), k, n_chunks)
    top = top_k(found.select("qid", F.col("id").alias("chunk_id"), F.col("score").cast("long").alias("matches")), ["qid"], [F.desc("matches"), F.col("chunk_id")], k)
    return for_all(top, same).select("qid", "chunk_id", "matches", "rank")


def literals(qs: DataFrame) -> DataFrame:
    """(qid, need, group, term): the literal groups of each question and how many of them a chunk must have."""
    rows = qs.select("qid", T.literal_groups(F.col("question")).alias("ts"))
    rows = rows.withColumn("need", F.least(F.lit(2), F.size(F.array_distinct(F.transform("ts", lambda t: t["group"])))))
    return rows.select("qid", "need", F.explode("ts").alias("t")).select("qid", "need", "t.group", "t.term")


def covered(qs: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, chunk_id) of chunks that have terms of at least two literal groups of the question, or of its only one. What a question
    was expanded by does not count here."""
    hits = literals(qs).join(index, "term").groupBy("qid", "chunk_id").agg(F.count_distinct("group").alias("n"), F.max("need").alias("need"))
    return hits.where("n >= need").select("qid", "chunk_id")


def lexical(qs: DataFrame, chunks: DataFrame, k: int = 64, fresh: DataFrame | None = None, synonyms: Synonyms | None = None) -> DataFrame:
    """(qid, chunk_id, strength, position): BM25 and term matches merged by the better rank, gated by coverage, top k. The index is
    written to the shared folder first, unless ``chunks`` is one; pairs of questions and chunks are scored where blocks of them meet."""
    chunks = chunks if "_terms" in chunks.columns else written_index(chunks)
    live = chunks if fresh is None else chunks.join(fresh, "chunk_id", "left_semi")
    texts, same = distinct_questions(qs)
    asked = _asked(question_tokens(texts), blocks.PART, "token").unionByName(_asked(question_terms(texts, synonyms), blocks.COUNT, "term")).unionByName(_asked(literals(texts), blocks.LITERAL, "term", F.col("group"), F.col("need")))
    posts = _posts(asked_parts(texts, chunks, fresh=fresh), blocks.PART, "token", F.col("part")).unionByName(_posts(chunk_terms(live), blocks.COUNT, "term", F.lit(1.0)))
    places = live.select(F.col("chunk_id").alias("id"), F.col("file_path").alias("path"), F.col("start_line").alias("line"))
    found = blocks.best_sums(asked, posts, k, chunks.count(), places).select("qid", F.col("id").alias("chunk_id"), F.col("score").alias("strength"))
    top = top_k(found.join(live.select("chunk_id", "file_path", "start_line"), "chunk_id"), ["qid"], [F.desc("strength"), F.col("file_path"), F.col("start_line"), F.col("chunk_id")], k, "position")
    return for_all(top, same).select("qid", "chunk_id", "strength", "position")


def grams(text: Column, width: int = 4) -> Column:
    """Distinct substrings of a width; the whole text if it is shorter."""
    n = F.length(text)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))
    return F.array_distinct(many)


def containing(parts: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(part, name): the first k names that contain each part. An equality join on the part's rarest substring of four letters among the names
    (the whole part, if it is shorter), then checked in full: nothing is compared pairwise that shares no substring."""
    cells = names.select("name", F.explode(F.array_distinct(F.concat(*[grams(F.col("name"), w) for w in (1, 2, 3, 4)]))).alias("gram"))
    asked = parts.select("part", F.explode(grams(F.col("part"))).alias("gram"))
    cells = cells.join(asked.select("gram").distinct(), "gram", "left_semi")
    held = asked.join(cells.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rare = held.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return top_k(rare.join(cells, "gram").where("instr(name, part) > 0").select("part", "name"), ["part"], [F.col("name")], k).select("part", "name")


def symbol_matches(qs: DataFrame, symbols: DataFrame, k: int = 64, synonyms: Synonyms | None = None) -> DataFrame:
    """(qid, symbol_id, match, priority): the k best symbols of each question, by priority, name, path and line.

    0 exact: the name is the question or a term it says; 1 expanded: the name is a term it was expanded by; 2 expanded: the
    name contains such a term of 4 letters or more; 3 partial: the name contains the question, or a term of 4 letters or more.
    Each text, part and name is looked at once. As the order is by priority and name, a name after the first k of a part has k before
    it in every question that has the part, so the k first names of each part suffice, and of each name its k first symbols.
    """
    question = F.col("question")
    whole = F.array(F.lower(F.trim(question)))
    said, more = T.query_terms(question), T.expansions(question, synonyms)

    def asked(terms: Column, priority: int) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("part"), F.lit(priority).alias("priority")))

    long = lambda terms: F.filter(terms, lambda t: F.length(t) >= 4)
    texts, same = distinct_questions(qs)
    known = symbols.select("symbol_id", "path", "start_line", F.lower("name").alias("name"))
    names = write_out(known.select("name").distinct())
    equal = texts.select("qid", F.explode(F.concat(asked(F.array_union(whole, said), 0), asked(more, 1))).alias("a")).select("qid", F.col("a.part").alias("name"), "a.priority")
    parts = write_out(texts.select("qid", F.explode(F.concat(asked(long(more), 2), asked(F.array_union(whole, long(said)), 3))).alias("a")).select("qid", "a.part", "a.priority").where("part <> ''"))
    hit = parts.join(containing(parts.select("part").distinct(), names, k), "part")
    both = equal.join(names, "name").select("qid", "name", "priority").unionByName(hit.select("qid", "name", "priority"))
    best = both.groupBy("qid", "name").agg(F.min("priority").cast("long").alias("priority"))
    best = top_k(best, ["qid"], [F.col("priority"), F.col("name")], k).select("qid", "name", "priority")
    place = [F.col("path"), F.col("start_line"), F.col("symbol_id")]
    rows = best.join(top_k(known, ["name"], place, k).drop("rank"), "name")
    kept = for_all(top_k(rows, ["qid"], [F.col("priority"), F.col("name"), *place], k).select("qid", "symbol_id", "priority"), same)
    match = F.when(F.col("priority") == 0, "exact").when(F.col("priority") < 3, "expanded").otherwise("partial")
    return kept.select("qid", "symbol_id", "priority", match.alias("match"))


def symbol_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(symbol_id, chunk_id): for each symbol the chunk of its file with its name, else the first that holds its first line."""
    c = chunks.select("chunk_id", "repo", F.col("file_path").alias("path"), "ordinal", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), F.col("symbol").alias("c_symbol"))
    pairs = symbols.join(c, ["repo", "path"])
    pref = F.when(F.col("c_symbol") == F.col("name"), 0).when((F.col("c_start") <= F.col("start_line")) & (F.col("c_end") >= F.col("start_line")), 1).otherwise(2)
    return top_k(pairs.withColumn("pref", pref), ["symbol_id"], [F.col("pref"), F.col("c_start"), F.col("ordinal"), F.col("chunk_id")], 1).select("symbol_id", "chunk_id", F.col("pref").cast("long").alias("pref"))


def aliases(files: DataFrame) -> DataFrame:
    """(repo, alias, path): names by which each file may be imported."""
    return files.select("repo", "path", F.explode(X.path_aliases(F.col("path"))).alias("alias")).select("repo", "alias", "path")


def folded_path(parts: Column) -> Column:
    """Components without ``.``, each ``..`` taking away the one before it, joined by slashes."""
    kept = F.aggregate(
        F.filter(parts, lambda p: (p != "") & (p != ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.array_join(kept, "/")


def import_names(target: Column, source_path: Column) -> Column:
    """Names under which the file that an import means may be known: as it is written, with dots or slashes, relative to the
    importing file (any number of ``../`` or leading dots), without a final .py, and without crate, self or super."""
    low = F.lower(F.regexp_replace(F.regexp_replace(F.trim(target), r"""^["']+|["']+$""", ""), r"\\", "/"))
    parts = F.split(F.lower(source_path), "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    steps = low.rlike(r"^\.\.?/")
    near = F.when(steps, folded_path(F.concat(folder, F.split(low, "/"))))
    level = F.length(F.regexp_extract(low, r"^(\.*)", 1))
    above = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - level + 1, F.lit(0)))
    dotted = F.when(~steps & low.startswith("."), folded_path(F.concat(above, F.split(F.regexp_replace(low, r"^\.+", ""), r"\."))))
    plain = F.when(~low.startswith("."), low)
    inner = F.when(low.rlike(r"^(crate|self|super)::"), F.regexp_replace(F.regexp_replace(low, r"^((crate|self|super)::)+", ""), "::", "."))
    base = F.filter(F.array(near, dotted, plain, inner), lambda x: x.isNotNull() & (x != ""))
    forms = F.flatten(F.transform(base, lambda x: F.array(x, F.regexp_replace(x, "::|/", "."), F.when(F.contains(x, F.lit("/")), x).otherwise(F.regexp_replace(x, r"\.|::", "/")), F.regexp_replace(x, r"\.py$", ""))))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def resolved_imports(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source_path, line, target, target_path): imports that name a file of the same repository, by aliases and equality joins."""
    wanted = deps.select("repo", "source_path", "line", "target", F.explode(import_names(F.col("target"), F.col("source_path"))).alias("alias")).distinct()
    found = wanted.join(aliases(files), ["repo", "alias"]).select("repo", "source_path", "line", "target", F.col("path").alias("target_path"))
    return found.where("source_path <> target_path").distinct()


def resolved_edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source_path, target_path) of these imports."""
    return resolved_imports(deps, files).select("repo", "source_path", "target_path").distinct()


def import_edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Imports by either rule: by an alias of the file, or by the longest prefix that names a module."""
    return module_targets(deps, files).unionByName(resolved_imports(deps, files)).distinct()


#: Languages whose files are modules.
MODULES = ("python", "javascript", "typescript", "go", "rust", "java", "c", "cpp")


def module_targets(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source_path, line, target, target_path): the file whose dotted name is the longest prefix of an import's target.

    Names leave out a leading src or lib, the suffix and a final __init__; case does not matter and a hyphen is an underscore.
    Of several files with one name the first path holds. Equality joins on the prefixes, of which a target has few.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower("path"), r"\.[^./]*$", ""), "^(src|lib)/", "")
    named = files.where(F.col("language").isin(*MODULES)).select("repo", "path", F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "/?__init__$", ""), "-", "_"), "/", ".").alias("name"))
    named = named.where("name <> ''").groupBy("repo", "name").agg(F.min("path").alias("target_path"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("target")), r"^[./]+", ""), "-", "_"), "/|::", ".")
    parts = F.split(plain, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("size"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("name")))
    rows = deps.select("repo", "source_path", "line", "target", F.explode(prefixes).alias("p")).select("repo", "source_path", "line", "target", "p.size", "p.name")
    best = rows.join(named, ["repo", "name"]).groupBy("repo", "source_path", "line", "target").agg(F.max_by("target_path", "size").alias("target_path"))
    return best.where("source_path <> target_path")


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, repo, path, seed_path, direction): files that seeds import or that import seeds, but are no seeds; one row per file."""
    out = seeds.join(edges, (seeds.repo == edges.repo) & (seeds.seed_path == edges.source_path)).select("qid", seeds.repo, F.col("target_path").alias("path"), "seed_path", F.lit("dependency of").alias("direction"))
    back = seeds.join(edges, (seeds.repo == edges.repo) & (seeds.seed_path == edges.target_path)).select("qid", seeds.repo, F.col("source_path").alias("path"), "seed_path", F.lit("dependent of").alias("direction"))
    known = seeds.select("qid", "repo", F.col("seed_path").alias("path"))
    rows = out.unionByName(back).join(known, ["qid", "repo", "path"], "left_anti")
    return rows.groupBy("qid", "repo", "path").agg(F.min(F.struct("direction", "seed_path")).alias("m")).select("qid", "repo", "path", "m.seed_path", "m.direction")


def hybrid(qs: DataFrame, chunks: DataFrame, files: DataFrame, symbols: DataFrame, deps: DataFrame, limit: int = 8, fresh: DataFrame | None = None, synonyms: Synonyms | None = None) -> DataFrame:
    """Ranked evidence: 8 * strength / best + 2 / position, 24, 10 or 12 for an exact, expanded or partial symbol, and a share of a
    seed's score for its neighbours' first chunks; each kind of candidate is bounded by 8 * limit, 32 at least and 500 at
    most. With ``fresh`` (chunk_id) only these chunks are evidence. Uses the shared folder.
    (qid, rank, chunk_id, path, start_line, end_line, score, reason)."""
    most = min(max(limit * 8, 32), 500)
    qs, same = distinct_questions(qs)
    symbols, fresh = write_out(symbols), fresh if fresh is None else write_out(fresh)
    chunks = chunks if "_terms" in chunks.columns else written_index(chunks)
    live = chunks if fresh is None else chunks.join(fresh, "chunk_id", "left_semi")
    best = F.max("strength").over(Window.partitionBy("qid"))  # at most ``most`` rows of a question
    a = lexical(qs, chunks, most, fresh, synonyms).withColumn("top", best).select("qid", "chunk_id", (8 * F.greatest("strength", F.lit(0.0)) / F.greatest("top", F.lit(1e-12)) + 2 / F.col("position")).alias("score"), F.lit("full-text match").alias("reason"))
    home = symbol_chunks(symbols, live)
    found = symbol_matches(qs, symbols, most, synonyms).join(home, "symbol_id").join(symbols.select("symbol_id", "name"), "symbol_id")
    one = found.groupBy("qid", "chunk_id").agg(F.min(F.struct("priority", "name")).alias("m"))
    exact, expanded = F.col("m.priority") == 0, F.col("m.priority") < 3
    said = F.when(exact, "exact symbol match: ").when(expanded, "query-expansion symbol match: ").otherwise("partial symbol match: ")
    b = one.select("qid", "chunk_id", F.when(exact, 24.0).when(expanded, 10.0).otherwise(12.0).alias("score"), F.concat(said, F.col("m.name")).alias("reason"))
    direct = write_out(a.unionByName(b))  # used twice: for the seeds, and for the sums
    place = live.select("chunk_id", "repo", F.col("file_path").alias("path"), "start_line", "end_line", "ordinal")
    by_path = direct.groupBy("qid", "chunk_id").agg(F.sum("score").alias("score")).join(place, "chunk_id").groupBy("qid", "repo", "path").agg(F.max("score").alias("score"))
    seeds = top_k(by_path.withColumn("score", F.round("score", 6)), ["qid"], [F.desc("score"), F.col("path"), F.col("repo")], min(limit, 8)).select("qid", "repo", F.col("path").alias("seed_path"), F.col("score").alias("seed_score"))
    near = neighbours(seeds.select("qid", "repo", "seed_path"), write_out(resolved_edges(deps, files))).join(seeds, ["qid", "repo", "seed_path"])
    first = top_k(place, ["repo", "path"], [F.col("ordinal"), F.col("start_line"), F.col("chunk_id")], 1).select("repo", "path", "chunk_id")
    kept = top_k(near.join(first, ["repo", "path"]), ["qid"], [F.col("path"), F.col("repo")], most, "_place")
    c = kept.select("qid", "chunk_id", F.greatest(F.lit(1.0), 0.25 * F.col("seed_score")).alias("score"), F.concat("direction", F.lit(" "), F.col("seed_path")).alias("reason"))
    merged = direct.unionByName(c).groupBy("qid", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    ranked = top_k(merged.join(place, "chunk_id"), ["qid"], [F.desc("score"), F.col("path"), F.col("start_line"), F.col("chunk_id")], limit)
    return for_all(ranked, same).select("qid", "rank", "chunk_id", "path", "start_line", "end_line", "score", "reason")
