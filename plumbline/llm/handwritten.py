"""Files that nobody wrote by hand: generated, minified, vendored, data saved as code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import join_split_hot
from plumbline.session import write_out

# --- Fixed values: what tools write and where copies are kept ----------------------------------------------------------

LOCK_FILES = {
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "cargo.lock",
    "poetry.lock", "pipfile.lock", "pdm.lock", "uv.lock", "gemfile.lock", "go.sum", "mix.lock", "pubspec.lock", "podfile.lock",
    "flake.lock", "gradle.lockfile", "packages.lock.json", "deno.lock", "conan.lock",
}
VENDOR_DIRS = {
    "vendor", "vendored", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern",
    "node_modules", "bower_components", "deps", "site-packages", "pods", "carthage", "jspm_packages", "_vendor",
}
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|cpp|hpp|swift|rs)|_pb\.(?:js|ts|d\.ts)|\.g\.(?:ts|js|cs|dart)|[._](?:gen|generated|autogen)\.\w+|\.designer\.cs)$")
_MINIFIED_NAME = re.compile(r"(?i)[.-](?:min|bundle|packed|prod)\.(?:js|mjs|cjs|css)$|\.chunk\.js$")
_BY_TOOL = re.compile(
    r"""(?ix)
      \bcode\ generated\b.*\bdo\ not\ edit
    | ^[\W_]*(?:this\ (?:file|code|source|module|class)\ (?:was|is|has\ been)\ )?(?:automatically|auto)[-\ ]?(?:generated|created|produced|built|written)\b
    | ^[\W_]*(?:this\ (?:file|code|source|module|class)\ (?:was|is|has\ been)\ )(?:machine[-\ ])?(?:generated|created|produced)\ (?:by|from|with|using|automatically)\b
    | ^[\W_]*@generated\b
    | ^[\W_]*<auto-?generated\b
    | ^[\W_]*auto-?generated\b
    | ^[\W_]*generated\ (?:on|at|by|from|with|using|code|file|automatically)\b
    | ^[\W_]*(?:machine|tool)[-\ ]generated\b
    | \b(?:do\ not|don't|never)\ (?:edit|modify|change)\b.*\b(?:generated|by\ hand|manually|overwritten|regenerate)
    | \bgenerated\b.*\b(?:do\ not|don't)\ (?:edit|modify|change)\b
    | \bchanges?\ (?:made\ )?(?:here\ |to\ this\ file\ )?will\ be\ (?:lost|overwritten)
    | \b(?:edits|modifications)\ will\ be\ (?:lost|overwritten)
    | \b(?:diese\ datei|dieser\ code)\ (?:wurde|ist)\ (?:automatisch|maschinell)\b
    | \bautomatisch\ (?:erzeugt|generiert|erstellt)
    | \b(?:fichier|code)\ (?:généré|créé|produit)\b | \bgénéré\ (?:automatiquement|par)\b
    | \b(?:archivo|fichero|código)\ (?:generado|creado|producido)\b | \bgenerado\ (?:automáticamente|por)\b
    | \bgerado\ (?:automaticamente|por)\b
    | 自动生成 | 由.{0,20}生成 | 自動生成 | 自動的に生成 | によって生成 | сгенерирован
    """
)
#: Words of a comment that say a person keeps the file after all.
_BY_HAND = re.compile(r"(?i)\bmaintained by hand\b|\b(?:hand|manually)[- ](?:written|edited|maintained|tuned)\b|\bno longer generated\b|\bonce (?:produced|generated|created)\b|\boriginally (?:generated|produced)\b|\bnot generated\b|\bformerly generated\b|\b(?:now|since) (?:edited|kept|maintained) by\b")
_COPIED = re.compile(r"(?i)\bimported from release\b|\bvendored (?:from|copy)\b|\bcopied (?:verbatim )?from (?:upstream|https?:)|^\W*upstream:\s*(?:https?|git):|\bbundled (?:third[- ]party|copy of)\b|\blocal patches:")
_COMMENT = re.compile(r"^\s*(?://+|/\*+!?|\*+(?!/)|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma|endif|else|import)\b)|<!--|--|;+|%+|\"\"\"|''')")
_TOKEN = re.compile(r"""\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\#[^\n]*|\d[\w.]*|[^\W\d]\w*|[^\s\w]""")

#: Lines at the head of a file in which comments beside code may tell where it comes from, too.
HEAD = 25
#: Data: at least so many literals, at least this share of literals among literals and names.
LITERALS, LITERAL_SHARE = 24, 0.85
#: Or at least so many characters of literals that are no prose, and this share of all characters.
BLOB, BLOB_SHARE = 400, 0.85
CODE_SUFFIXES = re.compile(r"(?i)\.(?:py|pyi|js|jsx|mjs|cjs|ts|tsx|mts|cts|go|rs|java|c|h|cc|cpp|cxx|hpp|hh|hxx|ipp)$")
SCRIPT_SUFFIXES = re.compile(r"(?i)\.(?:js|jsx|mjs|cjs|ts|mts|css)$")


def _head(text: str) -> Iterator[str]:
    """The comment lines before the first line of code, stripped, however many and long they are; imports and the like may stand between."""
    block = False
    for m in re.finditer(r"[^\n]+", text):
        bare = m[0].strip()
        if not bare:
            continue
        comment = block or bool(_COMMENT.match(bare))
        if not comment:
            if re.match(r"(?:package|module|namespace|using|import|from|#|'use strict'|\"use strict\"|<\?)", bare):
                continue
            break
        if bare.startswith("/*") and "*/" not in bare:
            block = True
        elif "*/" in bare:
            block = False
        yield bare


def header_says_generated(text: str) -> bool:
    """Whether a comment at the head of the file says that a tool wrote it; strings and later code do not count."""
    return any(not _BY_HAND.search(x) and _BY_TOOL.search(re.sub(r"^(?://+|/\*+!?|\*+|#+|<!--|--|;+|%+)\s*", "", x)) for x in _head(text))


def header_says_copied(text: str) -> bool:
    """Whether a comment at the head, or one in the first lines of code, says that the file comes from elsewhere."""
    near = (x for x in text.split("\n", HEAD)[:HEAD] if _COMMENT.match(x))
    return any(_COPIED.search(x) for x in near) or any(_COPIED.search(x) for x in _head(text))


def numbered_series(text: str) -> bool:
    """Whether most lines run through one series of numbered names, as tools write them."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 12:
        return False
    shapes: dict[str, int] = {}
    for x in lines:
        if re.search(r"[A-Za-z_](\d+)\b", x):
            k = re.sub(r"\w+", lambda m: "n" if m[0].isdigit() else "w#" if m[0][-1].isdigit() else "w", x)
            shapes[k] = shapes.get(k, 0) + 1
    return sum(n for n in shapes.values() if n >= 6) >= 0.7 * len(lines)


def looks_minified(text: str) -> bool:
    """Whether a script was squeezed for delivery: hardly any blanks or breaks, short names, dense statements."""
    code = re.sub(r"/\*![\s\S]*?\*/|//#\s*sourceMappingURL=.*", "", text).strip()
    if len(code) < 200:
        return False
    lines = code.split("\n")
    average = len(code) / len(lines)
    blanks = sum(c.isspace() for c in code) / len(code)
    names = re.findall(r"[A-Za-z_$][\w$]*", code)
    short = sum(len(n) <= 2 for n in names) / max(1, len(names))
    return blanks < 0.12 and short > 0.45 and average > 60 or average > 250 and blanks < 0.1 and short > 0.3


def looks_like_data(text: str) -> bool:
    """Whether a source file is little but literals: tables of numbers, bytes, strings or records."""
    literals = names = size = whole = 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[0] in "#/" and len(t) > 1:
            continue
        whole += len(t)
        if t[0] in "\"'":
            literals += 1
            if sum(map(str.isspace, t)) <= 0.08 * len(t):  # else it is prose, such as a docstring
                size += len(t)
        elif t[0].isdigit():
            literals += 1
            size += len(t)
        elif t[0].isalpha() or t[0] == "_":
            names += 1
    many = literals >= LITERALS and literals >= LITERAL_SHARE * (literals + names)
    return many or size >= BLOB and size >= BLOB_SHARE * whole


#: Lines of a leaf below a file that a blank line ends, and from which on one line in so many ends it, by its own hash.
LEAF_LINES, LONG_LEAF, ONE_IN = 3, 8, 4


def leaves(text: str) -> Iterator[tuple[int, int]]:
    """(hash, lines) of the blocks of a text: the leaves below a file. Comments, blanks and layout do not matter. A block ends at
    a blank line, once it has three lines, or behind a line whose own hash says so, once it has eight: a change costs the
    blocks it touches, wherever blank lines stand."""
    block: list[str] = []
    for line in text.split("\n"):
        bare = "".join(line.split())
        if not bare:
            if len(block) >= LEAF_LINES:
                yield _hash("\n".join(block)), len(block)
                block = []
        elif not _COMMENT.match(line):
            block.append(bare)
            if len(block) >= LONG_LEAF and zlib.crc32(bare.encode("utf-8", "surrogatepass")) % ONE_IN == 0:
                yield _hash("\n".join(block)), len(block)
                block = []
    if block:
        yield _hash("\n".join(block)), len(block)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def judge(path: str, text: str) -> str | None:
    """generated, minified, vendored or data, by the file alone; None if it may be written by hand."""
    name = path.replace("\\", "/").rpartition("/")[2]
    if name.lower() in LOCK_FILES or _GENERATED_NAME.search(name):
        return "generated"
    if any(p.lower() in VENDOR_DIRS for p in path.replace("\\", "/").split("/")[:-1]):
        return "vendored"
    if not text.strip():
        return None
    if header_says_generated(text):
        return "generated"
    if SCRIPT_SUFFIXES.search(name) and (looks_minified(text) or _MINIFIED_NAME.search(name) and text.count("\n") < len(text) / 80):
        return "minified"
    if header_says_copied(text):
        return "vendored"
    if CODE_SUFFIXES.search(name):
        if looks_like_data(text):
            return "data"
        if numbered_series(text):
            return "generated"
    return None


def merkle_nodes(leaves_of_files: DataFrame) -> DataFrame:
    """Bottom-up Merkle hashes of all directory trees: (repo, path, digest, lines), of files and directories.

    Input: (repo, path, digest, lines) of files. A directory's digest is an order-free sum of hashes of its children's
    names and digests, so it is built with map-side combining and no directory's children are gathered. Level by level,
    as many as the deepest path has; every level has fewer rows and is written to the shared folder, so that plans stay
    as short as one level.
    """
    files = leaves_of_files.select("repo", "path", "digest", "lines", (F.size(F.split("path", "/")) - 1).alias("depth"))
    depth = files.select(F.max("depth")).first()[0] or 0
    levels = [files]
    level = files.where(F.col("depth") == depth)
    for d in range(depth, 0, -1):
        parent = F.regexp_replace("path", "/?[^/]*$", "")
        name = F.regexp_extract("path", "([^/]*)$", 1)
        # Halves of the hash, so that sums neither overflow nor lose bits.
        h = F.xxhash64(name, "digest")
        up = level.groupBy("repo", parent.alias("path")).agg(
            F.sum(F.shiftright(h, 32)).alias("a"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"), F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines")
        )
        up = up.select("repo", "path", F.xxhash64("a", "b", "n").alias("digest"), "lines", F.lit(d - 1).alias("depth"))
        up = write_out(up)
        levels.append(up)
        level = files.where(F.col("depth") == d - 1).unionByName(up)
    return reduce(DataFrame.unionByName, levels).where("path <> ''").select("repo", "path", "digest", "lines")


#: A copy with local changes: at least this share of a file's lines lies in blocks that unrelated repositories have, too.
SHARED = 0.6
#: Trees with fewer lines tell nothing (empty package files and the like).
LEAST_LINES = 5


#: Two repositories are one family if at least this share of the files of one is in the other, and so many files.
KIN_SHARE, KIN_FILES = 0.5, 5


def families(judged: DataFrame) -> DataFrame:
    """(repo, family, files): forks and mirrors are named after the repository whose files they hold, others after themselves.

    Only files that nothing else marks count. Each content is compared with one repository, the first that has it, so no
    pairs of repositories arise; a fork of a fork leads to the same first one.
    """
    own = judged.where((F.col("lines") >= LEAST_LINES) & F.col("reason").isNull()).select("repo", "digest").distinct()
    first = own.groupBy("digest").agg(F.min("repo").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    both = join_split_hot(own, first.where("n > 1"), ["digest"], F.col("n"), own.count()).where("repo <> first")
    alike = both.groupBy("repo", "first").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "repo")
    kin = alike.where((F.col("shared") >= KIN_FILES) & (F.col("shared") >= KIN_SHARE * F.col("size")))
    kin = kin.groupBy("repo").agg(F.min_by("first", F.struct(-F.col("shared"), "first")).alias("first"))
    every = judged.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    return every.join(kin, "repo", "left").select("repo", F.coalesce("first", "repo").alias("family"), "files")


def not_handwritten(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, reason) of every file that nobody wrote by hand; reason is generated, minified, vendored or data.

    Files are judged by name, header and layout. Copies of third-party code are found by Merkle hashes: a file's blocks
    are the leaves, files and directories the inner nodes; nodes with the same hash in two unrelated repositories (not
    forks of each other), known digests and files most of whose lines lie in blocks shared with an unrelated repository or a
    known release are vendored.
    Null texts and null ids are no cases, repeated rows count once; extra columns are ignored.
    """
    rows = files.select("file_id", "repo", "path", F.lower("sha256").alias("sha"), "text").where("text IS NOT NULL AND file_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("leaf", pa.int64()), ("lines", pa.int32())]))
        for batch in batches:
            texts, paths = batch.column("text").to_pylist(), batch.column("path").to_pylist()
            found = [judge(p or "", t) for p, t in zip(paths, texts)]
            blocks = [list(leaves(t)) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "file_id": batch.column("file_id"),
                    "repo": batch.column("repo").fill_null(""),
                    "sha": batch.column("sha"),
                    "path": pa.array([(p or "").replace("\\", "/").strip("/") for p in paths], pa.string()),
                    "reason": pa.array(found, pa.string()),
                    "digest": pa.array([_hash("|".join(str(h) for h, _ in b)) for b in blocks], pa.int64()),
                    "lines": pa.array([sum(n for _, n in b) for b in blocks], pa.int32()),
                    "blocks": pa.array([[{"leaf": h, "lines": n} for h, n in b] for b in blocks], kind),
                }
            )

    schema = f"file_id {dict(rows.dtypes)['file_id']}, repo string, sha string, path string, reason string, digest long, lines int, blocks array<struct<leaf:long,lines:int>>"
    # Texts are read once; what follows works on hashes.
    judged = write_out(rows.mapInArrow(run, schema).dropDuplicates(["file_id"]))
    own = judged.where("reason IS NOT NULL").select("file_id", "reason")
    known = upstream.select(F.lower("sha256").alias("sha")).dropna().distinct()
    listed = judged.join(known, "sha", "left_semi").select("file_id")

    kin, n_files = write_out(families(judged)), judged.count()
    contents = write_out(judged.where("lines > 0").groupBy("repo", "path").agg(F.max("digest").alias("digest"), F.max("lines").alias("lines")))
    trees = merkle_nodes(contents)
    trees = trees.where(F.col("lines") >= LEAST_LINES)
    # A tree of one repository may be in it more than once: first the repositories of a digest, then their families.
    holders = trees.groupBy("digest", "repo").agg(F.count(F.lit(1)).alias("n"))
    holders = join_split_hot(holders, kin, ["repo"], F.col("files"), n_files)
    twice = holders.groupBy("digest").agg(F.min("family").alias("r0"), F.max("family").alias("r1"), F.sum("n").alias("n")).where("r0 <> r1").select("digest", "n")
    shared = join_split_hot(trees, twice, ["digest"], F.col("n"), max(1, trees.count())).select("repo", "path").distinct()
    # A file lies in a shared tree if one of its ancestors or itself is one: ancestors are few, so they are listed.
    parts = F.split("path", "/")
    above = judged.select("file_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    in_tree = above.join(shared, ["repo", "path"], "left_semi").select("file_id")

    cells = judged.select("file_id", "repo", "lines", F.explode("blocks").alias("b")).select("file_id", "repo", "lines", "b.leaf", F.col("b.lines").alias("n_lines"))
    cells = cells.join(listed.withColumn("_known", F.lit(True)), "file_id", "left")
    holders = cells.groupBy("leaf", "repo").agg(F.max("_known").alias("known"), F.count(F.lit(1)).alias("n"))
    holders = join_split_hot(holders, kin, ["repo"], F.col("files"), n_files)
    stats = holders.groupBy("leaf").agg(F.min("family").alias("r0"), F.max("family").alias("r1"), F.max("known").alias("known"), F.sum("n").alias("n"))
    common = stats.where("r0 <> r1 OR known").select("leaf", "n")
    hits = join_split_hot(cells, common, ["leaf"], F.col("n"), max(1, cells.count()))
    alike = hits.groupBy("file_id").agg(F.sum("n_lines").alias("hit"), F.max("lines").alias("lines"))
    alike = alike.where((F.col("hit") >= LEAST_LINES) & (F.col("hit") >= SHARED * F.col("lines"))).select("file_id")
    vendored = listed.unionByName(in_tree).unionByName(alike).distinct().select("file_id", F.lit("vendored").alias("reason"))
    return own.unionByName(vendored).groupBy("file_id").agg(F.min("reason").alias("reason"))
