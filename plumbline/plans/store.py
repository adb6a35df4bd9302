"""A versioned fact store: immutable generations of Parquet tables behind one pointer, with optimistic concurrency."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import terms as T
from plumbline.functions import text as X
from plumbline.operators import parsing, retrieval
from plumbline.sources.tree import content, language_of_path, listed

FORMAT = 2
TABLES = ("files", "symbols", "dependencies", "chunks")
#: Columns of the tables of a part, known beforehand so that no footers are read to plan a query.
SCHEMAS = {
    "files": "path string, language string, size_bytes long, sha256 string, line_count int, text string, mtime_ns long, ctime_ns long, is_entry_point boolean, error string, provenance string, stale boolean",
    "symbols": "path string, ordinal int, start_line int, end_line int, kind string, name string, signature string",
    "dependencies": "path string, ordinal int, line int, target string, kind string",
    "chunks": "path string, ordinal int, start_line int, end_line int, symbol string, content string",
    "terms": "path string, ordinal int, start_line int, end_line int, symbol string, _t_file_path array<string>, _t_symbol array<string>, _t_content array<string>, _terms array<string>",
    "gone": "path string",
    "stale": "path string",
}


class StaleScan(RuntimeError):
    """The store moved on since the scan began; scan again."""


class StoreError(RuntimeError):
    pass


@dataclass
class Pointer:
    """What CURRENT says: the generation that readers see, the revision of the last commit, and how it was made."""

    generation: int = 0
    revision: int = 0
    folder: str = ""
    fingerprint: str = ""
    incomplete: list[str] = field(default_factory=list)
    skipped: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    identity: str = ""
    format: int = FORMAT


@dataclass
class Update:
    added: int = 0
    changed: int = 0
    unchanged: int = 0
    removed: int = 0
    stale: int = 0
    generation: int = 0
    revision: int = 0
    cache_hit: bool = False


def fingerprint(manifest: object) -> str:
    """Digest of a manifest of components, by its canonical JSON."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Reasons of entries below which files may exist that the scan did not reach.
INCOMPLETE = ("incomplete", "repository_budget", "max_directory_depth")
#: Differences that are read and parsed by the driver; more go through Spark.
FEW = 200
#: Parts of which a generation may consist before it is written anew.
MOST_PARTS = 8


class Folder:
    """A folder on any file system that Spark reaches, so that the driver and all executors see the same."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._jvm, at = jvm, jvm.org.apache.hadoop.fs.Path(root)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(at).toString().rstrip("/")
        self._fs.mkdirs(at)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def put(self, source: str, name: str) -> None:
        """Gives a folder its final name, unless another process was first."""
        if self.exists(name) or not self._fs.rename(self._at(source), self._at(name)):
            self.delete(source)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.root)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of this name."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        with_close = self._fs.open(at)
        try:
            return bytes(with_close.readAllBytes()).decode()
        finally:
            with_close.close()

    def replace(self, name: str, text: str) -> None:
        """Puts a text in the place of a file; readers see the old or the new one, whole."""
        temp = f"{name}.{uuid.uuid4().hex}"
        self.create(temp, text)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(self._at(temp), self._at(name), how)


class FactStore:
    """Facts of one tree below a shared folder. A generation is a list of parts, gen-N folders that never change once CURRENT
    names them: what is new lies in the last one, with the paths that the ones before no longer hold and those that are stale."""

    def __init__(self, spark: SparkSession, root: str, registry: parsing.ParserRegistry | None = None, identity: str = "") -> None:
        """``identity`` is that of the tree: a store that holds facts of another one starts anew."""
        self.spark, self.files, self.identity = spark, Folder(spark, root), identity
        self.registry = registry or parsing.default_registry()

    @property
    def components(self) -> dict[str, str]:
        """Fingerprints of what facts depend on, one for each kind."""
        return {
            "parsers": fingerprint(self.registry.manifest()),
            "format": fingerprint(FORMAT),
            "chunks": fingerprint([parsing.MAX_LINES, parsing.MAX_CHARS, parsing.MAX_FACTS]),
            "terms": fingerprint([T.WORD, T.TOKEN, T.CJK, T.STOP_WORDS, T.LONGEST_TERM]),
        }

    @property
    def component(self) -> str:
        return fingerprint(self.components)

    def pointer(self) -> Pointer:
        text = self.files.read("CURRENT")
        if text is None:
            return Pointer()
        data = json.loads(text)
        if data.get("format") != FORMAT:
            raise StoreError(f"unknown store format {data.get('format')}")
        p = Pointer(**data)
        return p if not self.identity or p.identity in ("", self.identity) else Pointer(p.generation, p.revision)

    def table(self, name: str, pointer: Pointer | None = None) -> DataFrame:
        """A table of one generation: pass a pointer to read several tables of the same one."""
        p = pointer or self.pointer()
        if not p.folder:
            raise StoreError("nothing was committed yet")
        read = lambda part, what: self.spark.read.schema(SCHEMAS[what]).parquet(self.files.path(f"{part}/{what}"))
        out = read(p.parts[0], name)
        for part in p.parts[1:]:
            out = out.join(read(part, "gone"), "path", "left_anti").unionByName(read(part, name))
        if name == "files":
            stale = read(p.parts[-1], "stale").withColumn("_stale", F.lit(True))
            columns = out.columns
            out = out.join(stale, "path", "left").withColumn("stale", F.coalesce("_stale", F.lit(False))).select(*columns)
        return out

    def index(self, pointer: Pointer) -> DataFrame:
        """The inverted index of a generation: its chunks without contents, with their tokens and terms. It is kept by parts like the
        facts, so only the chunks of new parts are ever tokenised; a part that has none yet gets it now."""
        for part in pointer.parts:
            if not self.files.exists(f"{part}/terms"):
                chunks = self.spark.read.schema(SCHEMAS["chunks"]).parquet(self.files.path(f"{part}/chunks")).withColumn("file_path", F.col("path"))
                work = f"work-{uuid.uuid4().hex}"
                rows = retrieval.indexed(chunks).select("path", "ordinal", "start_line", "end_line", "symbol", *[f"_t_{c}" for c in retrieval.WEIGHTS], "_terms")
                rows.write.parquet(self.files.path(work))
                self.files.put(work, f"{part}/terms")
        return self.table("terms", pointer)

    @contextlib.contextmanager
    def _lock(self, wait_s: float = 30.0) -> Iterator[None]:
        until = time.monotonic() + wait_s
        while not self.files.create("LOCK", str(os.getpid())):
            if time.monotonic() > until:
                raise StoreError("the store is locked")
            time.sleep(0.05)
        try:
            yield
        finally:
            self.files.delete("LOCK")

    def differences(self, entries: list[tuple], files: DataFrame, most: int) -> list:
        """Paths whose size or times differ between listed entries and facts, that only one side has or that are stale, with what
        both sides say of them; at most ``most``. One aggregation, and nothing is read."""
        stat = F.struct("size_bytes", "mtime_ns", "ctime_ns")
        new = listed(self.spark, [e for e in entries if e[1] == "file" and not e[5]]).select("path", stat.alias("new"), F.lit(None).cast("struct<stat:struct<size_bytes:bigint,mtime_ns:bigint,ctime_ns:bigint>,sha:string,stale:boolean>").alias("old"))
        old = files.select("path", F.lit(None).cast("struct<size_bytes:bigint,mtime_ns:bigint,ctime_ns:bigint>").alias("new"), F.struct(stat.alias("stat"), F.col("sha256").alias("sha"), "stale").alias("old"))
        both = new.unionByName(old).groupBy("path").agg(F.max("new").alias("new"), F.max("old").alias("old"))
        return both.where(~F.col("new").eqNullSafe(F.col("old.stat")) | F.coalesce("old.stale", F.lit(False))).limit(most).collect()

    def commit_few(self, root: str, entries: list[tuple], changed: list, base: Pointer, most_bytes: int) -> Update:
        """Commits the few differences of a listed tree: they are read and parsed here, and a part is written for them. The result
        is that of ``commit`` for the whole scan."""
        incomplete = sorted(e[0] for e in entries if e[5] in INCOMPLETE)
        skipped = Counter(e[5] for e in entries if e[5])
        under = lambda p: any(i == "." or p == i or p.startswith(i + "/") for i in incomplete)
        states: dict[str, list[str]] = {k: [] for k in ("added", "changed", "unchanged", "removed", "stale", "still_stale")}
        rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        for r in changed:
            sha, text, why = content(root, r.path, most_bytes) if r.new else (None, None, None)
            skipped.update([why] if why else [])
            if text is None:
                if r.old:
                    states["removed" if not under(r.path) else "still_stale" if r.old.stale else "stale"].append(r.path)
                continue
            if r.old and r.old.sha == sha and not r.old.stale:
                continue
            states["changed" if r.old else "added"].append(r.path)
            language = language_of_path(r.path)
            facts = self.registry.parse(language or "", r.path, text)
            common = {"path": r.path, "language": language, "sha256": sha, "text": text, "line_count": len(parsing.split_lines(text)) if text else 0}
            rows["files"].append({**common, **r.new.asDict(), "is_entry_point": facts.is_entry_point, "error": facts.error, "provenance": "source", "stale": False})
            for t in TABLES[1:]:
                rows[t] += [{"path": r.path, "ordinal": i, **asdict(x)} for i, x in enumerate(getattr(facts, t))]
        moved = sum(len(states[k]) for k in ("added", "changed", "removed", "stale"))
        known = sum(e[1] == "file" and not e[5] for e in entries) - sum(1 for r in changed if r.new)
        touched = sum(1 for r in changed if r.new and r.old) - len(states["changed"]) - sum(1 for p in (*states["removed"], *states["stale"], *states["still_stale"]) if any(r.path == p and r.new for r in changed))
        up = Update(len(states["added"]), len(states["changed"]), known + touched, len(states["removed"]), len(states["stale"]) + len(states["still_stale"]))

        def write(folder: str) -> list[str]:
            self.files.delete(folder)
            out = {**rows, "gone": [{"path": p} for p in states["changed"] + states["removed"]], "stale": [{"path": p} for p in states["stale"] + states["still_stale"]]}
            for t in [t for t, x in out.items() if not x]:
                self.files.make(f"{folder}/{t}")
            with ThreadPoolExecutor(4) as pool:
                list(pool.map(lambda t: self.spark.createDataFrame(out[t], SCHEMAS[t]).coalesce(1).write.mode("append").parquet(self.files.path(f"{folder}/{t}")), [t for t, x in out.items() if x]))
            return [*base.parts, folder]

        return self._publish(base, up, moved, incomplete, dict(skipped), True, write)

    def _publish(self, base: Pointer, up: Update, moved: int, incomplete: list[str], skipped: dict[str, int], same_parsers: bool, write: Callable[[str], list[str]]) -> Update:
        """Writes what moved and puts the pointer there, unless another commit came between or nothing is new."""
        with self._lock():
            here = self.pointer()
            if (here.generation, here.revision) != (base.generation, base.revision):
                raise StaleScan(f"store is at {here.generation}.{here.revision}, the scan began at {base.generation}.{base.revision}")
            if base.folder and not moved and same_parsers and here.incomplete == incomplete and here.skipped == skipped:
                up.generation, up.revision, up.cache_hit = here.generation, here.revision, True
                return up
            new = bool(moved or not same_parsers or not base.folder)
            nxt = Pointer(here.generation + new, here.revision + 1, here.folder, self.component, incomplete, skipped, list(here.parts), identity=self.identity)
            if new:
                nxt.folder = f"gen-{nxt.generation}-{nxt.revision}"
                nxt.parts = write(nxt.folder)
            self.files.replace("CURRENT", json.dumps(asdict(nxt), sort_keys=True))
        up.generation, up.revision = nxt.generation, nxt.revision
        return up

    def commit(self, scan: DataFrame, base: Pointer, rebuild: bool = False) -> Update:
        """Commits a scan (rows of the tree source). The scan must have begun at ``base``: if another commit came between,
        StaleScan is raised and nothing changes.

        The scan is evaluated once: its rows, with the facts of what is new, are written out and all else works on that.
        A row without text and reason is a file whose size and times are those of the facts, which holds for its content.
        Paths that are gone are removed, unless they lie under an incomplete directory: then they stay, marked stale. A
        commit that changes nothing but times writes no facts. The generation moves on only if facts changed; the revision
        with every commit that is no cache hit. Only new and changed files are parsed, unless the parsers changed.
        """
        same_parsers = base.fingerprint == self.component and not rebuild
        work = f"work-{uuid.uuid4().hex}"
        try:
            return self._commit(scan, base, same_parsers, work)
        finally:
            self.files.delete(work)

    def _commit(self, scan: DataFrame, base: Pointer, same_parsers: bool, work: str) -> Update:
        old = self.table("files", base) if base.folder else None
        if "old_sha" not in scan.columns:
            known = (old.select("path", F.col("sha256").alias("old_sha"), F.col("stale").alias("was_stale")) if old is not None else scan.select("path", F.col("sha256").alias("old_sha"), F.lit(False).alias("was_stale")).limit(0))
            scan = scan.join(known, "path", "left").withColumn("was_stale", F.coalesce("was_stale", F.lit(False)))
        as_before = (F.col("old_sha") == F.coalesce("sha256", "old_sha")) & ~F.col("was_stale")
        facts = parsing.parse_all(scan, self.registry, as_before if same_parsers else None)
        is_file = (F.col("entry_type") == "file") & F.col("reason").isNull()
        facts = facts.withColumn("status", F.when(is_file, F.when(F.col("old_sha").isNull(), "added").when(as_before, "unchanged").otherwise("changed")))
        facts.write.parquet(self.files.path(f"{work}/scan"))
        seen = self.spark.read.schema(facts.schema).parquet(self.files.path(f"{work}/scan"))
        found = seen.groupBy("reason", "status").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("reason").isin(*INCOMPLETE), F.col("path"))).alias("p")).collect()
        incomplete = sorted({p for r in found for p in r.p})
        skipped = {r.reason: r.n for r in found if r.reason}
        counts = {r.status: r.n for r in found if r.status}
        now = seen.where("status IS NOT NULL")
        gone = now.select("path", "status").limit(0)
        if old is not None:
            # What lies under an incomplete directory, by its ancestors: a join, however many such directories there are.
            lost = old.select("path", "stale").join(now.select("path"), "path", "left_anti")
            up = F.explode(F.array_union(F.array(F.lit(".")), X.ancestors(F.col("path")))).alias("up")
            under = lost.select("path", up).join(self.spark.createDataFrame([(p,) for p in incomplete], "up string"), "up", "left_semi").select("path", F.lit(True).alias("under")).distinct()
            what = F.when(F.col("under") & F.col("stale"), "still_stale").when(F.col("under"), "stale").otherwise("removed")
            gone = lost.join(under, "path", "left").select("path", what.alias("status"))
            gone.write.parquet(self.files.path(f"{work}/gone"))
            gone = self.spark.read.schema("path string, status string").parquet(self.files.path(f"{work}/gone"))
            counts |= {r.status: r.n for r in gone.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        moved = sum(counts.get(k, 0) for k in ("added", "changed", "removed", "stale"))
        up = Update(*(counts.get(k, 0) for k in ("added", "changed", "unchanged", "removed")), stale=counts.get("stale", 0) + counts.get("still_stale", 0))
        fits = base if old is not None and same_parsers else None
        return self._publish(base, up, moved, incomplete, skipped, same_parsers, lambda folder: self._write(folder, now, gone, fits))

    def _write(self, folder: str, now: DataFrame, gone: DataFrame, base: Pointer | None) -> list[str]:
        """Writes a generation and gives the folders it consists of: a part with what is new and a list of the paths that
        older parts no longer hold; or, beyond MOST_PARTS of them or without an older generation, everything anew."""
        self.files.delete(folder)  # left over from a commit that failed before CURRENT named it
        parts = [] if base is None or len(base.parts) >= MOST_PARTS else base.parts
        rows = now.where(F.col("status").isin("added", "changed")) if base is not None else now
        files = rows.select("path", "language", "size_bytes", "sha256", X.line_count(F.col("text")).alias("line_count"), "text", "mtime_ns", "ctime_ns", "is_entry_point", "error", F.lit("source").alias("provenance"), F.lit(False).alias("stale"))
        new = {"files": files, **{t: parsing.exploded(rows, t) for t in TABLES[1:]}}
        states = now.select("path", "status").unionByName(gone)
        out = {"stale": states.where(F.col("status").isin("stale", "still_stale")).select("path")}
        if base is not None and not parts:
            kept = states.where(F.col("status").isin("unchanged", "stale", "still_stale")).select("path")
            new = {t: new[t].unionByName(self.table(t, base).select(*new[t].columns).join(kept, "path", "left_semi")) for t in TABLES}
        elif parts:
            out["gone"] = states.where(F.col("status").isin("changed", "removed")).select("path")
        with ThreadPoolExecutor(4) as pool:  # small jobs side by side
            list(pool.map(lambda x: x[1].write.parquet(self.files.path(f"{folder}/{x[0]}")), {**new, **out}.items()))
        return [*parts, folder]

    def clean(self) -> list[str]:
        """Removes parts that CURRENT does not name; refuses if anything unknown lies in the folder."""
        here, names = self.pointer(), self.files.names()
        if odd := [n for n in names if not re.fullmatch(r"CURRENT|LOCK|(?:gen-\d+-\d+)|work-[0-9a-f]+|\..*\.crc", n)]:
            raise StoreError(f"unknown entries: {odd[:3]}")
        gone = [n for n in names if n.startswith(("gen-", "work-")) and n not in here.parts]
        for n in gone:
            self.files.delete(n)
        return gone

    def status(self) -> dict[str, object]:
        p = self.pointer()
        counts = {t: self.table(t, p).count() for t in TABLES} if p.folder else dict.fromkeys(TABLES, 0)
        return {**asdict(p), "components": self.components, "parsers_current": p.fingerprint == self.component, **{f"n_{t}": n for t, n in counts.items()}}
