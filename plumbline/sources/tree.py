"""A source tree as a Spark data source: the driver lists names, executors read contents."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.operators.filters import (
    CONFIG_FILE_NAMES,
    ENV_TEMPLATES,
    IGNORED_DIRS,
    IGNORED_FILES,
    IGNORED_SUFFIXES,
    MARKDOWN_STEMS,
    SENSITIVE_NAMES,
    SENSITIVE_SUFFIXES,
)
from plumbline.functions.languages import BY_SUFFIX
from plumbline.sources.ignore import IgnoreStack, InvalidPattern

SCHEMA = "path string, entry_type string, language string, size_bytes long, mtime_ns long, ctime_ns long, sha256 string, text string, reason string"
#: Defaults of the options: largest file, deepest directory, most entries and bytes, bytes of one partition, largest ignore file.
OPTIONS = {"maxFileBytes": 1_000_000, "maxDepth": 64, "maxEntries": 100_000, "maxBytes": 512_000_000, "partitionBytes": 8_000_000, "maxIgnoreBytes": 256_000}


def language_of_path(path: str) -> str | None:
    name = path.rpartition("/")[2].lower()
    stem, _, suffix = name.rpartition(".")
    if stem and suffix in BY_SUFFIX:
        return BY_SUFFIX[suffix]
    if name in CONFIG_FILE_NAMES or name in ENV_TEMPLATES or name.startswith("requirements") and name.endswith(".txt"):
        return "config"
    return "markdown" if name in MARKDOWN_STEMS or stem in MARKDOWN_STEMS else None


def name_reason(path: str) -> str | None:
    """default_ignored, sensitive_filename or unsupported, by the name alone."""
    low = path.lower()
    name = low.rpartition("/")[2]
    if any(p in IGNORED_DIRS for p in low.split("/")) or name in IGNORED_FILES or name.endswith(tuple(IGNORED_SUFFIXES)):
        return "default_ignored"
    if ((name == ".env" or name.startswith(".env.")) and name not in ENV_TEMPLATES) or name in SENSITIVE_NAMES or name.endswith(tuple(SENSITIVE_SUFFIXES)):
        return "sensitive_filename"
    return None if language_of_path(path) else "unsupported"


def binary(data: bytes) -> bool:
    sample = data[:65_536]
    if b"\0" in sample or sample.startswith((b"\x7fELF", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"PK\x03\x04")):
        return True
    try:
        sample.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(sample) - 4 or len(data) <= len(sample):
            return True
    return sum(b < 32 and b not in b"\b\t\n\f\r" or b == 127 for b in sample) > 0.02 * max(1, len(sample))


def safe_read(root: str, path: str, most: int) -> tuple[bytes | None, str | None]:
    """(content, None) or (None, reason); links are not followed, and a file that changes while it is read is not taken."""
    try:
        fd = os.open(os.path.join(root, path), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    except OSError:
        return None, "unreadable"
    try:
        a = os.fstat(fd)
        if not stat.S_ISREG(a.st_mode):
            return None, "special_file"
        if a.st_size > most:
            return None, "oversize"
        data = b""
        while len(data) <= most and (part := os.read(fd, 1 << 20)):
            data += part
        b = os.fstat(fd)
    except OSError:
        return None, "unreadable"
    finally:
        os.close(fd)
    if (a.st_ino, a.st_size, a.st_mtime_ns, a.st_ctime_ns) != (b.st_ino, b.st_size, b.st_mtime_ns, b.st_ctime_ns) or len(data) != b.st_size:
        return None, "changed_during_scan"
    return data, None


def decoded(data: bytes) -> str | None:
    try:
        return data.decode("utf-8-sig").replace("\r\n", "\n")
    except UnicodeDecodeError:
        return None


def content(root: str, path: str, most: int) -> tuple[str | None, str | None, str | None]:
    """(sha256, text, reason for being skipped) of a file."""
    data, why = safe_read(root, path, most)
    if data is None:
        return None, None, why
    text = None if binary(data) else decoded(data)
    return hashlib.sha256(data).hexdigest(), text, "binary" if text is None else None


class Batch(InputPartition):
    def __init__(self, entries: list[tuple]) -> None:
        super().__init__(len(entries))
        self.entries = entries


class TreeReader(DataSourceReader):
    """Lists the tree in component order; a directory whose ignore file is invalid or unreadable is incomplete as a whole."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["path"])
        self.opt = {k: int(options.get(k.lower(), options.get(k, v))) for k, v in OPTIONS.items()}

    def _entries(self) -> Iterator[tuple]:
        """(path, type, size, mtime, ctime, reason) of every entry that is reached."""
        seen = total = 0
        out_of_budget = False

        def walk(directory: str, stack: IgnoreStack, depth: int) -> Iterator[tuple]:
            nonlocal seen, total, out_of_budget
            if depth > self.opt["maxDepth"]:
                yield directory, "directory", 0, 0, 0, "max_directory_depth"
                return
            ignore = os.path.join(self.root, directory, ".gitignore")
            if os.path.lexists(ignore):
                rel = f"{directory}/.gitignore" if directory else ".gitignore"
                data, reason = safe_read(self.root, rel, self.opt["maxIgnoreBytes"])
                try:
                    if reason:
                        raise InvalidPattern(reason)
                    stack = stack.below(directory, (data or b"").decode("utf-8-sig", "replace"))
                except InvalidPattern:
                    yield directory or ".", "directory", 0, 0, 0, "incomplete"
                    return
            try:
                names = sorted(os.listdir(os.path.join(self.root, directory)))
            except OSError:
                yield directory or ".", "directory", 0, 0, 0, "incomplete"
                return
            for name in names:
                path = f"{directory}/{name}" if directory else name
                seen += 1
                if out_of_budget:
                    return
                try:
                    s = os.lstat(os.path.join(self.root, path))
                except OSError:
                    yield path, "file", 0, 0, 0, "unreadable"
                    continue
                if seen > self.opt["maxEntries"]:
                    out_of_budget = True
                    yield ".", "directory", 0, 0, 0, "repository_budget"
                    return
                if stat.S_ISLNK(s.st_mode):
                    target = os.path.realpath(os.path.join(self.root, path))
                    yield path, "link", 0, 0, 0, "symlink" if target.startswith(self.root + os.sep) else "outside_root"
                elif stat.S_ISDIR(s.st_mode):
                    if name.lower() in IGNORED_DIRS:
                        yield path, "directory", 0, 0, 0, "default_ignored"
                    elif stack.ignored(path, True):
                        yield path, "directory", 0, 0, 0, "gitignored"
                    else:
                        yield from walk(path, stack, depth + 1)
                elif not stat.S_ISREG(s.st_mode):
                    yield path, "special", 0, 0, 0, "special_file"
                else:
                    reason = name_reason(path) if name_reason(path) == "default_ignored" else "gitignored" if stack.ignored(path, False) else name_reason(path)
                    reason = reason or ("oversize" if s.st_size > self.opt["maxFileBytes"] else None)
                    total += 0 if reason else s.st_size
                    if total > self.opt["maxBytes"]:
                        out_of_budget = True
                        yield ".", "directory", 0, 0, 0, "repository_budget"
                        return
                    yield path, "file", s.st_size, s.st_mtime_ns, s.st_ctime_ns, reason

        yield from walk("", IgnoreStack(), 0)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for e in self._entries():
            held.append(e)
            size += 0 if e[5] else e[2]
            if size >= self.opt["partitionBytes"] or len(held) >= 5_000:
                out.append(Batch(held))
                held, size = [], 0
        return [*out, Batch(held)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path, kind, size, mtime, ctime, reason in partition.entries:
            language = language_of_path(path) if kind == "file" else None
            if reason or kind != "file":
                yield path, kind, language, size, mtime, ctime, None, None, reason
                continue
            sha, text, why = content(self.root, path, self.opt["maxFileBytes"])
            yield path, kind, language, size, mtime, ctime, sha, text, why


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(dict(self.options))


def list_tree(path: str, **options: int) -> list[tuple]:
    """(path, type, size, mtime, ctime, reason) of every entry of a tree, without reading a file."""
    return list(TreeReader({"path": path, **options})._entries())


def read_changed(spark: SparkSession, path: str, entries: list[tuple], known: DataFrame | None, trust: bool = True, **options: int) -> DataFrame:
    """The rows of ``read_tree`` for listed entries, each with old_sha and was_stale of ``known`` (path, size_bytes, mtime_ns,
    ctime_ns, sha256, stale). With ``trust``, files whose size and times are the known ones are not read: they have neither
    text nor sha256 nor reason. One join decides; the driver only lists names.
    """
    root = os.path.realpath(path)
    most = int(options.get("maxFileBytes", OPTIONS["maxFileBytes"]))
    rows = listed(spark, entries)
    if known is None:
        rows = rows.withColumns({"old_sha": F.lit(None).cast("string"), "was_stale": F.lit(False), "same": F.lit(False)})
    else:
        old = known.select("path", F.struct("size_bytes", "mtime_ns", "ctime_ns").alias("_stat"), F.col("sha256").alias("old_sha"), F.col("stale").alias("was_stale"))
        same = (F.col("_stat") == F.struct("size_bytes", "mtime_ns", "ctime_ns")) & ~F.col("was_stale") & F.lit(trust)
        rows = rows.join(old, "path", "left").withColumns({"was_stale": F.coalesce("was_stale", F.lit(False)), "same": F.coalesce(same, F.lit(False))}).drop("_stat")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = []
                for name, kind, reason, same in zip(*(part.column(c).to_pylist() for c in ("path", "entry_type", "reason", "same"))):
                    is_file = kind == "file"
                    sha, text, why = content(root, name, most) if is_file and not same and not reason else (None, None, reason)
                    got.append((language_of_path(name) if is_file else None, sha, text, why))
                found = [pa.array([g[i] for g in got], pa.string()) for i in range(4)]
                kept = [part.column(c) for c in ("path", "entry_type", "size_bytes", "mtime_ns", "ctime_ns", "old_sha", "was_stale")]
                yield pa.RecordBatch.from_arrays([*kept, *found], READ)

    return rows.mapInArrow(read, "path string, entry_type string, size_bytes long, mtime_ns long, ctime_ns long, old_sha string, was_stale boolean, language string, sha256 string, text string, reason string")


READ = ["path", "entry_type", "size_bytes", "mtime_ns", "ctime_ns", "old_sha", "was_stale", "language", "sha256", "text", "reason"]
LISTED = pa.schema([("path", pa.string()), ("entry_type", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("ctime_ns", pa.int64()), ("reason", pa.string())])


def listed(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Entries as rows, in as many parts as the driver's default."""
    names = LISTED.names
    return spark.createDataFrame(pa.Table.from_pydict({n: [e[i] for e in entries] for i, n in enumerate(names)}, LISTED))


def read_tree(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Every entry of a tree with its reason for being skipped, if any; accepted files have a text."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("repotree").options(path=path, **{k: str(v) for k, v in options.items()}).load()
