"""The engine as a user sees it: scan a tree, ask, map, diagram."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import graph, retrieval
from plumbline.plans.store import FEW, MOST_PARTS, FactStore, Pointer, StaleScan, StoreError, Update
from plumbline.session import shared_dir, ship
from plumbline.sources.tree import OPTIONS, list_tree, read_changed

MODES = ("auto", "always", "never", "rebuild")


@dataclass(frozen=True)
class Evidence:
    path: str
    start_line: int
    end_line: int
    content: str
    score: float
    reason: str
    generation: int

    @property
    def citation(self) -> str:
        return f"{self.path}:{self.start_line}" + (f"-{self.end_line}" if self.end_line != self.start_line else "")


def tree_identity(root: str) -> str:
    """A digest of the device and the number of a tree's folder: another folder under the same name is another tree."""
    s = os.stat(root)
    return hashlib.sha256(f"{s.st_dev}:{s.st_ino}".encode()).hexdigest()


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str, synonyms: dict[str, list[str]] | None = None, **options: int) -> None:
        self.spark, self.root, self.options, self.synonyms = spark, root, options, synonyms
        self.store = FactStore(spark, store, identity=tree_identity(root))

    def scan(self, mode: str = "auto", attempts: int = 3) -> Update:
        """Brings the store up to date: auto and always parse what changed, rebuild everything, never only checks that facts fit."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        ship(self.spark)
        if mode == "never":
            p = self.store.pointer()
            if not p.folder or p.fingerprint != self.store.component:
                raise StoreError("the committed facts do not fit this engine; scan first")
            return Update(generation=p.generation, revision=p.revision, cache_hit=True)
        for left in range(attempts - 1, -1, -1):
            base = self.store.pointer()
            # auto trusts size and times of files whose facts fit; always and rebuild read every file.
            trust = mode == "auto" and bool(base.folder) and base.fingerprint == self.store.component
            entries = list_tree(self.root, **self.options)
            known = self.store.table("files", base) if base.folder else None
            try:
                if trust:
                    changed = self.store.differences(entries, known, FEW + 1)
                    if len(changed) <= FEW and (len(base.parts) < MOST_PARTS or not changed):
                        return self.store.commit_few(self.root, entries, changed, base, int(self.options.get("maxFileBytes", OPTIONS["maxFileBytes"])))
                return self.store.commit(read_changed(self.spark, self.root, entries, known, trust, **self.options), base, rebuild=mode == "rebuild")
            except StaleScan:
                if not left:
                    raise
        raise AssertionError

    def _views(self, pointer: Pointer | None = None) -> tuple[int, dict[str, DataFrame]]:
        """Tables of one pinned generation in the shape of the retrieval operators; only fresh files are seen."""
        p = pointer or self.store.pointer()
        fresh = self.store.table("files", p).where("NOT stale")
        ok = fresh.select("path")
        files = fresh.withColumns({"repo": F.lit("r"), "file_id": F.xxhash64("path")})
        chunks = self.store.table("chunks", p).join(ok, "path", "left_semi").withColumns({"repo": F.lit("r"), "file_path": F.col("path"), "chunk_id": F.xxhash64("path", "ordinal")})
        symbols = self.store.table("symbols", p).join(ok, "path", "left_semi").withColumns({"repo": F.lit("r"), "symbol_id": F.xxhash64("path", "ordinal", "name")})
        deps = self.store.table("dependencies", p).join(ok, "path", "left_semi").select(F.lit("r").alias("repo"), F.col("path").alias("source_path"), "line", "target")
        return p.generation, {"files": files, "chunks": chunks, "ok": ok, "symbols": symbols.select("symbol_id", "repo", "path", "name", "kind", "start_line", "end_line"), "deps": deps}

    def ask(self, question: str, limit: int = 8) -> list[Evidence]:
        """Ranked evidence for a question of at most 4000 characters; 1 to 20 results. Nothing if no chunk fits."""
        if not 1 <= limit <= 20 or len(question) > 4_000:
            raise ValueError("1 to 20 results for a question of at most 4000 characters")
        if not re.search(r"\w", question):
            return []
        shared_dir(self.spark)
        pointer = self.store.pointer()
        generation, v = self._views(pointer)
        qs = self.spark.createDataFrame([(1, question)], "qid long, question string")
        index = self.store.index(pointer).join(v["ok"], "path", "left_semi").withColumns({"repo": F.lit("r"), "file_path": F.col("path"), "chunk_id": F.xxhash64("path", "ordinal")})
        ranked = retrieval.hybrid(qs, index, v["files"], v["symbols"], v["deps"], limit, synonyms=self.synonyms)
        rows = ranked.join(v["chunks"].select("chunk_id", "content"), "chunk_id").orderBy("rank").collect()
        return [Evidence(r.path, r.start_line, r.end_line, r.content, r.score, r.reason, generation) for r in rows]

    def map(self) -> str:
        """A project map in Markdown: a few small aggregates, rendered here. The same facts give the same bytes."""
        from plumbline.plans import report

        return report.project_map(*self._views(), self.store.pointer().skipped)

    def diagram(self, evidence: bool = False) -> str:
        """A flowchart of the modules; with ``evidence`` also tables of a file for each node and of an import for each edge."""
        from plumbline.plans import report

        _, v = self._views()
        edges = graph.module_edges(retrieval.import_edges(v["deps"], v["files"])).orderBy(F.desc("n_edges"), "source", "target").collect()
        nodes = graph.module_nodes(v["files"]).orderBy(F.desc("n_files"), "label").collect()
        return report.flowchart(nodes, edges) + (report.evidence_tables(nodes, edges) if evidence else "")

    def doctor(self) -> dict[str, object]:
        """What a run depends on and whether it is there: versions, folders, the store and the parsers that made its facts."""
        from importlib.metadata import version

        p = self.store.pointer()
        return {
            "versions": {m: version(m) for m in ("pyspark", "pyarrow", "pandas", "numpy")},
            "root_readable": os.access(self.root, os.R_OK | os.X_OK),
            "shared_folder": shared_dir(self.spark),
            "store": {"folder": self.store.files.root, "committed": bool(p.folder), "generation": p.generation, "parts": len(p.parts), "incomplete": p.incomplete},
            "facts_fit": bool(p.folder) and p.fingerprint == self.store.component,
            "components": self.store.components,
            "synonyms": len(self.synonyms or {}),
        }

    def largest(self, k: int = 5) -> DataFrame:
        return self._views()[1]["files"].orderBy(F.desc(X.line_count(F.col("text"))), "path").limit(k).select("path", "line_count")
