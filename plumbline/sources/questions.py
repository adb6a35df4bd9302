"""Question sets with graded answers, and the settings of an engine."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "question string, language string, query_type string, answerable boolean, relevant array<struct<path:string,start:int,end:int,grade:int>>, must_not_return array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A set of questions as JSON lines, or as one JSON list; unknown fields are ignored."""
    whole = Path(path).read_text().lstrip().startswith("[")
    return spark.read.schema(SCHEMA).option("multiLine", whole).json(path)


def faults(questions: list[dict], line_counts: dict[str, int]) -> list[str]:
    """What is wrong with a question set, judged against the files it speaks of."""
    out, seen = [], set()
    for i, q in enumerate(questions, 1):
        text = (q.get("question") or "").strip()
        if not text or text in seen:
            out.append(f"{i}: empty or repeated question")
        seen.add(text)
        relevant = q.get("relevant") or []
        if bool(q.get("answerable")) != bool(relevant):
            out.append(f"{i}: answerable means that there are relevant places")
        for r in relevant:
            if not 1 <= r["start"] <= r["end"] <= line_counts.get(r["path"], 0) or not 1 <= r.get("grade", 1) <= 3:
                out.append(f"{i}: {r['path']} has no such lines or grade")
    return out


def tree_digest(root: str) -> str:
    """One digest of a tree's regular files, by sorted path and content."""
    h = hashlib.sha256()
    for p in sorted(x for x in Path(root).rglob("*") if x.is_file() and not x.is_symlink()):
        data = p.read_bytes()
        h.update(f"{p.relative_to(root).as_posix()}\0{len(data)}\0".encode() + hashlib.sha256(data).digest())
    return h.hexdigest()


#: Least values of a retrieval gate.
GATE = {"hit_rate": 0.90, "recall": 0.80, "mrr": 0.75, "citation_recall": 1.0, "no_answer_f1": 0.80}


def gate(metrics: dict[str, float], violations: int = 0, least: dict[str, float] = GATE) -> list[str]:
    """The thresholds that are missed; a missing metric is one."""
    out = [f"{k}: {metrics.get(k)} < {v}" for k, v in least.items() if metrics.get(k) is None or metrics[k] < v]
    return out + ([f"{violations} forbidden paths"] if violations else [])


@dataclass(frozen=True)
class Settings:
    """Limits of an engine. A repository's own file may only lower them."""

    max_file_bytes: int = 1_000_000
    max_entries: int = 100_000
    max_bytes: int = 512_000_000
    max_depth: int = 64
    context_chars: int = 24_000
    limit: int = 8
    #: terms that stand for each other, only from the user
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def load(cls, user: str | None = None, repository: str | None = None, env: dict[str, str] | None = None) -> Settings:
        """Defaults, then the user's TOML, then the repository's (numbers only, and only downwards), then PLUMBLINE_* variables."""
        env = dict(os.environ) if env is None else env
        numbers = {f.name for f in fields(cls) if f.name != "synonyms"}
        out = cls()

        def checked(values: dict, allowed: set[str]) -> dict:
            if odd := sorted(set(values) - allowed):
                raise ValueError(f"unknown settings: {odd}")
            for k, v in values.items():
                if k in numbers and (not isinstance(v, int) or isinstance(v, bool) or v < 1):
                    raise ValueError(f"{k} is a positive whole number")
            return values

        if user and os.path.exists(user):
            values = checked(tomllib.loads(Path(user).read_text()), numbers | {"synonyms"})
            if "synonyms" in values:
                values["synonyms"] = tuple(sorted((k.lower(), tuple(map(str.lower, v))) for k, v in values["synonyms"].items()))
            out = replace(out, **values)
        if repository and os.path.exists(repository):
            values = checked(tomllib.loads(Path(repository).read_text()), numbers)
            out = replace(out, **{k: min(v, getattr(out, k)) for k, v in values.items()})
        given = {k: int(env[n]) for k in numbers if (n := f"PLUMBLINE_{k.upper()}") in env}
        return replace(out, **checked(given, numbers))

    def expanded(self, terms: list[str]) -> list[str]:
        """Terms with their synonyms after them, each once, in order."""
        known = dict(self.synonyms)
        return list(dict.fromkeys([*terms, *[s for t in terms for s in known.get(t, ())]]))


def fingerprints(parts: dict[str, object]) -> dict[str, str]:
    """A digest of each component's manifest by its canonical JSON."""
    return {k: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for k, v in parts.items()}
