"""Command line: scan, ask, map, diagram, status and doctor of a source tree."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.plans import report
from plumbline.plans.engine import Engine, MODES
from plumbline.sources.questions import Settings


def write_generated(target: Path, text: str, force: bool = False) -> None:
    """Writes a generated document atomically; a file that is not generated is kept unless forced."""
    if target.suffix.lower() not in (".md", ".markdown"):
        raise ValueError("a generated document has a Markdown suffix")
    if target.exists() and not force and "Generator: plumbline" not in target.read_text(errors="replace")[:4096]:
        raise FileExistsError(f"{target} was not generated")
    temp = target.with_name(f".{target.name}.{os.getpid()}")
    temp.write_text(text)
    os.replace(temp, target)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("command", choices=["scan", "ask", "map", "diagram", "status", "clean", "doctor"])
    p.add_argument("root")
    p.add_argument("question", nargs="?", default="")
    p.add_argument("--store", required=True, help="folder of the fact store")
    p.add_argument("--mode", choices=MODES, default="auto")
    p.add_argument("--limit", type=int)
    p.add_argument("--settings", help="TOML file of the user's settings; the tree's own plumbline.toml may only lower them")
    p.add_argument("--evidence", action="store_true", help="tables of evidence below a diagram")
    p.add_argument("--output", type=Path)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    use = Settings.load(a.settings, os.path.join(a.root, "plumbline.toml"))
    engine = Engine(spark, a.root, a.store, {k: list(v) for k, v in use.synonyms}, maxFileBytes=use.max_file_bytes, maxEntries=use.max_entries, maxBytes=use.max_bytes, maxDepth=use.max_depth)
    if a.command == "status":
        print(json.dumps(engine.store.status(), sort_keys=True))
        return 0
    if a.command == "doctor":
        print(json.dumps(engine.doctor(), sort_keys=True))
        return 0
    if a.command == "clean":
        print(json.dumps(engine.store.clean()))
        return 0
    update = engine.scan(a.mode)
    if a.command == "scan":
        print(json.dumps(asdict(update), sort_keys=True))
    elif a.command == "ask":
        print(report.extract(report.bounded(engine.ask(a.question, a.limit or use.limit), use.context_chars)))
    else:
        text = engine.map() if a.command == "map" else engine.diagram(a.evidence)
        if a.output:
            write_generated(a.output, text, a.force)
        else:
            print(text, end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
