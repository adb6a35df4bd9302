"""Six small projects, eighteen questions: what must be found, and what must not be answered."""

from __future__ import annotations

from plumbline.plans.engine import Engine
from plumbline.sources.questions import gate

PROJECTS = {
    "py": {
        "src/settings.py": 'def load_profile(path):\n    """Read a profile file."""\n    return open(path).read()\n', "src/start.py": "from .settings import load_profile\n\n\ndef launch():\n    return load_profile('p.toml')\n",
        "tests/decoy.py": "# notes\ndef other():\n    return 'load profile'\n",
    },
    "cpp": {"CMakeLists.txt": "project(lamp)\nadd_executable(lamp src/main.cpp)\n", "src/dimmer.hpp": "int parse_dimmer(const char *text);\n", "src/dimmer.cpp": '#include "dimmer.hpp"\n\nint parse_dimmer(const char *text) {\n    return text[0];\n}\n', "src/main.cpp": '#include "dimmer.hpp"\n\nint main() {\n    return parse_dimmer("7");\n}\n'},
    "rust": {"Cargo.toml": '[package]\nname = "ferryboat"\n', "src/tide.rs": "pub fn read_tide(name: &str) -> usize {\n    name.len()\n}\n", "src/main.rs": 'mod tide;\n\nfn main() {\n    println!("{}", tide::read_tide("high"));\n}\n'},
    "go": {"go.mod": "module quay.invalid/crane\n", "hoist/handler.go": "package hoist\n\nfunc ServeHoist(name string) string {\n\treturn name\n}\n", "cmd/main.go": 'package main\n\nimport (\n\t"quay.invalid/crane/hoist"\n)\n\nfunc main() {\n\thoist.ServeHoist("x")\n}\n'},
    "ts": {"package.json": '{\n  "name": "kite",\n  "dependencies": {"windlib": "1"}\n}\n', "src/api/gust.ts": "export async function fetchGust(place: string): Promise<string> {\n  return place;\n}\n", "src/Sky.tsx": "import { fetchGust } from './api/gust';\nexport const Sky = () => fetchGust('hill');\n"},
    "java": {"build.gradle": "plugins { id 'application' }\n", "Ledger.java": "package shop;\n\npublic class Ledger {\n    public int postEntry(int amount) {\n        return amount;\n    }\n}\n", "Shop.java": "package shop;\n\npublic class Shop {\n    public static void main(String[] args) {\n        new Ledger().postEntry(3);\n    }\n}\n"},
}
#: question, the path that must come, its lines (or None), paths that must not come first
QUESTIONS = [
    ("py", "Where is `load_profile` defined?", "src/settings.py", (1, 3)), ("py", "launch", "src/start.py", (4, 5)), ("py", "Which Erlang supervisor restarts crashed workers?", None, None),
    ("cpp", "Where is parse_dimmer implemented?", "src/dimmer.cpp", (3, 5)), ("cpp", "add_executable", "CMakeLists.txt", None), ("cpp", "How are Terraform VPC subnets provisioned?", None, None),
    ("rust", "Which function is read_tide?", "src/tide.rs", (1, 3)), ("rust", "main", "src/main.rs", (3, 5)), ("rust", "Where does the Postgres migration runner live?", None, None),
    ("go", "Who defines ServeHoist?", "hoist/handler.go", (3, 5)), ("go", "Where is main in the crane command?", "cmd/main.go", (7, 9)), ("go", "Which middleware validates JWT bearer signatures?", None, None),
    ("ts", "Where is fetchGust declared?", "src/api/gust.ts", (1, 3)), ("ts", "Sky", "src/Sky.tsx", None), ("ts", "How does WebSocket reconnect backoff work?", None, None),
    ("java", "What does postEntry do?", "Ledger.java", (4, 6)), ("java", "Shop", "Shop.java", None), ("java", "How are image thumbnails decoded?", None, None),
]


def test_release_gate(spark, tmp_path):
    hits = recall = mrr = cited = n = 0
    tp = fp = fn = 0
    engines = {}
    for name, files in PROJECTS.items():
        for p, t in files.items():
            (tmp_path / name / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / p).write_text(t)
        engines[name] = Engine(spark, str(tmp_path / name), str(tmp_path / f"{name}-store"))
        up = engines[name].scan()
        assert (up.generation, up.revision) == (1, 1)
    missed = []
    for project, question, path, lines in QUESTIONS:
        got = engines[project].ask(question, 5)
        if path is None:
            tp, fn = tp + (not got), fn + bool(got)
            if got:
                missed.append((question, [(g.citation, g.reason) for g in got]))
            continue
        n += 1
        fp += not got
        rank = next((i for i, g in enumerate(got, 1) if g.path == path), None)
        hits += rank is not None
        recall += rank is not None
        mrr += 1 / rank if rank else 0
        ok = any(g.path == path and (lines is None or g.start_line <= lines[0] and lines[1] <= g.end_line) for g in got)
        cited += ok
        if rank != 1 or not ok:
            missed.append((question, [(g.citation, g.reason) for g in got]))
    f1 = 2 * tp / max(1, 2 * tp + fp + fn)
    assert gate({"hit_rate": hits / n, "recall": recall / n, "mrr": mrr / n, "citation_recall": cited / n, "no_answer_f1": f1}) == [], missed
