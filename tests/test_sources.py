from __future__ import annotations

import json

import pytest

from plumbline.sources.questions import Settings, faults, fingerprints, gate, read_questions, tree_digest

Q = {"question": "Where is it?", "language": "en", "query_type": "definition", "answerable": True, "relevant": [{"path": "a.py", "start": 1, "end": 2, "grade": 3}], "must_not_return": [], "extra": 1}


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps(Q) + "\n" + json.dumps({**Q, "question": "Which?", "answerable": False, "relevant": []}) + "\n")
    (tmp_path / "q.json").write_text(json.dumps([Q]))
    assert read_questions(spark, str(tmp_path / "q.jsonl")).count() == 2
    assert read_questions(spark, str(tmp_path / "q.json")).first().relevant[0].grade == 3
    assert faults([Q], {"a.py": 2}) == [] and len(faults([Q, Q, {**Q, "question": "x", "answerable": False}], {"a.py": 1})) == 5


def test_gate():
    good = {"hit_rate": 1.0, "recall": 0.8, "mrr": 0.9, "citation_recall": 1.0, "no_answer_f1": 0.9}
    assert gate(good) == [] and len(gate({**good, "mrr": 0.7, "recall": None}, 2)) == 3


def test_settings(tmp_path):
    user, repo = tmp_path / "user.toml", tmp_path / "repo.toml"
    user.write_text('max_depth = 90\n[synonyms]\nConfig = ["Settings"]\n')
    repo.write_text("max_depth = 100\nlimit = 3\n")
    s = Settings.load(str(user), str(repo), {"PLUMBLINE_MAX_ENTRIES": "7"})
    assert (s.max_depth, s.limit, s.max_entries) == (90, 3, 7) and s.expanded(["config", "x", "settings"]) == ["config", "x", "settings"]
    repo.write_text("[synonyms]\na = ['b']\n")
    with pytest.raises(ValueError):
        Settings.load(None, str(repo), {})
    with pytest.raises(ValueError):
        Settings.load(None, None, {"PLUMBLINE_LIMIT": "0"})


def test_digests(tmp_path):
    (tmp_path / "a").write_text("x")
    before = tree_digest(str(tmp_path))
    (tmp_path / "a").write_text("y")
    assert tree_digest(str(tmp_path)) != before
    assert fingerprints({"a": {"y": 1, "x": 2}}) == fingerprints({"a": {"x": 2, "y": 1}})
