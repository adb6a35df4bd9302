from __future__ import annotations

import datetime as dt
import random
import unicodedata

import pytest

from plumbline.operators.snapshots import manifest_changes

SCHEMA = "repo string, snapshot_no int, delivered_at timestamp, path string, sha256 string, size_bytes long, mtime_ns long, change string"
T0 = dt.datetime(2025, 1, 1)


def clean(p):
    out = []
    for x in p.replace("\\", "/").split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return unicodedata.normalize("NFC", "/".join(out))


def brute(rows, snaps):
    state = {}
    for repo, no, at, path, sha, size, mtime, _ in rows:
        if path is None or repo is None:
            continue
        k = (repo, no, clean(path))
        v = (at, sha.lower() if sha else "", size, -1 if mtime is None else mtime)
        if k not in state or v > state[k]:
            state[k] = v
    out = set()
    for repo in {r for r, _ in snaps}:
        nos = sorted(n for r, n in snaps if r == repo)
        for a, b in zip(nos, nos[1:]):
            x = {k[2]: v for k, v in state.items() if k[:2] == (repo, a)}
            y = {k[2]: v for k, v in state.items() if k[:2] == (repo, b)}
            out |= {(repo, b, p, "added") for p in y.keys() - x.keys()} | {(repo, b, p, "removed") for p in x.keys() - y.keys()}
            for p in x.keys() & y.keys():
                differ = x[p][1] != y[p][1] if x[p][1] and y[p][1] else x[p][2:] != y[p][2:]
                if differ:
                    out.add((repo, b, p, "changed"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    paths = ["a/b.py", "a//b.py", "./a/b.py", "a\\b.py", "x/../a/c.py", "a/c.py", "größe.py", unicodedata.normalize("NFD", "größe.py"), "A/b.py", None]
    rows = [(rng.choice("pq"), rng.choice([1, 2, 4, 9]), T0 + dt.timedelta(hours=i), rng.choice(paths), rng.choice([None, "AA", "aa", "bb"]), rng.choice([1, 2]), rng.choice([None, 5, 6]), "x") for i in range(120)]
    rows += rows[:15]
    snaps = [("p", 1), ("p", 2), ("p", 4), ("q", 2), ("q", 4)]
    got = manifest_changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*snaps, ("p", 1)], "repo string, snapshot_no int"))
    assert got.columns == ["repo", "snapshot_no", "path", "change"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == brute(rows, snaps)


def test_empty_snapshots_and_tables(spark):
    one = [("p", 1, T0, "a", "aa", 1, 1, "x")]
    snaps = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "repo string, snapshot_no int")
    assert [tuple(r) for r in manifest_changes(spark.createDataFrame(one, SCHEMA), snaps).collect()] == [("p", 2, "a", "removed")]
    assert manifest_changes(spark.createDataFrame([], SCHEMA), snaps).count() == 0
    assert manifest_changes(spark.createDataFrame(one, SCHEMA), snaps.limit(0)).count() == 0
