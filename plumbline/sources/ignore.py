"""Ignore files: patterns per directory, the last match decides, deeper files win over shallower ones."""

from __future__ import annotations

import re
from dataclasses import dataclass


class InvalidPattern(ValueError):
    """A line that is no pattern; its directory must not be scanned as if the line were not there."""


def translate(line: str) -> tuple[re.Pattern[str], bool, bool] | None:
    """(pattern over a path below the file's directory, negated, only directories) of a line; None for blank lines and comments."""
    if line.endswith("\\ "):
        line = line[:-2] + "\\ "
    else:
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if not line or line == "/":
        raise InvalidPattern(line)
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(line) and line[i] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "[" + inner.replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, only_dirs
    except re.error as e:
        raise InvalidPattern(line) from e


@dataclass(frozen=True)
class IgnoreStack:
    """Scopes from the root down: (directory, patterns)."""

    scopes: tuple[tuple[str, tuple[tuple[re.Pattern[str], bool, bool], ...]], ...] = ()

    def below(self, directory: str, text: str) -> IgnoreStack:
        """The stack with the ignore file of a directory added. Raises InvalidPattern."""
        rules = tuple(r for r in map(translate, text.splitlines()) if r)
        return IgnoreStack((*self.scopes, (directory, rules))) if rules else self

    def ignored(self, path: str, is_dir: bool) -> bool:
        verdict = False
        for directory, rules in self.scopes:
            inner = path[len(directory) + 1 :] if directory else path
            for pattern, negated, only_dirs in rules:
                if (is_dir or not only_dirs) and pattern.match(inner):
                    verdict = not negated
        return verdict
