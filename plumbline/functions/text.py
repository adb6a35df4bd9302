"""Lines, names and display of text, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNSAFE = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"


def line_count(text: Column) -> Column:
    """Lines of a text: they end at line feeds, a final one starts no further line, an empty text has none."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def lines(text: Column) -> Column:
    """The lines of a text without their ends."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(text, "\n", -1), F.lit(1), line_count(text)))


def first_nonblank_line(text: Column) -> Column:
    """Number of the first line that is not blank; 1 if there is none."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.trim(F.regexp_replace(x, r"[\t\r\f\x0b]", " ")) != "", i + 1))
    return F.coalesce(F.array_min(F.filter(numbered, lambda x: x.isNotNull())), F.lit(1))


def citation(path: Column, start: Column, end: Column) -> Column:
    """path:start, and -end where it differs."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.when(end == start, F.lit("")).otherwise(F.concat(F.lit("-"), end.cast("string"))))


def top_group(path: Column) -> Column:
    """The first component of a path, or a name for the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("(repository root)"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_group(path: Column) -> Column:
    """Package of a path for the graph: below src and lib the next component, and one more if there is one."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    first = F.when(parts[0].isin("src", "lib") & (F.size(parts) > 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(F.size(first) == 0, stem).otherwise(F.array_join(F.slice(first, 1, 2), "."))


def node_id(label: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(F.sha1(label), 1, 10))


def is_test(path: Column) -> Column:
    """Whether a path looks like a test: by a directory's name, or by the file's."""
    low = F.lower(path)
    name = base_name(low)
    in_dir = F.exists(F.slice(F.split(low, "/"), F.lit(1), F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0))), lambda p: p.isin("test", "tests", "spec", "specs", "__tests__"))
    return in_dir | name.startswith("test_") | name.rlike(r"(_test\.py|\.(test|spec)\.(ts|js))$")


CONFIG_NAMES = [
    "cargo.toml", "dockerfile", "go.mod", "makefile", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "setup.cfg",
    "setup.py", "tsconfig.json",
]


def is_config(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.isin(*CONFIG_NAMES) | name.rlike(r"\.(yaml|yml|toml)$")


def unsafe_controls(text: Column) -> Column:
    """Whether a text has control or bidirectional characters that must not reach a terminal."""
    return text.rlike(UNSAFE)


def ancestors(path: Column) -> Column:
    """All directories above a path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def path_aliases(path: Column) -> Column:
    """Names by which a file may be imported: its path and base name with and without suffix, and every dotted tail."""
    low = F.lower(path)
    bare = F.regexp_replace(low, r"\.[^./]*$", "")
    package = F.regexp_replace(bare, "/__init__$", "")

    def tails(p: Column) -> Column:
        parts = F.split(p, "/")
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))

    return F.array_distinct(F.concat(F.array(low, base_name(low), bare, base_name(bare)), tails(bare), tails(package)))


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dots."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def is_local(url: Column) -> Column:
    """Whether an endpoint is this machine: none is given, or its host is a loopback name or address."""
    return F.coalesce(url.isNull() | url_host(url).rlike(r"^(localhost|127\.[0-9]+\.[0-9]+\.[0-9]+|\[::1\])$"), F.lit(False))
