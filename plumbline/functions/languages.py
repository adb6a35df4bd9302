"""Programming languages of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and the suffixes that mean them.
SUFFIXES = {
    "python": "py pyi",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx mts cts",
    "go": "go",
    "rust": "rs",
    "java": "java",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hh hxx ipp",
    "markdown": "md markdown mdown mdx",
    "config": "json jsonc json5 yaml yml toml ini cfg conf config xml properties gradle lock mod sum",
}
BY_SUFFIX = {s: language for language, all_of in SUFFIXES.items() for s in all_of.split()}


def suffix_language(path: Column) -> Column:
    """The language that the last suffix of a path means, ignoring case; null if none."""
    known = F.create_map(*[F.lit(x) for pair in BY_SUFFIX.items() for x in pair])
    return known[F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))]


def language_of(language: Column, path: Column) -> Column:
    """The given language if it is one of the known names as they stand; otherwise the path's suffix decides."""
    return F.when(language.isin(*SUFFIXES), language).otherwise(suffix_language(path))
