"""Terms of texts, as Catalyst expressions; the exact variants that need Unicode tables are Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
STOP_WORDS = [
    "a", "an", "and", "are", "be", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "was",
    "what", "where", "which", "who", "why", "with",
]
MOST_QUERY_TERMS, LONGEST_TERM = 64, 128
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]+"
WORD = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
TOKEN = r"[\p{L}\p{N}]+"


def word_terms(text: Column) -> Column:
    """Runs of letters and digits, joined by underscores, in lower case, in order and with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case: the units of full-text search."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sub_terms(text: Column) -> Column:
    """Parts of words at underscores, camel case and acronyms, in lower case."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def document_terms(*texts: Column) -> Column:
    """Distinct words, parts of words and CJK grams of several texts, without stop words; nulls count as empty."""
    both = F.concat(*[F.concat(word_terms(t), sub_terms(t), cjk_grams(F.lower(t))) for t in (F.coalesce(t, F.lit("")) for t in texts)])
    return F.array_distinct(F.filter(both, lambda x: ~x.isin(*STOP_WORDS)))


def query_terms(text: Column) -> Column:
    """At most 64 terms of a question, first seen first, each cut to 128 code points."""
    return F.slice(F.transform(document_terms(text), lambda x: F.substring(x, 1, LONGEST_TERM)), 1, MOST_QUERY_TERMS)


def expansions(text: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Terms that a question did not say but may mean: other forms of its terms, and the terms of configured synonyms of the whole
    question or of a term. At most 64 with those it did say."""
    said = query_terms(text)
    forms = F.flatten(F.transform(said, morph_variants))
    if synonyms:
        table = F.create_map(*[F.lit(x) for k, v in synonyms.items() for x in (k.strip().lower(), " ".join(v))])
        keys = F.array_union(F.array(F.lower(F.trim(text))), said)
        forms = F.concat(forms, F.flatten(F.transform(F.filter(keys, lambda k: F.map_contains_key(table, k)), lambda k: query_terms(table[k]))))
    more = F.array_except(F.filter(forms, lambda x: ~x.isin(*STOP_WORDS)), said)
    return F.slice(more, F.lit(1), F.greatest(F.lit(0), F.lit(MOST_QUERY_TERMS) - F.size(said)))


def is_identifier(text: Column) -> Column:
    """Whether a question is one name, in snake or camel case."""
    return ~F.trim(text).rlike(r"\s") & (F.contains(text, F.lit("_")) | text.rlike("[a-z0-9][A-Z]"))


def literal_groups(text: Column) -> Column:
    """What a question says literally, as (group, term): each word is a group of its own; a word with CJK letters is a group of its
    grams, of which one is enough. A question that is one identifier is its first word only."""
    words = F.array_distinct(F.filter(word_terms(text), lambda t: ~t.isin(*STOP_WORDS)))
    words = F.when(is_identifier(text), F.slice(words, 1, 1)).otherwise(words)
    each = F.transform(words, lambda w, i: F.transform(F.when(w.rlike(CJK), cjk_grams(w)).otherwise(F.array(w)), lambda t: F.struct(i.alias("group"), t.alias("term"))))
    return F.flatten(each)


def cjk_grams(text: Column) -> Column:
    """Bigrams and trigrams of each run of CJK characters; a run of one character stands for itself."""

    def grams(run: Column, width: int) -> Column:
        n = F.length(run)
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(run, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))

    runs = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3)))))


def morph_variants(term: Column) -> Column:
    """Other forms of an English term: ies to y, s dropped, ed and ing dropped, with an e, and without a doubled end."""
    n = F.length(term)

    def stem(k: int) -> Column:
        base = F.substring(term, F.lit(1), n - k)
        doubled = F.substring(base, -1, 1) == F.substring(base, -2, 1)
        return F.concat(F.array(base, F.concat(base, F.lit("e"))), F.when(doubled, F.array(F.substring(base, F.lit(1), F.length(base) - 1))).otherwise(F.array().cast("array<string>")))

    none = F.array().cast("array<string>")
    plain = term.rlike("^[a-zA-Z0-9]+$")
    return (
        F.when(~plain, none)
        .when(term.endswith("ies") & (n >= 5), F.array(F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y"))))
        .when(term.endswith("ing") & (n >= 7), stem(3))
        .when(term.endswith("ed") & (n >= 6), stem(2))
        .when(term.endswith("s") & ~term.endswith("ss") & (n >= 5), F.array(F.substring(term, F.lit(1), n - 1)))
        .otherwise(none)
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def exact_terms(text: pa.Array) -> pa.Array:
    """Terms by NFKC and full case folding, which Spark lacks: words, their parts and CJK grams, first seen first."""
    word = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
    stop = set(STOP_WORDS)
    out = []
    for t in text.to_pylist():
        seen: dict[str, None] = {}
        for w in word.findall(unicodedata.normalize("NFKC", t or "")):
            apart = re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub("([a-z0-9])([A-Z])", r"\1_\2", w))
            for x in (w, *apart.split("_")):
                folded = unicodedata.normalize("NFKC", x).casefold()[:LONGEST_TERM]
                if folded and folded not in stop:
                    seen.setdefault(folded)
        out.append(list(seen))
    return pa.array(out, pa.list_(pa.string()))
