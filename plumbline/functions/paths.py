"""Path functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrow import map_distinct


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode NFC, whole Arrow batches at a time (Spark SQL has no such function)."""
    return map_distinct(text, lambda s: s if s.isascii() else unicodedata.normalize("NFC", s))


def clean_path(path: Column) -> Column:
    """Forward slashes, no empty, ``.`` or ``..`` components (``..`` takes away the one before it), NFC. Null stays null."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return nfc(F.array_join(folded, "/"))
