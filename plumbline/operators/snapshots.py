"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.paths import clean_path


def latest(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key (map-side combined). Ties go to the greatest values, nulls last."""
    best = F.max(F.struct(order, *values)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def diff_consecutive(states: DataFrame, numbers: DataFrame, group: str, number: str, key: str, digest: Column, fallback: Column) -> DataFrame:
    """Added, removed and changed keys between each snapshot and the one before it in its group.

    ``states`` has one row per (group, number, key); ``numbers`` lists the snapshots that exist as (group, number), whose
    order decides what is consecutive, whatever the gaps. A full outer join on (group, position, key) pairs both sides:
    a missing side gives an addition or removal. ``digest`` is the row's canonical hash; where it is null on either
    side, ``fallback`` (never null) decides instead. Rows of unlisted snapshots, null keys and the first snapshot of a
    group give nothing; an empty snapshot removes all that the one before it had; empty tables give no rows.

    Result: group, number, key, change.
    """
    # One row per snapshot: partitions of this window are as small as the list of a group's snapshots.
    w = Window.partitionBy(group).orderBy(number)
    seq = numbers.select(group, number).dropna().distinct().select(group, number, F.row_number().over(w).alias("_seq"))
    rows = states.where(F.col(key).isNotNull()).join(seq, [group, number]).select(group, "_seq", key, digest.alias("_d"), fallback.alias("_f"))
    now = rows.where(F.col("_seq") > 1).select(group, "_seq", key, F.col("_d").alias("_d1"), F.col("_f").alias("_f1"))
    before = rows.select(group, (F.col("_seq") + 1).alias("_seq"), key, F.col("_d").alias("_d0"), F.col("_f").alias("_f0"))
    both = F.col("_d1").isNotNull() & F.col("_d0").isNotNull()
    change = (
        F.when(F.col("_f0").isNull(), "added")
        .when(F.col("_f1").isNull(), "removed")
        .when(F.when(both, F.col("_d1") != F.col("_d0")).otherwise(F.col("_f1") != F.col("_f0")), "changed")
    )
    out = now.join(before, [group, "_seq", key], "full_outer").select(group, "_seq", key, change.alias("change")).where("change is not null")
    return out.join(seq, [group, "_seq"]).select(group, number, key, "change")  # drops what follows a group's last snapshot


def manifest_changes(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes of paths between consecutive snapshots of each repository: repo, snapshot_no, path, change.

    Paths are cleaned first; of several deliveries of one path in one snapshot the latest holds (ties: the greatest row).
    Two rows differ if their sha256, ignoring case, differ, or, where one of these is null, if size or mtime differ (null
    equals only null). Null repositories, numbers or paths give nothing. Columns beyond those named are ignored.

    Digests travel as bytes, not as text, until a path's latest delivery is known, and as a hash of 64 bits from then on:
    it is compared with that of one other row only, so a change is missed once in 2^64.
    """
    rows = manifests.select(
        "repo", "snapshot_no", clean_path(F.col("path")).alias("path"), "delivered_at", as_bytes(F.lower("sha256")).alias("sha"), "size_bytes", "mtime_ns"
    )
    state = latest(rows, ["repo", "snapshot_no", "path"], "delivered_at", ["sha", "size_bytes", "mtime_ns"])
    digest = F.when(F.col("sha").isNotNull(), F.xxhash64("sha"))
    fallback = F.xxhash64(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("size_bytes", "mtime_ns")]))
    return diff_consecutive(state, snapshots, "repo", "snapshot_no", "path", digest, fallback)


def as_bytes(digest: Column) -> Column:
    """A lower-case hexadecimal digest as bytes, in the same order; other text as its own bytes behind a mark. Null stays null."""
    return F.when(digest.rlike("^([0-9a-f]{2})+$"), F.unhex(digest)).otherwise(F.concat(F.unhex(F.lit("FFFF")), F.encode(digest, "UTF-8")))
