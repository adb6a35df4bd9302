"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 4000


def join_split_hot(facts: DataFrame, dims: DataFrame, keys: list[str], weight: Column, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of many facts with one row per key, without sending a hot key's facts to one task.

    ``weight`` (over dims) is the number of facts of the key and ``total`` their sum, so at most 1 / share keys weigh
    share * total or more: that proven bound lets their dims be broadcast, and their facts are joined where they are.
    The facts of all other keys are shuffled; none of these keys holds more than share of the rows. Facts with a null
    key join nothing; empty inputs give an empty result.
    """
    least = max(2, int(total * share))
    hot = dims.where(weight >= least)
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return facts.join(F.broadcast(hot), keys).unionByName(rest.join(dims.where(weight < least), keys))
