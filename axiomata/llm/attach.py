"""Joining facts about groups back to the rows of the groups, whatever their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with more than this share of all rows are joined by broadcast: at most ``SHARE`` of them can exist.
SHARE = 1024


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a group, none null in ``keys``) by ``keys``.

    ``copies`` names the column of ``facts`` with the rows of the group, ``total`` is the sum over all groups.
    Groups of over one in ``SHARE`` rows are fewer than ``SHARE``, so they are broadcast;
    what is shuffled holds no larger group. Rows without facts are dropped.
    """
    large = F.col(copies) > F.lit(max(SHARE, total // SHARE))
    hot = facts.filter(large)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.filter(~large), keys)
    return near.select(*far.columns).unionByName(far)
