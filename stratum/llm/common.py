"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.storage import removed as drop
from stratum.storage import shared_folder, stored

__all__ = ["BROADCAST_ROWS", "by_key", "cut", "drop", "maybe_broadcast", "new_path"]

#: Sides of a join up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: A key is hot with more rows than this, and than one in ``HOT_KEYS`` of all rows: so at most ``HOT_KEYS`` keys are.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into a table in the shared folder, so that later reads neither repeat it nor depend on its executors."""
    return stored(df, "cut")


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows are few."""
    return F.broadcast(df) if rows <= limit else df


def by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined on ``key`` with ``table``, which has one row a key and, in ``count``, how many of ``rows`` it meets.

    ``total`` is the number of all rows. Hot keys, ``HOT_KEYS`` at most, are broadcast, so that their rows stay where
    they are; the rest is shuffled. Both sides are read twice, so they should be tables.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.where(F.col(count) > least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) <= least), key, how)
    return cold.unionByName(rows.join(F.broadcast(hot), key))
