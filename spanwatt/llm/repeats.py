"""What the two exact deduplications of passages share: copies of whole texts, and marks of
removed units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, written


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (a null id counts as the last), key (a hash of the text), text (null: empty).

    A row is told by (id, key): rows that share both are repeated rows and get one result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def later_copies(rows: DataFrame) -> DataFrame:
    """(id, key) of the rows whose whole text also belongs to a smaller id, as a written table.

    Texts are grouped by 128 bits of hash; counting comes before the shuffle."""
    keys = rows.select("id", "key", F.xxhash64(F.lit(1), "text").alias("more"))
    first = keys.groupBy("key", "more").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return written(keys.join(first, ["key", "more"]).where("id > first").select("id", "key").distinct())


def spread(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of size units are covered by windows of ``width`` units."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, size), -1)
    return np.cumsum(edge[:-1]) > 0


def spans(gone: np.ndarray) -> np.ndarray:
    """Maximal runs of true values, as rows (start, end)."""
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
