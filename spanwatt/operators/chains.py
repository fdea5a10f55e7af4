"""Folds of a key's rows in order, where each row depends on what the rows before it left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.storage import written

#: Rows of a key that one fold takes; a key's next ones wait for a round of their own.
ROWS = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(rows: DataFrame, keys: list[str], order: list[str], start: DataFrame | None, fresh: Column, step: Callable[[Column, Column], Column], made: str, most: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(what ``step`` makes of every row, the memory of every key after its last row).

    rows: ``keys``, ``order`` and what the step needs.  start: keys and a column memory, for keys that have
    one; ``fresh`` is the memory of all others.  step: (memory, row) to a struct of ``memory`` and ``made``.
    A key's rows are folded in Spark's engine in runs of at most ``most`` rows, so no more than that meet in one
    value.  The first runs of all keys go side by side, then the second ones with the memories that the first ones left;
    runs and memories are written tables.
    """
    columns = [c for c in rows.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    inner = F.struct(*order, *[c for c in columns if c not in order])
    runs = written(rows.withColumn("_run", F.floor(place / most)).groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(inner)).alias("_rows")))
    last = runs.agg(F.max("_run")).first()[0] or 0

    def one(acc: Column, row: Column) -> Column:
        return let(F.struct(acc["out"].alias("out"), step(acc["memory"], row).alias("x")), lambda s: F.struct(s["x"]["memory"].alias("memory"), F.concat(s["out"], F.array(s["x"]["made"])).alias("out")))

    outs, memories, ended = [], start, []
    for k in range(last + 1):
        now = runs.where(F.col("_run") == k)
        now = now.withColumn("memory", fresh) if memories is None else now.join(memories, keys, "left").withColumn("memory", F.coalesce("memory", fresh))
        now = written(now.select(*keys, F.aggregate("_rows", F.struct(F.col("memory").alias("memory"), F.array().cast(f"array<{made}>").alias("out")), one).alias("x")))
        memories = now.select(*keys, "x.memory")
        ended.append(memories.withColumn("_run", F.lit(k)))
        outs.append(now.select(*keys, F.explode("x.out").alias("r")).select(*keys, "r.*"))
    final = reduce(DataFrame.unionAll, ended)
    if last:
        final = final.groupBy(*keys).agg(F.max_by("memory", "_run").alias("memory"))
    else:
        final = final.drop("_run")
    if start is not None:
        final = final.unionByName(start.join(runs.select(*keys).distinct(), keys, "left_anti"))
    return reduce(DataFrame.unionAll, outs), final
