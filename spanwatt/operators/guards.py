"""Rules that rows must keep: what breaks them is named, counted while the rows pass, and kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanwatt.storage import written

#: Rules map a code to the condition that breaks it; a null condition does not.
Rules = dict[str, Column]


def broken(rules: Rules) -> Column:
    """The array of codes that a row breaks."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))


def marked(df: DataFrame, rules: Rules, name: str = "guard") -> tuple[DataFrame, Observation]:
    """``df`` with the column refusals, and counts that any action on it gathers on the way: rows, refused, and a
    count for every code."""
    seen = Observation(name)
    made = df.withColumn("refusals", broken(rules))
    counts = [F.coalesce(F.count_if(F.array_contains("refusals", code)), F.lit(0)).alias(code) for code in rules]
    return made.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("refusals") > 0).alias("refused"), *counts), seen


def divided(df: DataFrame, rules: Rules, name: str = "guard") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows that keep all rules, rows that don't with their refusals, the counts), in one pass over ``df``: it is written
    once, and both parts are read from there."""
    made, seen = marked(df, rules, name)
    made = written(made)
    return made.where(F.size("refusals") == 0).drop("refusals"), made.where(F.size("refusals") > 0), seen.get


def required(df: DataFrame, rules: Rules, message: str) -> DataFrame:
    """``df``, which fails the job that comes upon a row that breaks a rule, and names what it breaks; no job of its own."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in rules.values()])
    said = F.concat(F.lit(f"{message}: "), F.array_join(broken(rules), ", "))
    return df.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
