"""Sharding by a k-d tree: a node is split at the weighted median of its widest metadata
dimension until every leaf holds its share of the bytes.  DataFrame operations only.

Rows of a node are in a total order: the chosen dimension, a hash of the text, the row's own
number.  A median is searched as a quantile of that order with histograms of a fixed number
of bins, computed by Spark for all nodes of a level at once; only bins come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bins of one round, over all nodes of a level.
BINS = 1 << 13


def dimensions(df: DataFrame, names: list[str]) -> list[Column]:
    """Numbers stay as they are, anything else becomes a hash of its text; null is 0."""
    kinds = dict(df.dtypes)
    number = {"tinyint", "smallint", "int", "bigint"}
    return [F.coalesce(F.col(c).cast("long") if kinds[c] in number else F.crc32(F.col(c).cast("string")), F.lit(0)) for c in names]


def kd_shards(docs: DataFrame, shards: int, by: tuple[str, ...] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text", keep_whole: float = 0.002) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32, shard (from 0), slot (gapless from 0 in each shard).

    The leaves' targets are equal shares of all bytes; a node of k leaves is split at
    floor(k/2)/k of its weight.  Equal texts lie next to each other in the order, and a cut
    that would part them moves to the nearer end of their run while that costs at most
    ``keep_whole`` of a leaf; only larger groups of copies are parted.  Repeated rows and ties
    are told apart by the row's number.  An empty table gives an empty result; extra columns
    don't matter.  The widest dimension is the one whose range in the node is the largest part
    of its range over all rows, the first named among equals.
    """
    dims = [f"d{k}" for k in range(len(by))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("hash"), *[c.alias(d) for c, d in zip(dimensions(docs, list(by)), dims, strict=True)],
        ).withColumn("row", F.monotonically_increasing_id())
    )
    total = rows.agg(F.sum("size"), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    node = F.lit(0)
    if total[0]:
        spread = {d: max(1, total[2 + 2 * k] - total[1 + 2 * k]) for k, d in enumerate(dims)}
        leaf = total[0] / shards
        # nodes: number -> (leaves, key column); numbers are those of the first shard in the node
        level, node = {0: shards}, F.lit(0)
        while any(k > 1 for k in level.values()):
            open_nodes = {n: k for n, k in level.items() if k > 1}
            cuts = _medians(rows.withColumn("node", node), open_nodes, dims, spread, leaf * keep_whole)
            after, move = node, []
            for n, k in open_nodes.items():
                level[n], level[n + k // 2] = k // 2, k - k // 2
                move.append((n, n + k // 2, cuts[n]))
            for n, right, cut in move:
                after = F.when((node == n) & ~_before(cut), right).otherwise(after)
            rows = written(rows.withColumn("node_", after).drop("node").withColumnRenamed("node_", "node"))
            node = F.col("node")
    placed = rows.select("id", "size", "crc", "row", node.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(max(64, 1 + rows.count() // 200_000))).alias("block"))
    counts = placed.groupBy("shard", "block").count()
    first = counts.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return placed.withColumn("place", place).join(first, ["shard", "block"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("place")).alias("slot"))


def _before(cut: list[tuple[str, int]]) -> Column:
    """Whether a row lies before the cut: a list of (component, first value after the cut),
    each deciding among the rows that equal the ones before."""
    (name, value), *rest = cut
    here = F.col(name) < value
    return here | ((F.col(name) == value) & _before(rest)) if rest else here


def _medians(rows: DataFrame, nodes: dict[int, int], dims: list[str], spread: dict[str, int], spare: float) -> dict[int, list[tuple[str, int]]]:
    rows = rows.where(F.col("node").isin(list(nodes)))
    ranges = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(c).alias(n + c) for c in [*dims, "hash", "row"] for f, n in ((F.min, "lo_"), (F.max, "hi_"))]).collect()}
    state, done = {}, {}
    for n, k in nodes.items():
        if n not in ranges:  # no row came here
            done[n] = [("row", 0)]
            continue
        r = ranges[n]
        widest = max(dims, key=lambda d: ((r["hi_" + d] - r["lo_" + d]) / spread[d], -dims.index(d)))
        # equal: components already fixed; goal: weight that shall lie before the cut
        state[n] = {"order": [widest, "hash", "row"], "equal": [], "lo": r["lo_" + widest], "hi": r["hi_" + widest], "goal": r["w"] * (k // 2) / k}
    while state:
        bins = max(16, BINS // len(state))
        bucket, wanted, value = F.lit(None).cast("long"), F.lit(False), F.lit(None).cast("long")
        for n, s in state.items():
            mine = F.col("node") == n
            for c, v in s["equal"]:
                mine &= F.col(c) == v
            c = F.col(s["order"][0])
            mine &= c.between(s["lo"], s["hi"])
            s["step"] = (s["hi"] - s["lo"]) // bins + 1
            bucket = F.when(mine, F.expr(f"({s['order'][0]} - {s['lo']}L) div {s['step']}L")).otherwise(bucket)
            value = F.when(mine, c).otherwise(value)
            wanted |= mine
        seen = rows.where(wanted).select("node", "size", "hash", bucket.alias("bin"), value.alias("v")).groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("hash").alias("h0"), F.max("hash").alias("h1"))
        found: dict[int, list] = {n: [] for n in state}
        for r in seen.collect():
            found[r["node"]].append(r)
        for n, s in list(state.items()):
            run, got = 0, sorted(found[n], key=lambda r: r["lo"])
            for k, r in enumerate(got):
                if run + r["w"] >= s["goal"] or k == len(got) - 1:
                    break
                run += r["w"]
            before, inside = s["goal"] - run, r["w"]
            if min(before, inside - before) <= spare and (r["lo"] < r["hi"] or inside - before <= spare or before <= spare) and (s["order"][0] != "row" or r["lo"] == r["hi"]):
                # a border of this bin is near enough, and no run of equal texts is parted there
                done[n] = [*s["equal"], (s["order"][0], r["lo"] if before <= inside - before else r["hi"] + 1)]
                del state[n]
            elif r["lo"] < r["hi"]:
                s.update(lo=r["lo"], hi=r["hi"], goal=before)
            elif len(s["order"]) > 1:
                s["equal"].append((s["order"].pop(0), r["lo"]))
                s.update(lo=0, hi=2**62, goal=before)
                if s["order"][0] == "hash":
                    s.update(lo=r["h0"], hi=r["h1"])
            else:
                done[n] = [*s["equal"], ("row", r["lo"] if before <= inside - before else r["hi"] + 1)]
                del state[n]
    return done
