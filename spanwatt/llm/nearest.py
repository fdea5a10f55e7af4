"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all.

1. Equal vectors become one, with its smallest ids; no more than k + 1 of them can be an answer.
2. The forest is fitted on at most ``sample`` of the distinct vectors (those with the smallest hashes).  A
   node splits at the median of the projection on the line through two of its vectors.  Every
   vector of the table is then put in a leaf of each tree.
3. A query walks all trees at once through one priority queue: the open node with the smallest sum of
   squared distances to the borders crossed so far comes next.  It stops when the leaves that it took hold
   ``share`` of the vectors, counted by tree.  The share is measured: on the sample, against brute force, as
   much as finds ``recall`` of the true neighbours of some of its vectors.
4. Rows of a leaf come to a task in blocks of bounded size, and the queries that want that leaf stream
   past them.  Candidates are ranked by the exact distance.

In a table of independent coordinates no projection tells neighbours apart, so the measured share
comes near to 1, the cost to that of brute force, and the recall stays.

Nulls: a vector that is null, zero, of another length than most of the sample, or with a null or non-finite
component takes no part, nor does a row without an id.  An empty table gives no row.  Ties fall to the
smaller id.  Rows that share an id are one entry with several vectors: the smallest distance counts; a
repeated row changes nothing.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bounds of the index: vectors that it is fitted on, those of them that measure the share, the fewest in a leaf.
SAMPLE, MEASURED, FEWEST = 16_384, 256, 8
#: Vectors of a leaf that one task holds at once.
BLOCK = 4_096


class Forest:
    """Trees as arrays: the children of node i are 2 i + 1 and 2 i + 2, the last level are the leaves."""

    def __init__(self, vectors: np.ndarray, trees: int, depth: int, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.inner = trees, depth, 2**depth - 1
        self.lines, self.cuts = np.zeros((trees, self.inner, vectors.shape[1])), np.zeros((trees, self.inner))
        for t in range(trees):
            own = {0: np.arange(len(vectors))}
            for node in range(self.inner):
                rows = own.pop(node)
                pair = vectors[rng.choice(rows, 2, replace=False)] if len(rows) > 1 else np.zeros((2, vectors.shape[1]))
                line = pair[0] - pair[1]
                if not line.any():
                    line = rng.normal(size=vectors.shape[1])
                self.lines[t, node] = line / np.linalg.norm(line)
                at = vectors[rows] @ self.lines[t, node]
                self.cuts[t, node] = np.median(at) if len(rows) else 0.0
                right = at > self.cuts[t, node]
                own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", vectors, self.lines[t, node]) > self.cuts[t, node])
            out[:, t] = node - self.inner
        return out

    def searched(self, vector: np.ndarray, sizes: np.ndarray, rows: float, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the queue, until they hold ``rows`` vectors in all and those
        of some tree hold ``least``.  sizes: vectors by tree and leaf."""
        margins = self.lines.reshape(-1, len(vector)) @ vector - self.cuts.reshape(-1) if self.inner else np.zeros(0)
        margins = margins.reshape(self.trees, self.inner).tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]
        taken, by_tree, found = 0, [0] * self.trees, []
        while queue and (taken < rows or max(by_tree) < least):
            far, t, node = heapq.heappop(queue)
            while node < self.inner:
                m = margins[t][node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (far + m * m, t, 4 * node + 3 - near))
                node = near
            n = int(sizes[t, node - self.inner])
            taken, by_tree[t] = taken + n, by_tree[t] + n
            found.append((t, node - self.inner))
        return found

    def share(self, vectors: np.ndarray, recall: float, k: int) -> float:
        """Of all vectors, counted by tree, how many must be searched for ``recall``, as the first
        MEASURED of ``vectors`` show against brute force over all of them."""
        own = self.leaves(vectors)
        sizes = np.stack([np.bincount(own[:, t], minlength=self.inner + 1) for t in range(self.trees)])
        needed = []
        for q in range(min(MEASURED, len(vectors))):
            gap = ((vectors - vectors[q]) ** 2).sum(1)
            gap[q] = np.inf
            true = np.argsort(gap, kind="stable")[: min(k, len(vectors) - 1)]
            order = self.searched(vectors[q], sizes, np.inf, 0)
            upto = np.zeros(sizes.shape)
            upto[tuple(np.array(order).T)] = np.cumsum([sizes[x] for x in order])
            needed.append(upto[np.arange(self.trees)[:, None], own[true].T].min(0))
        return float(np.quantile(np.concatenate(needed), recall, method="higher")) / len(vectors) if len(vectors) > 1 else 1.0


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def _packed(smallest: int):
    """Rows (id, vec) to (vec, ids): doubles as bytes, the smallest ids of equal vectors of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            flat, where = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0, batch.column(1).offsets.to_numpy()
            for i, own in enumerate(batch.column(0).to_pylist()):
                held.setdefault(flat[where[i] - where[0] : where[i + 1] - where[0]].tobytes(), []).append(own)
            ids = [sorted(set(x))[:smallest] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def distinct_vectors(rows: DataFrame, smallest: int) -> DataFrame:
    """(vec, ids) of (id, vec): equal vectors once, with their ``smallest`` ids, in two steps so that a
    vector that many rows share is put together from partial lists by many tasks."""
    packed = rows.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_packed(smallest), "vec binary, ids array<long>")
    join = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, smallest).alias("ids")
    return packed.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("heap")).agg(join).groupBy("vec").agg(join)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 4, leaf: int = 256, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row of ``queries`` the k nearest rows of ``vectors``
    found, by Euclidean distance, without those of its own id.  leaf: about so many vectors in a
    leaf, as far as the sample allows.  Both have an integer id and an array column."""
    spark = vectors.sparkSession
    rows, asked = (x.where(F.col(id_col).isNotNull() & _usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")) for x in (vectors, queries))
    all_vectors = written(distinct_vectors(rows, k + 1))
    chosen = [x.vec for x in all_vectors.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("vec").collect()]
    size = Counter(map(len, chosen)).most_common(1)[0][0] if chosen else 0
    all_vectors = all_vectors.where(F.length("vec") == size)
    fitted = np.array([np.frombuffer(x) for x in chosen if len(x) == size]).reshape(-1, max(size // 8, 1))
    total = all_vectors.count()
    depth = max(0, min(int(np.log2(max(total / leaf, 1))), int(np.log2(max(len(fitted) / FEWEST, 1)))))
    forest = Forest(fitted, trees, depth)
    share = forest.share(fitted, recall, k)
    known = spark.sparkContext.broadcast(forest)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = known.value.leaves(np.stack([np.frombuffer(x) for x in batch.column(0).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.tolist(), pa.list_(pa.int64()))], names=["vec", "ids", "leaves"])

    placed = written(all_vectors.mapInArrow(routed, "vec binary, ids array<long>, leaves array<long>"))
    cell = placed.select("vec", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 2**depth), np.int64)
    for x in cell.groupBy("tree", "leaf").count().collect():  # at most trees * 2**depth rows
        sizes[x.tree, x.leaf] = x["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec in batch.column(0).to_pylist():
                for t, x in known.value.searched(np.frombuffer(vec), sizes, share * total, k + 1):
                    out += [(vec, t, x, b) for b in range(int(blocks[t, x]))]
                if len(out) >= 4096:
                    yield wanted(out)
                    out = []
            if out:
                yield wanted(out)

    def wanted(out: list[tuple]) -> pa.RecordBatch:
        vec, t, x, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(vec, pa.binary()), pa.array(t, pa.int32()), pa.array(x, pa.int64()), pa.array(b, pa.int64())], names=["vec", "tree", "leaf", "block"])

    # equal queries are searched once; each is told by the hash of its vector
    wants = written(distinct_queries(asked, size))
    visits = wants.select("vec").distinct().mapInArrow(searching, "vec binary, tree int, leaf long, block long")
    key = F.unhex(F.md5("vec"))
    many = F.element_at(F.element_at(F.lit(blocks.tolist()), F.col("tree") + 1), (F.col("leaf") + 1).cast("int"))
    stored = cell.select("tree", "leaf", F.pmod(F.xxhash64("vec"), many).alias("block"), F.lit(0).alias("kind"), "vec", "ids", F.lit(None).cast("binary").alias("key"))
    asks = visits.select("tree", "leaf", "block", F.lit(1).alias("kind"), "vec", F.lit(None).cast("array<long>").alias("ids"), key.alias("key"))
    order = ("tree", "leaf", "block", "kind")
    both = stored.unionByName(asks).repartition("tree", "leaf", "block").sortWithinPartitions(*order)
    near = both.mapInArrow(_ranked(k + 1), "key binary, id long, score double")
    best = near.groupBy("key", "id").agg(F.min("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("score", "id"))).where(F.col("place") <= k + 1)
    answers = wants.select("query_id", key.alias("key")).join(best, "key").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def distinct_queries(asked: DataFrame, size: int) -> DataFrame:
    """(vec, query_id), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, where = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0, batch.column(1).offsets.to_numpy()
            vec = [flat[a:b].tobytes() for a, b in zip(where[:-1] - where[0], where[1:] - where[0], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(vec, pa.binary()), batch.column(0)], names=["vec", "query_id"])

    packed = asked.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "vec binary, query_id long")
    return packed.where(F.length("vec") == size).distinct()


def _ranked(most: int):
    """Rows of a block, then the queries that want it, to the nearest (key, id, score) of each."""

    def scored(asked: list[tuple[bytes, bytes]], block: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        q = np.stack([np.frombuffer(x) for _, x in asked])
        square = (block**2).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            gap = square[None, :] + (q**2).sum(1)[:, None] - 2.0 * (q @ block.T)
        gap[np.isnan(gap)] = np.inf
        # rounding may swap what is this close; the exact distance decides among all of it
        slack = 1e-12 * (square.max() + (q**2).sum(1))
        reach = np.partition(gap, min(most, len(block)) - 1, 1)[:, min(most, len(block)) - 1] + slack
        out = []
        for i, ((own, _), at) in enumerate(zip(asked, reach, strict=True)):
            there = np.flatnonzero(gap[i] <= at)
            exact = np.sqrt(((block[there] - q[i]) ** 2).sum(1)).tolist()
            out += [(own, x, d) for d, x in sorted((d, x) for d, j in zip(exact, there.tolist(), strict=True) for x in ids[j])[:most]]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["key", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stored, ids, block, asked = None, [], [], None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for here, kind, vec, own, key in zip(keys, *(batch.column(c).to_pylist() for c in range(3, 7)), strict=True):
                if here != place:
                    if asked:
                        yield scored(asked, block, ids)
                    place, stored, ids, block, asked = here, [], [], None, []
                if kind == 0:
                    stored.append(vec)
                    ids.append(own)
                    continue
                if not stored and block is None:
                    continue
                if block is None:
                    block, stored = np.stack([np.frombuffer(x) for x in stored]), []
                asked.append((key, vec))
                if len(asked) >= 256:
                    yield scored(asked, block, ids)
                    asked = []
        if asked:
            yield scored(asked, block, ids)

    return run
