"""N-gram Jaccard self-join by a MinHash LSH forest.

Every tree of the forest is a trie of signatures; documents that share a prefix in some tree
are candidates.  Prefixes are shortened from the full depth until the expected recall at the
threshold reaches its target.  Candidates of a bucket are tied to its smallest document, the
connected candidates form clusters, and all pairs of a cluster are verified exactly on their
shingles, block against block; a task answers with counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, SPACE, Lane, components, mix, signed, text_chunks, words_of, written
from .repeats import keyed

LANE = Lane(17)
U32, U64 = np.uint32, np.uint64
#: Documents of a block of a cluster.
BLOCK = 256


def depth_for(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix, from the full depth down, whose expected recall at the threshold
    reaches the target: 1 - (1 - threshold ** depth) ** trees."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the first of each row; a row of fewer words, but not none,
    has one shingle of all its words."""
    starts, ends, rows = words_of(data, offsets, ~SPACE)
    prefix = LANE.prefix(LANE.spans(LANE.prefix(LANE.byte[data]), starts, ends))
    words = np.diff(rows)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(words)), count)
    at = np.arange(first[-1]) - first[row] + rows[row]
    return LANE.spans(prefix, at, at + np.minimum(words[row], n)), first


def _signatures(trees: int, depth: int, n: int):
    rng = np.random.default_rng(23)
    flip = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)
    odd = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * U32(2) + U32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2), 1 << 20):
                shingle, first = _shingles(data, offsets, n)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                low = (shingle >> U64(32)).astype(U32)
                prefix = np.zeros((len(some), trees), U64)
                for k in range(trees * depth):
                    x = (low ^ flip[k]) * odd[k]
                    x ^= x >> U32(15)
                    x *= U32(0x85EBCA6B)
                    least = np.minimum.reduceat(x, first[some]).astype(U64)
                    prefix[:, k // depth] = mix(prefix[:, k // depth] * U64(0x100000001B3) + least + U64(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * trees), signed(prefix.ravel()))
                part = batch.slice(lo, hi - lo).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "key", "prefix"])

    return run


def join(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, trees: int = 24, deepest: int = 6, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id with an equal text), group_id (the
    smallest id of the connected group), n_links (other rows whose similarity to this one is
    at least ``threshold``, copies included), text_key (xxhash64 of the text).

    Similarity is the Jaccard similarity of the sets of ``shingle`` consecutive words (runs of
    characters other than the space and 0x09-0x0D).  A text of fewer words has one shingle of
    all of them; a null or empty text, or one without a word, is linked to nothing but texts
    equal to it.  A null id counts as the last.  Shingles are told apart by 64 bits of hash.
    Candidates are missed with a chance of 1 - ``recall`` at the threshold, less above it.
    """
    rows = keyed(docs, id_col, text_col)
    keys = written(rows.select("id", "key", F.xxhash64(F.lit(1), "text").alias("more")))
    classes = keys.groupBy("key", "more").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    depth = depth_for(threshold, trees, deepest, recall)
    first = written(classes.select(F.col("class").alias("id"), "key", "n"))
    signs = rows.mapInArrow(_signatures(trees, depth, shingle), "id long, key long, prefix array<long>").join(first.select("id", "key"), ["id", "key"], "left_semi")
    signs = written(signs.dropDuplicates(["id", "key"]))
    node = F.xxhash64("id", "key")  # rows that share an id stay apart
    nodes = signs.select(node.alias("node"), F.posexplode("prefix").alias("tree", "prefix"))
    heads = nodes.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("tree", "prefix", "head")
    edges = nodes.join(heads, ["tree", "prefix"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(edges)
    blocks = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = first.withColumn("node", node).join(clusters, "node").join(blocks, "root")
    members = members.select("id", "key", "n", "node", "root", "blocks", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                values, at = _shingles(data, offsets, shingle)
                packed = [np.unique(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array(packed, pa.binary())], ["node", "n", "root", "blocks", "block", "set"])

    packed = rows.join(members, ["id", "key"]).select("text", "node", "n", "root", "blocks", "block").mapInArrow(sets, "node long, n long, root long, blocks int, block int, set binary")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "set")
    sorted_ = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")
    found = written(sorted_.mapInArrow(_verify(threshold), "node long, links long, other long"))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = first.withColumn("node", node)
    group = groups.join(named.select("node", "id"), "node").select("root", "id").groupBy("root").agg(F.min("id").alias("group"))
    by_class = named.join(links, "node", "left").join(groups.join(group, "root").select("node", "group"), "node", "left")
    by_class = by_class.select(F.col("id").alias("class"), "key", F.coalesce("group", "id").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    own = keys.join(classes.select("key", "more", "class"), ["key", "more"]).join(by_class, ["class", "key"])
    out = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return own.select(out("id").alias(id_col), out("class").alias("class_id"), out("group").alias("group_id"), F.col("links").alias("n_links"), F.col("key").alias("text_key"))


def _verify(threshold: float):
    def pairs(block: np.ndarray, n: np.ndarray, node: np.ndarray, sets: list[np.ndarray], same: bool) -> pa.RecordBatch | None:
        size = np.array([len(s) for s in sets], np.float64)
        who = np.repeat(np.arange(len(sets)), size.astype(int))
        _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = times[number] > 1
        who, number = who[use], number[use]
        order = np.argsort(number, kind="stable")
        who, number = who[order], np.concatenate([[0], np.cumsum(np.diff(number[order]) > 0)]) if use.any() else number
        common = np.zeros((len(sets), len(sets)))
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            a, b = np.searchsorted(number, [lo, lo + 4096])
            table = np.zeros((len(sets), 4096), np.float32)
            table[who[a:b], number[a:b] - lo] = 1
            common += table @ table.T
        linked = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
        linked &= (common > 0) & ~np.eye(len(sets), dtype=bool)
        if not same:
            linked &= block[:, None] != block[None, :]
        label = np.arange(len(sets))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(1))
            if (least == label).all():
                break
            label = least
        links, tied = linked @ n, np.flatnonzero(label != np.arange(len(sets)))
        some = np.flatnonzero(links)
        if not len(some):
            return None
        ids = np.concatenate([node[some], node[tied]])
        counts = np.concatenate([links[some], np.zeros(len(tied), links.dtype)]).astype(np.int64)
        other = pa.array(np.concatenate([np.zeros(len(some), np.int64), node[label[tied]]]), mask=np.arange(len(ids)) < len(some))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), other], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            _, once = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows are one
            table = table.take(pa.array(once))
            one = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
            made = pairs(table.column("block").to_numpy(), table.column("n").to_numpy(), table.column("node").to_numpy(), [np.frombuffer(x, U64) for x in table.column("set").to_pylist()], one)
            if made is not None:
                yield made

        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a])
                if held and key != last:
                    yield from close()
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from close()

    return run
