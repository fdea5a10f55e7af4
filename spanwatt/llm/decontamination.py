"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark's items.  A shift table over
blocks of words tells how far a search may skip; where the shift is 0, the patterns of the
block's bucket are compared directly.  All texts of a batch are searched side by side, each
with its own pointer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lane, mix, text_chunks, words_of

U64 = np.uint64
#: Words are runs of letters a-z (A-Z become these), digits, and bytes from 0x80 on.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LANE = Lane(11)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, first word of each row, hashes of words."""
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets, IN_WORD)
    return data, starts, ends, rows, _LANE.spans(_LANE.prefix(_LANE.byte[data]), starts, ends)


@dataclass
class Patterns:
    """Patterns of one length: tables of the search."""

    length: int
    block: int
    mask: int
    shift: np.ndarray  #: by hash of a block
    bucket: dict[int, list[int]]  #: hash of the last block -> numbers of patterns
    names: np.ndarray  #: whole-window hashes, in order; a window of another hash is no pattern
    words: list[tuple[bytes, ...]]
    items: list[tuple[int, ...]]


def _blocks(hashes: np.ndarray, b: int) -> np.ndarray:
    """Hash of the block of b words that ends at each word; the first b-1 are of no use."""
    out = np.zeros(len(hashes), U64)
    if len(hashes) >= b:
        h = np.full(len(hashes) - b + 1, b, U64)
        for k in range(b):
            h = mix(h * U64(31) + hashes[k : len(hashes) - b + 1 + k])
        out[b - 1 :] = h
    return out


def build(items: list[tuple[int | None, str | None]], window: int = 13, block: int = 3) -> list[Patterns]:
    """Tables for each length of pattern: ``window`` words, and fewer for shorter items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        data, starts, ends, _, _ = _words(raw, np.array([0, len(raw)]))
        words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[k : k + n]), set()).update([] if item is None else [item])
    out = []
    for n, patterns in sorted(by_length.items()):
        b, words = min(block, n), list(patterns)
        flat = b"".join(w for p in words for w in p)
        ends = np.cumsum([len(w) for p in words for w in p])
        hashes = _LANE.spans(_LANE.prefix(_LANE.byte[np.frombuffer(flat, np.uint8)]), np.concatenate([[0], ends[:-1]]), ends).reshape(-1, n)
        bits = min(24, max(12, int(len(words) * n * 8).bit_length()))
        shift, bucket = np.full(1 << bits, n - b + 1, np.int64), {}
        for end in range(b - 1, n):
            h = hashes[:, end - b + 1]
            value = np.full(len(words), b, U64)
            for k in range(b):
                value = mix(value * U64(31) + hashes[:, end - b + 1 + k])
            np.minimum.at(shift, (value & U64((1 << bits) - 1)).astype(np.int64), n - 1 - end)
            if end == n - 1:
                for k, v in enumerate(value.tolist()):
                    bucket.setdefault(v, []).append(k)
            del h
        out.append(Patterns(n, b, (1 << bits) - 1, shift, bucket, np.array(sorted(bucket), U64), words, [tuple(sorted(patterns[w])) for w in words]))
    return out


def _search(p: Patterns, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(last word, pattern) of every occurrence, in all rows."""
    blocks = _blocks(hashes, p.block)
    place = (blocks & U64(p.mask)).astype(np.int64)
    at, stop = rows[:-1] + p.length - 1, rows[1:]
    live = at < stop
    at, stop = at[live], stop[live]
    while len(at):
        skip = p.shift[place[at]]
        zero = np.flatnonzero(skip == 0)
        if len(zero):
            value = blocks[at[zero]]
            found = p.names[np.minimum(np.searchsorted(p.names, value), len(p.names) - 1)] == value
            for end, v in zip(at[zero[found]].tolist(), value[found].tolist(), strict=True):
                first = end - p.length + 1
                here = tuple(data[a:b].tobytes() for a, b in zip(starts[first : end + 1], ends[first : end + 1], strict=True))
                for k in p.bucket[v]:
                    if p.words[k] == here:
                        yield end, k
        at = at + np.maximum(skip, 1)
        live = at < stop
        at, stop = at[live], stop[live]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """Every row of docs with n_words, hit_words (numbers of the words inside occurrences) and
    hit_items (ids of the items with an occurrence, sorted); columns of such names give way.

    The benchmark comes to the driver and is broadcast in blocks of about ``block_bytes`` of
    text, each searched by a pass of its own over the rows that the pass before hands on; no
    shuffle.  A null text or item has no words.  An item with a null id marks words but isn't
    listed; rows that share an item id are one item.  An empty benchmark hits nothing.
    """
    docs = docs.drop("n_words", "hit_words", "hit_items").withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<bigint>")})
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 + size // block_bytes
    for k in range(parts):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items
        docs = _pass(docs, build([(r.i, r.t) for r in block.toLocalIterator()], window), text_col)
    return docs


def _pass(docs: DataFrame, tables: list[Patterns], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    at, n_at = docs.columns.index(text_col), len(docs.columns) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                data, starts, ends, rows, hashes = _words(data, offsets)
                words, items = ([set(x) for x in part.column(c).to_pylist()] for c in ("hit_words", "hit_items"))
                for p in shared.value:
                    for end, k in _search(p, data, starts, ends, rows, hashes):
                        row = int(np.searchsorted(rows, end, "right")) - 1
                        words[row].update(range(end - p.length + 1 - int(rows[row]), end + 1 - int(rows[row])))
                        items[row].update(p.items[k])
                made = [pa.array(np.diff(rows)), pa.array([sorted(x) for x in words], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_at], *made], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contaminated(percent: int = 5) -> F.Column:
    """The rule: at least ``percent`` of the words are hit, and one at least."""
    return (F.size("hit_words") > 0) & (100 * F.size("hit_words") >= percent * F.col("n_words"))
