"""Phrase collocation mining: Misra-Gries summaries per hash partition, then exact counts.

A phrase is 2 to 5 words in a row within one piece of a text.  ``mine`` keeps the phrases of each
language that occur often, scores them against their parts, and returns the first of each
language.

1. Words and pairs of words are counted by 64-bit hash inside each task.  Such a count is a
   Misra-Gries summary without error; it goes to the task that owns its part of the hash space.
2. That task merges the summaries.  Past ``capacity`` counters it takes the (capacity + 1)-th
   largest count off all of them.  What it took off in total is at most mass / (capacity + 1), so
   with a capacity over mass / least no frequent key is lost; where a partition is heavier
   than that, the counters grow rather than lose a key.  Kept: counter + taken off >= least.
3. The kept hashes become a bitmap of at most 2**28 bits, which is broadcast.  Longer phrases are
   summarised the same way, and only those of which every pair of words passes it.
4. The second pass counts by text whatever passes the bitmap: in the task, then in the task that owns
   the part of the hash space.  A false pass costs an entry and changes no result, so counts and results are exact.

Nulls: a null text is empty, a null language is "und".  Empty texts give nothing, an empty table
gives no row.  Long texts are cut between pieces (a piece itself is never cut).  Ties in a
language's order fall to the smaller phrase in UTF-8 order.  Repeated rows count as often as they
are there.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Lane, mix, stretches, words_of, written

NO_LANGUAGE = "und"
LONGEST = 5
#: Bytes that end a piece, and bytes that are in no word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words that a task counts at once, and counts that it holds.
WORDS, HELD = 1_500_000, 250_000
MOST_BITS = 28


def _stretches(texts: pa.Array, langs: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs of texts: language of each row, bytes, offsets; one long text comes in several."""
    for lo, hi, data, offsets in stretches(texts, lambda x: BREAK[x]):
        yield [x if x is not None else NO_LANGUAGE for x in langs[lo:hi]], data, offsets


class _Words:
    """The words of a run of texts: where they are, in which piece and row, and hashes of the
    phrases that begin with each."""

    lane = Lane(11)
    seeds: dict[str, np.uint64] = {}

    def __init__(self, langs: list[str], data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, first = words_of(self.data, offsets, WORD)
        self.row = np.repeat(np.arange(len(langs)), np.diff(first))
        self.piece = np.cumsum(BREAK[data], dtype=np.int64)[self.starts] + self.row
        for x in set(langs) - self.seeds.keys():
            self.seeds[x] = U64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little"))
        own = np.array([self.seeds[x] for x in langs], np.uint64)[self.row] if len(langs) else np.zeros(0, np.uint64)
        self.one = mix(self.lane.spans(self.lane.prefix(self.lane.byte[self.data]), self.starts, self.ends) + own)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, hash of the phrase from each word on, whether it stays in a piece)."""
        h = self.one
        yield 1, h, np.ones(len(h), bool)
        for m in range(2, LONGEST + 1):
            if len(self.one) < m:
                return
            h = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + self.one[m - 1 :])
            yield m, h, self.piece[m - 1 :] == self.piece[: len(self.piece) - m + 1]

    def text(self, i: int, m: int) -> str:
        return " ".join(self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace") for k in range(i, i + m))


#: A hash marks three bits, its own lowest and those from here on.
SHIFTS = (0, 18, 36)


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are marked."""
    left = np.arange(len(h))
    for shift in SHIFTS:
        slot = (h[left] >> U64(shift)) & U64(len(bitmap) * 64 - 1)
        left = left[(bitmap[slot >> U64(6)] >> (slot & U64(63))) & U64(1) > 0]
    found = np.zeros(len(h), bool)
    found[left] = True
    return found


SUMMARY = "part int, once binary, keys binary, counts binary"


def _summarised(parts: int, known=None):
    """Partial counts by hash, a row for each part of the hash space.  Without ``known`` of
    words and pairs, with it of longer phrases whose pairs are all in that bitmap."""

    def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(keys), return_counts=True)
        edge = np.searchsorted((h >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1))
        out = []
        for p in range(parts):
            a, b = edge[p], edge[p + 1]
            if a < b:
                single = n[a:b] == 1
                out.append((p, h[a:b][single].tobytes(), h[a:b][~single].tobytes(), n[a:b][~single].astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "once", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for langs, data, offsets in _stretches(batch.column(0), batch.column(1).to_pylist()):
                words = _Words(langs, data, offsets)
                run_of = None
                for m, h, there in words.phrases():
                    if known is None and m > 2:
                        break
                    if known is not None:
                        if m == 1:
                            continue
                        if m == 2:
                            pair = run_of = there & _in(known.value, h)
                            continue
                        there = run_of = run_of[:-1] & pair[m - 2 :]
                    held.append(h[there])
                    size += len(held[-1])
                if size >= 2 * WORDS:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


class MisraGries:
    """Counters of 64-bit keys that lose no key with a count of ``least`` or more."""

    def __init__(self, least: int, capacity: int):
        self.least, self.capacity, self.lost = least, capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(4 * self.capacity, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[head], np.add.reduceat(counts, head) if len(head) else counts
        self.waiting, self.size = [], 0
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.lost + off < self.least:  # else a frequent key might go: grow instead
                stay = self.counts > off
                self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay] - off, self.lost + off

    def frequent(self) -> np.ndarray:
        """Every key whose count may be ``least`` or more."""
        self.settle()
        return self.keys[self.counts + self.lost >= self.least]


def _survivors(rows: DataFrame, least: int, capacity: int) -> DataFrame:
    """h: the hashes that may be frequent; each partition merges its part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = MisraGries(least, capacity)
        for batch in batches:
            for once, keys, counts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                keys_once = np.frombuffer(once, np.uint64)
                kept.merge(keys_once, np.ones(len(keys_once), np.int64))
                kept.merge(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(kept.frequent().view(np.int64))], names=["h"])

    return rows.repartition("part").mapInArrow(run, "h long")


def _bitmap(hashes: DataFrame):
    """A broadcast bitmap of the hashes: 32 bits or more for each, 2**20 to 2**28 in all."""
    bits = min(MOST_BITS, max(20, int(32 * hashes.count()).bit_length()))
    slot = F.explode(F.array(*[F.shiftrightunsigned("h", k).bitwiseAND(F.lit(2**bits - 1)) for k in SHIFTS])).alias("slot")
    made = hashes.select(slot).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(2 ** (bits - 6), np.uint64)
    bitmap[made.column(0).to_numpy()] = made.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


PARTIAL = "part int, lang array<string>, words array<int>, phrase array<string>, n array<long>"


def _exact(known, parts: int):
    """Counts of all that passes the bitmap, summed inside the task: a row for each part of the hash space, with lists of
    language, words, phrase and n; words 0 is the number of all words of the language."""

    def rows(held: dict[int, int], read: dict[int, tuple[str, int, str]], totals: dict[str, int]) -> pa.RecordBatch:
        h = np.fromiter(held, np.uint64, len(held))
        part = np.concatenate([(h >> U64(32)) * U64(parts) >> U64(32), np.zeros(len(totals), np.uint64)]).astype(np.int64)
        keys, n = [*(read[x] for x in held), *((x, 0, "") for x in totals)], [*held.values(), *totals.values()]
        order = np.argsort(part, kind="stable")
        own, first = np.unique(part[order], return_index=True)
        ends = pa.array(np.append(first, len(part)), pa.int32())
        listed = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
        columns = [listed([keys[i][k] for i in order.tolist()], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *columns, listed([n[i] for i in order.tolist()], pa.int64())], names=["part", "lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}  # by hash
        read: dict[int, tuple[str, int, str]] = {}  # so that a phrase is read once a task
        totals: dict[str, int] = {}
        waiting, size = [], 0

        def count() -> None:
            """What waits is counted by hash; only a hash that is new here has its phrase read."""
            for m in range(1, LONGEST + 1):
                mine = [(k, h[m], at[m]) for k, (_, _, h, at) in enumerate(waiting) if m in h]
                if not mine:
                    continue
                h = np.concatenate([x for _, x, _ in mine])
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                edge = np.cumsum([0, *(len(x) for _, x, _ in mine)])
                part = np.searchsorted(edge, first, "right") - 1
                place = np.concatenate([at for _, _, at in mine])[first]
                for x, p, j, times in zip(h.tolist(), part.tolist(), place.tolist(), n.tolist(), strict=True):
                    if x not in held:
                        langs, words = waiting[mine[p][0]][:2]
                        read[x] = (langs[words.row[j]], m, words.text(j, m))
                        held[x] = 0
                    held[x] += times
            waiting.clear()

        for batch in batches:
            for langs, data, offsets in _stretches(batch.column(0), batch.column(1).to_pylist()):
                words = _Words(langs, data, offsets)
                for row, n in enumerate(np.bincount(words.row, minlength=len(langs)).tolist()):
                    totals[langs[row]] = totals.get(langs[row], 0) + n
                hashes, places = {}, {}
                for m, h, there in words.phrases():
                    at = np.flatnonzero(there & _in(known.value, h))
                    if len(at):
                        hashes[m], places[m] = h[at], at
                waiting.append((langs, words, hashes, places))
                size += len(words.starts)
                if size >= WORDS // 3:
                    count()
                    size = 0
                    if len(held) >= HELD:
                        yield rows(held, read, totals)
                        for x in (held, read, totals):
                            x.clear()
        count()
        if held or totals:
            yield rows(held, read, totals)

    return run


def _summed(least: int):
    """Adds up the lists of a part by language, words and phrase; keeps what occurs often, and the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, str], int] = {}
        for batch in batches:
            for lists in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                for *key, n in zip(*lists, strict=True):
                    held[tuple(key)] = held.get(tuple(key), 0) + n
        often = [(*key, n) for key, n in held.items() if n >= least or key[1] == 0]
        for k in range(0, len(often), 10_000):
            columns = zip(zip(*often[k : k + 10_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["lang", "words", "phrase", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", capacity: int = 1 << 20, parts: int | None = None) -> DataFrame:
    """(lang, words, phrase, n) of all words and phrases of up to 5 words that occur ``least``
    times or more in their language, and of all words of a language (words = 0), as a written
    table.  parts: of the hash space, else 16 for each shuffle partition."""
    spark = docs.sparkSession
    parts = parts or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    short = written(_survivors(texts.mapInArrow(_summarised(parts), SUMMARY), least, capacity))
    pairs = _bitmap(short)
    long = written(_survivors(texts.mapInArrow(_summarised(parts, pairs), SUMMARY), least, capacity))
    made = texts.mapInArrow(_exact(_bitmap(short.union(long)), parts), PARTIAL)
    return written(made.repartition("part").mapInArrow(_summed(least), "lang string, words int, phrase string, n long"))


#: A language's candidates are cut to the wanted number in so many heaps before they meet.
HEAPS = 32


def mine(docs: DataFrame, least: int = 100, first: int = 2000, share: tuple[int, int] = (100, 100), text_col: str = "text", lang_col: str = "lang", capacity: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language.

    a, l, r: occurrences of the phrase, its first part and the rest, for the cut with the lowest
    score (the first of equals); n: words of the language; score: 1000 a n / (l r), cut to a whole number.
    A phrase goes if a longer one holds it and share[0] * f(longer) >= share[1] * a.
    """
    counts = phrase_counts(docs, least, text_col, lang_col, capacity)
    size = F.col("words")
    found = counts.where(size >= 2).select("lang", "words", "phrase", F.col("n").alias("a"))
    cut = found.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = counts.where(size.between(1, LONGEST - 1))
    cut = cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    heap = F.pmod(F.xxhash64("phrase"), F.lit(HEAPS)).alias("heap")
    total = counts.where(size == 0).select("lang", "n", F.explode(F.expr(f"sequence(0L, {HEAPS - 1}L)")).alias("heap"))
    exact = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {exact}) * cast(a as {exact}) * cast(n as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    scored = cut.withColumn("heap", heap).join(total, ["lang", "heap"]).withColumn("score", score).groupBy("lang", "heap", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    held = found.where(size >= 3).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (share[0] * F.col("longer") < share[1] * F.col("a")))

    flat = alone.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").cast("long").alias("score"), "heap")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "heap").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
