"""Spelling variants: words of a corpus, the words one edit away from each, and its most common form.

``vocabulary`` counts words inside tasks, many texts side by side.  ``near_pairs`` finds all pairs
of words that one inserted, deleted or replaced code point tells apart:

1. Two such words, the longer of c code points, have the same first or the same last
   (c - 1) // 2 code points.  Every word goes, for its own length and the next, to the
   groups of that beginning and, read backwards, of that ending.  No group knows more than words of one such
   part and two lengths, so the number of words in a task stays small beside the vocabulary.
2. In a group the words stand sorted.  For all words of the group at once, the list is walked as
   the dynamic programming over it would: the three cells of the edit matrix that can be
   at most 1 are kept for each prefix, and words that share that prefix (their longest common prefix
   with the word before says so) reuse them.  A range whose prefix is already
   more than one edit away is skipped whole.
3. A pair belongs to the group of its beginning if it has that in common, else to that of its ending,
   so it is found once in each direction.

``variants`` puts forms and roots to the words.  A form has at least twice its word's count, so
chains of forms have fewer than 64 members; pointers double until they stay.

Nulls: a null text has no words, a null id is written as the empty text.  Empty texts give nothing, an
empty table gives no row.  Long texts are cut between words.  Ties in count fall to the smaller word in code-point
order.  Repeated rows count as often as they are there.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lane, stretches, words_of, written

#: Words are runs of A-Z, a-z and U+00C0 to U+00FF: one byte each, or 0xC3 and one more.
ASCII = np.zeros(256, bool)
ASCII[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHORTEST, LEAST = 5, 3
#: One occurrence in so many loses a code point.
ONE_IN = 97
#: Words that a task counts at once, and counts that it holds.
WORDS, HELD = 1_000_000, 400_000
#: Steps of the walk that are kept at once, and words that are walked together.
STEPS, TOGETHER = 2_000_000, 100_000


def letters(data: np.ndarray) -> np.ndarray:
    there = ASCII[data] | (data == LEAD)
    there[1:] |= data[:-1] == LEAD
    return there


class Crc32:
    """CRC-32 of many strings with a common set of tails: crc(a + b) from crc(a), crc(b), len(b)."""

    LONGEST = 128

    def __init__(self):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        shift = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        made = [shift]
        for _ in range(self.LONGEST):
            shift = (shift >> 8) ^ table[shift & 255]
            made.append(shift)
        self.shift = np.stack(made)

    def joined(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For tails of up to LONGEST bytes."""
        out = tail.copy()
        for k in range(4):
            out ^= self.shift[size, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def _counted(shortest: int):
    lane, crc = Lane(12), Crc32()

    def chunk(ids: list[str], data: np.ndarray, offsets: np.ndarray, held: dict[str, int]) -> int:
        data = LOWER[data]
        starts, ends, first = words_of(letters(data).view(np.uint8), offsets, np.array([False, True]))
        leads = np.concatenate([[0], np.cumsum(data == LEAD)])
        points = ends - starts - (leads[ends] - leads[starts])
        row, long = np.repeat(np.arange(len(ids)), np.diff(first)), points >= shortest
        starts, ends, row, points = starts[long], ends[long], row[long], points[long]
        if not len(starts):
            return 0
        _, at, own, n = np.unique(lane.spans(lane.prefix(lane.byte[data]), starts, ends), return_index=True, return_inverse=True, return_counts=True)
        text = [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        head = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)[row]
        size = ends - starts
        code = crc.joined(head, np.array([zlib.crc32(x) for x in text], np.uint32)[own], np.minimum(size, crc.LONGEST))
        for i in np.flatnonzero(size > crc.LONGEST).tolist():
            code[i] = zlib.crc32(text[own[i]], int(head[i]))
        cut = np.flatnonzero(code % np.uint32(ONE_IN) == 0)
        words = [x.decode() for x in text]
        for word, times in zip(words, (n - np.bincount(own[cut], minlength=len(n))).tolist(), strict=True):
            if times:
                held[word] = held.get(word, 0) + times
        for k, c in zip(own[cut].tolist(), code[cut].tolist(), strict=True):
            word = words[k]
            word = word[: c % len(word)] + word[c % len(word) + 1 :]
            if len(word) >= shortest:
                held[word] = held.get(word, 0) + 1
        return len(starts)

    def rows(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for lo, hi, data, offsets in stretches(batch.column(0), lambda x: ~letters(x)):
                chunk(ids[lo:hi], data, offsets, held)
                if len(held) >= HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n), as a written table: words of ``shortest`` code points or more, as often as they
    occur, ``least`` times or more, after some occurrences lost a code point (see ONE_IN)."""
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    made = texts.mapInArrow(_counted(shortest), "word string, n long")
    return written(made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# ------------------------------------------------------------------ words one edit apart


def _walk(grid: np.ndarray, size: np.ndarray, group: np.ndarray, common: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (word, other) one edit apart, of which one at least has ``longest`` code points.

    grid: code points, a row for each word, sorted in each group, zeros at the end; the words
    of a group have the first ``common`` code points in common.
    """
    n = len(grid)
    wide = np.concatenate([grid, np.zeros((n, 1), np.uint8)], 1)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([edge[1:], [n]])
    differ = grid[1:] != grid[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), longest)
    lcp = np.concatenate([[-1], lcp])
    lcp[edge] = -1
    starts = {}
    of = np.repeat(np.arange(len(edge)), end - edge)
    word = np.flatnonzero((end - edge)[of] > 1)
    one = np.uint8(1)
    first = (word, edge[of[word]], end[of[word]], *(np.full(len(word), x, np.uint8) for x in (1, 0, 1)))
    stack, found = [(common, first)], []
    while stack:
        d, (q, lo, hi, left, mid, right) = stack.pop()
        if not len(q):
            continue
        if d not in starts:
            starts[d] = np.append(np.flatnonzero(lcp <= d), n)
        heads = starts[d]
        a = np.searchsorted(heads, lo)
        times = np.searchsorted(heads, hi) - a
        total = int(times.sum())
        if total > STEPS and len(q) > 1:
            half = len(q) // 2
            stack += [(d, tuple(x[half:] for x in (q, lo, hi, left, mid, right))), (d, tuple(x[:half] for x in (q, lo, hi, left, mid, right)))]
            continue
        at = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        lo, hi = heads[at], heads[at + 1]
        q, left, mid, right = (np.repeat(x, times) for x in (q, left, mid, right))
        char = grid[lo, d]
        if d == longest - 1:  # here the shorter words have ended
            done = (char == 0) & (size[q] == longest) & (right == 1)
            found.append((q[done], lo[done]))
        go = char > 0
        q, lo, hi, left, mid, right, char = (x[go] for x in (q, lo, hi, left, mid, right, char))
        low = left + (wide[q, d - 1] != char) if d else np.full(len(q), 2, np.uint8)
        low = np.minimum(low, mid + one)
        mid = np.minimum(np.minimum(mid + (wide[q, d] != char), right + one), low + one)
        high = np.minimum(right + (wide[q, d + 1] != char), mid + one)
        if d == longest - 1:
            done = np.where(size[q] == longest, mid, low) == 1
            found.append((q[done], lo[done]))
            continue
        go = np.minimum(np.minimum(low, mid), high) <= 1
        cap = lambda x: np.minimum(x[go], 2).astype(np.uint8)
        stack.append((d + 1, (q[go], lo[go], hi[go], cap(low), cap(mid), cap(high))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (longest, back, part, text, n), sorted, to pairs (word, near, near_n)."""

    def pairs(longest: int, back: bool, text: list[str], counts: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        common = (longest - 1) // 2
        grid = np.array([x.encode("latin-1") for x in text], f"S{longest}").view(np.uint8).reshape(len(text), longest)
        size = np.array([len(x) for x in text])
        q, other = _walk(grid, size, group, common, longest)
        if back and len(q):  # those with the same beginning are found by it
            same = np.ones(len(q), bool)
            for t in range(common):
                same &= grid[q, size[q] - 1 - t] == grid[other, size[other] - 1 - t]
            q, other = q[~same], other[~same]
        own = [x[::-1] for x in text] if back else text
        return pa.RecordBatch.from_arrays([pa.array([own[i] for i in q.tolist()], pa.string()), pa.array([own[i] for i in other.tolist()], pa.string()), pa.array(counts[other], pa.int64())], names=["word", "near", "near_n"])

    def cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Each kind (longest, back) of the rows; groups are told by a running number."""
        longest, back, part = t.column(0).to_numpy(), t.column(1).to_numpy(zero_copy_only=False), np.array(t.column(2).to_pylist(), object)
        kind = np.flatnonzero(np.concatenate([[True], (longest[1:] != longest[:-1]) | (back[1:] != back[:-1]), [True]]))
        text, counts = t.column(3).to_pylist(), t.column(4).to_numpy()
        for a, b in zip(kind[:-1].tolist(), kind[1:].tolist(), strict=True):
            group = np.concatenate([[0], np.cumsum(part[a + 1 : b] != part[a : b - 1])])
            for lo in range(0, b - a, TOGETHER):  # whole groups, about so many words at once
                lo, hi = (int(np.searchsorted(group, group[min(x, b - a - 1)])) if x < b - a else b - a for x in (lo, lo + TOGETHER))
                if hi > lo:
                    yield pairs(int(longest[a]), bool(back[a]), text[a + lo : a + hi], counts[a + lo : a + hi], group[lo:hi])

    waiting, size, enough = [], 0, TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size >= enough:
            t = pa.Table.from_batches(waiting).combine_chunks()
            last = [t.column(k)[-1].as_py() for k in range(3)]
            own = t.column(2).to_pylist()
            k = size  # the last group may go on in the next batch
            while k and own[k - 1] == last[2]:
                k -= 1
            if k:
                yield from cut(t.slice(0, k).combine_chunks())
            waiting, size = t.slice(k).to_batches(), size - k
            enough = max(TOGETHER, 2 * size)
    if size:
        yield from cut(pa.Table.from_batches(waiting).combine_chunks())


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every two words of (word, n) that are one edit apart, in both directions."""
    size = F.length("word")
    longest = F.explode(F.array(size, size + 1)).alias("longest")
    back = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    rows = words.select("word", "n", longest).select("word", "n", "longest", back).withColumn("text", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    rows = rows.select("longest", "back", F.expr("substring(text, 1, cast((longest - 1) div 2 as int))").alias("part"), "text", "n")
    return rows.repartition("longest", "back", "part").sortWithinPartitions("longest", "back", "part", "text").mapInArrow(_paired, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms, by doubling pointers."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = made.select("word", "root")
        if made.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n): the form is the most common near word, if
    it is at least ``times`` as common as the word."""
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form = -F.col("best.less") >= times * F.col("n")
    made = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")))
    ends = roots(made.where("form is not null"))
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
