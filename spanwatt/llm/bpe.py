"""Byte-level BPE by recursive DuckDB queries, a query for each run of new words in a partition.

Rows are (word, position, token).  Each step joins neighbouring tokens with the merge table
and contracts the pair of smallest rank; a word is done when no pair of it merges.  A text's
words are matches of a pattern, encoded separately; a worker remembers words it has met.
Decoding joins ids with the vocabulary and puts the bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a worker remembers; the oldest half goes when there are more.
CACHE = 800_000
#: Bytes of new words that one query takes.
QUERY_BYTES = 1 << 16
#: Words up to so many bytes take one contraction a step.
SHORT_BYTES = 48

# A row is a token of word w over the bytes p to e, as x = 64 w + p and y = 64 w + e; its right
# neighbour's x is its y.  Only rows of words that still have a pair go on, so the tokens of a
# word are those of its last step.  This form contracts one pair a step, the leftmost of
# smallest rank: the smallest of (rank, p, e, end of the neighbour), put into one number.
SHORT = """
with recursive step(i, x, y, t) as (
    select 0::utinyint, w::bigint * 64 + p, w::bigint * 64 + p + 1, t from given
  union all
    select (i + 1)::utinyint, s.x, case when (s.x & 63) = ((v >> 12) & 63) then b.w * 64 + (v & 63) else s.y end, case when (s.x & 63) = ((v >> 12) & 63) then (v >> 18)::integer else s.t end
    from step s
    join (
        select a.x >> 6 as w, min(g.m::bigint * 262144 + (a.x & 63) * 4096 + (a.y & 63) * 64 + (z.y & 63)) as v
        from step a join step z on z.x = a.y join merges g on g.pair = a.t::bigint * 1048576 + z.t
        group by 1
    ) b on b.w = (s.x >> 6)
    where (s.x & 63) <> ((v >> 6) & 63)
)
select (x >> 6)::integer as w, t from step join (select x >> 6 as w, max(i) as i from step group by 1) m on m.w = (step.x >> 6) and m.i = step.i order by x
"""

# For long words, whose steps would be too many: equal pairs further on are contracted in the
# same step where that can't change the outcome (``safe``: no token that begins or ends with
# the new one has a smaller rank).  Of hits that overlap, as in aaaa, every other one is taken,
# from the left: those at an odd distance from the last place without a hit.
LONG = """
with recursive step(i, w, p, t) as (
    select 0, w, p, t from given
  union all
    select i + 1, w, k, case when hit and (safe or hits = 1) and (k - miss) % 2 = 1 then m else t end
    from (
        select i, w, k, t, m, safe, hit,
            count(*) filter (hit) over upto as hits, coalesce(max(k) filter (not hit) over upto, 0) as miss,
            coalesce(lag(hit) over so, false) as hit_1, coalesce(lag(safe) over so, false) as safe_1,
            count(*) filter (hit) over before as hits_1, coalesce(max(k) filter (not hit) over before, 0) as miss_1
        from (select *, coalesce(m = best, false) as hit from (
            select n.i, n.w, n.k, n.t, g.m, coalesce(g.safe, false) as safe, min(g.m) over (partition by n.w) as best
            from (
                select i, w, t, lead(t) over (partition by w order by p) as nt,
                    (row_number() over (partition by w order by p))::integer as k
                from step
            ) n
            left join merges g on g.l = n.t and g.r = n.nt
        ) where best is not null)
        window so as (partition by w order by k),
            upto as (partition by w order by k rows unbounded preceding),
            before as (partition by w order by k rows between unbounded preceding and 1 preceding)
    )
    where not (hit_1 and (safe_1 or hits_1 = 1) and (k - 1 - miss_1) % 2 = 1)
)
select w, t from step qualify i = max(i) over (partition by w) order by w, p
"""


class Codec:
    """The ranks of a file, one 'base64 rank' a line, in a DuckDB database in memory."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # a word's ids, as 32-bit integers
        left, right, merged = [], [], []
        low = {}  # the smallest rank among tokens that a token begins or ends
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
                    low[a], low[b] = min(low.get(a, rank), rank), min(low.get(b, rank), rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        table = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32()), "pair": np.array(left, np.int64) << 20 | np.array(right, np.int64), "safe": [low.get(m, m) >= m for m in merged]})
        self.db.register("given", table)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        self.db.register("given", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "b": pa.array([k.hex() for k in ranks])}))
        self.db.execute("create table vocabulary as select * from given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these words, none of which is a token itself."""
        sizes = np.array([len(w) for w in words])
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("given", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": at.astype(np.int32), "t": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        got = self.db.sql(SHORT if sizes.max() <= SHORT_BYTES else LONG).to_arrow_table()
        self.db.unregister("given")
        w, t = got.column("w").to_numpy(), got.column("t").to_numpy()
        raw, at = t.astype(np.int32).tobytes(), 4 * np.searchsorted(w, np.arange(len(words) + 1))
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of these words."""
        rest: tuple[list, list] = [], []
        for word in words:
            raw = word.encode("utf-8", "replace")
            if raw in self.ranks:
                self.known[word] = np.int32(self.ranks[raw]).tobytes()
            else:
                rest[len(raw) > SHORT_BYTES].append((word, raw))
        for pairs in rest:
            lo = 0
            while lo < len(pairs):
                hi, size = lo, 0
                while hi < len(pairs) and (size < QUERY_BYTES):
                    size, hi = size + len(pairs[hi][1]), hi + 1
                self.known.update(zip((w for w, _ in pairs[lo:hi]), self._contract([b for _, b in pairs[lo:hi]]), strict=True))
                lo = hi

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words.findall(t) for t in texts]
        every = set(chain.from_iterable(split))
        if len(self.known) + len(every) > CACHE:
            for word in [w for w, _ in zip(self.known, range(len(self.known) // 2), strict=False)]:
                del self.known[word]
        self.learn(every.difference(self.known))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids])
        table = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": np.arange(sizes.sum(), dtype=np.int64), "t": np.concatenate([*ids, np.zeros(0, np.int32)])})
        self.db.register("given", table)
        got = dict(self.db.execute("select d, string_agg(b, '' order by p) from given join vocabulary using (t) group by d").fetchall())
        self.db.unregister("given")
        return [bytes.fromhex(got.get(k, "")) for k in range(len(ids))]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """A worker's codec stays from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(sizes):
        hi, size = lo, 0
        while hi < len(sizes) and (hi == lo or size + sizes[hi] <= most):
            size, hi = size + sizes[hi], hi + 1
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds column ``to``: the text's token ids (array<int>), special tokens being ordinary text.

    A null text is an empty one; an empty text has no ids.  A column of that name gives way.
    decoded: add a column of that name with the bytes that the ids decode to, as ``decode``
    does, by the same Python worker: a round trip then needs one worker a task and not two.
    """
    more = [decoded] if decoded else []
    docs = docs.drop(to, *more)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for lo, hi in _runs([len(t) for t in texts], 1 << 20):
                ids = codec.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                back = [pa.array([b for x, y in _runs([len(i) for i in ids], 1 << 18) for b in codec.decode(ids[x:y])], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists, *back], [*batch.schema.names, to, *more])

    made = [T.StructField(to, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.BinaryType()) for c in more]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds column ``to``: the bytes that the ids stand for.  Null or no ids: no bytes."""
    tokens = tokens.drop(to)
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int).tolist()
            for lo, hi in _runs(sizes, 1 << 18):
                part = lists.slice(lo, hi - lo)
                ids = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in (part[k].values.to_numpy() if part[k].is_valid else None for k in range(hi - lo))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(codec.decode(ids), pa.binary())], [*batch.schema.names, to])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(to, T.BinaryType())]))


def digest(tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Adds n_tokens and ids_sha256 (of the decimal ids, joined by one space)."""
    return tokens.withColumns({"n_tokens": F.size(ids_col).cast("long"), "ids_sha256": F.sha2(F.array_join(F.col(ids_col), " "), 256)})
