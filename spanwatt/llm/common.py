"""What the operators of this subpackage share: the shared folder, written tables, vectorised
hashing of words and bytes, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Takes the place of a null doc_id: such a row counts as the last document.
LAST_ID = 2**63 - 1
U64 = np.uint64
#: And that of a null id that isn't a number: no text lies after it.
LAST_TEXT = "\U0010ffff" * 4


#: Spark's setting by which the shuffle files of an execution are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ranked(df: DataFrame, id_col: str) -> Column:
    """An id to order rows by: a whole number, or the text of any other id; a null is the last."""
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    return F.coalesce(F.col(id_col).cast("long" if whole else "string"), F.lit(LAST_ID if whole else LAST_TEXT))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``.  Only where that is unset and Spark runs in this
    process (tests) a temporary folder is made and remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: cuts the lineage, and a
    lost executor costs no more than the reading.  The job's shuffle files go once the table is
    there, as nothing reads them again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Gives back the disk of tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


# ------------------------------------------------------------------ text in Arrow batches


def text_chunks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``most`` bytes (one row at least).

    Yields (first row, end row, bytes, offsets): the rows' UTF-8 bytes end to end and where
    each row begins.  A null is an empty text.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def stretches(column: pa.Array, ends: Callable[[np.ndarray], np.ndarray], most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``text_chunks``, but a text of more than twice ``most`` bytes comes in several runs.  It is
    cut after bytes that ``ends`` marks, where it has such."""
    for lo, hi, data, offsets in text_chunks(column, most):
        if hi - lo > 1 or len(data) <= 2 * most:
            yield lo, hi, data, offsets
            continue
        cuts, at = np.flatnonzero(ends(data)) + 1, 0
        while at < len(data):
            k = int(np.searchsorted(cuts, at + most, "right"))
            end = int(cuts[k - 1]) if k and cuts[k - 1] > at else int(cuts[k]) if k < len(cuts) else len(data)
            yield lo, hi, data[at:end], np.array([0, end - at])
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lane:
    """Polynomial fingerprints modulo 2**64 of all windows of a sequence of 64-bit symbols."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 20)
            for name, base in (("power", self.base % 2**64), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.power[: len(symbols)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A fingerprint of symbols[start:end] for each pair."""
        self._grow(len(prefix))
        return mix((prefix[end] - prefix[start]) * self.inverse[start])


def words_of(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one more at the end).

    in_word: for each byte value, whether it belongs to a word; no word crosses rows.
    """
    word = in_word[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words are runs of bytes other than the space and 0x09-0x0D; UTF-8 keeps these bytes for themselves.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, on Spark alone.

    edges: columns a, b (long).  Returns (node, root), the root being the smallest id of the
    component; only nodes that have an edge are listed.  Alternates the large-star and the
    small-star step until the edges stay as they are; every round is a written table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark.n == 0 or mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes to the smallest node that u sees
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct())
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
