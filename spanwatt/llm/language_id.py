"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of the labelled rows.  Its matrix of log
probabilities, whose size is fixed by ``buckets`` and ``most_languages``, is broadcast; each
Arrow batch is scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, text_chunks

U32, U64 = np.uint32, np.uint64
NO_LANGUAGE = "und"
#: Bytes of text that are scored at once; a text of more is scored whole.
CHUNK = 1 << 19
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (2, 3)  #: lengths of the n-grams, in code points
    buckets: int = 1 << 16  #: a power of 2
    sample: int = 4000  #: the fit takes about so many labelled rows of each language at most
    most_languages: int = 200
    smoothing: float = 0.5


def _grams(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (buckets of all n-grams, the first n-gram of each row)."""
    text = data.tobytes().decode("utf-8", "replace").lower()
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[offsets]
    codes = np.frombuffer(text.encode("utf-32-le"), U32).astype(U64)
    if len(codes) != ends[-1]:  # lower-casing changed the length somewhere: row by row then
        rows = [data[a:b].tobytes().decode("utf-8", "replace").lower().encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
        codes = np.frombuffer(b"".join(rows), U32).astype(U64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    for n in s.orders:
        if len(codes) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        h = np.full(len(codes) - n + 1, n, U64)
        for k in range(n):
            h = h * U64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        inside = row[: len(h)] == row[n - 1 :]
        bucket = (mix(h) & U64(s.buckets - 1)).astype(np.int64)[inside]
        yield bucket, np.concatenate([[0], np.cumsum(inside)])[np.minimum(ends, len(h))]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (buckets + 1) x languages of log probabilities whose
    last row holds the priors.

    Rows whose text or language is null are left out.  Of a language with more than
    ``sample`` rows, the rows with the smallest hashes of their id are taken, about that many;
    priors come from all rows.  No labelled row at all: no language, an empty matrix.
    """
    s = settings
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = rows.groupBy("l").count().orderBy("l").limit(s.most_languages + 1).collect()
    if len(counts) > s.most_languages:
        raise ValueError(f"more than {s.most_languages} languages")
    langs = [r["l"] for r in counts]
    if not langs:
        return [], np.zeros((s.buckets + 1, 0), np.float32)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(min(1.0, s.sample / r["count"])))])
    sample = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share[F.col("l")] * (1 << 30)).select("t", "l")
    index = {name: k for k, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(langs), s.buckets), np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()])
            for lo, hi, data, offsets in text_chunks(batch.column(0), CHUNK):
                for bucket, first in _grams(data, offsets, s):
                    own = np.repeat(lang[lo:hi], np.diff(first))
                    seen += np.bincount(own * s.buckets + bucket, minlength=seen.size).reshape(seen.shape)
        lang, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(seen[lang, bucket])], ["l", "b", "n"])

    table = np.zeros((s.buckets + 1, len(langs)))
    for r in sample.coalesce(32).mapInArrow(count, "l long, b long, n long").groupBy("b").agg(F.collect_list(F.struct("l", "n")).alias("x")).toLocalIterator():
        for lang, n in r.x:
            table[r.b, lang] += n
    body = table[:-1] + s.smoothing
    table[:-1] = np.log(body / body.sum(0))
    table[-1] = np.log(np.array([r["count"] for r in counts]) / sum(r["count"] for r in counts))
    return langs, table.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Adds lang_pred, score (the posterior of lang_pred) and fit (the mean log probability of
    an n-gram in lang_pred, which doesn't grow with the text) to every row; a column of such a
    name gives way.

    A null text, a text without a letter, or a model without languages: ``und``, 0, a null fit.  A tie
    goes to the language that comes first by name.  Whole texts count, however long.
    """
    s, (langs, table) = settings, model
    docs = docs.drop("lang_pred", "score", "fit")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value.astype(np.float64)
        for batch in batches:
            names, scores, fits = [], [], []
            for _, _, data, offsets in text_chunks(batch.column(at), CHUNK):
                total = np.tile(log[-1], (len(offsets) - 1, 1))
                grams = np.zeros(len(total), np.int64)
                for bucket, first in _grams(data, offsets, s):
                    grams += first[1:] - first[:-1]
                    for k in range(len(langs)):
                        run = np.concatenate([[0.0], np.cumsum(log[bucket, k])])
                        total[:, k] += run[first[1:]] - run[first[:-1]]
                best = total.argmax(1) if langs else np.zeros(len(total), int)
                top = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1) if langs else np.zeros(len(total))
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    known = bool(langs) and _LETTER.search(data[a:b].tobytes().decode("utf-8", "replace")) is not None
                    names.append(langs[best[k]] if known else NO_LANGUAGE)
                    scores.append(float(top[k]) if known else 0.0)
                    fits.append(float((total[k, best[k]] - log[-1, best[k]]) / grams[k]) if known and grams[k] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], [*batch.schema.names, "lang_pred", "score", "fit"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 3, is 1; a null id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))
