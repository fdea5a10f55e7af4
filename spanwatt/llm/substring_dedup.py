"""Removal of repeated passages of words, by difference-cover anchors.

D is a difference cover modulo v: any two positions, moved together by some d < v, both
fall on D modulo v.  So two equal windows of n words share an aligned anchor of n - v + 1
words, and only anchors at cover positions are hashed.  Anchors that two texts share extend to
the windows of n words around them; Spark groups the fingerprints of those windows and finds
for each the first document.  No pairs are made: a window goes unless its document is first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_ID, SPACE, Lane, signed, text_chunks, words_of, written
from .repeats import keyed, later_copies, spans, spread

#: Perfect difference covers by period: q + 1 residues modulo q * q + q + 1.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LANES = Lane(3), Lane(5)


def period_for(window: int) -> int:
    """The longest period that leaves anchors of two fifths of the window at least."""
    return max(v for v in COVERS if window - v + 1 >= 0.4 * window)


def _symbols(data: np.ndarray, offsets: np.ndarray, lanes: tuple[Lane, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    starts, ends, rows = words_of(data, offsets, ~SPACE)
    return starts, ends, rows, [lane.prefix(lane.spans(lane.prefix(lane.byte[data]), starts, ends)) for lane in lanes]


def _names(prefix: list[np.ndarray], starts: np.ndarray, width: int) -> list[np.ndarray]:
    return [lane.spans(p, starts, starts + width) for lane, p in zip(LANES, prefix, strict=False)]


def _anchors(window: int, period: int):
    cover, width = np.zeros(period, bool), window - period + 1
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column(2)):
                _, _, rows, prefix = _symbols(data, offsets, LANES[:1])
                n = np.diff(rows)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - rows[row]
                pick = np.flatnonzero(cover[at % period] & (at + width <= n[row]) & (n[row] >= window))
                row = row[pick] + lo
                yield pa.RecordBatch.from_arrays([signed(_names(prefix, pick, width)[0]), pa.array(ids[row]), pa.array(keys[row]), pa.array(at[pick].astype(np.int32))], ["a", "id", "key", "at"])

    return run


def _starts(anchors: np.ndarray, window: int, width: int, words: int) -> np.ndarray:
    """Starts of the windows that hold one of these anchors."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, np.maximum(anchors - (window - width), 0), 1)
    np.add.at(edge, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, words - window + 1)])


def dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, removed (array of [from, to) spans of
    words), kept_text (the kept words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id; this is judged on the input.  Words are runs of characters other than the space
    and 0x09-0x0D.  A null or empty text has no words.  A null id counts as the last.  Of rows
    that share an id, equal texts get equal results, and different ones count in the order of
    a hash of the text.  Windows are told apart by 128 bits of hash.  A task holds a few MB of
    texts, or one text, at a time.
    """
    rows, period = keyed(docs, id_col, text_col), period_for(window)
    width = window - period + 1
    copies = later_copies(rows)
    anchors = rows.mapInArrow(_anchors(window, period), "a long, id long, key long, at int")
    shared = anchors.groupBy("a").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").select("a")
    found = anchors.join(shared, "a").groupBy("id", "key").agg(F.collect_list("at").alias("anchors"))
    found = written(found.join(copies, ["id", "key"], "left_anti"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, anchors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                if anchors.slice(lo, hi - lo).null_count == hi - lo:
                    continue
                _, _, rows, prefix = _symbols(data, offsets, LANES)
                for k in np.flatnonzero(anchors.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)):
                    at = _starts(anchors[int(lo + k)].values.to_numpy(), window, width, int(rows[k + 1] - rows[k]))
                    a, b = _names(prefix, at + rows[k], window)
                    _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
                    first.sort()
                    n = len(first)
                    yield pa.RecordBatch.from_arrays([signed(a[first]), signed(b[first]), pa.array(np.full(n, ids[lo + k])), pa.array(np.full(n, keys[lo + k])), pa.array(at[first].astype(np.int32))], ["a", "b", "id", "key", "at"])

    near = rows.join(found, ["id", "key"], "left").select("id", "key", "text", "anchors")
    named = near.mapInArrow(windows, "a long, b long, id long, key long, at int")
    lone = named.groupBy("a", "b").agg(F.min(F.struct("id", "key", "at")).alias("f")).select("f.*").groupBy("id", "key").agg(F.collect_list("at").alias("first"))
    info = found.join(lone, ["id", "key"], "left").select("id", "key", "anchors", "first", F.lit(False).alias("copy"))
    info = info.unionByName(copies.select("id", "key", F.lit(None).cast("array<int>").alias("anchors"), F.lit(None).cast("array<int>").alias("first"), F.lit(True).alias("copy")))
    joined = rows.join(info, ["id", "key"], "left").select("id", "key", "text", "anchors", "first", "copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                part, out = batch.slice(lo, hi - lo), {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
                busy = part.column(3).null_count < len(part)
                starts, ends, rows, prefix = _symbols(data, offsets, LANES if busy else ())
                raw = data.tobytes()
                for k, copy in enumerate(part.column(5).to_pylist()):
                    a, b = int(rows[k]), int(rows[k + 1])
                    gone = np.full(b - a, bool(copy) and b - a >= window)
                    if part.column(3)[k].is_valid:
                        at = _starts(part.column(3)[k].values.to_numpy(), window, width, b - a)
                        own = part.column(4)[k].values.to_numpy() if part.column(4)[k].is_valid else np.zeros(0, np.int32)
                        names = np.stack(_names(prefix, at + a, window), 1)
                        _, same = np.unique(names, axis=0, return_inverse=True)
                        kept = np.isin(same.ravel(), same.ravel()[np.isin(at, own)])
                        gone = spread(at[~kept], window, b - a)
                    keep = np.flatnonzero(~gone) + a
                    out["n_words"].append(b - a)
                    out["n_removed"].append(int(gone.sum()))
                    out["removed"].append(spans(gone).tolist())
                    out["kept_text"].append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode("utf-8", "replace"))
                ids = pa.array([None if i == LAST_ID else i for i in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], pa.list_(pa.list_(pa.int64()))), pa.array(out["kept_text"], pa.string())], ["i", *out])

    schema = T.StructType([T.StructField(id_col, T.LongType()), *T._parse_datatype_string("n_words long, n_removed long, removed array<array<long>>, kept_text string").fields])
    return joined.mapInArrow(cut, schema)
