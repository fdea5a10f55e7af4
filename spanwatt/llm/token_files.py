"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of pairs of Arrow IPC files, one pair for each range of ids:
``part-00000.arrow`` with record batches of two fixed-size-list columns, ``ids`` (unsigned
integers, little-endian) and ``mask`` (true for a token, false for padding), and
``part-00000.docs.arrow`` with the documents of the part: id, start (in the part), n_tokens.
Documents follow each other without gaps; only a part's last sequence is padded.  All batches
but a part's last hold equally many sequences, and the file form carries their places in a
footer, so a memory map gives any sequence without a copy.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, shared_dir

#: Words kept by a Python worker with their ids; the oldest half goes when there are more.
#: Words of more characters than this are not kept.
CACHE, LONGEST = 900_000, 64
#: Sequences of a record batch; only a part's last batch has fewer.
ROWS = 64

#: str.split() also splits at U+001C to U+001F, which the tokenizer keeps.
_KEPT, _RUNS = re.compile(r"[\x1c-\x1f]"), re.compile(r"[\S\x1c-\x1f]+")


def word_encoder(path: str, kind: type) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts with a file of the tokenizers library, without adding special tokens, to
    ids of a numpy type end to end.

    The tokenizer drops white space and splits there, so a text's ids are those of its
    space-free runs end to end; each run is encoded once and then remembered.  It also splits
    letters from marks, and ignores case: a run of letters (that are still letters as it reads
    them, composed and in lower case) before ASCII marks has the ids of
    both, and runs of letters are encoded many at a time, as a text, and told apart by the
    tokens that end a word.  Where these are not as many as the runs, each goes by itself.
    """
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")

    def singly(words: list[str]) -> None:
        known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True))

    def learn(words: set[str]) -> None:
        cut, other = {}, []
        for w in words:
            head = w.rstrip(string.punctuation)
            if head.isalpha() and head.isascii():
                cut[w] = head.lower(), w[len(head) :]
            elif head.isalpha() and unicodedata.normalize("NFC", head).lower().isalpha():
                cut[w] = head, w[len(head) :]
            else:
                other.append(w)
        letters = list({head for head, _ in cut.values()}.difference(known))
        for run in (letters[k : k + 4096] for k in range(0, len(letters), 4096)):
            ids = np.array(tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(ends[ids]) + 1
            if len(last) == len(run) and last[-1] == len(ids):
                raw, at = ids.astype(kind).tobytes(), [0, *(last * kind().itemsize).tolist()]
                known.update((w, raw[a:b]) for w, a, b in zip(run, at[:-1], at[1:], strict=True))
            else:
                singly(run)
        singly([*other, *{tail for _, tail in cut.values() if tail}.difference(known)])
        known.update((w, known[head] + known[tail] if tail else known[head]) for w, (head, tail) in cut.items())

    def encode(texts: list[str]) -> list[bytes]:
        words = [_RUNS.findall(t) if _KEPT.search(t) else t.split() for t in texts]
        every = set(chain.from_iterable(words))
        if len(known) + len(every) > CACHE:
            for w in [w for w, _ in zip(known, range(len(known) // 2), strict=False)]:
                del known[w]
        missing = every.difference(known)
        if missing:
            learn(missing)
        made = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in missing:
            if len(w) > LONGEST:
                for x in {w, (head := w.rstrip(string.punctuation)), head.lower(), w[len(head) :]}:
                    known.pop(x, None)
        return made

    return encode


_encoders: dict[tuple, Callable[[list[str]], list[bytes]]] = {}


def _encoder(path: str, kind: type) -> Callable[[list[str]], list[bytes]]:
    """A worker's encoder stays from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = word_encoder(path, kind)
    return _encoders[path, kind]


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, id_bits: int = 16, parts: int | None = None) -> DataFrame:
    """Encodes every text, puts ``end_id`` after each, writes the files, and returns their
    manifest: part, path, n_docs, n_tokens, in the order of the ids.

    A null text is an empty one: only the end id.  Null ids come last; rows with equal ids are
    all kept, in no stated order among them.  An empty table gives an empty manifest.
    Texts are ranged by id and then encoded by the task that writes them, so that the sampling
    of the ranges doesn't encode.  A task writes under a
    name of its own and renames at the end: a task that runs again replaces whole files.
    """
    spark = docs.sparkSession
    folder, kind = folder or shared_dir(spark), {16: np.uint16, 32: np.uint32}[id_bits]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end = _encoder(vocabulary, kind), kind(end_id).tobytes()
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, top = _place(folder)
        files.create_dir(top, recursive=True)
        name, own = f"{top}/part-{part:05d}", f"{top}/.attempt-{attempt}"
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        index = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        total = docs_seen = 0
        left = np.zeros(0, kind)
        with files.open_output_stream(own + ".d") as d, pa.ipc.new_file(d, index) as by_doc, files.open_output_stream(own + ".s") as s, pa.ipc.new_file(s, schema) as by_seq:

            def put(ids: np.ndarray, n: int) -> None:
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), sequence) for x in (ids, np.arange(len(ids)) < n)]
                by_seq.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

            for batch in (b.slice(lo, 512) for b in batches for lo in range(0, len(b), 512)):
                ids = [x + end for x in to_ids([t or "" for t in batch.column(1).to_pylist()])]
                n = np.array([len(x) for x in ids], np.int64) // kind().itemsize
                by_doc.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=index))
                total, docs_seen = total + int(n.sum()), docs_seen + len(n)
                left = np.concatenate([left, np.frombuffer(b"".join(ids), kind)])
                whole = len(left) // (sequence * ROWS) * sequence * ROWS
                for lo in range(0, whole, sequence * ROWS):
                    put(left[lo : lo + sequence * ROWS], sequence * ROWS)
                left = left[whole:]
            if len(left):
                put(np.concatenate([left, np.zeros(-len(left) % sequence, kind)]), len(left))
        if docs_seen:
            files.move(own + ".d", name + ".docs.arrow")
            files.move(own + ".s", name + ".arrow")
            row = [[part], [f"{folder}/part-{part:05d}"], [docs_seen], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), *(pa.array(x, pa.int64()) for x in row[2:])], ["part", "path", "n_docs", "n_tokens"])
        else:
            files.delete_file(own + ".d")
            files.delete_file(own + ".s")

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    parts = parts or max(1, docs.rdd.getNumPartitions())
    ordered = docs.select(key.alias("id"), F.col(text_col).alias("t")).repartitionByRange(parts, "id").sortWithinPartitions("id")
    manifest = ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long")
    return spark.createDataFrame(manifest.collect(), manifest.schema)  # a row for each pair of files


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back, in as many tasks as there are pairs: id, start (tokens of all documents
    before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, crc in _documents(path):
                    ids = [None if i == LAST_ID else i for i in docs.column("id").to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.compute.add(docs.column("start"), first), docs.column("n_tokens"), pa.array(crc, pa.int64())], ["i", "start", "n_tokens", "ids_crc32"])

    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.select("path", first.alias("first"), "part").repartition(max(1, manifest.count()), "part").select("path", "first")
    return rows.mapInArrow(read, "i long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("i", id_col)


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    files, name = _place(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(name))


def _documents(path: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The batches of a part's documents with the checksums of their ids; holds a document and
    the sequences it lies in at a time."""
    index, data = _open(path + ".docs.arrow"), _open(path + ".arrow")
    at, left, first = 0, np.zeros(0, np.uint32), 0  # left: ids from number first on
    for k in range(index.num_record_batches):
        docs, crc = index.get_batch(k), []
        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
            parts = [left[start - first :]]
            have = len(parts[0])
            while have < n:
                parts.append(data.get_batch(at).column("ids").flatten().to_numpy().astype("<u4"))
                have, at = have + len(parts[-1]), at + 1
            left, first = np.concatenate(parts) if len(parts) > 1 else parts[0], start
            crc.append(zlib.crc32(memoryview(left[:n]).cast("B")))
        yield docs, crc


def sequences(path: str, numbers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences of a part by number: (ids, mask).  Only the batches that hold them are looked
    at.  In a local file the ids are views of the memory map; the mask's bits are unpacked."""
    data, out = _open(path + ".arrow"), []
    for i in numbers:
        batch, row = data.get_batch(i // ROWS), i % ROWS
        size = batch.schema.field("ids").type.list_size
        ids, mask = (batch.column(c).values.slice(row * size, size) for c in ("ids", "mask"))
        out.append((ids.to_numpy(), mask.to_numpy(zero_copy_only=False)))
    return out


def token_table(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1, **options: object) -> DataFrame:
    """Writes the files and reads them back."""
    return read_tokens(write_tokens(docs, vocabulary, end_id, **options), options.get("id_col", "doc_id"))
