"""Weather files: encodings, layouts, fingerprints, and merged ingestion."""

from __future__ import annotations

import codecs
import csv
import io
import logging
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanwatt.functions.parsing import date_and_time, instant, number, tower_id, tower_number
from spanwatt.operators import quality

# Encodings in the order in which they are tried, and the headers of both layouts.
ENCODINGS = ("utf-8-sig", "gb18030", "gbk")
LEGACY_HEADERS = (("position", "位置"), ("date", "日期"), ("time_str", "时刻"), ("ambient_temp", "环境温度"), ("wind_speed", "风速"), ("wind_direction", "风向"), ("solar_radiation", "太阳辐射"), ("elevation", "海拔"), ("humidity", "相对湿度"))
TOWER_HEADERS = (("time_str", "时间"), ("tower", "杆塔"), ("wind_speed", "WS(m/s)"), ("wind_direction", "WD(deg)"), ("ambient_temp", "TEM(C)"), ("humidity", "RHU(%)"), ("longitude", "经度"), ("latitude", "纬度"))
MEASURES = ("ambient_temp", "wind_speed", "wind_direction", "solar_radiation", "humidity", "elevation", "longitude", "latitude")
#: Bytes of a file that go to Python at once.
PIECE = 1 << 20
MANDATORY = ("ambient_temp", "wind_speed", "wind_direction")


def clean_header(name: str) -> str:
    """One spelling for full-width brackets and slashes, and for units."""
    for a, b in (("﻿", ""), ("（", "("), ("）", ")"), ("／", "/"), ("℃", "C"), ("°", "deg")):
        name = name.replace(a, b)
    return name.strip()


@dataclass(frozen=True)
class Layout:
    """How a kind of file is told by its headers: names with the marks that a header may bear, and
    the names that must be there (``needs``: to be of this layout; ``must``: to be usable)."""

    name: str
    headers: tuple[tuple[str, tuple[str, ...]], ...]
    needs: tuple[str, ...]
    must: tuple[str, ...] = ()

    def places(self, header: list[str]) -> dict[str, int]:
        """The column of each name: the first mark that some header bears, the first such header."""
        found = {}
        for name, marks in self.headers:
            at = next((k for m in marks for k, h in enumerate(header) if m in h), None)
            if at is not None:
                found[name] = at
        return found


WEATHER = (
    Layout("tower", tuple((n, (m,)) for n, m in TOWER_HEADERS), ("time_str", "tower", "wind_speed"), MANDATORY),
    Layout("legacy", tuple((n, (m,)) for n, m in LEGACY_HEADERS), ("position",), ("date", "time_str", *MANDATORY)),
)


def names_of(layouts: tuple[Layout, ...]) -> list[str]:
    return list(dict.fromkeys(n for x in layouts for n, _ in x.headers))


def _of_header(header: list[str], layouts: tuple[Layout, ...]) -> tuple[Layout | None, dict[str, int]]:
    """The layout that a first row has, and its columns by name."""
    header = [clean_header(c) for c in header]
    layout = next((x for x in layouts if set(x.needs) <= set(x.places(header))), None)
    return layout, layout.places(header) if layout else {}


class _Bytes(io.RawIOBase):
    """A file out of its pieces, of which it holds one at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out: memoryview) -> int:  # type: ignore[override]
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(out), len(self.rest))
        out[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def _rows(pieces: Iterator[bytes], encoding: str) -> Iterator[list[str]]:
    return csv.reader(io.TextIOWrapper(io.BufferedReader(_Bytes(pieces), 1 << 16), encoding=encoding, newline=""))


def _first_row(pieces: Iterator[bytes]) -> tuple[str | None, list[str]]:
    """The first encoding that decodes all bytes strictly, and the first row in it; else None.  The encodings
    are tried side by side; of the text only the beginning is kept."""
    tried = {e: codecs.getincrementaldecoder(e)("strict") for e in ENCODINGS}
    begun = dict.fromkeys(ENCODINGS, "")

    def fed(piece: bytes, end: bool) -> None:
        for encoding, decoder in list(tried.items()):
            try:
                text = decoder.decode(piece, end)
            except UnicodeDecodeError:
                del tried[encoding]
                continue
            if len(begun[encoding]) < PIECE:
                begun[encoding] += text

    for piece in pieces:
        fed(piece, False)
    fed(b"", True)
    encoding = next(iter(tried), None)
    return encoding, next(csv.reader(io.StringIO(begun[encoding] if encoding else "", newline="")), [])


def _binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content, sha256 of all files at the paths, in folders too.  Spark reads them, wherever
    its file systems reach, and deals the files to tasks by their size; a file is one row, which must fit into the heap of a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "content", F.sha2("content", 256).alias("source_file_hash"))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content, source_file_hash, piece: all files in pieces of their bytes, those of a file in a row within one task, so that
    Python holds some pieces and never a file."""
    size = F.greatest(F.ceil(F.length("content") / PIECE).cast("int"), F.lit(1))
    cut = _binary(spark, paths).select("path", "content", "source_file_hash", F.explode(F.sequence(F.lit(0), size - 1)).alias("piece"))
    return cut.select("path", F.substring("content", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("content"), "source_file_hash", "piece")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Iterator[bytes]]]:
    """Path, hash and pieces of each file of a task, in one pass."""

    def numbered() -> Iterator[tuple[int, str, str, bytes]]:
        number = 0
        for batch in batches:
            path, content, print_, piece = batch.columns
            for k in range(batch.num_rows):
                number += piece[k].as_py() == 0
                yield number, path[k].as_py(), print_[k].as_py(), content[k].as_py()

    for _, rows in groupby(numbered(), lambda r: r[0]):
        first = next(rows)
        yield first[1], first[2], chain([first[3]], (r[3] for r in rows))


def file_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, sha256 of each file's bytes."""
    return _binary(spark, paths).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("source_file_hash").alias("sha256"))


def inspect(spark: SparkSession, paths: list[str], layouts: tuple[Layout, ...] = WEATHER) -> DataFrame:
    """path, source_file_hash, encoding, layout, missing, problem (null: readable) of every file.

    A file of another ending isn't looked into; one that no encoding decodes, of no known layout or without
    a mandatory column has a problem.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, print_, pieces in _files(batches):
            if not path.lower().endswith(".csv"):
                out.append((path, print_, None, None, None, "not a CSV file"))
                continue
            encoding, header = _first_row(pieces)
            layout, places = _of_header(header, layouts)
            missing = [c for c in layout.must if c not in places] if layout else None
            problem = "no known encoding" if encoding is None else "no known layout" if layout is None else f"missing columns {missing}" if missing else None
            out.append((path, print_, encoding, layout and layout.name, missing, problem))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "source_file_hash", "encoding", "layout", "missing", "problem"])

    return _pieces(spark, paths).mapInArrow(look, "path string, source_file_hash string, encoding string, layout string, missing array<string>, problem string")


def read_rows(spark: SparkSession, paths: list[str], layouts: tuple[Layout, ...] = WEATHER, files: list[Row] | None = None) -> DataFrame:
    """path, source_file_hash, layout, row_order and a text column for every name of the layouts: all
    rows of all usable files, in one pass over their bytes.  A name that a file lacks is null in its rows, and
    ``has`` lists those that it has.  files: what ``usable`` found of them; without it all are looked into first."""
    names = names_of(layouts)
    encodings = {r.path: r.encoding for r in (inspect(spark, paths, layouts).collect() if files is None else files) if not r.problem}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, print_, pieces in _files(batches):
            if path not in encodings:
                continue
            lines = _rows(pieces, encodings[path])
            layout, places = _of_header(next(lines, []), layouts)
            if layout is None or any(c not in places for c in layout.must):
                continue
            first, has = 0, list(places)
            while rows := list(islice(lines, 10_000)):
                rows, n = [r for r in rows if r], len(rows)
                cell = lambda k: [r[k] if k < len(r) and r[k] != "" else None for r in rows]  # noqa: B023, E731
                columns = [pa.array(cell(places[c]) if c in places else [None] * len(rows), pa.string()) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([print_] * len(rows)), pa.array([layout.name] * len(rows)), pa.array([has] * len(rows), pa.list_(pa.string())), pa.array(range(first, first + len(rows)), pa.int64()), *columns], names=["path", "source_file_hash", "layout", "has", "row_order", *names])
                first += n

    schema = "path string, source_file_hash string, layout string, has array<string>, row_order long, " + ", ".join(f"`{n}` string" for n in names)
    return _pieces(spark, paths).mapInArrow(parse, schema)


def usable(spark: SparkSession, paths: list[str], layouts: tuple[Layout, ...], skip_bad: bool = False) -> list[Row]:
    """The readable files in the order of ``paths``, files of a folder by name.  One job looks into all files;
    an empty file counts only where it is named itself.

    Other files are refused, or with ``skip_bad`` left out with a warning as long as one is left.  Only
    the list of files comes to the driver.
    """
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    given = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    given = [p.getFileSystem(hadoop).makeQualified(p).toString() for p in given]
    place = lambda path: next((k for k, p in enumerate(given) if path == p or path.startswith(p.rstrip("/") + "/")), len(given))
    found = sorted(inspect(spark, paths, layouts).collect(), key=lambda r: (place(r.path), r.path))
    bad = {r.path: r.problem for r in found if r.problem}
    seen = {place(r.path) for r in found}  # Spark lists no file without a byte
    bad |= {p: "empty" for k, p in enumerate(given) if k not in seen}
    good = [r for r in found if not r.problem]
    if bad and not skip_bad or not good:
        raise ValueError(f"unreadable files: {bad}")
    if bad:
        logging.getLogger(__name__).warning("left out unreadable files: %s", bad)
    return good


def canonical(rows: DataFrame, role: str) -> DataFrame:
    """Rows of ``read_rows`` in the canonical columns.

    Text that is no number is missing.  Radiation, elevation and humidity may be absent.  Times are read in the
    project's zone and kept in UTC.
    """
    tower = F.col("layout") == "tower"
    wall = date_and_time(F.col("date"), F.col("time_str"))
    who = F.when(tower, tower_id(F.col("tower"))).otherwise(tower_number(F.col("position")).cast("string"))
    when = F.when(tower, instant(F.col("time_str"))).otherwise(instant(wall.cast("string")))
    return rows.select(who.alias("tower_id"), when.alias("timestamp"), *[number(F.col(c)).alias(c) for c in MEASURES], F.lit(role).alias("dataset_role"), "path", "source_file_hash", "row_order", "has")


def ingest(spark: SparkSession, paths: list[str], role: str, skip_bad: bool = False) -> tuple[DataFrame, DataFrame]:
    """Weather out of many files, and the report by file and in total.

    Files are told by their full paths, so that two of one name are two.  Of rows that share tower and time
    the first in file order, then row order, stays.  Only files with places are tested for places.
    """
    files = usable(spark, paths, WEATHER, skip_bad)
    order = spark.createDataFrame([(r.path, k) for k, r in enumerate(files)], "path string, file_order long")
    df = quality.validated(canonical(read_rows(spark, paths, files=files), role))
    placed = F.array_contains("has", "longitude") & F.array_contains("has", "latitude")
    reasons = F.when(placed, F.col("reasons")).otherwise(F.array_except("reasons", F.array(F.lit("longitude_not_finite"), F.lit("latitude_not_finite"))))
    df = df.withColumn("reasons", reasons).drop("has").join(order, "path")
    keys = ["file_order", "row_order"]
    return quality.clean_weather(df, keys), quality.merged_report(df, keys)


def ingest_truth(spark: SparkSession, paths: list[str], enabled: bool = True) -> DataFrame | None:
    """Truth is optional: without files, or with one that can't be read, there is none, and the
    physical path goes on."""
    if not enabled or not paths:
        return None
    try:
        df, _ = ingest(spark, paths, "truth")
        df.limit(1).count()
        return df
    except Exception:
        logging.getLogger(__name__).warning("the truth files are left out", exc_info=True)
        return None
