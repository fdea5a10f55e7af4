"""Files that come to Python in pieces."""

import io

import pyarrow as pa

from spanwatt.sources import weather

TOP = "位置,日期,时刻,环境温度,风速,风向\n"


def test_files_in_pieces(spark, tmp_path, monkeypatch):
    """Cuts through characters, quoted lines and line ends change nothing; Spark hands over pieces, not files."""
    monkeypatch.setattr(weather, "PIECE", 7)
    body = "".join(f"{k}号,2024-01-01,00:{k:02}:00,{k},1,90\r\n" for k in range(30)) + '"31\n号",2024-01-01,00:31,5,"1",90\n'
    for name, encoding in (("a.csv", "gb18030"), ("b.csv", "utf-8-sig"), ("c.csv", "utf-8")):
        (tmp_path / name).write_bytes((TOP + body).encode(encoding))
    (tmp_path / "d.csv").write_bytes((TOP + body).encode("gb18030") + b"\x81")
    assert max(len(r.content) for r in weather._pieces(spark, [str(tmp_path)]).select("content").collect()) == 7
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.layout, r.problem) for r in weather.inspect(spark, [str(tmp_path)]).collect()}
    assert got == {"a.csv": ("gb18030", "legacy", None), "b.csv": ("utf-8-sig", "legacy", None), "c.csv": ("utf-8-sig", "legacy", None), "d.csv": (None, None, "no known encoding")}
    rows = weather.read_rows(spark, [str(tmp_path)]).orderBy("path", "row_order").collect()
    assert [(r.position, r.row_order, r.wind_direction) for r in rows] == 3 * [*[(f"{k}号", k, "90") for k in range(30)], ("31\n号", 30, "90")]


def test_bytes_held():
    """A file of many pieces is read while one of them is held."""
    taken = []

    def pieces():
        for k in range(1000):
            taken.append(k)
            yield b"1,2\n" * 5000

    rows = weather._rows(pieces(), "utf-8-sig")
    assert next(rows) == ["1", "2"] and len(taken) <= 5
    batches = (pa.RecordBatch.from_arrays([pa.array([p]), pa.array([b"x"]), pa.array(["h"]), pa.array([k])], names=list("abcd")) for p, k in (("f", 0), ("f", 1), ("g", 0), ("g", 0)))
    assert [(p, b"".join(parts)) for p, _, parts in weather._files(batches)] == [("f", b"xx"), ("g", b"x"), ("g", b"x")]
    assert isinstance(weather._Bytes(iter([b"ab", b"", b"c"])), io.RawIOBase) and io.BufferedReader(weather._Bytes(iter([b"ab", b"", b"c"]))).read() == b"abc"
