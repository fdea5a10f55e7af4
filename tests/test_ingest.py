"""Weather files by full path: names that repeat, encodings, folders, ragged rows, problems by file."""

import tempfile
from pathlib import Path

import pytest

from spanwatt.sources import weather

LEGACY = "位置,日期,时刻,环境温度,风速,风向\n"


def folder_of(files: dict[str, bytes]) -> Path:
    top = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    return top


def test_two_files_of_one_name(spark):
    """Both count; the one named first in the list is first, whatever its folder is called."""
    top = folder_of({"x/a.csv": (LEGACY + "1,2024-01-01,00:00,5,1,90\n").encode("gb18030"), "b/a.csv": (LEGACY + "1,2024-01-01,00:00,6,2,90\n2,2024-01-01,00:00,7,3,90\n").encode("utf-8-sig")})
    df, report = weather.ingest(spark, [f"{top}/x/a.csv", f"{top}/b/a.csv"], "physical")
    assert sorted((r.tower_id, r.ambient_temp) for r in df.collect()) == [("1", 5.0), ("2", 7.0)]
    assert df.select("source_file_hash").distinct().count() == 2
    df, _ = weather.ingest(spark, [f"{top}/b", f"{top}/x"], "physical")
    assert sorted((r.tower_id, r.ambient_temp) for r in df.collect()) == [("1", 6.0), ("2", 7.0)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_problems_by_file(spark):
    top = folder_of({"good.csv": LEGACY.encode() + b"1,2024-01-01,00:00,5,1\n\n2,2024-01-01,00:00,5,1,90,9,9\n", "bytes.csv": b"\xff\xff\xff", "other.csv": "a,b\n1,2\n".encode(), "lacks.csv": "位置,日期,时刻,风速\n".encode(), "note.txt": b"x", "empty.csv": b""})
    got = {Path(r.path).name: (r.encoding, r.layout, r.problem) for r in weather.inspect(spark, [str(top)]).collect()}
    assert got["good.csv"] == ("utf-8-sig", "legacy", None) and got["note.txt"] == (None, None, "not a CSV file")
    assert got["bytes.csv"][2] == "no known encoding" and got["other.csv"][2] == "no known layout" and got["lacks.csv"][2].startswith("missing columns")
    with pytest.raises(ValueError, match="lacks.csv"):
        weather.ingest(spark, [str(top)], "physical")
    df, report = weather.ingest(spark, [str(top)], "physical", skip_bad=True)
    assert [r.tower_id for r in df.collect()] == ["2"]  # a short row lacks its last cells, an empty line is no row
    total = {r.reason: r.rows for r in report.where("source_file_hash is null").collect()}
    assert total == {"input_rows": 2, "valid_rows": 1, "dropped_rows": 1, "missing_wind_direction": 1}
    with pytest.raises(ValueError, match="empty"):
        weather.ingest(spark, [f"{top}/good.csv", f"{top}/empty.csv"], "physical")
    with pytest.raises(ValueError):
        weather.ingest(spark, [f"{top}/other.csv"], "physical", skip_bad=True)
