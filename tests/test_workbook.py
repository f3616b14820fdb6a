import random
import re
import zipfile
import zlib

from pyspark.sql import functions as F

from ledgerloom.sources import xlsx
from ledgerloom.sources.xlsx import fragments, joined_crc, load_sheet, read_sheet, write_workbook


def test_joined_crc():
    draw = random.Random(3)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (100, 7), (3, 70_000)]:
        a, b = draw.randbytes(n), draw.randbytes(m)
        assert joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_rows_go_on_in_further_sheets(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("<é & "), "id")).alias("text"), (F.col("id") % 2 == 0).alias("even"), F.lit("ANOMALY").alias("verdict"))
    path = write_workbook({"All": df, "all 2": df.limit(0), "None": df.limit(0)}, tmp_path / "w.xlsx", {"ANOMALY": "Odd one"}, most_rows=1000)  # no multiple of a partition
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = re.findall(r'<sheet name="([^"]+)"', z.read("xl/workbook.xml").decode())
        last = z.read("xl/worksheets/sheet1.xml").decode()
    assert len(set(map(str.lower, names))) == len(names) and names[0] == "All" and "None" in names
    own = [n for n in names if re.fullmatch(r"All( \d+)?", n)]
    rows = [read_sheet(path.read_bytes(), n) for n in own]
    assert [len(r) for r in rows] == [1001] * 5 and all(r[0] == df.columns for r in rows)
    assert [tuple(x) for r in rows for x in r[1:]] == [(str(r["id"]), r["text"], str(r["even"]).lower(), "Odd one") for r in df.collect()]
    assert 'ref="A1:D1001"' in last and '<row r="1001"><c r="A1001" s="0"><v>999</v></c>' in last and '<c r="D1001" s="2" t="inlineStr">' in last
    assert read_sheet(path.read_bytes(), "None") == [df.columns] and load_sheet(spark, str(path), "None").count() == 0


def test_values(spark, tmp_path):
    df = spark.sql("SELECT 1.5D AS v, double('NaN') AS v, date'2020-01-02' AS d, timestamp'2020-01-02 03:04:05' AS t, 1.20BD AS n, array(1, 2) AS a, null AS z, char(7) || 'b' AS c")
    row = read_sheet(write_workbook({'A "b" <c>': df, "Empty": spark.range(1).select()}, tmp_path / "w.xlsx").read_bytes(), 'A "b" <c>')
    assert row == [["v", "v", "d", "t", "n", "a", "z", "c"], ["1.5", "nan", "2020-01-02", "2020-01-02 03:04:05", "1.20", "[1, 2]", None, "b"]]


def test_tasks_hold_pieces_not_tables(spark, tmp_path, monkeypatch):
    """Two million rows over two sheets; no piece has more rows than it may, and nothing else is collected."""
    df = spark.range(0, 2_000_000, 1, 16).select("id", F.lit("MATCH").alias("verdict"))
    made = fragments(df).select("rows", "packed").collect()
    assert sum(r["rows"] for r in made) == 2_000_000 and max(r["rows"] for r in made) <= xlsx.FRAGMENT_ROWS
    path = write_workbook({"All": df}, tmp_path / "w.xlsx")
    with zipfile.ZipFile(path) as z:
        counts = []
        for name in sorted(n for n in z.namelist() if "worksheets" in n):
            with z.open(name) as f:  # reads the member to its end and checks its CRC
                counts.append(sum(part.count(b"<row ") for part in iter(lambda: f.read(1 << 24), b"")))
    assert len(counts) == 2 and abs(sum(counts) - 2_000_002) < 3 and max(counts) <= 1_048_576  # a row may begin where a part ends
