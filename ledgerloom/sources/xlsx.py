"""Spreadsheets with the standard library: reading sheets on the driver, as a Spark data source, and writing workbooks,
whose rows tasks format and deflate."""

from __future__ import annotations

import io
import itertools
import math
import re
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..keeping import checkpointed

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(data: bytes, sheet: str | int = 0) -> list[list[str | None]]:
    """Rows of a sheet as text (numbers as stored, booleans as true and false)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        chosen = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(z.read("xl/" + links[chosen.get(_REL)].removeprefix("/xl/")))
    out: list[list[str | None]] = []
    for row in root.findall("m:sheetData/m:row", _NS):
        cells: list[str | None] = []
        for i, c in enumerate(row.findall("m:c", _NS)):
            at = _column(c.get("r")) if c.get("r") else i
            cells += [None] * (at + 1 - len(cells))
            v = c.find("m:v", _NS)
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None:
                cells[at] = strings[int(v.text)] if c.get("t") == "s" else {"0": "false", "1": "true"}.get(v.text, v.text) if c.get("t") == "b" else v.text
        out.append(cells)
    return out


def _table(data: bytes, sheet: str | int) -> tuple[list[str], list[tuple]]:
    rows = read_sheet(data, sheet)
    head = [str(x) for x in rows[0]] if rows else []
    return head, [tuple((r + [None] * len(head))[: len(head)]) for r in rows[1:]]


def load_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet with a header as strings, with _seq, the order of its rows. Read through Spark, so any store will do."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    head, rows = _table(data, sheet)
    schema = ", ".join(f"`{c}` string" for c in head)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], (schema + ", " if schema else "") + "_seq long")


class SheetSource(DataSource):
    """spark.read.format("sheet").option("sheet", ...).load(path); register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _sheet(self) -> str | int:
        x = self.options.get("sheet", "0")
        return int(x) if x.isdigit() else x

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in _table(Path(self.options["path"]).read_bytes(), self._sheet())[0])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._sheet())


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | int):
        self.path, self.sheet = path, sheet

    def read(self, partition) -> Iterator[tuple]:
        yield from _table(Path(self.path).read_bytes(), self.sheet)[1]


#: Fill colours of verdicts. Fixed values.
FILLS = {"ANOMALY": "FFF8CBAD", "AMBIGUOUS": "FFFFE699", "JUSTIFIED": "FFDDEBF7", "MATCH": "FFE2EFDA"}


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _cell(ref: str, value: object, style: int) -> str:
    if value is None:
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and math.isfinite(value):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


#: Rows of a sheet at most, its header aside. A fixed value of the format.
SHEET_ROWS = 1_048_575
#: Rows that a task deflates together.
FRAGMENT_ROWS = 8192
WIDEST = 70
_FRAGMENT = "sheet long, rows long, size long, crc long, packed long, widths array<int>, data binary"
_PLAIN = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def _deflated(text: str) -> tuple[int, int, bytes]:
    """Size, CRC-32 and a piece of a raw deflate stream that ends on a byte and refers to nothing before it."""
    data, packer = text.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(data), zlib.crc32(data), packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)


def fragments(df: DataFrame, words: dict[str, str] | None = None, most_rows: int = SHEET_ROWS) -> DataFrame:
    """Rows of ``df`` as deflated pieces of sheets of ``most_rows``, made where the rows are and in their order. The
    table is kept, and the rows of its partitions are counted first, so that every task knows the numbers of its rows."""
    words, fills = words or {}, list(FILLS)
    letters = [_letters(i) for i in range(len(df.columns))]
    # by position, since names may repeat
    shown = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    kept = checkpointed(shown.select(*(F.col(f.name) if f.dataType.simpleString() in _PLAIN else F.col(f.name).cast("string") for f in shown.schema)))
    part, starts, before = F.spark_partition_id().alias("part"), {}, 0
    for r in sorted(kept.groupBy(part).agg(F.count("*").alias("n")).collect()):  # two numbers for a partition
        starts[r["part"]], before = before, before + r["n"]

    def line(n: int, values: tuple) -> str:
        cells = (_cell(f"{c}{n}", words.get(v, v), fills.index(v) + 2) if isinstance(v, str) and v in FILLS else _cell(f"{c}{n}", v, 0) for c, v in zip(letters, values))
        return f'<row r="{n}">{"".join(cells)}</row>'

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                number = starts[batch.column(0)[0].as_py()] if number is None else number
                sheet, row = divmod(number, most_rows)
                n = min(FRAGMENT_ROWS, most_rows - row, batch.num_rows - at)
                columns = [c.to_pylist() for c in batch.slice(at, n).columns[1:]]
                size, crc, data = _deflated("".join(line(row + i, r) for i, r in enumerate(zip(*columns) if columns else [()] * n, 2)))
                widths = [min(WIDEST, max((len(str(v)) for v in c if v is not None), default=0)) for c in columns]
                yield pa.RecordBatch.from_pylist([{"sheet": sheet, "rows": n, "size": size, "crc": crc, "packed": len(data), "widths": widths, "data": data}], _ARROW)
                at, number = at + n, number + n

    return kept.select(part, "*").mapInArrow(pack, _FRAGMENT)


_ARROW = pa.schema([("sheet", pa.int64()), ("rows", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("packed", pa.int64()), ("widths", pa.list_(pa.int32())), ("data", pa.binary())])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, where the highest bit stands for 1."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts in a row, from theirs and the ``size`` of the second."""
    shift, square = 1 << 31, 1 << 23  # 1 and x^8: one byte on
    while size:
        if size & 1:
            shift = _times(shift, square)
        square, size = _times(square, square), size >> 1
    return _times(shift, first) ^ second


def _sheet_names(name: str, n: int, taken: set[str]) -> list[str]:
    """Names of a table's sheets, 31 characters at most, unlike all ``taken``, whatever the case."""
    out, k = [], 1
    while len(out) < n:
        tail = "" if k == 1 else f" {k}"
        own, k = name[: 31 - len(tail)] + tail, k + 1
        if own.lower() not in taken:
            taken.add(own.lower())
            out.append(own)
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str | Path, words: dict[str, str] | None = None, most_rows: int = SHEET_ROWS) -> Path:
    """A workbook of tables by name, with all their rows: what one sheet can't hold goes on in the next ("All", "All 2").
    Tasks make and deflate the rows; the driver joins the pieces' streams, of which it holds one partition of a table at a
    time, deflated. Header bold and frozen, filter over the table, columns as wide as their text (70 at most). The cell of
    a verdict is filled by its colour, in whatever column it stands, and shown by its word in ``words``."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names, taken = [], set()
        for name, df in sheets.items():
            made = checkpointed(fragments(df, words, most_rows))
            every = made.drop("data").collect()  # some numbers for thousands of rows
            dealt = [list(own) for _, own in itertools.groupby(every, lambda p: p["sheet"])] or [[]]
            data = made.select("data").toLocalIterator()
            for own, pieces in zip(_sheet_names(name, len(dealt), taken), dealt):
                names.append(own)
                _write_sheet(z, f"xl/worksheets/sheet{len(names)}.xml", df.columns, pieces, data)
        _write_parts(z, names)
    return Path(path)


def _write_sheet(z: zipfile.ZipFile, member: str, head: list[str], pieces: list, data: Iterator) -> None:
    """A member from pieces that are deflated already: its size and CRC are known before the first of them is read."""
    width = [min(WIDEST, 2 + max([len(h), *(p["widths"][k] for p in pieces)])) for k, h in enumerate(head)]
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(width))
    last = f"{_letters(max(0, len(head) - 1))}{sum(p['rows'] for p in pieces) + 1}"
    begin = f'<worksheet xmlns="{_NS["m"]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{f"<cols>{cols}</cols>" if cols else ""}<sheetData><row r="1">{"".join(_cell(f"{_letters(k)}1", h, 1) for k, h in enumerate(head))}</row>'
    first, final = _deflated(begin), _deflated(f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>')
    end = zlib.compressobj(6, zlib.DEFLATED, -15).flush()  # an empty last block
    info = zipfile.ZipInfo(member)
    info.compress_type, info.header_offset = zipfile.ZIP_DEFLATED, z.fp.tell()
    every = [first[:2], *((p["size"], p["crc"]) for p in pieces), final[:2]]
    for size, crc in every:
        info.CRC, info.file_size = joined_crc(info.CRC, crc, size) if info.file_size else crc, info.file_size + size
    info.compress_size = len(first[2]) + sum(p["packed"] for p in pieces) + len(final[2]) + len(end)
    z.fp.write(info.FileHeader())
    z.fp.write(first[2])
    for _ in pieces:
        z.fp.write(next(data)["data"])
    z.fp.write(final[2] + end)
    z.filelist.append(info)
    z.NameToInfo[member] = info
    z.start_dir = z.fp.tell()


def _write_parts(z: zipfile.ZipFile, names: list[str]) -> None:
    fills = list(FILLS)
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{FILLS[v]}"/></patternFill></fill>' for v in fills)
    styles = f'<styleSheet xmlns="{_NS["m"]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(fills) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(fills) + 2}"><xf/><xf fontId="1" applyFont="1"/>' + "".join(f'<xf fillId="{i + 2}" applyFill="1"/>' for i in range(len(fills))) + "</cellXfs></styleSheet>"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names)))
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    z.writestr("xl/styles.xml", styles)
    z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
    z.writestr("_rels/.rels", f'{rel}<Relationship Id="rId1" Type="{base}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/_rels/workbook.xml.rels", rel + "".join(f'<Relationship Id="rId{i + 1}" Type="{base}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + f'<Relationship Id="rId{len(names) + 1}" Type="{base}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{base}"><sheets>' + "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, name in enumerate(names)) + "</sheets></workbook>")
