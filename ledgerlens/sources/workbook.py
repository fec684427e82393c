"""Workbook (.xlsx) statements as a Spark source.

Files are listed and read by Spark's ``binaryFile`` source (any Hadoop file
system; files are packed into tasks up to ``spark.sql.files.maxPartitionBytes``),
and each workbook's first sheet is decoded inside ``mapInPandas`` with the
standard library (a workbook is a zip of XML parts). A zip cannot be split,
so parallelism comes from the number of files.

Reading follows the single-file reader's defaults: the first sheet, row 1
is the header, empty cells are missing. Cell values arrive as text (numbers
as written, dates with a date style as ``yyyy-MM-dd[ HH:mm:ss]``); the
statement normaliser casts them. Header names are made unique the usual
way (``X``, ``X.1``); blank headers become ``Unnamed: <i>``.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import REQUIRED_COLUMNS
from ledgerlens.session import ship_package

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in number formats that display dates/times.
BUILTIN_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
# Cell texts that count as missing, as the single-file reader's defaults do.
MISSING_TEXTS = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
SUFFIX_GLOB = "*.[xX][lL][sS][xX]"
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", NS)
    rid = sheet.get(f"{{{NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("pr:Relationship", NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("workbook has no first sheet")


def _date1904(z: zipfile.ZipFile) -> bool:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    pr = wb.find("m:workbookPr", NS)
    return pr is not None and pr.get("date1904") in ("1", "true")


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.findall("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dy]|m{3,}", code))
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in BUILTIN_DATE_FORMATS or custom.get(fid, False):
            out.add(i)
    return out


def _serial_to_text(v: float, date1904: bool) -> str:
    base = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
    t = base + dt.timedelta(days=v)
    t = t.replace(microsecond=0) if t.microsecond < 500000 else (t + dt.timedelta(seconds=1)).replace(microsecond=0)
    return t.strftime("%Y-%m-%d") if t.time() == dt.time(0) else t.strftime("%Y-%m-%d %H:%M:%S")


def _cell(c, strings: list[str], dates: set[int], d1904: bool) -> str | None:
    t = c.get("t", "n")
    v = c.find("m:v", NS)
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if t == "s":
        return strings[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    if t == "n" and int(c.get("s", "0")) in dates:
        return _serial_to_text(float(v.text), d1904)
    return v.text if t in ("str", "n", "d") else None


def _sheet_rows(z: zipfile.ZipFile):
    """(row number, {column: text}) in file order, one row held at a time."""
    strings, dates, d1904 = _shared_strings(z), _date_styles(z), _date1904(z)
    number = 0
    with z.open(_first_sheet_path(z)) as f:
        for _, row in ET.iterparse(f):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            number = int(row.get("r")) if row.get("r") else number + 1
            cells = {}
            for pos, c in enumerate(row.findall("m:c", NS)):
                ref = c.get("r")
                cells[_col_index(_CELL_REF.match(ref).group(1)) if ref else pos] = _cell(c, strings, dates, d1904)
            row.clear()
            yield number, cells


def _header(cells: dict[int, str | None], width: int) -> list[str]:
    header, seen = [], {}
    for i in range(width):
        name = cells.get(i)
        name = f"Unnamed: {i}" if name is None or str(name).strip() == "" else str(name)
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        header.append(name)
    return header


def sheet_header(data: bytes) -> list[str]:
    """Column names of one workbook's first sheet: row 1, and ``Unnamed: <i>``
    for cells of later rows to the right of it. Rows are read one by one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        head, width = None, 0
        for _, cells in _sheet_rows(z):
            head = cells if head is None else head
            width = max(width, max((i for i, v in cells.items() if v is not None or cells is head), default=-1) + 1)
    return _header(head or {}, width)


def sheet_rows(data: bytes):
    """Data rows of one workbook's first sheet as {column: text}; texts that
    mean a missing value are None, skipped rows are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        last = None
        for number, cells in _sheet_rows(z):
            if last is not None:
                yield from ({} for _ in range(last + 1, number))
                yield {i: None if v in MISSING_TEXTS else v for i, v in cells.items()}
            last = number


def read_sheet(data: bytes) -> tuple[list[str], list[list]]:
    """First sheet of one workbook -> (column names, rows of text cells)."""
    header = sheet_header(data)
    return header, [[cells.get(i) for i in range(len(header))] for cells in sheet_rows(data)]


#: Rows of one workbook handed to Spark at a time.
ROWS_AT_ONCE = 10_000


def _list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p.lower().endswith(".xlsx") or "*" in p:
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).getFileStatus(path).isDirectory():
            raise ValueError("Input file must be an Excel file (.xlsx)")
    return (spark.read.format("binaryFile").option("pathGlobFilter", SUFFIX_GLOB)
            .option("recursiveFileLookup", "true").load(paths).select("path", "content"))


def read_workbooks(spark: SparkSession, paths) -> DataFrame:
    """Display-named statement rows from every workbook under ``paths``, as
    strings, plus ``_source_file`` and ``_row_id`` (data row number, 1-based).

    A first job reads each workbook's column names row by row and keeps the
    distinct lists; the output schema is their union (required columns first).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    ship_package(spark)
    files = _list_files(spark, paths)
    return _decoded(files, _columns(files))


def _columns(files: DataFrame) -> list[str]:
    """Column names of all workbooks, required ones first."""
    def headers(batches):
        for pdf in batches:
            yield pd.DataFrame({"columns": [sheet_header(b) for b in pdf["content"]]})

    sets = [r["columns"] for r in files.mapInPandas(headers, "columns array<string>").distinct().collect()]
    names: list[str] = []
    for cols in sorted(sets, key=lambda c: (len(c), c)):
        for c in cols:
            if c not in names:
                names.append(c)
    return [c for c in REQUIRED_COLUMNS if c in names] + [c for c in names if c not in REQUIRED_COLUMNS]


def stream_workbooks(spark: SparkSession, source_dir: str, columns: list[str] | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of what :func:`read_workbooks` gives, for the workbooks that arrive under ``source_dir``.

    ``columns`` names the display columns, as a stream needs them before it starts: by default those of the workbooks
    there now, or the required ones where there are none. Columns of later workbooks beyond them are left out, and are
    missing (null) where a workbook lacks them. Which files were read is kept by Spark's file source in the checkpoint."""
    ship_package(spark)
    if columns is None:
        columns = _columns(_list_files(spark, [source_dir])) or REQUIRED_COLUMNS
    reader = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
              .option("pathGlobFilter", SUFFIX_GLOB).option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _decoded(reader.load(source_dir).select("path", "content"), columns)


def _decoded(files: DataFrame, ordered: list[str]) -> DataFrame:
    """Rows of workbooks given as ``path, content``."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in ordered)
    schema += ", _source_file string, _row_id bigint"

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                pos = {h: i for i, h in enumerate(sheet_header(content))}
                rows, begin = sheet_rows(content), 1
                while some := list(itertools.islice(rows, ROWS_AT_ONCE)):
                    cols = {c: pd.Series([row.get(pos.get(c)) for row in some], dtype=object) for c in ordered}
                    cols["_source_file"] = pd.Series([path] * len(some), dtype=object)
                    cols["_row_id"] = pd.Series(range(begin, begin + len(some)), dtype="int64")
                    yield pd.DataFrame(cols)
                    begin += len(some)

    return files.mapInPandas(parse, schema)
