"""File sources and sinks.

Readers load every field as text, turn the NA tokens into NULL (one
projection), then infer each column's type with **one** aggregate over the
data: a column becomes ``boolean``, ``bigint``, ``double``, ``date``,
``timestamp_ntz`` or stays ``string`` depending on whether every non-null
value parses.  Workbooks (``.xlsx``) are read one file per task with the
Python standard library (zip + XML), no driver-side parsing.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.columns import col, quote
from tabsight.session import checkpoint_dir

# pandas' default NA tokens for read_csv.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_DATE = r"^\d{4}-\d{2}-\d{2}$"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "tabsight-files", f"{name}-{uuid.uuid4().hex[:12]}")


def canonicalize_na(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    return df.select(*[F.when(col(c).isin(list(tokens)), None).otherwise(col(c)).alias(c) for c in df.columns])


# a number as text: no type suffix such as 1d or 2f
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Quotes are doubled inside quoted fields, as other CSV tools write and read.
_CSV_QUOTES = {"quote": '"', "escape": '"'}


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest type every non-null value parses as
    (one aggregate for all columns and candidate types)."""
    checks = {
        "boolean": lambda c: F.lower(c).isin("true", "false"),
        "bigint": lambda c: c.try_cast("bigint").isNotNull() & c.rlike(r"^[+-]?\d+$"),
        "double": lambda c: c.try_cast("double").isNotNull() & c.rlike(_NUMBER),
        "date": lambda c: c.rlike(_DATE) & c.try_cast("date").isNotNull(),
        "timestamp_ntz": lambda c: c.try_cast("timestamp_ntz").isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"),
    }
    aggs = []
    for i, c in enumerate(df.columns):
        x = col(c)
        aggs.append(F.count(x).alias(f"n{i}"))
        for t, fn in checks.items():
            aggs.append(F.count(F.when(x.isNotNull() & fn(F.trim(x)), 1)).alias(f"{t}{i}"))
    if not aggs:
        return df
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        target = "string"
        if n:
            for t in checks:
                if r[f"{t}{i}"] == n:
                    target = t
                    break
        x = F.trim(col(c)) if target != "string" else col(c)
        if target == "boolean":
            out.append((F.lower(x) == "true").alias(c))
        elif target == "string":
            out.append(x.alias(c))
        else:
            out.append(x.cast(target).alias(c))
    return df.select(*out)


#: Write options that keep microseconds (Spark's default drops them).
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_csv(spark: SparkSession, path: str, header: bool = True, na_tokens=NA_TOKENS,
             infer: bool = True, multi_line: bool | None = None, **options) -> DataFrame:
    """CSV source (S1): header row, NA tokens -> NULL, inferred types.

    Quoted fields may hold quotes (doubled), commas and line breaks.  Files
    stay splittable (many tasks per large file) unless a line leaves a quote
    open; then a field holds a line break and each file is one task.
    ``multi_line`` skips that look."""
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    options = _CSV_QUOTES | options
    raw = spark.read.options(header=str(header).lower(), inferSchema="false", multiLine=str(multi_line).lower(),
                             **options).csv(path)
    raw = canonicalize_na(raw, na_tokens)
    return infer_types(raw) if infer else raw


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """JSON source (S2): an array of records (one row per element) or JSON
    lines; nested objects stay structs."""
    if multi_line is None:
        multi_line = _looks_like_array(spark, path)
    return spark.read.option("multiLine", str(multi_line).lower()).json(path)


def _looks_like_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("v")).first()
    return bool(first) and first["v"].startswith("[")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink (S5): header, one file per partition, datetimes to the
    microsecond."""
    df.write.mode(mode).options(header="true", **_CSV_QUOTES, **MICROSECONDS).csv(path)
    return path


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write scored rows (S5) as CSV (default) or parquet."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return path
    return write_csv(df, path)


# ------------------------------------------------------------------ xlsx
#: Rows of a written workbook (a sheet may hold 1,048,576), and of a parsed batch.
WORKBOOK_ROWS, PARSED_ROWS = 50_000, 5_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_rows(data: bytes) -> Iterator[list]:
    """Cell values (as text) of the first worksheet of an xlsx file, row by
    row: the sheet is never held as a tree."""
    m = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in _elements(f, f"{m}si")]
        sheets = sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        wb = ET.fromstring(z.read("xl/workbook.xml")) if "xl/workbook.xml" in names else None
        first = sheets[0]
        if wb is not None and "xl/_rels/workbook.xml.rels" in names:
            sh = wb.find("m:sheets/m:sheet", _NS)
            rid = sh.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels:
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/")
                    first = target if target.startswith("xl/") else "xl/" + target
        with z.open(first) as f:
            for row in _elements(f, f"{m}row"):
                vals: dict = {}
                for c in row.findall("m:c", _NS):
                    t = c.get("t")
                    v = c.find("m:v", _NS)
                    if t == "s" and v is not None:
                        val = shared[int(v.text)]
                    elif t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(f"{m}t"))
                    elif t == "b" and v is not None:
                        val = "true" if v.text == "1" else "false"
                    else:
                        val = v.text if v is not None else None
                    vals[_col_index(c.get("r"))] = val
                width = max(vals) + 1 if vals else 0
                yield [vals.get(i) for i in range(width)]


def _elements(file, tag: str) -> Iterator[ET.Element]:
    """The elements of this tag; what is read is given up at once."""
    held: list = []
    for event, e in ET.iterparse(file, events=("start", "end")):
        if event == "start":
            held.append(e)
            continue
        held.pop()
        if e.tag == tag:
            yield e
            if held:
                held[-1].clear()


def read_workbooks(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Workbook source (S3): every ``.xlsx`` file under ``path``, first sheet,
    first row = header.  One task per file (``binaryFile`` +
    ``mapInPandas``); files must share the header of the first file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx") \
        .option("recursiveFileLookup", "true").load(path)
    def header_of(batches):
        for pdf in batches:
            for content in pdf["content"]:
                first = next(_first_sheet_rows(content), [])
                yield pd.DataFrame({"h": [[None if v is None else str(v) for v in first]]})
    head = files.orderBy("path").limit(1).select("content").mapInPandas(header_of, "h array<string>").first()
    if head is None:
        return spark.createDataFrame([], "_empty string")
    header = [h if h is not None else f"col{i}" for i, h in enumerate(head["h"])]
    schema = ", ".join(f"{quote(h)} string" for h in header)

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = itertools.islice(_first_sheet_rows(content), 1, None)
                while some := [(r + [None] * len(header))[:len(header)] for r in itertools.islice(rows, PARSED_ROWS)]:
                    yield pd.DataFrame(some, columns=header, dtype=object)
    n = max(1, files.count())
    raw = files.select("content").repartition(n).mapInPandas(parse, schema)
    raw = canonicalize_na(raw)
    return infer_types(raw) if infer else raw


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = str(value).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def workbook_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """A minimal one-sheet xlsx (inline strings)."""
    wb = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
          f'<workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
          '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>')
    ctypes = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
              '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
              '<Default Extension="xml" ContentType="application/xml"/>'
              '<Override PartName="/xl/workbook.xml" '
              'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
              '<Override PartName="/xl/worksheets/sheet1.xml" '
              'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
    root_rels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                 '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                 '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
                 'Target="xl/workbook.xml"/></Relationships>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ctypes)
        z.writestr("_rels/.rels", root_rels)
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                         f'<worksheet xmlns="{_NS["m"]}"><sheetData>').encode())
            for ri, r in enumerate(itertools.chain([tuple(columns)], rows), start=1):
                cells = "".join(_cell(f"{_letters(ci)}{ri}", v) for ci, v in enumerate(r))
                sheet.write(f'<row r="{ri}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return buf.getvalue()


def write_workbooks(df: DataFrame, path: str) -> str:
    """Workbooks of up to ``WORKBOOK_ROWS`` rows, written by the tasks that
    hold the rows; a table of more is dealt to as many tasks first."""
    columns = df.columns
    os.makedirs(path, exist_ok=True)
    n = -(-df.count() // WORKBOOK_ROWS)
    if n > df.rdd.getNumPartitions():
        df = df.repartition(n)

    def save(rows):
        name = os.path.join(path, f"part-{uuid.uuid4().hex}.xlsx")
        with open(name, "wb") as fh:
            fh.write(workbook_bytes(columns, rows))
        return pd.DataFrame({"file": [name], "rows": [len(rows)]})

    def write(batches):
        rows = []
        for pdf in batches:
            rows.extend(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None))
            while len(rows) >= WORKBOOK_ROWS:
                yield save(rows[:WORKBOOK_ROWS])
                rows = rows[WORKBOOK_ROWS:]
        if rows:
            yield save(rows)
    df.mapInPandas(write, "file string, rows long").collect()
    return path
