"""File sources: text, DOCX, XLSX, PPTX, PDF (if a PDF library is there), HTML, JSON, Markdown.

Files are read by Spark as binary rows (path, content), so any store Spark reads will do, and parsed on
Arrow batches. Each reader yields rows; nothing is gathered on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Kinds of files by extension; any other is text.
KINDS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".txt": "text", ".md": "text", ".xlsx": "excel", ".xls": "excel"}
# Encodings in the order they are tried.
CODECS = ("utf-8", "gbk", "gb2312", "utf-16")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit("text")
    for e, k in KINDS.items():
        out = F.when(ext == e, F.lit(k)).otherwise(out)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, file_type, content) of the files under a path or pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), kind(F.col("path")).alias("file_type"), "content")


def decode_bytes(data: bytes | None) -> str:
    """Text by the first codec that takes all bytes, else UTF-8 without what it can't read."""
    data = bytes(data or b"")
    for codec in CODECS:
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


@F.pandas_udf(StringType())
def decode(contents: pd.Series) -> pd.Series:
    return contents.map(decode_bytes)


def text(content: Column) -> Column:
    """Decoded text; valid UTF-8 never leaves the JVM's own decoder for its value."""
    return F.coalesce(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")), decode(content))


def docx_parts(data: bytes) -> tuple[list[tuple[str, str]], list[str]]:
    """(paragraphs as (text, style), tables as text with column numbers for a header)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    paragraphs, tables = [], []
    for e in body:
        if e.tag == f"{_W}p" and said(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val") if style is not None else "Normal"
            paragraphs.append((said(e).strip(), styles.get(name, name)))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(said(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if rows:
                wide = max(map(len, rows))
                lines = [[str(i) for i in range(wide)], ["---"] * wide, *[r + ["None"] * (wide - len(r)) for r in rows]]
                tables.append("\n".join(" | ".join(r) for r in lines))
    return paragraphs, tables


def xlsx_rows(data: bytes) -> list[str]:
    """`name：value` lines of all sheets, the first row naming the columns; empty, 0 and false cells are left out."""
    if not data.startswith(b"PK"):
        raise ValueError("not an XLSX file")
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links.get(sheet.get(f"{_R}id"), f"worksheets/sheet{sheet.get('sheetId')}.xml")
            grid = []
            for row in ElementTree.fromstring(z.read(f"xl/{target.removeprefix('/xl/')}")).iter(f"{_S}row"):
                cells = {}
                for i, c in enumerate(row.findall(f"{_S}c")):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                    v, how = c.find(f"{_S}v"), c.get("t")
                    if how == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if how == "s" else v.text if how in ("str", "e") else {"1": "True", "0": ""}[v.text] if how == "b" else "" if float(v.text) == 0 else v.text
                grid.append(cells)
            head = grid[0] if grid else {}
            out += ["; ".join((f"{head[i]}：" if head.get(i) else "") + x for i, x in sorted(r.items()) if x) for r in grid[1:]]
    return out


def pptx_slides(data: bytes) -> list[str]:
    """Text of each slide, shapes from top to bottom (in tens of points) and left to right; tables as `head: value` lines."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for name in slides:
            shapes = []
            for e in ElementTree.fromstring(z.read(name)).iter():
                if e.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                    continue
                off = next(e.iter(f"{_A}off"), None)
                place = (int(off.get("y")) // 127000, int(off.get("x"))) if off is not None else (0, 0)
                rows = [["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.iter(f"{_A}tc")] for r in e.iter(f"{_A}tr")]
                if rows:
                    said = "\n".join("; ".join(f"{h}: {x}" for h, x in zip(rows[0], r, strict=False) if x) for r in rows[1:])
                else:
                    said = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in e.iter(f"{_A}p"))
                if said.strip():
                    shapes.append((place, said))
            out.append("\n".join(s for _, s in sorted(shapes)))
    return out


def pdf_pages(data: bytes, from_page: int = 0, to_page: int = 100_000) -> list[str]:
    """Text of each page, by whichever PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs a PDF library (pypdf)") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages[from_page:to_page]]


def load(files: DataFrame, from_page: int = 0, to_page: int = 100_000) -> DataFrame:
    """(path, file_name, file_type, page_num, text, tables, error) with a row for each page.

    A file that can't be read gives one row with its error, so that the others are.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                data, error, tables = bytes(r.content or b""), None, []
                try:
                    if r.file_type == "pdf":
                        pages = pdf_pages(data, from_page, to_page)
                    elif r.file_type == "docx":
                        paragraphs, tables = docx_parts(data)
                        pages = ["\n".join(t for t, _ in paragraphs)]
                    elif r.file_type == "excel":
                        pages = ["\n".join(xlsx_rows(data))]
                    else:
                        pages = [decode_bytes(data)]
                except Exception as e:  # one bad file must not end the job
                    pages, error = [None], str(e)
                out += [(r.path, r.file_name, r.file_type, from_page + i + 1, t, tables if i == 0 else [], error) for i, t in enumerate(pages)]
            yield pd.DataFrame(out, columns=["path", "file_name", "file_type", "page_num", "text", "tables", "error"])

    return files.mapInPandas(run, "path string, file_name string, file_type string, page_num int, text string, tables array<string>, error string")


def quick(loaded: DataFrame, most_pages: int = 4) -> DataFrame:
    """Files of at most so many pages, cleaned."""
    from pyspark.sql import Window

    from lectern.functions import text as T

    pages = F.max("page_num").over(Window.partitionBy("path"))
    return loaded.withColumn("__n", pages).where((F.col("file_type") != "pdf") | (F.col("__n") <= most_pages)).withColumn("text", T.clean_text(F.col("text"))).drop("__n")
