"""Uploaded files: CSV with a sniffed delimiter, XLSX and DOCX through Spark's binary reader."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"
MAX_ROWS, MAX_COLUMNS, MAX_BYTES = 10_000, 200, 20 << 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_kind(name: str, head: bytes) -> str:
    """Magic bytes beat the name; old Word files and PDFs that are none are refused."""
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        ext = name.lower().rpartition(".")[2]
        if ext in ("docx", "xlsx"):
            return ext
        raise ValueError("unsupported archive")
    ext = name.lower().rpartition(".")[2]
    if ext in ("pdf", "doc", "docx", "xlsx"):
        raise ValueError(f"not a real {ext} file")
    return "csv" if ext == "csv" else "text"


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def sniff_delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:8192], DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_sheet(name: str, data: bytes) -> tuple[list[str], list[dict[str, str | None]]]:
    """(headers, rows as text); blank rows and nameless columns go.  For one bounded upload."""
    if file_kind(name, data[:8]) == "xlsx":
        table = xlsx_rows(data)
    else:
        text = decode(data)
        table = list(csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text)))
    head = [(h or "").strip() for h in (table[0] if table else [])]
    rows = []
    for r in table[1:]:
        row = {h: (r[i] if i < len(r) else None) for i, h in enumerate(head) if h}
        if any((v or "").strip() for v in row.values()):
            rows.append(row)
    headers = [h for h in head if h]
    if not headers or not rows or len(headers) > MAX_COLUMNS or len(rows) > MAX_ROWS:
        raise ValueError("a sheet needs 1 to 200 columns and 1 to 10000 rows")
    return headers, rows


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every byte of a text file is UTF-8: Spark keeps a line's bytes as they are, so all lines are judged, where they lie."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def _in_file_order(rows: DataFrame, block: str) -> DataFrame:
    """``rows`` with ``row_number`` from 1: counts of the file's blocks before, and the place inside the block."""
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    sizes = marked.groupBy(block).agg(F.count(F.lit(1)).alias("__n"))  # a row a block of the file
    before = sizes.select(F.col(block).alias("__block"), F.coalesce(F.sum("__n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = marked.withColumn("__place", F.row_number().over(Window.partitionBy(block).orderBy("__id")))
    met = inside.join(F.broadcast(before), inside[block] == before["__block"])
    return met.select((F.col("__before") + F.col("__place")).cast("long").alias("row_number"), *(F.col(f"`{c}`") for c in rows.columns if c != block))


def read_table(spark: SparkSession, path: str, max_rows: int | None = MAX_ROWS, multiline: bool = False) -> DataFrame:
    """The rows of one .csv, .txt or .xlsx file as text, numbered from 1 (``row_number``) in file order; blank rows and nameless columns go.

    CSV is read by Spark in as many parts as it has (one, if ``multiline``): UTF-8 if the whole file is, else latin-1; its
    first lines give the delimiter.  A workbook is one executor's.  Raises ValueError for a sheet without columns or rows, with more than
    200 columns or, unless that is None, with more than ``max_rows`` rows.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "xlsx":
        book = spark.read.format("binaryFile").load(path).select("content")
        cells = lambda frames: (pd.DataFrame({"row_number": range(len(r)), "cells": r}) for f in frames for d in f["content"] for r in [xlsx_rows(bytes(d))])
        table = book.mapInPandas(cells, "row_number long, cells array<string>")
        first = table.orderBy("row_number").first()
        head = [(h or "").strip() for h in (first["cells"] if first else [])]
        rows = table.where(F.col("row_number") > (first["row_number"] if first else 0)).select(F.lit(0).alias("__at"), *(F.try_element_at("cells", F.lit(i + 1)).alias(h) for i, h in enumerate(head) if h))
    elif kind in ("csv", "txt"):
        lines = [r[0] for r in spark.read.text(path).limit(50).collect()]
        encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
        raw = spark.read.csv(path, header=True, sep=sniff_delimiter("\n".join(lines).lstrip("\ufeff")), encoding=encoding, inferSchema=False, multiLine=multiline, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        named = [(c, c.lstrip("\ufeff").removeprefix("\u00ef\u00bb\u00bf").strip()) for c in raw.columns if c.strip() and not re.fullmatch(r"_c\d+", c)]
        rows = raw.select(F.col("_metadata.file_block_start").alias("__at"), *(F.col(f"`{c}`").alias(h) for c, h in named))
    else:
        raise ValueError("a sheet is a .xlsx, .csv or .txt file")
    heads = [c for c in rows.columns if c != "__at"]
    if not heads or len(heads) > MAX_COLUMNS:
        raise ValueError(f"a sheet needs 1 to {MAX_COLUMNS} columns")
    filled = F.lit(False)
    for h in heads:
        filled = filled | (F.trim(F.coalesce(F.col(f"`{h}`"), F.lit(""))) != "")
    rows = rows.where(filled)
    n = rows.limit(max_rows + 1).count() if max_rows is not None else int(not rows.isEmpty())
    if not n or (max_rows is not None and n > max_rows):
        raise ValueError(f"a sheet needs 1 to {max_rows} rows")
    return _in_file_order(rows, "__at")


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (at - 1 - len(cells))
                value = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            out.append(cells)
        return out


def docx_text(data: bytes) -> str:
    """Paragraphs in body order; headings get a mark, table rows are joined by bars with repeated cells once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = []
    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and style.get(f"{_W}val", "").lower().startswith("heading")
            lines.append(("# " if heading and text(e) else "") + text(e))
        elif e.tag == f"{_W}tbl":
            for row in e.iter(f"{_W}tr"):
                cells = [text(c).strip() for c in row.iter(f"{_W}tc")]
                lines.append(" | ".join(c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]))
    return "\n\n".join(x for x in lines if x.strip())


def extracted(found: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, kind, text, error, and what else ``found`` has) of files (path, length, content); each executor reads its own files.

    A file over ``max_bytes``, of an unknown kind, or with too little text has an error and no text.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data, size in zip(f["path"], f["content"], f["length"], strict=True):
                kind, text, error = None, None, None
                try:
                    if size > max_bytes:
                        raise ValueError("file too large")
                    kind = file_kind(p, bytes(data[:8]))
                    if kind == "pdf":
                        raise ValueError("no PDF reader is installed")
                    if kind == "text" and b"\0" in data[:8192]:
                        raise ValueError("binary content")
                    text = docx_text(data) if kind == "docx" else "\n".join("\t".join(c or "" for c in r) for r in xlsx_rows(data)) if kind == "xlsx" else decode(data)
                    if len(text) < 80:
                        raise ValueError("too little text")
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as x:
                    text, error = None, str(x) or type(x).__name__
                rows.append((kind, text, error))
            out = f.drop(columns=["content", "length"])
            yield out.assign(**dict(zip(("kind", "text", "error"), map(list, zip(*rows, strict=True)) if rows else ([], [], []), strict=True)))

    slim = found.withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.lit(b"")))
    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in found.schema if x.name not in ("content", "length"))
    return slim.mapInPandas(extract, f"{kept}, kind string, text string, error string")


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, kind, text, error) of the files under ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extracted(found.select("path", "length", "content"), max_bytes)
