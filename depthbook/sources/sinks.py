"""Sinks: CSV, Parquet and XLSX of a book or a series."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV parts with headers; `single` makes one file of a bounded table.

    The one file is made by one task and moved by the driver, so it is for local paths.
    """
    if not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    with tempfile.TemporaryDirectory() as folder:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"file://{folder}/out")
        part = next(p for p in os.listdir(f"{folder}/out") if p.startswith("part-"))
        shutil.move(f"{folder}/out/{part}", path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


#: Rows of one sheet; the format has no more.
SHEET_ROWS = 1_048_575

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
_BOOK_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    # a sheet's numbers are doubles: wider integers, and what is no number, are text
    if isinstance(value, (int, float)) and value == value and abs(value) < 2**53:
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet, streamed through the driver row by row; more rows than a sheet holds
    are an error, found before anything is written."""
    if (n := df.count()) > SHEET_ROWS:
        raise ValueError(f"{n} rows; a sheet holds {SHEET_ROWS}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _BOOK_RELS)):
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for row in [df.columns]:
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            for row in df.toLocalIterator():
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")


def to_pandas(df: DataFrame):
    return df.toPandas()


def to_numpy(df: DataFrame, numeric: bool = False):
    """The rows as an array; floats with `numeric`, else objects; empty keeps its width."""
    import numpy as np

    rows = [tuple(r) for r in df.collect()]
    return np.array(rows, dtype=float if numeric else object).reshape(len(rows), len(df.columns))


__all__ = ["to_numpy", "to_pandas", "write_csv", "write_parquet", "write_xlsx"]
