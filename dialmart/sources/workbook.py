"""Spreadsheets (.xlsx) as a data source: one row for each row of each sheet, cells as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Bytes that a sheet may unpack to.
MOST = 512 << 20


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        if any(f.file_size > MOST for f in book.infolist()):
            raise ValueError("a part of the workbook unpacks to too much")
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in root.iter(_MAIN + "si")]
        titles = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
        for i, title in enumerate(titles, 1):
            with book.open(f"xl/worksheets/sheet{i}.xml") as part:
                for _, row in ElementTree.iterparse(part):
                    if row.tag != _MAIN + "row":
                        continue
                    cells: dict[int, str | None] = {}
                    for k, c in enumerate(row.iter(_MAIN + "c")):
                        at = _column(c.get("r")) if c.get("r") else k
                        value = c.findtext(_MAIN + "v")
                        if c.get("t") == "s" and value is not None:
                            value = shared[int(value)]
                        elif c.get("t") == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                        cells[at] = value
                    yield title, int(row.get("r") or 0), [cells.get(j) for j in range(max(cells, default=-1) + 1)]
                    row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_no and cells (array<string>) of the workbooks below path."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *r) for r in sheet_rows(bytes(raw))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row_no long, cells array<string>")


def handoff_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """interactions, files and messages of a hand-off workbook, told apart by their cells, in any order.

    Messages have six cells and a UM- and a COR- id, files two, interactions the rest.
    """
    c = lambda i: F.trim(F.get("cells", F.lit(i)))
    message = c(0).rlike("(?i)^UM-") & c(1).rlike("(?i)^COR-")
    file = (F.size(F.filter("cells", lambda x: x.isNotNull())) == 2) & c(1).rlike(r"(?i)\.(wav|mp3|nmf)$")
    contact = c(4).isNotNull() & c(2).isNotNull() & ~message & c(2).rlike("[0-9]")
    return {
        "messages": rows.where(message).select(*[c(i).alias(n) for i, n in enumerate(["message_id", "correspondence_id", "sent_at", "direction", "subject", "body"])]),
        "files": rows.where(file & ~message).select(c(0).alias("call_id"), c(1).alias("file_name")),
        "interactions": rows.where(contact).select(
            c(0).alias("first_at"), c(1).alias("branch"), c(2).alias("account"), c(3).alias("started_at"), F.lower(c(4)).alias("interaction_id"), c(6).alias("declared"), F.lower(c(7)).alias("file_name")
        ),
    }
