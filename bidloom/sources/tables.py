"""Tables inside text: HTML and Markdown, as rows of cells; and JSON objects inside free text."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = "array<struct<table_no int, row_no int, cells array<string>>>"


class _Tables(HTMLParser):
    """Top-level tables; the text of a nested table belongs to the cell that holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.depth = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.close_cell()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.close_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif tag in ("br", "td", "th", "tr") and self.cell is not None:
            self.cell.append(" ")

    def close_cell(self):
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self.close_cell()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(html: str | None) -> list[list[list[str]]]:
    """Cells of each top-level table; rows of blanks alone and tables without rows are left out."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    if p.cell is not None:
        p.close_cell()
    return [t for t in ([r for r in t if any(r)] for t in p.tables) if t]


def explode_html(df: DataFrame, column: str) -> DataFrame:
    """One row per table row: the row's columns, table_no, row_no (from 1) and cells."""

    @F.pandas_udf(TABLE_ROWS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"table_no": i, "row_no": j, "cells": r} for i, t in enumerate(html_tables(h), 1) for j, r in enumerate(t, 1)])

    return df.withColumn("__t", F.explode(run.asNondeterministic()(F.col(column)))).select(*[c for c in df.columns if c.lower() not in ("table_no", "row_no", "cells")], "__t.*")


def explode_markdown(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of Markdown tables: key, table_no, row_no, cells. Neighbouring lines with bars make a table; rules go; a table has two rows or more.

    Everything stays in the JVM: lines are numbered, islands of neighbouring table lines get a number."""
    from pyspark.sql.window import Window

    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    rows = lines.filter(F.col("line").rlike(r"^\|.*\|$"))
    w = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("__g", F.col("at") - F.row_number().over(w)).filter(~F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(F.split(F.substring("line", F.lit(2), F.length("line") - 2), r"\|"), lambda c: F.trim(c))
    size = F.count("*").over(Window.partitionBy(key, "__g"))
    rows = rows.select(key, "__g", "at", cells.alias("cells"), size.alias("__n")).filter("__n >= 2")
    return rows.select(key, F.dense_rank().over(Window.partitionBy(key).orderBy("__g")).alias("table_no"), F.row_number().over(Window.partitionBy(key, "__g").orderBy("at")).alias("row_no"), "cells")


def first_json(text: str | None) -> str | None:
    """The first complete JSON object in free text, also inside a code fence; None if there is none."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text[at:])[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_column(column: Column) -> Column:
    """``first_json`` of each value, for ``from_json``."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(first_json)

    return run(column)
