"""The relational tail of reading scanned tables: which candidate readings fit together, and how sure a document is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.operators.peers import first_per_key

#: Candidates per cell that may be combined, and the share of the weights.
CANDIDATES = 5


def reconcile(candidates: DataFrame, record: str, tolerance: float = 0.01) -> DataFrame:
    """For each record the quantity, price and amount, among its candidates, whose product fits best.

    ``candidates``: (record, field 'q'|'p'|'a', value, confidence). At most ``CANDIDATES`` of each field, the surest first, so
    at most 125 combinations per record. Least of 5 * error + 0.15 * mean doubt wins; it is accepted up to max(2 * tolerance, 0.015)."""
    surest = lambda f: F.slice(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct(F.col("confidence").alias("c"), F.col("value").alias("v")))), asc=False), 1, CANDIDATES)
    sides = candidates.filter("value is not null").groupBy(record).agg(*[surest(f).alias(f) for f in ("q", "p", "a")])
    rows = sides.select(record, F.explode("q").alias("q"), "p", "a").select(record, "q", F.explode("p").alias("p"), "a").select(record, "q", "p", F.explode("a").alias("a"))
    made = F.col("q.v") * F.col("p.v")
    error = F.abs(made - F.col("a.v")) / F.greatest(F.abs(made), F.abs("a.v"), F.lit(1.0))
    rows = rows.withColumn("error", error).withColumn("cost", 5 * error + 0.15 * (1 - (F.col("q.c") + F.col("p.c") + F.col("a.c")) / 3))
    out = first_per_key(rows, [record], F.col("cost"), F.col("q.v"), F.col("p.v"), F.col("a.v"))
    return out.select(record, F.col("q.v").alias("quantity"), F.col("p.v").alias("price"), F.col("a.v").alias("amount"), "error", (F.col("error") <= max(2 * tolerance, 0.015)).alias("accepted"))


def second_opinion(cells: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell with another model's reading of it: agreed, only one of them, or the surer one."""
    o = others.select(*keys, F.col("text").alias("other"), F.col("confidence").alias("other_confidence"))
    j = cells.join(o, keys, "left")
    same = F.lower(F.trim("text")) == F.lower(F.trim("other"))
    state = F.when(F.col("other").isNull(), "single").when(same, "agreed").when(F.col("other_confidence") > F.col("confidence"), "replaced").otherwise("kept")
    return j.select(*keys, F.when(state == "replaced", F.col("other")).otherwise(F.col("text")).alias("text"), state.alias("state"), F.when(state == "agreed", F.greatest("confidence", "other_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def document_summary(cells: DataFrame, by: str, text_least: float = 0.82, number_least: float = 0.9) -> DataFrame:
    """Cells, blanks, doubtful ones and mean confidence per document; numbers need more confidence than texts."""
    doubt = F.col("confidence") < F.when(F.col("text").rlike(r"^[\d.,\s()+-]+$"), number_least).otherwise(text_least)
    return cells.groupBy(by).agg(F.count("*").alias("cells"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), F.count_if(doubt).alias("doubtful"), F.avg("confidence").alias("mean_confidence"))


def merge_boxes(boxes: DataFrame, page: str, overlap: float = 0.6, least_gap: float = 20.0, share: float = 0.025) -> DataFrame:
    """Boxes (page, x0, y0, x1, y1, height of the page) that stand over each other in one column become one: (page, x0, y0, x1, y1, n).

    Per page, from top to bottom: a box joins the lowest one so far that it overlaps sideways by the share of the narrower
    and from whose foot it is no farther than the gap. Pages are groups; a page's boxes are few."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for x0, y0, x1, y1, h in pdf.sort_values(["y0", "x0"])[["x0", "y0", "x1", "y1", "height"]].itertuples(index=False):
            gap = max(least_gap, share * h)
            for b in reversed(out):
                side = min(x1, b[2]) - max(x0, b[0])
                if side >= overlap * min(x1 - x0, b[2] - b[0]) and y0 - b[3] <= gap:
                    b[0], b[1], b[2], b[3], b[4] = min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1), b[4] + 1
                    break
            else:
                out.append([x0, y0, x1, y1, 1])
        return pd.DataFrame([[pdf[page].iloc[0], *b] for b in out], columns=[page, "x0", "y0", "x1", "y1", "n"])

    kind = dict(boxes.dtypes)[page]
    return boxes.groupBy(page).applyInPandas(fold, f"{page} {kind}, x0 double, y0 double, x1 double, y1 double, n int")


def assign_fields(scores: DataFrame, table: str) -> DataFrame:
    """C20: (table, col, field): every column and every field once, best score first, then the leftmost column."""
    from bidloom.operators.matching import assign_one_to_one

    ids = scores.withColumn("c", F.concat_ws(":", table, "col")).withColumn("f", F.concat_ws(":", table, "field")).withColumn("minus", -F.col("score"))
    got = assign_one_to_one(ids.select("c", "f", "minus", "col", table, "field"), "c", "f", ["minus", "col"])
    return got.select(table, "col", "field")


def assemble_rows(cells: DataFrame, by: list[str], fields: list[str], numeric: list[str], required: list[str]) -> DataFrame:
    """C17: cells (by…, field, text, confidence) as one row per line: fields, parsed numbers, least confidence and flags for what is missing or unreadable."""
    from bidloom.functions.number import parse_number

    wide = cells.groupBy(*by).pivot("field", fields).agg(F.max_by("text", "confidence"))
    sure = cells.groupBy(*by).agg(F.min("confidence").alias("least_confidence"))
    flags = [F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f"missing {f}")) for f in required] + [F.when((F.trim(f) != "") & parse_number(F.col(f)).isNull(), F.lit(f"unreadable {f}")) for f in numeric]
    out = wide.withColumn("flags", F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>"))
    return out.withColumns({f: parse_number(F.col(f)) for f in numeric}).join(sure, by)
