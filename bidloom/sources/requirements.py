"""Two more sheet layouts: lists of material requirements, and historical quotes with columns at fixed distances from an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import number, text
from bidloom.sources.sheets import SHEET, clean_header

# Words, without accents, that name the columns.
ITEM, ASKED, NOTE, ORDINAL = ["vat tu", "hang muc", "ten vat tu"], ["thuong hieu", "xuat xu", "yeu cau"], ["ghi chu"], ["stt", "tt"]
ANCHOR, QUANTITY = "thanh tien boq", "kl nha thau"


def _cells(rows: DataFrame, search: int) -> DataFrame:
    return rows.filter(F.col("row_number") <= search).select(*SHEET, "row_number", F.posexplode("cells").alias("col", "v")).withColumn("clean", F.concat(F.lit(" "), clean_header(F.col("v")), F.lit(" ")))


def _names(words: list[str]) -> Column:
    return F.col("clean").rlike(" (" + "|".join(words) + ") ")


def requirement_headers(rows: DataFrame, search: int = 40) -> DataFrame:
    """SRC15: the first row of each sheet that names both an item and a requirement column, with the columns' places."""
    c = _cells(rows, search)
    first = lambda words: F.min(F.when(_names(words), F.col("col")))
    found = c.groupBy(*SHEET, "row_number").agg(first(ITEM).alias("item_at"), first(ASKED).alias("asked_at"), first(NOTE).alias("note_at"), first(ORDINAL).alias("ordinal_at")).filter("item_at is not null and asked_at is not null and item_at <> asked_at")
    return found.withColumn("n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_number"))).filter("n = 1").drop("n").withColumnRenamed("row_number", "header_row")


def requirements(rows: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """SRC16: requirement rows with their system heading carried down, brands and origins split; only sheets whose name holds a keyword, if any are given."""
    if keywords:
        rows = rows.filter(clean_header(F.col("sheet")).rlike("|".join(keywords)))
    body = rows.join(requirement_headers(rows), SHEET).filter("row_number > header_row")
    at = lambda c: F.when(F.trim(F.get("cells", F.col(c))) != "", F.trim(F.get("cells", F.col(c))))
    r = body.select(*SHEET, "row_number", at("item_at").alias("item_name"), at("asked_at").alias("requirement_text"), at("note_at").alias("note")).filter("item_name is not null")
    heading = F.col("requirement_text").isNull() & clean_header(F.col("item_name")).startswith("he thong")
    w = Window.partitionBy(*SHEET).orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("system", F.last(F.when(heading, F.col("item_name")), ignorenulls=True).over(w)).filter("requirement_text is not null")
    parts = text.split_requirement(F.col("requirement_text"))
    return r.select(*SHEET, "row_number", "system", "item_name", "requirement_text", parts["brands"].alias("allowed_brands"), parts["origins"].alias("allowed_origins"), "note", text.normalize_name(F.col("item_name")).alias("normalized_name"))


def quote_layouts(rows: DataFrame, search: int = 12) -> DataFrame:
    """SRC17: per sheet the row and columns of the two anchors, found in the first rows."""
    c = _cells(rows, search)
    one = lambda word: F.min(F.when(F.col("clean").contains(f" {word} "), F.struct("row_number", "col")))
    return c.groupBy(*SHEET).agg(one(ANCHOR).alias("amount"), one(QUANTITY).alias("quantity")).filter("amount is not null and quantity is not null").select(*SHEET, F.greatest("amount.row_number", "quantity.row_number").alias("header_row"), F.col("amount.col").alias("amount_at"), F.col("quantity.col").alias("quantity_at"))


def historical_quotes(rows: DataFrame) -> DataFrame:
    """SRC17, P11: priced detail rows: name and unit from the left, material, model, brand and origin right of the bidder's quantity, prices left of the amount."""
    body = rows.join(quote_layouts(rows), SHEET).filter("row_number > header_row")
    cell = lambda i: F.trim(F.get("cells", i if isinstance(i, Column) else F.lit(i)))
    q, a = F.col("quantity_at"), F.col("amount_at")
    r = body.select(
        *SHEET, "row_number", cell(1).alias("description"), cell(2).alias("unit"), number.parse_number(cell(q)).alias("quantity"), cell(q + 1).alias("material"), cell(q + 2).alias("model"), cell(q + 3).alias("brand"), cell(q + 4).alias("origin"),
        number.parse_number(cell(a - 1)).alias("price"), number.parse_number(cell(a)).alias("amount"),
    )
    title = (F.upper("description") == F.col("description")) & (F.length("description") < 40)
    keep = (F.col("price") > 0) & (F.coalesce("description", F.lit("")) != "") & (F.coalesce("unit", F.lit("")) != "") & (F.length(text.normalize_name(F.col("description"))) >= 3) & ~title
    r = r.filter(keep).withColumn("ref_id", text.stable_id("HQ-", *[F.col(c) for c in (*SHEET, "row_number")]))
    return r.withColumn("out_of_range", (F.col("price") <= 500) | (F.col("price") >= 5e9))
