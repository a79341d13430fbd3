"""From sheet rows to line items: header detection, column mapping, row typing. Rows: workbook, sheet, row_number, cells array<string>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions import number, text
from bidloom.operators import ordered

SHEET = ["workbook", "sheet"]
# Fields of a line item and the words, without accents, that a header names them with; the first match wins.
FIELDS = {
    "stt": ["stt", "tt", "no"], "item_code": ["ma hieu", "ma so", "code"], "item_name": ["ten hang muc", "dien giai", "noi dung cong viec", "mo ta", "description"], "unit": ["dvt", "don vi", "unit"],
    "bid_quantity": ["khoi luong nha thau", "kl nha thau", "khoi luong du thau", "nha thau khoi luong"], "reference_quantity": ["khoi luong moi thau", "khoi luong", "quantity", "kl"],
    "unit_price_total": ["don gia tong hop", "don gia", "unit price"], "bid_amount": ["thanh tien", "amount"], "material": ["vat lieu", "material"], "brand": ["thuong hieu", "nhan hieu", "brand"], "origin": ["xuat xu", "origin"], "note": ["ghi chu", "note"],
}
NUMERIC = ["bid_quantity", "reference_quantity", "unit_price_total", "bid_amount"]
#: Sheets that hold no line items.
SKIP = ["tong hop", "bia", "dieu khoan", "cover", "summary"]
DEEP, SEARCH = 3, 60


def clean_header(c: Column) -> Column:
    return F.array_join(F.filter(F.split(text.strip_accents(text.normalize_text(c)), " "), lambda w: w != ""), " ")


def header_candidates(rows: DataFrame, depth: int = DEEP, search: int = SEARCH) -> DataFrame:
    """SRC7, SRC8: for every start row and depth the flattened header: filled to the right, joined downwards without repeats; with its score (SRC9)."""
    cells = rows.filter(F.col("row_number") <= search + depth).select(*SHEET, "row_number", F.posexplode("cells").alias("col", "v"))
    right = Window.partitionBy(*SHEET, "row_number").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.withColumn("v", F.when(F.trim("v") != "", F.trim("v"))).withColumn("carried", F.last("v", ignorenulls=True).over(right))
    spans = filled.select(*SHEET, "row_number", "col", "v", "carried", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("depth"))
    spans = spans.withColumn("start", F.explode(F.sequence(F.col("row_number") - F.col("depth") + 1, F.col("row_number")))).filter(F.col("start").between(1, search))
    top = F.when((F.col("depth") > 1) & (F.col("row_number") < F.col("start") + F.col("depth") - 1), F.col("carried")).otherwise(F.col("v"))
    flat = spans.groupBy(*SHEET, "start", "depth", "col").agg(F.array_sort(F.collect_list(F.struct("row_number", top.alias("v")))).alias("__l"))
    label = F.array_join(F.array_distinct(F.filter(F.transform("__l", lambda x: x["v"]), lambda v: v.isNotNull())), " | ")
    flat = flat.withColumn("header", label).withColumn("clean", clean_header(label)).withColumn("first", F.element_at("__l", 1)["v"])
    hits = F.lit(0)
    for words in FIELDS.values():
        for w in words:
            hits = hits + F.when(F.concat(F.lit(" "), F.col("clean"), F.lit(" ")).contains(f" {w} "), 3).otherwise(0)
    bonus = lambda words, n: F.max(F.when(F.col("clean").rlike(r"\b(" + "|".join(words) + r")\b"), n).otherwise(0))
    return flat.groupBy(*SHEET, "start", "depth").agg(
        (F.sum(hits) + bonus(["stt"], 8) + bonus(FIELDS["item_name"], 8) + bonus(["don gia", "thanh tien"], 6) + F.least(F.count_if(F.col("header") != ""), F.lit(20))).alias("score"),
        F.count_if(F.col("first") != "").alias("filled"), F.map_from_entries(F.collect_list(F.struct("col", F.col("header")))).alias("headers"),
    ).filter("filled >= 2")


def detect_headers(rows: DataFrame, least: int = 16) -> DataFrame:
    """One header per sheet: the best score of at least ``least``; ties go to the flatter, then to the earlier one."""
    best = F.max_by(F.struct("start", "depth", "headers", "score"), F.struct(F.col("score"), -F.col("depth"), -F.col("start")))
    return header_candidates(rows).filter(F.col("score") >= least).groupBy(*SHEET).agg(best.alias("h")).select(*SHEET, "h.*")


def map_columns(headers: DataFrame) -> DataFrame:
    """SRC10: (workbook, sheet, field, col): per column the field whose word it names earliest in the rules and best; every field and every column once."""
    cols = headers.select(*SHEET, F.explode("headers").alias("col", "header")).withColumn("clean", clean_header(F.col("header")))
    rules = [F.struct(F.lit(f).alias("field"), F.lit(100 - 10 * i).alias("rank"), F.lit(w).alias("word")) for f, ws in FIELDS.items() for i, w in enumerate(ws)]
    hits = cols.withColumn("r", F.explode(F.array(*rules))).filter(F.concat(F.lit(" "), "clean", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("r.word"), F.lit(" "))))
    hits = hits.select(*SHEET, "col", "r.field", (F.col("r.rank") + F.length("r.word")).alias("rank"))
    by_col = Window.partitionBy(*SHEET, "col").orderBy(F.desc("rank"), "field")
    by_field = Window.partitionBy(*SHEET, "field").orderBy(F.desc("rank"), "col")
    return hits.withColumn("n", F.row_number().over(by_col)).filter("n = 1").withColumn("n", F.row_number().over(by_field)).filter("n = 1").drop("n", "rank")


def technical_columns(headers: DataFrame, mapped: DataFrame, words: list[str]) -> DataFrame:
    """SRC11: headers that no field took and that hold one of the words."""
    cols = headers.select(*SHEET, F.explode("headers").alias("col", "header"))
    free = cols.join(mapped.select(*SHEET, "col"), [*SHEET, "col"], "left_anti")
    return free.filter(clean_header(F.col("header")).rlike("|".join(words)))


def line_items(rows: DataFrame, blanks: int = 250) -> DataFrame:
    """SRC12: typed line items of every sheet that has a header: fields, numbers, row type, section path; legend and blank rows go."""
    rows = rows.filter(~clean_header(F.col("sheet")).isin(SKIP))
    headers = detect_headers(rows)
    fields = map_columns(headers).groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("field", "col"))).alias("at"))
    body = rows.join(headers.select(*SHEET, (F.col("start") + F.col("depth")).alias("body")), SHEET).filter(F.col("row_number") >= F.col("body")).join(fields, SHEET).filter(~ordered.is_legend(F.col("cells")))
    value = lambda f: F.when(F.trim(F.get("cells", F.col("at")[f])) != "", F.trim(F.get("cells", F.col("at")[f])))
    items = body.select(*SHEET, "row_number", *[(number.parse_number(value(f)) if f in NUMERIC else value(f)).alias(f) for f in FIELDS])
    kind = ordered.row_kind(F.col("item_name"), F.col("stt"), F.col("unit"), *[F.col(f) for f in NUMERIC])
    items = items.withColumn("row_type", kind).filter(F.coalesce("item_name", "item_code", "stt").isNotNull())
    items = ordered.before_number_gap(items.filter(F.coalesce("item_name", "item_code").isNotNull()), SHEET, "row_number", blanks)
    level = F.when(F.col("row_type") == "group", F.when(F.col("stt").rlike("^[A-Za-z]$"), 0).when(F.col("stt").rlike("^[IVXLC]+$"), 1).when(F.col("stt").rlike(r"^\d+(\.\d+)*$"), F.least(F.size(F.split("stt", r"\.")) + 1, F.lit(5))).otherwise(3))
    return ordered.section_path(items, SHEET, "row_number", level, F.col("item_name"))
