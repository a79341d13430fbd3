"""Queries of the general data problems: units (3) and packed values (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.lineage import written
from bidloom.operators import packed, units
from bidloom.plans.registry import query, read



def common_unit(kind: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for x in ("length", "m", "area", "m²", "volume", "m³", "mass", "kg", "count", "cái")])[kind]



def measured(spark: SparkSession, d: str) -> DataFrame:
    """Quantities and prices of both tables with the unit that each row tells, in one schema; texts are read once."""
    items = read(spark, d, "item_records").filter("bid_quantity is not null").select(
        F.lit("item_records").alias("src"), F.col("item_id").cast("string").alias("row_id"), "unit", F.col("item_name").alias("name"), "note", F.col("bid_quantity").alias("quantity"), F.col("unit_price_total").alias("price"), F.col("source_id").alias("source")
    )
    prices = read(spark, d, "price_references").select(F.lit("price_references"), "ref_id", "unit", "description", F.lit(None).cast("string"), F.lit(None).cast("double"), "price", "source")
    return written(units.read_units(items.union(prices), "unit", "name", "note").drop("note"))


@query()
def p3_units(spark: SparkSession, d: str) -> DataFrame:
    """Every measured row in common units: told by the unit field, by a text, or predicted; uncertain rows are routed for review."""
    rows = measured(spark, d)
    cols = {c: F.col(c) for c in ("quantity", "price", "source", "name")}
    out = units.predict_units(rows, "row_id", cols)
    kind = F.coalesce("kind", F.when(F.col("route") == "convert", F.col("predicted_kind")))
    factor = F.coalesce("factor_micro", F.when(F.col("route") == "convert", F.col("predicted_factor")))
    return out.select(
        "src", "row_id", kind.alias("kind"), common_unit(kind).alias("unit_name"), factor.alias("factor_micro"), (F.col("quantity") * factor / 1e6).alias("common_quantity"),
        F.when(F.col("src") == "price_references", F.col("price") * 1e6 / factor).alias("common_price"), F.coalesce("told_by", "route").alias("told_by"), "confidence",
    )


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows in another unit or package than the common one, or whose unit only a text names; units that the grammar can't read as the classifier says, if it is sure."""
    rows = measured(spark, d)
    out = units.predict_units(rows, "row_id", {c: F.col(c) for c in ("quantity", "price", "source", "name")})
    return found_units(out).select("src", "row_id", common_unit(F.col("kind")).alias("unit_name"), "factor_micro")


def found_units(out: DataFrame) -> DataFrame:
    """The rows of ``predict_units``' output that p3_found names, with the predicted unit where the field names one that wasn't read."""
    told = F.col("told_by")
    unread = told.isNull() & ~units.empty_unit(F.col("unit")) & (F.col("route") == "convert") & F.col("predicted_factor").isNotNull() & (F.col("predicted_factor") != 10**6)
    read_ = F.col("factor_micro").isNotNull() & (told == "text") | (told == "unit") & ~F.col("common") & F.col("factor_micro").isNotNull()
    return out.filter(F.coalesce(read_, F.lit(False)) | F.coalesce(unread, F.lit(False))).withColumns({"kind": F.coalesce("kind", "predicted_kind"), "factor_micro": F.coalesce("factor_micro", "predicted_factor")})


def segmenter(spark: SparkSession, d: str) -> packed.Segmenter:
    return packed.Segmenter(packed.dictionary(read(spark, d, "brand_list"), read(spark, d, "origin_list")))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each brand and origin name of the fields that name two or more."""
    cut = segmenter(spark, d)
    items = read(spark, d, "item_records").select(F.lit("item_records").alias("src"), F.col("item_id").alias("row_id"), F.col("brand").alias("field"))
    asked = read(spark, d, "material_requirements").select(F.lit("material_requirements"), "requirement_id", "requirement_text")
    return packed.split_values(items.union(asked), "field", cut).select("src", "row_id", "list_kind", "value_no", "value_text")
