"""Queries pN_ of the text problems, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.lineage import written
from bidloom.llm import abuse, canonical, garbled, leaks, lookalike, packing, products
from bidloom.operators import packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def damaged_fields(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, field_name, text) of the fields that problem 2 is about."""
    items = read(spark, d, "item_records").select(F.lit("item_records").alias("src"), F.col("item_id").alias("row_id"), F.lit("item_name").alias("field_name"), F.col("item_name").alias("text"))
    asked = read(spark, d, "material_requirements").select(F.lit("material_requirements"), "requirement_id", F.lit("requirement_text"), "requirement_text")
    return items.union(asked)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = damaged_fields(spark, d)
    return garbled.damaged(fields, "text", garbled.fit(fields)).select("src", "row_id", "field_name")


@query
def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    fields = damaged_fields(spark, d)
    return garbled.damaged(fields, "text", garbled.fit(fields)).select("src", "row_id", "field_name", "restored", "damage")


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, field_name, value_no, value, list_kind) of every non-blank brand and origin typed in a field or an array; each table is read once."""
    one = lambda c: F.array(F.struct(F.lit(c).alias("field_name"), F.lit(1).alias("value_no"), F.col(c).alias("value"), F.lit(c).alias("list_kind")))
    several = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(c).alias("field_name"), (i + 1).alias("value_no"), v.alias("value"), F.lit(c[8:-1]).alias("list_kind")))
    items = read(spark, d, "item_records").select(F.lit("item_records").alias("src"), F.col("item_id").alias("row_id"), F.explode(F.concat(one("brand"), one("origin"))).alias("v"))
    asked = read(spark, d, "material_requirements").select(F.lit("material_requirements"), "requirement_id", F.explode(F.concat(several("allowed_brands"), several("allowed_origins"))))
    return items.union(asked).select("src", "row_id", "v.*").filter(F.col("value").rlike(r"[^\s ]"))


def mappers(spark: SparkSession, d: str) -> tuple[canonical.Mapper, canonical.Mapper]:
    """Mappers over the two list tables, whose size is checked before they are collected."""
    brands, origins = (read(spark, d, t).limit(packed.MOST_ENTRIES + 1).collect() for t in ("brand_list", "origin_list"))
    if max(len(brands), len(origins)) > packed.MOST_ENTRIES:
        raise ValueError(f"a list of more than {packed.MOST_ENTRIES} entries can't be shipped to every executor")
    return canonical.brand_mapper([(r.brand_id, r.brand_name) for r in brands]), canonical.origin_mapper([(r.origin_id, r.origin_name, r.english_name, r.iso_code) for r in origins])


def mapped_values(spark: SparkSession, d: str) -> DataFrame:
    """Every typed value with the id of its entry; packed brand fields are left to problem 6."""
    brands, origins = mappers(spark, d)
    names = [("brand", n) for _, n in brands.args[0]] + [("origin", n) for _, n in origins.args[0]]
    cut = packed.Segmenter(names)
    exact = {n for _, n in brands.args[0]} | origins.canonical
    got = typed_values(spark, d).withColumn("got", canonical.map_values(F.col("field_name"), F.col("value"), {"brand": brands, "origin": origins, "allowed_brands": brands, "allowed_origins": origins}, exact, lambda v: len(cut.split(v)) >= 2, "brand"))
    return got.filter("not got.packed").select("src", "row_id", "field_name", "value_no", "value", "list_kind", "got.exact", "got.list_id")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped_values(spark, d).filter("not exact").select("src", "row_id", "field_name", "value_no", "list_id")


@query
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, with the number of places where they stand."""
    return mapped_values(spark, d).filter("list_id = -1").groupBy("list_kind", "value").agg(F.count("*").alias("places"))


def look_fields(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, field_name, text) of the fields that problem 4 is about."""
    items = read(spark, d, "item_records")
    parts = [items.select(F.lit("item_records").alias("src"), F.col("item_id").cast("string").alias("row_id"), F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("item_name", "unit")]
    prices = read(spark, d, "price_references").select(F.lit("price_references"), "ref_id", F.lit("description"), "description")
    return parts[0].union(parts[1]).union(prices)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    repairer = garbled.fit(damaged_fields(spark, d))
    fields, can_be_damaged = look_fields(spark, d), F.col("field_name") == "item_name"
    found = lookalike.disguised(fields.filter(can_be_damaged), "text", lambda t: repairer.repair(t) is None)
    return found.union(lookalike.disguised(fields.filter(~can_be_damaged), "text")).select("src", "row_id", "field_name")


@query
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Different originals with one look, per field: the consistent form, the number of spellings and of rows."""
    return lookalike.look_alikes(look_fields(spark, d), "text", "field_name")


def product_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").filter("row_type = 'detail'")
    return products.grouped(rows, "item_id", "item_name", "material", "item_code", "bidder")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return products.pairs(product_groups(spark, d).filter("bidder is not null"), "item_id", "bidder")


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per listing with its product."""
    return product_groups(spark, d).select("item_id", "product")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    tests = leaks.index(read(spark, d, "test_items"), "test_id", "text")
    return leaks.leaks(read(spark, d, "documents"), "doc_id", "text", tests).select("doc_id", "test_id")


@query
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without leaks."""
    tests = leaks.index(read(spark, d, "test_items"), "test_id", "text")
    return leaks.without_leaks(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", tests).select("doc_id")


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container, document and piece number of every text."""
    sizes = written(packing.token_counts(read(spark, d, "documents"), "doc_id", "text"))
    return packing.fill(sizes, "doc_id").select("container", "doc_id", "piece_no", "n_tokens")


def abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    scorer = abuse.fit(documents, "doc_id", "text", read(spark, d, "review_marks"), "doc_id", "verdict")
    return abuse.scores(documents, "doc_id", "text", scorer, "source")


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(spark, d).filter(F.col("score") >= abuse.FOUND).select("doc_id")


@query
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(spark, d)


@query
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of abusive documents per source."""
    bad = F.col("score") >= abuse.FOUND
    return abuse_scores(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(bad).alias("abusive"), F.avg("score").alias("mean_score")).withColumn("rate", F.col("abusive") / F.col("documents"))
