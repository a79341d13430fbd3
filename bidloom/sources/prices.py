"""Price references as CSV: known columns typed, every other column kept in a metadata map; and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.number import parse_number
from bidloom.functions.text import safe_cell

KNOWN = {"ref_id": "string", "description": "string", "unit": "string", "price": "double", "source": "string", "source_type": "string", "observed_at": "date"}


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """One row per reference with a positive price and an id; blank metadata entries go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    typed = {c: parse_number(F.col(c)) if t == "double" else F.try_to_date(F.col(c)) if t == "date" else F.col(c) for c, t in KNOWN.items() if c in raw.columns}
    other = [c for c in raw.columns if c not in KNOWN]
    meta = F.map_filter(F.create_map(*[x for c in other for x in (F.lit(c), F.trim(f"`{c}`"))]), lambda k, v: v.isNotNull() & (v != "")) if other else F.create_map().cast("map<string,string>")
    out = raw.select(*[typed.get(c, F.lit(None).cast(t)).alias(c) for c, t in KNOWN.items()], meta.alias("metadata"))
    return out.filter("ref_id is not null and price > 0")


def write_references(df: DataFrame, path: str) -> None:
    """CSV with a header; metadata goes as JSON, cells that a spreadsheet would run are made safe."""
    df.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in KNOWN.items()], F.to_json("metadata").alias("metadata")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def name_and_date(file: str) -> tuple[str, str]:
    """SQL expressions for the bidder and the date in a file name such as "Công ty X_2024-05-12.xlsx" or "… 12.05.2024 …"."""
    base = f"regexp_replace(element_at(split({file}, '/'), -1), '[.][A-Za-z]+$', '')"
    iso = f"try_to_date(regexp_extract({base}, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), 'yyyy-MM-dd')"
    day = f"try_to_date(regexp_replace(regexp_extract({base}, '([0-9]{{1,2}}[._-][0-9]{{1,2}}[._-][0-9]{{4}})', 1), '[._]', '-'), 'd-M-yyyy')"
    name = f"trim(regexp_replace(regexp_replace({base}, '[0-9]{{1,4}}[._-][0-9]{{1,2}}[._-][0-9]{{1,4}}', ''), '[_-]+', ' '))"
    return name, f"coalesce({iso}, {day})"
