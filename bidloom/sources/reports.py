"""Where results go: one relation per report sheet, split at a sheet's capacity; previews, manifests, hashes, audit lines."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.text import safe_cell

#: Data rows that fit on one spreadsheet sheet below a header.
CAPACITY = 1_048_574


def parts(df: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """SNK1: ``part`` (from 0), so that no part exceeds the capacity, in the given order.

    Rows are range-sorted and numbered from the counts per partition, so no task sees them all; the counts are one number a partition."""
    from bidloom.functions.lineage import written

    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, at = {}, 0
    for p, n in sorted(map(tuple, ranged.groupBy("__p").count().collect())):
        before[p] = at
        at += n
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return ranged.withColumn("part", F.floor((starts[F.col("__p").cast("long")] + F.col("__i")) / capacity).cast("int")).drop("__p", "__i")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """SNK1 to SNK4: every relation as Parquet under its name, texts safe for spreadsheets."""
    for name, df in tables.items():
        df.select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").parquet(f"{path}/{name}")


def preview(df: DataFrame, *order, rows: int = 250, lists: int = 8) -> DataFrame:
    """SNK8, O4: the first rows, with array columns cut to their first entries."""
    cut = [F.slice(c, 1, lists).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    return df.orderBy(*order).limit(rows).select(*cut)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, source_id) of every file below a path; the id is the first 16 hex digits."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), F.left(F.sha2("content", 256), F.lit(16)).alias("source_id"))


def write_manifest(path: str, facts: dict) -> None:
    """SNK7, SNK8: JSON written beside and moved into place, so readers never see half a file."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=1, default=str)
    os.replace(part, path)


def audit(spark: SparkSession, path: str, event: dict) -> None:
    """SNK10: one more JSON line in a folder of lines."""
    spark.createDataFrame([(time.time(), json.dumps(event, ensure_ascii=False, default=str))], "at double, event string").coalesce(1).write.mode("append").json(path)
