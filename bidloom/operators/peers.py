"""Statistics over the offers that several sellers make for one item. All aggregations combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bidloom.functions.number import symmetric_pct


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """W6, O9, SNK6: one row per key, the first by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, by: Sequence[str], k: int, *order: Column, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group, numbered."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and all of ``new``."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def spread(offers: DataFrame, by: Sequence[str], seller: str, value: str) -> DataFrame:
    """A1: per item with at least two offers: how many, least, most, median, symmetric spread, and who is lowest and highest (ties: smaller seller)."""
    v = F.col(value)
    agg = offers.filter(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("offers"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("middle"),
        F.min(F.struct(v, F.col(seller))).getField(seller).alias("lowest"), F.min(F.struct(-v, F.col(seller))).getField(seller).alias("highest"),
    ).filter("offers >= 2")
    return agg.withColumn("spread", symmetric_pct(F.col("most"), F.col("least")))


def robust_z(offers: DataFrame, by: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """A3: each offer with the group's median, median absolute deviation and robust z.

    The scale is 1.4826 times the deviation; if that is 0, one per cent of the median, at least 1; z is 0 for a median of 0.
    Groups of fewer than ``least`` offers give no rows."""
    v = F.col(value)
    mid = offers.filter(v.isNotNull() & (v >= 0)).groupBy(*by).agg(F.median(v).alias("middle"), F.count("*").alias("offers")).filter(F.col("offers") >= least)
    with_mid = offers.filter(v.isNotNull() & (v >= 0)).join(mid, list(by))
    mad = with_mid.groupBy(*by).agg(F.median(F.abs(v - F.col("middle"))).alias("mad"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.greatest(0.01 * F.abs(F.col("middle")), F.lit(1.0)))
    return with_mid.join(mad, list(by)).withColumn("z", F.when(F.col("middle") == 0, 0.0).otherwise((v - F.col("middle")) / scale))


def matrix(offers: DataFrame, item: Sequence[str], seller: str, value: str, sellers: Sequence) -> DataFrame:
    """A row per item, a column per given seller with its largest value, and least, median, most and spread over those cells."""
    some = offers.filter(F.col(seller).isin(list(sellers))).groupBy(*item, seller).agg(F.max(value).alias("__v"))
    wide = some.groupBy(*item).pivot(seller, list(sellers)).agg(F.max("__v"))
    stats = some.groupBy(*item).agg(F.min("__v").alias("least"), F.median("__v").alias("middle"), F.max("__v").alias("most"))
    return wide.join(stats, list(item)).withColumn("spread", symmetric_pct(F.col("most"), F.col("least")))


def consolidated(offers: DataFrame, item: Sequence[str], seller: str, value: str) -> DataFrame:
    """Each offer with its deviation from the item's median, for items with at least two offers; else a null deviation."""
    stats = offers.groupBy(*item).agg(F.median(value).alias("middle"), F.count(value).alias("offers"))
    return offers.join(stats, list(item)).withColumn("deviation", F.when((F.col("offers") >= 2) & (F.col("middle") != 0), (F.col(value) - F.col("middle")) / F.col("middle")))


def conflicting_codes(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """A10: keys under which more than one distinct name stands."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(name).alias("names")).filter("names > 1")


def repeated_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A11."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def consensus(df: DataFrame, by: Sequence[str], value: str, at: str) -> DataFrame:
    """The most frequent value without regard to case (tie: the one seen first), in its longest spelling (tie: the smaller one)."""
    rows = df.filter(F.trim(value) != "").withColumn("__k", F.lower(F.trim(value)))
    each = rows.groupBy(*by, "__k").agg(F.count("*").alias("votes"), F.min(at).alias("__first"), F.min(F.struct(-F.length(value), F.col(value))).getField(value).alias("value"))
    return first_per_key(each, by, F.desc("votes"), F.col("__first")).select(*by, "value", "votes")


def longest(key: str, name: str, code: str) -> Column:
    """A14 as an aggregate: the key of the row with the longest name, then with a code, then with the smallest key."""
    return -F.max(F.struct(F.coalesce(F.length(name), F.lit(0)).alias("l"), (F.coalesce(F.col(code), F.lit("")) != "").cast("int").alias("c"), (-F.col(key)).alias("m"))).getField("m")


def representative(df: DataFrame, by: Sequence[str], key: str, name: str, code: str) -> DataFrame:
    """Of each group the row with the longest name, then with a code, then with the smallest key."""
    return df.groupBy(*by).agg(longest(key, name, code).alias(key))


def price_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, least, most, median, mean and quartiles (linear interpolation) of the positive values."""
    return df.filter(F.col(value) > 0).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("middle"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3")
    )


#: Sellers that a plan may name; more raise an error.
MOST_SELLERS = 10_000


def completion(clusters: DataFrame, cluster: str, seller: str, sellers: DataFrame) -> DataFrame:
    """A row for every cluster and seller; ``present`` tells whether the seller is in it. Raises ValueError for more than ``MOST_SELLERS`` sellers."""
    have = clusters.select(cluster, seller).distinct().withColumn("present", F.lit(True))
    names = [r[0] for r in sellers.select(seller).distinct().orderBy(seller).limit(MOST_SELLERS + 1).collect()]
    if len(names) > MOST_SELLERS:
        raise ValueError(f"more than {MOST_SELLERS} sellers can't be completed")
    every = have.select(cluster).distinct().withColumn(seller, F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast(f"array<{dict(sellers.dtypes)[seller]}>")))
    return every.join(have, [cluster, seller], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def vote(candidates: DataFrame, cell: Sequence[str], text: str, confidence: str, engine: str, variant: str) -> DataFrame:
    """The reading of each cell that most engines and variants agree on.

    agreement = 2 * engines + variants; score = min(0.999, best + min(0.16, 0.025 * (agreement - 1))); order: agreement, score, longer text, text."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    g = candidates.withColumn("__k", key).groupBy(*cell, "__k").agg(F.countDistinct(engine).alias("e"), F.countDistinct(variant).alias("v"), F.max(confidence).alias("best"), F.min(F.struct((-F.col(confidence)).alias("m"), F.col(text).alias("t"))).getField("t").alias("reading"))
    g = g.withColumn("agreement", 2 * F.col("e") + F.col("v")).withColumn("score", F.least(F.lit(0.999), F.col("best") + F.least(F.lit(0.16), 0.025 * (F.col("agreement") - 1))))
    return first_per_key(g, cell, F.desc("agreement"), F.desc("score"), F.desc(F.length("reading")), F.col("reading")).select(*cell, "reading", "agreement", "score")


def rollup_notes(df: DataFrame, by: Sequence[str], rank: str, reason: str, note: str) -> DataFrame:
    """Worst rank, distinct reasons and notes in order of the alphabet, joined."""
    return df.groupBy(*by).agg(F.max(rank).alias("worst"), F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("reasons"), F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"))


def largest_change(df: DataFrame, by: Sequence[str], field: str, delta: str) -> DataFrame:
    """Number of fields that changed and the largest change by magnitude (tie: field name)."""
    return df.groupBy(*by).agg(F.countDistinct(field).alias("fields"), F.min(F.struct((-F.abs(delta)).alias("m"), F.col(field).alias("f"), F.col(delta).alias("d"))).alias("__b")).select(*by, "fields", F.col("__b.f").alias("largest_field"), F.col("__b.d").alias("largest_delta"))
