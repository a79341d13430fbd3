"""Problem 5: listings of one product, grouped.

Each listing gets an identifier (check-digit-valid trade number or normalised maker's part number) and the multiset of its
measured attributes in SI units (``listing``). Listings are joined on these two reliable keys and form connected components,
guarded: an attribute set links listings only if all identifiers seen with it are one and the same; if no identifier was seen with
it, only if it holds at least ``least_values`` values; so two products with conflicting part numbers never meet. Under that guard a component is one
identifier with the attribute sets that belong to it, or an attribute set alone, and its label follows from one aggregation
and one join: no iteration and no growing lineage.

Hot keys: attribute sets are aggregated with partial sums before the shuffle, and the join back splits hot keys over
``salts`` parts. Defined cases: a listing that tells neither identifier nor enough attributes is in no group; nulls count as not
told; texts of any length are read whole; repeated rows are listings of their own; an empty table gives an empty result;
extra columns named in ``keep`` come along, but ones called like the columns added here are replaced by them.

Texts are read once: what they tell is written to the checkpoint folder, and everything after works on that small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.lineage import written
from bidloom.llm.listing import describe

LEAST_VALUES = 3


def described(df: DataFrame, name: str, material: str, code: str, *keep: str) -> DataFrame:
    """The kept columns of each listing that tells something, with ``ident`` and ``attrs``."""
    keep = tuple(c for c in keep if c.lower() not in ("ident", "attrs", "product"))
    schema = df.select(*keep).schema.simpleString()[7:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [describe(x, y, z) for x, y, z in zip(pdf[name].tolist(), pdf[material].tolist(), pdf[code].tolist(), strict=True)]
            hit = np.array([t != (None, None) for t in told], bool)
            if hit.any():
                yield pdf.loc[hit, list(keep)].assign(ident=[t[0] for t, h in zip(told, hit, strict=True) if h], attrs=[t[1] for t, h in zip(told, hit, strict=True) if h])

    return df.select(*dict.fromkeys((*keep, name, material, code))).mapInPandas(run, f"{schema},ident:string,attrs:string")


def grouped(df: DataFrame, key: str, name: str, material: str, code: str, *keep: str, least_values: int = LEAST_VALUES, salts: int = 8) -> DataFrame:
    """(key, keep…, ident, attrs, product) of the listings that belong to a product; ``product`` is the group's label."""
    told = described(df, name, material, code, key, *keep)
    told = told.withColumn("ident", F.when(~F.col("ident").startswith("?"), F.col("ident")))
    told = written(told.filter("ident is not null or attrs is not null"))
    enough = F.size(F.split("attrs", r"\|")) >= least_values
    # attribute sets whose identifiers agree, one row each; replicated once per salt for the sets that a salted side may hold
    owner = told.filter("ident is not null and attrs is not null").groupBy("attrs").agg(F.min("ident").alias("owner"), F.max("ident").alias("other")).filter("owner = other").select("attrs", "owner")
    salted = owner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = told.filter("ident is not null").withColumn("product", F.col("ident"))
    bare = told.filter("ident is null").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    placed = bare.join(salted, ["attrs", "salt"], "left").withColumn("product", F.coalesce("owner", F.when(enough, F.concat(F.lit("~"), F.col("attrs"))))).filter("product is not null").select(named.columns)
    return named.unionByName(placed)


#: Listings of one product that one task joins; larger products are split.
PART_ROWS = 2_000


def pairs(groups: DataFrame, key: str, seller: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key_a, key_b) of the listings of one product by different sellers, smaller key first.

    Listings of one seller's products go before the join; the result is as large as its definition makes it. A product of more than
    ``part_rows`` listings is split: its left side over as many parts as it needs, its right side copied to each of them."""
    slim = groups.select("product", F.col(key).alias("k"), F.col(seller).alias("s"))
    several = slim.groupBy("product").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).filter("lo <> hi").select("product", "parts")
    slim = written(slim.join(several, "product").select(F.xxhash64("product").alias("h"), "product", "k", "s", "parts"))
    a = slim.select("h", "product", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), F.col("k").alias("a"), F.col("s").alias("sa"))
    b = slim.select("h", "product", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("k").alias("b"), F.col("s").alias("sb"))
    return a.join(b, ["h", "product", "part"]).filter("a < b and sa <> sb").select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
