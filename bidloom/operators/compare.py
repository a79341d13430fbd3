"""Field-by-field comparison of matched rows as one unpivot and one CASE, driven by a table of specifications."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import number, similarity, text

RANKS = ["ok", "info", "review", "warning", "critical"]


@dataclass(frozen=True)
class NumberSpec:
    """How far two numbers of a field may differ: relative limits that count only from an absolute change on."""

    field: str
    warn: float = 0.05
    critical: float = 0.2
    warn_abs: float = 0.0
    critical_abs: float = 0.0
    missing: str = "review"
    zero_base: str = "warning"
    cap: str = "critical"


@dataclass(frozen=True)
class TextSpec:
    """How alike two texts of a field must be (0..1)."""

    field: str
    review: float = 0.8
    critical: float = 0.5
    missing: str = "review"


def numbers(df: DataFrame, keys: Sequence[str], specs: Sequence[NumberSpec], left: str = "_ref", right: str = "_bid") -> DataFrame:
    """(keys, field, base, value, delta, pct, severity) of every field that differs; severity never exceeds the field's cap.

    Two nulls say nothing; one null has the field's missing severity; a base of 0 its zero-base severity, critical from the
    critical absolute change on if that is set and the cap allows it."""
    entries = [F.struct(F.lit(s.field).alias("field"), F.col(s.field + left).cast("double").alias("base"), F.col(s.field + right).cast("double").alias("value"), *[F.lit(getattr(s, n)).alias(n) for n in ("warn", "critical", "warn_abs", "critical_abs", "missing", "zero_base", "cap")]) for s in specs]
    d = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")
    delta = F.col("value") - F.col("base")
    pct = number.pct_delta(F.col("base"), F.col("value"))
    big = F.abs(delta) >= F.col("critical_abs")
    severity = (
        F.when(F.col("base").isNull() & F.col("value").isNull(), "ok").when(F.col("base").isNull() | F.col("value").isNull(), F.col("missing"))
        .when((F.col("base") == 0) & (F.col("value") != 0), F.when((F.col("critical_abs") > 0) & (F.col("cap") == "critical") & big, "critical").otherwise(F.col("zero_base")))
        .when((F.abs(pct) >= F.col("critical")) & big, F.col("cap")).when((F.abs(pct) >= F.col("warn")) & (F.abs(delta) >= F.col("warn_abs")), "warning").otherwise("ok")
    )
    return d.select(*keys, "field", "base", "value", delta.alias("delta"), pct.alias("pct"), severity.alias("severity")).filter("severity <> 'ok'")


def texts(df: DataFrame, keys: Sequence[str], specs: Sequence[TextSpec], left: str = "_ref", right: str = "_bid") -> DataFrame:
    """(keys, field, base, value, similarity, severity) of the text fields that differ. Equal texts never reach Python."""
    entries = [F.struct(F.lit(s.field).alias("field"), F.coalesce(F.trim(s.field + left), F.lit("")).alias("base"), F.coalesce(F.trim(s.field + right), F.lit("")).alias("value"), F.lit(s.review).alias("review"), F.lit(s.critical).alias("critical"), F.lit(s.missing).alias("missing")) for s in specs]
    d = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*").filter("base <> value")
    alike = similarity.measure("text_similarity", text.normalize_name(F.col("base")), text.normalize_name(F.col("value")))
    d = d.withColumn("similarity", F.when((F.col("base") != "") & (F.col("value") != ""), alike))
    severity = F.when((F.col("base") == "") | (F.col("value") == ""), F.col("missing")).when(F.col("similarity") < F.col("critical"), "warning").when(F.col("similarity") < F.col("review"), "review").otherwise("ok")
    return d.select(*keys, "field", "base", "value", "similarity", severity.alias("severity")).filter("severity <> 'ok'")


def maps(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Entries of two maps joined by their normalised label: (keys, label, base, value); a label on one side only has a null."""
    side = lambda c, name: df.select(*keys, F.explode(c).alias("k", name)).select(*keys, text.strip_accents(text.normalize_text(F.col("k"))).alias("label"), name).groupBy(*keys, "label").agg(F.min(name).alias(name))
    return side(left, "base").join(side(right, "value"), [*keys, "label"], "full")


def simple_number(c: Column) -> Column:
    """M7: the number of a text that is a plain number; null for anything with letters, fractions or comparisons."""
    return F.when(~c.rlike(r"[\p{L}/×%<>]"), number.parse_number(c))


def worst(severity: Column) -> Column:
    """The gravest of a group's severities (an aggregate)."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RANKS) for x in (r, i)])
    return F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.max(order[severity]) + 1)


def disagreeing_texts(df: DataFrame, by: Sequence[str], seller: str, value: str, alike: float = 0.8) -> DataFrame:
    """A2: per group the distinct wordings: a text joins the first representative it resembles, in order of seller. (by…, wording, sellers).

    Groups are the offers for one item. Equal texts are put together first, so a group's frame holds distinct wordings only."""
    each = df.filter(F.trim(value) != "").groupBy(*by, text.normalize_name(F.col(value)).alias("w")).agg(F.min(seller).alias("first"), F.count("*").alias("n"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in each.dtypes if c in by)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for w, n in pdf.sort_values(["first", "w"])[["w", "n"]].itertuples(index=False):
            for k in kept:
                if similarity.text_similarity(k[0], w) >= alike:
                    k[1] += n
                    break
            else:
                kept.append([w, n])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), w, n] for w, n in kept], columns=[*by, "wording", "sellers"])

    return each.groupBy(*by).applyInPandas(pick, f"{kinds}, wording string, sellers long")
