"""Severity and score of what a comparison finds: values that stand out among peers, rows that are incomplete, a row's total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.operators import compare, peers

#: Most that the scores of one row add up to.
MOST = 100


def graded(value: Column, *steps: tuple[float, str, float]) -> tuple[Column, Column]:
    """(severity, score) of the first step (least value, severity, score) that the value reaches; 'ok' and 0 for none and for null."""
    severity, score = F.lit("ok"), F.lit(0.0)
    for least, name, points in reversed(steps):
        severity, score = F.when(value >= least, name).otherwise(severity), F.when(value >= least, points).otherwise(score)
    return severity, score


def outlying(z: DataFrame, critical: float = 3.5, warn: float = 2.5) -> DataFrame:
    """The rows of ``peers.robust_z`` whose score is far out, with severity and points."""
    severity, score = graded(F.abs("z"), (critical, "critical", 35.0), (warn, "warning", 20.0))
    return z.withColumns({"severity": severity, "score": score}).filter("severity <> 'ok'")


def peer_flags(offers: DataFrame, by: Sequence[str], seller: str, value: str, warn: float = 0.15, critical: float = 0.35, points: tuple[float, float] = (26.0, 14.0)) -> DataFrame:
    """(by…, seller, value, middle, deviation, severity, score) of the offers that make an item's spread notable.

    Items whose symmetric spread reaches a limit are flagged, critical or as a warning. Of these the offers that stand out are marked: both
    of two, else those that deviate from the median by ``warn`` or more, and the least and the most. Null and single offers are never flagged."""
    s = peers.spread(offers, by, seller, value).select(*by, "offers", "least", "most", "middle", "spread")
    severity, score = graded(F.col("spread"), (critical, "critical", points[0]), (warn, "warning", points[1]))
    s = s.withColumns({"severity": severity, "score": score}).filter("severity <> 'ok'")
    v = F.col(value)
    deviation = F.when(F.col("middle") != 0, (v - F.col("middle")) / F.abs("middle"))
    got = offers.filter(v.isNotNull()).join(s, list(by)).withColumn("deviation", deviation)
    marked = (F.col("offers") == 2) | (F.abs("deviation") >= warn) | (v == F.col("least")) | (v == F.col("most"))
    return got.filter(F.coalesce(marked, F.lit(False))).select(*by, seller, value, "middle", "deviation", "severity", "score")


def text_flags(wordings: DataFrame, by: Sequence[str], severity: str = "review", points: float = 4.0) -> DataFrame:
    """C11: (by…, wordings, severity, score) of the groups in which ``compare.disagreeing_texts`` found more than one wording."""
    return wordings.groupBy(*by).agg(F.count("*").alias("wordings")).filter("wordings > 1").withColumns({"severity": F.lit(severity), "score": F.lit(points)})


def flag_severity(flag: Column) -> tuple[Column, Column]:
    """C4: (severity, score) of a row's quality flag: broken references, formulas and products are critical."""
    bad = F.lower(flag).rlike("#ref|formula|product")
    return F.when(bad, "critical").otherwise("review"), F.when(bad, 22.0).otherwise(5.0)


def lone_severity(kind: Column) -> tuple[Column, Column]:
    """(severity, score) of rows that only one document has."""
    return F.when(kind == "missing", "critical").otherwise("warning"), F.when(kind == "missing", 45.0).otherwise(30.0)


def name_severity(kind: Column, lexical: Column, score: Column) -> tuple[Column, Column]:
    """(severity, score) of a match's names: matched by code but unlike in words, or matched by a low score."""
    by_code = kind == "exact_code"
    severity = F.when(by_code & (lexical < 0.58), "critical").when(by_code & (lexical < 0.78), "warning").when(score < 0.78, "review").otherwise("ok")
    points = F.when(by_code & (lexical < 0.58), 32.0).when(by_code & (lexical < 0.78), 20.0).when(score < 0.78, F.least(F.lit(30.0), 100 * (0.78 - score))).otherwise(0.0)
    return severity, points


def totals(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per row the gravest severity and the sum of the scores, at most ``MOST``, and the number of flags."""
    return flags.groupBy(*by).agg(F.count("*").alias("flags"), compare.worst(F.col("severity")).alias("severity"), F.least(F.lit(float(MOST)), F.sum("score")).alias("score"))
