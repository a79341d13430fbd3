"""Operators on rows in order: forward fill, sections, streaks, one-dimensional clusters. Ordered work is per sheet, in parallel over sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _upto(by: Sequence[str], at: str):
    return Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_down(df: DataFrame, by: Sequence[str], at: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(by, at)))


def blank_streak(df: DataFrame, by: Sequence[str], at: str, blank: Column, name: str = "streak") -> DataFrame:
    """How many blank rows in a row end at this one."""
    group = F.sum(F.when(blank, 0).otherwise(1)).over(_upto(by, at))
    g = df.withColumn("__g", group).withColumn("__blank", blank)
    return g.withColumn(name, F.sum(F.col("__blank").cast("int")).over(_upto([*by, "__g"], at))).drop("__g", "__blank")


def before_long_gap(df: DataFrame, by: Sequence[str], at: str, blank: Column, most: int = 250) -> DataFrame:
    """The non-blank rows before the first streak of more than ``most`` blank rows."""
    s = blank_streak(df, by, at, blank, "__s")
    stop = F.min(F.when(F.col("__s") > most, F.col(at))).over(Window.partitionBy(*by))
    return s.withColumn("__stop", stop).filter((F.col("__stop").isNull() | (F.col(at) < F.col("__stop"))) & (F.col("__s") == 0)).drop("__s", "__stop")


def before_number_gap(df: DataFrame, by: Sequence[str], at: str, most: int = 250) -> DataFrame:
    """The rows before the first gap of more than ``most`` numbers in ``at``, for rows whose blank ones are gone already."""
    gap = F.col(at) - F.coalesce(F.lag(at).over(Window.partitionBy(*by).orderBy(at)), F.col("__start")) - 1
    s = df.withColumn("__start", F.min(at).over(Window.partitionBy(*by)) - 1).withColumn("__gap", gap)
    stop = F.min(F.when(F.col("__gap") > most, F.col(at))).over(Window.partitionBy(*by))
    return s.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col(at) < F.col("__stop"))).drop("__start", "__gap", "__stop")


def section_path(df: DataFrame, by: Sequence[str], at: str, level: Column, title: Column, levels: int = 6, name: str = "path") -> DataFrame:
    """The titles of the open sections at each row. A heading of level L closes all of level L and deeper.

    Per level the last heading is carried down and holds only if no heading of a smaller level came after it."""
    d = df.withColumn("__l", level).withColumn("__t", title)
    w = _upto(by, at)
    for i in range(levels):
        d = d.withColumn(f"__at{i}", F.max(F.when(F.col("__l") == i, F.col(at))).over(w)).withColumn(f"__t{i}", F.last(F.when(F.col("__l") == i, F.col("__t")), ignorenulls=True).over(w))
    parts = []
    for i in range(levels):
        shallower = [F.col(f"__at{j}") for j in range(i)]
        open_ = F.col(f"__at{i}").isNotNull()
        for s in shallower:
            open_ = open_ & (s.isNull() | (s < F.col(f"__at{i}")))
        parts.append(F.when(open_, F.col(f"__t{i}")))
    path = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return d.withColumn(name, path).drop("__l", "__t", *[f"__at{i}" for i in range(levels)], *[f"__t{i}" for i in range(levels)])


def parent_row(df: DataFrame, by: Sequence[str], at: str, is_parent: Column, resets: Column, is_child: Column, name: str = "parent") -> DataFrame:
    """For each child the place of the last parent before it, forgotten at a reset row."""
    seg = F.sum(F.when(resets, 1).otherwise(0)).over(_upto(by, at))
    d = df.withColumn("__seg", seg)
    last = F.last(F.when(is_parent, F.col(at)), ignorenulls=True).over(_upto([*by, "__seg"], at))
    return d.withColumn(name, F.when(is_child, last)).drop("__seg")


def merge_close(df: DataFrame, by: Sequence[str], value: str, gap: float) -> DataFrame:
    """Values less than or equal to ``gap`` apart from their neighbour fall together: (by…, line, mean, n)."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    d = df.withColumn("__new", new).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "line").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def row_kind(name: Column, ordinal: Column, *numbers: Column) -> Column:
    """Summary, group, component or detail from what a row holds."""
    empty = F.lit(True)
    for n in numbers:
        empty = empty & n.isNull()
    total = F.lower(F.coalesce(name, F.lit(""))).rlike(r"^\s*(tổng|cộng|total|sub-?total|thành tiền)")
    return F.when(total, "summary").when(empty & name.isNotNull() & (F.length(name) < 220), "group").when(F.coalesce(F.trim(ordinal), F.lit("")) == "", "component").otherwise("detail")


def is_legend(cells: Column) -> Column:
    """A row of column numbers: at least four cells filled, the first four 1 to 4 and at least 70 % of all mere labels like [5] or (5)=(1)+(2)."""
    filled = F.filter(F.transform(cells, lambda c: F.regexp_replace(F.trim(c), r"\.0$", "")), lambda c: c.isNotNull() & (c != ""))
    digits = F.transform(filled, lambda c: F.regexp_extract(c, r"^[\[(]?(\d+)", 1))
    labels = F.size(F.filter(filled, lambda c: c.rlike(r"^[\[(]?\d{1,2}[\])]?(=.*)?$")))
    return (F.size(filled) >= 4) & (F.slice(digits, 1, 4) == F.array(*[F.lit(str(i)) for i in (1, 2, 3, 4)])) & (labels >= 0.7 * F.size(filled))
