"""Queries of severities, scores and totals, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import number
from bidloom.operators import compare, flags, matching, peers
from bidloom.plans.engine_queries import QUOTES, quotes, r4, sql4
from bidloom.plans.registry import query, read

Z = f"""WITH {QUOTES}, m AS (SELECT item, median(price) AS middle, count(*) AS offers FROM quotes WHERE price >= 0 GROUP BY item HAVING count(*) >= 3),
a AS (SELECT q.item, median(abs(price - middle)) AS mad FROM quotes q JOIN m ON q.item = m.item GROUP BY q.item),
z AS (SELECT q.item, q.seller, abs(CASE WHEN middle = 0 THEN 0 ELSE (price - middle) / CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE greatest(0.01e0 * abs(middle), 1.0e0) END END) AS z
 FROM quotes q JOIN m ON q.item = m.item JOIN a ON q.item = a.item)"""


@query(f"""{Z} SELECT item, seller, CASE WHEN z >= 3.5e0 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN z >= 3.5e0 THEN 35.0e0 ELSE 20.0e0 END AS score FROM z WHERE z >= 2.5e0""")
def robust_flags(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that lie far from the others for the item."""
    return flags.outlying(peers.robust_z(quotes(spark, d), ["item"], "price")).select("item", "seller", "severity", "score")


@query(f"""WITH {QUOTES}, s AS (SELECT item, count(*) AS offers, min(price) AS least, max(price) AS most, median(price) AS middle FROM quotes GROUP BY item HAVING count(*) >= 2),
f AS (SELECT *, CASE WHEN (abs(most) + abs(least)) / 2 = 0 THEN 0 ELSE (most - least) / ((abs(most) + abs(least)) / 2) END AS spread FROM s)
SELECT q.item, q.seller, {sql4('CASE WHEN middle <> 0 THEN (price - middle) / abs(middle) END')} AS deviation, CASE WHEN spread >= 0.35e0 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN spread >= 0.35e0 THEN 26.0e0 ELSE 14.0e0 END AS score
FROM quotes q JOIN f ON q.item = f.item WHERE spread >= 0.15e0 AND (offers = 2 OR abs((price - middle) / nullif(abs(middle), 0)) >= 0.15e0 OR price = least OR price = most)""")
def peer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that make the spread of an item's prices notable."""
    got = flags.peer_flags(quotes(spark, d), ["item"], "seller", "price")
    return got.select("item", "seller", r4("deviation").alias("deviation"), "severity", "score")


@query(f"""SELECT source_id, sheet, count(*) AS rows_, {sql4('sum(coalesce(bid_amount, bid_quantity * unit_price_total))')} AS total FROM item_records WHERE row_type = 'detail' GROUP BY source_id, sheet""")
def sheet_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the detail rows of each sheet."""
    rows = read(spark, d, "item_records").filter("row_type = 'detail'")
    return rows.groupBy("source_id", "sheet").agg(F.count("*").alias("rows_"), r4(F.sum(number.amount(F.col("bid_quantity"), F.col("unit_price_total"), F.col("bid_amount")))).alias("total"))


FLAGGED = """f AS (SELECT item_id, unnest(list_filter([CASE WHEN bid_quantity IS NULL THEN 'no quantity' END, CASE WHEN unit_price_total IS NULL THEN 'no price' END, CASE WHEN bid_amount IS NULL THEN 'no amount' END,
 CASE WHEN abs(bid_quantity * unit_price_total - bid_amount) / greatest(abs(bid_quantity * unit_price_total), abs(bid_amount), 1.0e0) > 0.005e0 THEN 'product' END,
 CASE WHEN coalesce(price_main, price_aux, price_labor, price_management, price_profit) IS NOT NULL AND abs(p - unit_price_total) / greatest(abs(p), abs(unit_price_total), 1.0e0) > 0.005e0 THEN 'components' END], lambda x: x IS NOT NULL)) AS flag
 FROM (SELECT *, 0.0e0 + coalesce(price_main, 0) + coalesce(price_aux, 0) + coalesce(price_labor, 0) + coalesce(price_management, 0) + coalesce(price_profit, 0) AS p FROM item_records WHERE row_type = 'detail'))"""


def row_flags(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, flag) of the detail rows: what is missing, products and sums of components that don't come out."""
    q, p, a = F.col("bid_quantity"), F.col("unit_price_total"), F.col("bid_amount")
    parts = number.sum_present(*[F.col(f"price_{c}") for c in ("main", "aux", "labor", "management", "profit")])
    sums = F.abs(parts - p) / F.greatest(F.abs(parts), F.abs(p), F.lit(1.0)) > 0.005
    told = F.array(F.when(q.isNull(), "no quantity"), F.when(p.isNull(), "no price"), F.when(a.isNull(), "no amount"), F.when(number.product_error(q, p, a).isNotNull(), "product"), F.when(sums, "components"))
    return read(spark, d, "item_records").filter("row_type = 'detail'").select("item_id", F.explode(F.filter(told, lambda f: f.isNotNull())).alias("flag"))


@query(f"""WITH {FLAGGED} SELECT item_id, count(*) AS flags, CASE WHEN count(*) FILTER (WHERE flag = 'product') > 0 THEN 'critical' ELSE 'review' END AS severity, least(100.0e0, sum(CASE WHEN flag = 'product' THEN 22.0e0 ELSE 5.0e0 END)) AS score FROM f GROUP BY item_id""")
def row_scores(spark: SparkSession, d: str) -> DataFrame:
    """The gravest severity and the score of each detail row's quality flags."""
    severity, score = flags.flag_severity(F.col("flag"))
    return flags.totals(row_flags(spark, d).withColumns({"severity": severity, "score": score}), ["item_id"])


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand FROM part)
SELECT kind, severity, score, count(*) AS n FROM (SELECT 'missing' AS kind, 'critical' AS severity, 45.0e0 AS score FROM p a WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.p_partkey % 2 = 1 AND b.p_name = a.p_name AND b.p_brand = a.p_brand)
 UNION ALL SELECT 'extra', 'warning', 30.0e0 FROM p a WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.p_partkey % 2 = 0 AND b.p_name = a.p_name AND b.p_brand = a.p_brand)) GROUP BY ALL""")
def lone_rows(spark: SparkSession, d: str) -> DataFrame:
    """Severity of the rows that only one of two documents (even and odd parts) has."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    l, r = p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "a"), p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "b")
    both = l.join(r, ["p_name", "p_brand"]).select("a", "b")
    severity, score = flags.lone_severity(F.col("kind"))
    return matching.unmatched(both, l, r, "a", "b").withColumns({"severity": severity, "score": score}).groupBy("kind", "severity", "score").agg(F.count("*").alias("n"))


@query()
def wording_flags(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose section titles the bidders word differently."""
    rows = read(spark, d, "item_records").filter("row_type = 'group'")
    return flags.text_flags(compare.disagreeing_texts(rows, ["sheet"], "bidder", "item_name"), ["sheet"])
