"""Queries of comparison, retrieval, reading and outlier operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import compare, forest, matching, peers, readings, retrieval
from bidloom.plans import documents
from bidloom.plans.engine_queries import QUOTES, quotes, r4, sql4
from bidloom.plans.registry import query, read
from bidloom.sources import tables
from bidloom.streaming import windows


@query("""WITH d AS (SELECT item_id, 'quantity' AS field, reference_quantity AS base, bid_quantity AS value, 0.05e0 AS w, 0.2e0 AS c FROM item_records
 UNION ALL SELECT item_id, 'amount', reference_amount, bid_amount, 0.1e0, 0.3e0 FROM item_records),
s AS (SELECT item_id, field, base, value, CASE WHEN base IS NULL AND value IS NULL THEN 'ok' WHEN base IS NULL OR value IS NULL THEN 'review' WHEN base = 0 AND value <> 0 THEN 'warning'
 WHEN abs((value - base) / abs(base)) >= c THEN 'critical' WHEN abs((value - base) / abs(base)) >= w THEN 'warning' ELSE 'ok' END AS severity FROM d)
SELECT item_id, field, severity FROM s WHERE severity <> 'ok'""")
def number_differences(spark: SparkSession, d: str) -> DataFrame:
    """Invited against offered numbers, field by field."""
    rows = read(spark, d, "item_records").select("item_id", F.col("reference_quantity").alias("quantity_ref"), F.col("bid_quantity").alias("quantity_bid"), F.col("reference_amount").alias("amount_ref"), F.col("bid_amount").alias("amount_bid"))
    specs = [compare.NumberSpec("quantity", 0.05, 0.2), compare.NumberSpec("amount", 0.1, 0.3)]
    return compare.numbers(rows, ["item_id"], specs).select("item_id", "field", "severity")


@query()
def text_differences(spark: SparkSession, d: str) -> DataFrame:
    """Wordings of the invitation and of the bids under one bill code."""
    rows = read(spark, d, "item_records").filter("row_type = 'detail' and trim(item_code) <> ''")
    one = lambda role, name: peers.first_per_key(rows.filter(F.col("role") == role), ["item_code"], F.col("item_id")).select("item_code", F.col("item_name").alias(f"item_name{name}"), F.col("unit").alias(f"unit{name}"))
    both = one("HSMT", "_ref").join(one("HSDT", "_bid"), "item_code")
    return compare.texts(both, ["item_code"], [compare.TextSpec("item_name", 0.88, 0.55), compare.TextSpec("unit", 0.99, 0.8)]).select("item_code", "field", "severity", r4("similarity").alias("similarity"))


@query("""WITH a AS (SELECT item_id, unnest(map_entries(technical_specs)) AS e FROM item_records WHERE item_id % 2 = 0), b AS (SELECT item_id - 1 AS item_id, unnest(map_entries(technical_specs)) AS e FROM item_records WHERE item_id % 2 = 1)
SELECT coalesce(a.item_id, b.item_id) AS item_id, replace(strip_accents(lower(coalesce(a.e.key, b.e.key))), 'đ', 'd') AS label, a.e.value AS base, b.e.value AS value FROM a FULL JOIN b ON a.item_id = b.item_id AND a.e.key = b.e.key""")
def technical_differences(spark: SparkSession, d: str) -> DataFrame:
    """Technical entries of two documents (rows with even and odd numbers stand for them), by normalised label."""
    rows = read(spark, d, "item_records").select("item_id", "technical_specs")
    l = rows.filter("item_id % 2 = 0").withColumnRenamed("technical_specs", "l")
    r = rows.filter("item_id % 2 = 1").select((F.col("item_id") - 1).alias("item_id"), F.col("technical_specs").alias("r"))
    return compare.maps(l.join(r, "item_id", "full"), ["item_id"], "l", "r")


@query()
def wording_groups(spark: SparkSession, d: str) -> DataFrame:
    """Distinct wordings of a sheet's sections over the bidders."""
    rows = read(spark, d, "item_records").filter("row_type = 'group'")
    return compare.disagreeing_texts(rows, ["sheet"], "bidder", "item_name")


@query()
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar references of the same unit for every fiftieth reference, against all rows."""
    refs = read(spark, d, "price_references").select("ref_id", "description", "unit").filter("unit is not null")
    asked = refs.filter(F.substring("ref_id", -7, 7).cast("long") % 50 == 0).withColumnRenamed("ref_id", "query_id")
    return retrieval.lookup(asked, refs, "query_id", "ref_id").select("query_id", "ref_id", r4("similarity").alias("similarity"), "place")


@query()
def requirement_match(spark: SparkSession, d: str) -> DataFrame:
    """The best material requirement for every detail row."""
    items = read(spark, d, "item_records").filter("row_type = 'detail'").select("item_id", "item_name")
    return retrieval.best_requirement(items, read(spark, d, "material_requirements").select("requirement_id", F.col("item_name").alias("wanted")), "item_id", "requirement_id", "item_name", "wanted").select("item_id", "requirement_id", r4("score").alias("score"))


@query("""WITH c AS (SELECT l_orderkey AS record, unnest([{'f': 'q', 'v': l_quantity}, {'f': 'p', 'v': l_extendedprice / l_quantity}, {'f': 'a', 'v': l_extendedprice}]) AS x, 1 - l_discount AS conf FROM lineitem),
s AS (SELECT record, x.f AS f, x.v AS v, conf FROM c QUALIFY row_number() OVER (PARTITION BY record, x.f ORDER BY conf DESC, x.v DESC) <= 5),
m AS (SELECT q.record, abs(q.v * p.v - a.v) / greatest(abs(q.v * p.v), abs(a.v), 1.0e0) AS error, (q.conf + p.conf + a.conf) / 3 AS conf FROM s q JOIN s p ON q.record = p.record JOIN s a ON q.record = a.record WHERE q.f = 'q' AND p.f = 'p' AND a.f = 'a')
SELECT record, count(*) > 0 AS found, min(floor((5 * error + 0.15e0 * (1 - conf)) * 10000.0e0 + 0.500001e0)) / 10000.0e0 AS cost FROM m GROUP BY record""")
def reconciled_orders(spark: SparkSession, d: str) -> DataFrame:
    """Quantity, price and amount of each order among the readings of all its lines that fit together best."""
    return reconciled(read(spark, d, "lineitem"))


def reconciled(lines: DataFrame) -> DataFrame:
    l = lines.select(F.col("l_orderkey").alias("record"), (1 - F.col("l_discount")).alias("confidence"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("q", F.col("l_quantity")), ("p", F.col("l_extendedprice") / F.col("l_quantity")), ("a", F.col("l_extendedprice")))])).alias("x"))
    rows = l.select("record", "confidence", "x.field", "x.value")
    best = readings.reconcile(rows, "record")
    conf = lambda f, v: rows.filter(F.col("field") == f).groupBy("record", "value").agg(F.max("confidence").alias(f"c{f}")).withColumnRenamed("value", v)
    j = best.join(conf("q", "quantity"), ["record", "quantity"]).join(conf("p", "price"), ["record", "price"]).join(conf("a", "amount"), ["record", "amount"])
    cost = 5 * F.col("error") + 0.15 * (1 - (F.col("cq") + F.col("cp") + F.col("ca")) / 3)
    return j.select("record", F.lit(True).alias("found"), (F.floor(cost * 10000.0 + 0.500001) / 10000.0).alias("cost"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS text, l_discount AS confidence FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE l_returnflag END AS text, l_tax AS confidence FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, CASE WHEN b.text IS NULL THEN 'single' WHEN lower(trim(a.text)) = lower(trim(b.text)) THEN 'agreed' WHEN b.confidence > a.confidence THEN 'replaced' ELSE 'kept' END AS state,
 CASE WHEN b.text IS NOT NULL AND lower(trim(a.text)) <> lower(trim(b.text)) AND b.confidence > a.confidence THEN b.text ELSE a.text END AS text FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def second_opinion(spark: SparkSession, d: str) -> DataFrame:
    """Cells read by two models, of which the second left some unread."""
    l = read(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    a = l.select(*keys, F.col("l_returnflag").alias("text"), F.col("l_discount").alias("confidence"))
    b = l.select(*keys, F.when(F.col("l_linenumber") % 6 == 0, None).when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("text"), F.col("l_tax").alias("confidence"))
    return readings.second_opinion(a, b, keys).select(*keys, "state", "text")


@query(f"""SELECT l_orderkey, count(*) AS cells, count(*) FILTER (WHERE coalesce(trim(l_returnflag), '') = '') AS blank, count(*) FILTER (WHERE 1 - l_discount < CASE WHEN regexp_matches(l_returnflag, '^[0-9.,\\s()+-]+$') THEN 0.9e0 ELSE 0.95e0 END) AS doubtful, {sql4('avg(1 - l_discount)')} AS mean_confidence FROM lineitem GROUP BY l_orderkey""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("text"), (1 - F.col("l_discount")).alias("confidence"))
    return readings.document_summary(cells, "l_orderkey", text_least=0.95).withColumn("mean_confidence", r4("mean_confidence"))


@query()
def isolation_signal(spark: SparkSession, d: str) -> DataFrame:
    """How much each quote stands out by price, relative price and quantity of quotes."""
    z = peers.robust_z(quotes(spark, d), ["item"], "price").select("item", "seller", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("z"))).alias("z"), F.log1p("price").alias("size"), F.col("offers").cast("double").alias("offers"), F.concat_ws("-", "item", "seller").alias("key"))
    out = forest.outlier_signal(forest.isolation_scores(z, "key", ["z", "size", "offers"]))
    return out.select("item", "seller", r4("signal").alias("signal"))


@query(f"""WITH {QUOTES} SELECT a.seller AS left_seller, b.seller AS right_seller, count(*) AS common_items FROM quotes a JOIN quotes b ON a.item = b.item AND a.seller < b.seller GROUP BY a.seller, b.seller""")
def seller_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For all pairs of sellers the number of items that both offer."""
    q = quotes(spark, d).select("item", "seller")
    a, b = q.withColumnRenamed("seller", "left_seller"), q.withColumnRenamed("seller", "right_seller")
    return a.join(b, "item").filter("left_seller < right_seller").groupBy("left_seller", "right_seller").agg(F.count("*").alias("common_items"))


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || '42'), c_custkey) AS rn FROM customer) WHERE rn <= 100""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows without replacement, the same for the same seed."""
    return read(spark, d, "customer").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("42"))), "c_custkey").limit(100).select("c_custkey")


@query("""WITH q AS (SELECT source_id, sheet, row_number, count(*) AS issues, array_to_string(list_sort(list(DISTINCT row_type)), ',') AS kinds FROM item_records WHERE bid_amount IS NULL GROUP BY ALL)
SELECT i.item_id, coalesce(q.issues, 0) AS issues, coalesce(q.kinds, '') AS kinds FROM item_records i LEFT JOIN q ON i.source_id = q.source_id AND i.sheet = q.sheet AND i.row_number = q.row_number""")
def attached_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of a sheet row, attached to its item."""
    rows = read(spark, d, "item_records")
    keys = ["source_id", "sheet", "row_number"]
    q = rows.filter("bid_amount is null").groupBy(*keys).agg(F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_set("row_type")), ",").alias("kinds"))
    return rows.join(q, keys, "left").select("item_id", F.coalesce("issues", F.lit(0).cast("long")).alias("issues"), F.coalesce("kinds", F.lit("")).alias("kinds"))


@query("""SELECT ref_id, 'REF-' || row_number() OVER (PARTITION BY source ORDER BY price DESC, ref_id, loaded_at) AS alias FROM price_references""")
def anonymous_references(spark: SparkSession, d: str) -> DataFrame:
    """References numbered by rank within their source instead of named."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy(F.desc("price"), "ref_id", "loaded_at")
    return read(spark, d, "price_references").select("ref_id", F.concat(F.lit("REF-"), F.row_number().over(w).cast("string")).alias("alias"))


@query("""SELECT p_partkey, 1 AS table_no, r AS row_no, CASE r WHEN 1 THEN 'Tên|Loại' ELSE p_name || '|' || p_type END AS line FROM part CROSS JOIN (SELECT unnest([1, 2]) AS r)""")
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an HTML table made of each part."""
    page = F.concat(F.lit("<p>x</p><table><tr><th>Tên<th>Loại</tr><tr><td> </td></tr><tr><td>"), "p_name", F.lit("</td><td>"), "p_type", F.lit("</td></tr></table>"))
    rows = tables.explode_html(read(spark, d, "part").select("p_partkey", page.alias("html")), "html")
    return rows.select("p_partkey", "table_no", "row_no", F.array_join("cells", "|").alias("line"))


@query("""SELECT p_partkey, 1 AS table_no, r AS row_no, CASE r WHEN 1 THEN 'a|b' ELSE p_name || '|' || p_type END AS line FROM part CROSS JOIN (SELECT unnest([1, 2]) AS r)""")
def markdown_table_rows(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("intro\n| a | b |\n|---|---|\n| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\nend"))
    rows = tables.explode_markdown(read(spark, d, "part").select("p_partkey", page.alias("md")), "p_partkey", "md")
    return rows.select("p_partkey", "table_no", "row_no", F.array_join("cells", "|").alias("line"))


@query(f"""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, {sql4('min(value)')} AS least, {sql4('max(value)')} AS most FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows over the event stream, here as a batch."""
    w = windows.windowed_spread(read(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r4("least").alias("least"), r4("most").alias("most"))


@query("""SELECT item_id, len(list_filter(['stt', 'name', 'unit'], lambda x: (x = 'stt' AND coalesce(trim(stt), '') <> '') OR (x = 'name' AND coalesce(trim(item_name), '') <> '') OR (x = 'unit' AND coalesce(trim(unit), '') <> ''))) AS filled FROM item_records""")
def filled_cells(spark: SparkSession, d: str) -> DataFrame:
    full = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("long")
    return read(spark, d, "item_records").select("item_id", (full("stt") + full("item_name") + full("unit")).alias("filled"))


@query()
def bidder_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and name, each linked to the next two in size; no two of one size class fall together."""
    from pyspark.sql.window import Window

    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    w = Window.partitionBy("p_name", "p_brand").orderBy("p_size", "p_partkey")
    near = [p.select("p_name", "p_brand", F.col("p_partkey").alias("a"), F.lead("p_partkey", i).over(w).alias("b"), (1 - (F.lead("p_size", i).over(w) - F.col("p_size")) / 100).alias("score")) for i in (1, 2)]
    edges = near[0].union(near[1]).filter("b is not null and score < 1")
    return matching.constrained_clusters(edges, p.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("string").alias("bidder")), within=["p_name", "p_brand"])


@query("""SELECT item_id, lower(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(sheet, ''))), 'đ', 'd'), '[^0-9a-z]+', ' ', 'g'), '^ +| +$', '', 'g')) AS sheet_key FROM item_records""")
def sheet_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").select("item_id", text.strip_accents(text.normalize_text(F.coalesce("sheet", F.lit("")))).alias("sheet_key"))


def line_items(spark: SparkSession, d: str, role: str) -> DataFrame:
    """Rows of one role in their latest state, as line items."""
    rows = peers.first_per_key(read(spark, d, "item_records").filter(F.col("role") == role), ["source_id", "sheet", "row_number"], F.desc("loaded_at"), F.desc("item_id"))
    return rows.withColumn("path", F.coalesce("section_path", F.array().cast("array<string>"))).withColumnRenamed("item_id", "id")


@query()
def document_matches(spark: SparkSession, d: str) -> DataFrame:
    """The invitation's rows matched one to one with the bids' rows through the whole cascade."""
    return documents.match_documents(line_items(spark, d, "HSMT"), line_items(spark, d, "HSDT")).select("id_r", "id_b", "kind", r4("score").alias("score"))


@query()
def peer_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Items that several bidders offer, without a reference document."""
    states = read(spark, d, "item_records").filter("role = 'HSDT'").withColumn("path", F.lit(None).cast("array<string>")).withColumnRenamed("item_id", "id")
    return documents.peer_catalogue(states, ["source_id", "sheet", "row_number"], "loaded_at").select("cluster", "bidders", "item_name", "unit", "representative")
