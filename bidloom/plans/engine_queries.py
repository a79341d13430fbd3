"""Queries of the comparison engine's operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import number, similarity, text
from bidloom.functions.number import half_up
from bidloom.operators import matching, ordered, peers
from bidloom.plans.registry import query, read

QUOTES = """
quotes AS (SELECT l_partkey AS item, l_suppkey AS seller, price FROM (
  SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS price,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
  FROM lineitem WHERE l_quantity > 0) WHERE rn = 1)
"""


def r4(c) -> F.Column:
    return half_up(F.col(c) if isinstance(c, str) else c, 4)


def sql4(x: str) -> str:
    return f"floor(({x}) * 10000.0e0 + 0.5e0) / 10000.0e0"


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """The first price that each supplier asked for each part."""
    rows = read(spark, d, "lineitem").filter("l_quantity > 0").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("seller"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_shipdate", "l_orderkey", "l_linenumber")
    return peers.first_per_key(rows, ["item", "seller"], F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select("item", "seller", "price")


@query(f"""WITH {QUOTES}, s AS (SELECT item, count(*) AS offers, min(price) AS least, max(price) AS most, median(price) AS middle,
  (min_by(seller, (price, seller))) AS lowest, (min_by(seller, (-price, seller))) AS highest FROM quotes GROUP BY item HAVING count(*) >= 2)
SELECT item, offers, {sql4('least')} AS least, {sql4('most')} AS most, {sql4('middle')} AS middle, lowest, highest,
  {sql4('CASE WHEN (abs(most) + abs(least)) / 2 = 0 THEN 0 ELSE (most - least) / ((abs(most) + abs(least)) / 2) END')} AS spread FROM s""")
def peer_spread(spark: SparkSession, d: str) -> DataFrame:
    s = peers.spread(quotes(spark, d), ["item"], "seller", "price")
    return s.select("item", "offers", r4("least").alias("least"), r4("most").alias("most"), r4("middle").alias("middle"), "lowest", "highest", r4("spread").alias("spread"))


@query(f"""WITH {QUOTES}, m AS (SELECT item, median(price) AS middle, count(*) AS offers FROM quotes WHERE price >= 0 GROUP BY item HAVING count(*) >= 3),
a AS (SELECT q.item, median(abs(price - middle)) AS mad FROM quotes q JOIN m ON q.item = m.item GROUP BY q.item)
SELECT q.item, q.seller, {sql4('middle')} AS middle, {sql4('mad')} AS mad,
  {sql4('CASE WHEN middle = 0 THEN 0 ELSE (price - middle) / CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE greatest(0.01e0 * abs(middle), 1.0e0) END END')} AS z
FROM quotes q JOIN m ON q.item = m.item JOIN a ON q.item = a.item""")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    z = peers.robust_z(quotes(spark, d), ["item"], "price")
    return z.select("item", "seller", r4("middle").alias("middle"), r4("mad").alias("mad"), r4("z").alias("z"))


@query(f"""WITH {QUOTES}, c AS (SELECT item, s_nationkey AS seller, max(price) AS v FROM quotes JOIN supplier ON seller = s_suppkey GROUP BY item, s_nationkey)
SELECT item, {', '.join(f"{sql4(f'max(CASE WHEN seller = {i} THEN v END)')} AS s{i}" for i in range(25))},
  {sql4('min(v)')} AS least, {sql4('median(v)')} AS middle, {sql4('max(v)')} AS most,
  {sql4('CASE WHEN (abs(max(v)) + abs(min(v))) / 2 = 0 THEN 0 ELSE (max(v) - min(v)) / ((abs(max(v)) + abs(min(v))) / 2) END')} AS spread FROM c GROUP BY item""")
def price_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every part's prices by the nation of the supplier, side by side; there are 25 nations at any size."""
    m = peers.matrix(national_quotes(spark, d), ["item"], "seller", "price", list(range(25)))
    return m.select("item", *[r4(F.col(str(i))).alias(f"s{i}") for i in range(25)], *[r4(c).alias(c) for c in ("least", "middle", "most", "spread")])


def national_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with the supplier's nation as the seller."""
    nation = read(spark, d, "supplier").select(F.col("s_suppkey").alias("seller"), F.col("s_nationkey").alias("nation"))
    return quotes(spark, d).join(nation, "seller").select("item", F.col("nation").alias("seller"), "price")


@query(f"""WITH {QUOTES}, s AS (SELECT item, median(price) AS middle, count(price) AS offers FROM quotes GROUP BY item)
SELECT q.item, q.seller, {sql4('price')} AS price, {sql4('CASE WHEN offers >= 2 AND middle <> 0 THEN (price - middle) / middle END')} AS deviation FROM quotes q JOIN s ON q.item = s.item""")
def consolidated_quote(spark: SparkSession, d: str) -> DataFrame:
    return peers.consolidated(quotes(spark, d), ["item"], "seller", "price").select("item", "seller", r4("price").alias("price"), r4("deviation").alias("deviation"))


@query(f"""WITH {QUOTES} SELECT item, count(*) AS n, {sql4('min(price)')} AS least, {sql4('max(price)')} AS most, {sql4('median(price)')} AS middle, {sql4('avg(price)')} AS mean,
  floor(quantile_cont(price, 0.25) * 10000.0e0 + 0.500001e0) / 10000.0e0 AS q1, floor(quantile_cont(price, 0.75) * 10000.0e0 + 0.500001e0) / 10000.0e0 AS q3 FROM quotes WHERE price > 0 GROUP BY item""")
def price_stats(spark: SparkSession, d: str) -> DataFrame:
    s = peers.price_stats(quotes(spark, d), ["item"], "price")
    return s.select("item", "n", *[r4(c).alias(c) for c in ("least", "most", "middle", "mean")], *[(F.floor(F.col(c) * 10000.0 + 0.500001) / 10000.0).alias(c) for c in ("q1", "q3")])


@query(f"""WITH s AS (SELECT unit, min(price) AS a, max(price) AS b, avg(price) AS m FROM price_references WHERE price > 0 AND unit IS NOT NULL GROUP BY unit),
e AS (SELECT unit, a, b, greatest(0.05e0, least(0.25e0, 0.2e0 * (b - a) / m)) AS w FROM s)
SELECT unit, {sql4('greatest(a * (1 - w), least(a / 2, b * (1 + w)))')} AS low, {sql4('greatest(a * (1 - w), least(b * 2, b * (1 + w)))')} AS high FROM e""")
def clamp_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of half the least to twice the most price, clamped to what the spread of the references allows."""
    s = read(spark, d, "price_references").filter("price > 0 and unit is not null").groupBy("unit").agg(F.min("price").alias("a"), F.max("price").alias("b"), F.avg("price").alias("m"))
    w = F.greatest(F.lit(0.05), F.least(F.lit(0.25), 0.2 * (F.col("b") - F.col("a")) / F.col("m")))
    low, high = number.clamp(F.col("a") / 2, F.col("b") * 2, F.col("a") * (1 - w), F.col("b") * (1 + w))
    return s.select("unit", r4(low).alias("low"), r4(high).alias("high"))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) > 1")
def conflicting_codes(spark: SparkSession, d: str) -> DataFrame:
    return peers.conflicting_codes(read(spark, d, "part"), ["p_brand"], "p_name")


@query("SELECT source_id, sheet, row_number, count(*) AS n FROM item_records GROUP BY source_id, sheet, row_number HAVING count(*) > 1")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return peers.repeated_keys(read(spark, d, "item_records"), ["source_id", "sheet", "row_number"])


@query("""SELECT source_id, sheet, row_number, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, sheet, row_number ORDER BY loaded_at DESC, item_id DESC) AS rn FROM item_records) WHERE rn = 1""")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were read twice, in their latest state."""
    return peers.first_per_key(read(spark, d, "item_records"), ["source_id", "sheet", "row_number"], F.desc("loaded_at"), F.desc("item_id")).select("source_id", "sheet", "row_number", "item_id")


@query("""SELECT ref_id, price FROM price_references WHERE ref_id NOT IN (SELECT ref_id FROM price_references WHERE source_type = 'manual')
UNION ALL SELECT ref_id, price * 2 AS price FROM price_references WHERE source_type = 'manual'""")
def upsert_references(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "price_references")
    new = rows.filter("source_type = 'manual'").select("ref_id", (F.col("price") * 2).alias("price"))
    return peers.upsert(rows.select("ref_id", "price"), new, ["ref_id"])


@query("""WITH e AS (SELECT p_type, lower(trim(p_name)) AS k, count(*) AS votes, min(p_partkey) AS first, min_by(p_name, (-length(p_name), p_name)) AS value FROM part WHERE trim(p_name) <> '' GROUP BY ALL)
SELECT p_type, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY votes DESC, first) AS rn FROM e) WHERE rn = 1""")
def consensus_value(spark: SparkSession, d: str) -> DataFrame:
    return peers.consensus(read(spark, d, "part"), ["p_type"], "p_name", "p_partkey")


@query("""SELECT section, item_id FROM (SELECT sheet AS section, item_id, row_number() OVER (PARTITION BY sheet ORDER BY coalesce(length(item_name), 0) DESC, (coalesce(item_code, '') <> '') DESC, item_id) AS rn FROM item_records WHERE sheet IS NOT NULL) WHERE rn = 1""")
def representative_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").filter("sheet is not null")
    return peers.representative(rows.withColumn("section", F.col("sheet")), ["section"], "item_id", "item_name", "item_code").select("section", "item_id")


@query(f"""SELECT bidder, count(*) AS rows_, {sql4('sum(coalesce(bid_amount, bid_quantity * unit_price_total))')} AS total FROM (SELECT DISTINCT ON (bidder, source_id, sheet, row_number) * FROM item_records WHERE row_type = 'detail' ORDER BY bidder, source_id, sheet, row_number, item_id) GROUP BY bidder""")
def bidder_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").filter("row_type = 'detail'")
    one = peers.first_per_key(rows, ["bidder", "source_id", "sheet", "row_number"], F.col("item_id"))
    return one.groupBy("bidder").agg(F.count("*").alias("rows_"), r4(F.sum(number.amount(F.col("bid_quantity"), F.col("unit_price_total"), F.col("bid_amount")))).alias("total"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (WHERE row_type = 'detail') AS details, count(*) FILTER (WHERE row_type = 'component') AS components, count(*) FILTER (WHERE row_type = 'group') AS groups_,
 count(*) FILTER (WHERE row_type = 'detail' AND bid_quantity IS NULL) AS no_quantity, count(*) FILTER (WHERE row_type = 'detail' AND unit_price_total IS NULL) AS no_price FROM item_records GROUP BY role""")
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    detail = F.col("row_type") == "detail"
    return read(spark, d, "item_records").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(detail).alias("details"), F.count_if(F.col("row_type") == "component").alias("components"), F.count_if(F.col("row_type") == "group").alias("groups_"),
        F.count_if(detail & F.col("bid_quantity").isNull()).alias("no_quantity"), F.count_if(detail & F.col("unit_price_total").isNull()).alias("no_price"),
    )


@query("""SELECT DISTINCT source_id, sheet, row_number, flag FROM (SELECT source_id, sheet, row_number, unnest(list_filter([CASE WHEN bid_quantity IS NULL THEN 'no quantity' END, CASE WHEN unit_price_total IS NULL THEN 'no price' END,
 CASE WHEN abs(bid_quantity * unit_price_total - bid_amount) / greatest(abs(bid_quantity * unit_price_total), abs(bid_amount), 1.0e0) > 0.005e0 THEN 'product' END], lambda x: x IS NOT NULL)) AS flag FROM item_records WHERE row_type = 'detail')""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags per row: what is missing and products that don't come out."""
    q, p, a = F.col("bid_quantity"), F.col("unit_price_total"), F.col("bid_amount")
    flags = F.array(F.when(q.isNull(), "no quantity"), F.when(p.isNull(), "no price"), F.when(number.product_error(q, p, a).isNotNull(), "product"))
    return read(spark, d, "item_records").filter("row_type = 'detail'").select("source_id", "sheet", "row_number", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("flag")).distinct()


@query(f"""SELECT item_id, {sql4('CASE WHEN reference_quantity <> 0 THEN (bid_quantity - reference_quantity) / abs(reference_quantity) WHEN bid_quantity = 0 THEN 0 END')} AS delta,
 {sql4('CASE WHEN (abs(bid_quantity) + abs(reference_quantity)) / 2 = 0 THEN 0 ELSE (bid_quantity - reference_quantity) / ((abs(bid_quantity) + abs(reference_quantity)) / 2) END')} AS symmetric_delta
FROM item_records WHERE bid_quantity IS NOT NULL AND reference_quantity IS NOT NULL""")
def quantity_delta(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("reference_quantity"), F.col("bid_quantity")
    return read(spark, d, "item_records").filter("bid_quantity is not null and reference_quantity is not null").select("item_id", r4(number.pct_delta(a, b)).alias("delta"), r4(number.symmetric_pct(b, a)).alias("symmetric_delta"))


@query(f"""WITH c AS (SELECT item_id, unit_price_total AS t, CASE WHEN coalesce(price_main, price_aux, price_labor, price_management, price_profit) IS NOT NULL
 THEN 0.0e0 + coalesce(price_main, 0) + coalesce(price_aux, 0) + coalesce(price_labor, 0) + coalesce(price_management, 0) + coalesce(price_profit, 0) END AS s FROM item_records)
SELECT item_id, {sql4('coalesce(t, s)')} AS total, coalesce(abs(s - t) / greatest(abs(s), abs(t), 1.0e0) > 0.005e0, false) AS misses FROM c WHERE s IS NOT NULL""")
def component_check(spark: SparkSession, d: str) -> DataFrame:
    """Unit prices from their components, and whether they miss the given total."""
    s = number.sum_present(*[F.col(f"price_{c}") for c in ("main", "aux", "labor", "management", "profit")])
    rows = read(spark, d, "item_records").select("item_id", F.col("unit_price_total").alias("t"), s.alias("s")).filter("s is not null")
    misses = F.abs(F.col("s") - F.col("t")) / F.greatest(F.abs("s"), F.abs("t"), F.lit(1.0)) > 0.005
    return rows.select("item_id", r4(F.coalesce("t", "s")).alias("total"), F.coalesce(misses, F.lit(False)).alias("misses"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
SELECT l_orderkey, l_linenumber, cast(cents AS DOUBLE) / 100 AS vn, cast(cents AS DOUBLE) / 100 AS en, -cast(cents // 100 AS DOUBLE) AS bracketed FROM v""")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in Vietnamese, international and bracketed form, read back."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    whole, part = F.format_number(F.floor(F.col("cents") / 100), 0), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    en = F.concat(whole, F.lit("."), part)
    vn = F.concat(F.translate(whole, ",", "."), F.lit(","), part, F.lit(" VNĐ"))
    return rows.select("l_orderkey", "l_linenumber", number.parse_number(vn).alias("vn"), number.parse_number(en).alias("en"), number.parse_number(F.concat(F.lit("("), whole, F.lit(")"))).alias("bracketed"))


FOLD = "replace(strip_accents(lower({})), 'đ', 'd')"


PLAIN = "replace(replace(replace(replace(replace(replace(lower(text), '²', '2'), '³', '3'), '×', 'x'), 'ø', ' phi '), '^2', '2'), '^3', '3')"


@query(f"""SELECT doc_id, len(list_distinct(w)) AS words, md5(array_to_string(w, ' ')) AS folded FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace({FOLD.format(PLAIN)}, '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)})) AS w FROM documents WHERE text IS NOT NULL)""")
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents normalised to words without accents and stopwords."""
    rows = read(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.size(text.token_set(F.col("text"))).cast("long").alias("words"), F.md5(text.normalize_name(F.col("text"))).alias("folded"))


@query(r"""WITH c AS (SELECT item_id, item_code, regexp_replace(regexp_replace(regexp_replace(replace(upper(strip_accents(trim(item_code))), 'Đ', 'D'), '[\s_/\\.]+', '-', 'g'), '[^A-Z0-9-]', '', 'g'), '-+', '-', 'g') AS t FROM item_records WHERE item_code IS NOT NULL),
u AS (SELECT item_id, item_code, trim(t, '-') AS t FROM c)
SELECT item_id, CASE WHEN trim(item_code) LIKE '=%' THEN '' ELSE regexp_replace(t, '^([A-Z]+)-?([0-9]+)$', '\1-\2') END AS code FROM u""")
def normalized_code(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").filter("item_code is not null").select("item_id", text.normalize_code(F.col("item_code")).alias("code"))


@query(r"""SELECT item_id, CASE WHEN trim(stt) LIKE '=%' THEN '' ELSE trim(regexp_replace(upper(strip_accents(stt)), '[^A-Z0-9.-]', '', 'g'), '.-') END AS ordinal FROM item_records WHERE stt IS NOT NULL""")
def normalized_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").filter("stt is not null").select("item_id", text.normalize_ordinal(F.col("stt")).alias("ordinal"))


@query("SELECT item_id, 'PR-' || left(sha1(coalesce(bidder, '') || '|' || coalesce(workbook, '') || '|' || coalesce(cast(row_number AS VARCHAR), '')), 12) AS stable FROM item_records")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").select("item_id", text.stable_id("PR-", F.col("bidder"), F.col("workbook"), F.col("row_number")).alias("stable"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b(employer|designer|site manager)\b', '***', 'g')) AS masked FROM documents WHERE text IS NOT NULL")
def masked_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(text.mask_names(F.col("text"), ["employer", "designer", "site manager"])).alias("masked"))


@query(r"SELECT item_id, CASE WHEN regexp_matches(item_name, '^[=+\-@]') THEN '''' || item_name ELSE item_name END AS cell, left(regexp_replace(sheet, '[\[\]:*?/\\]', '_', 'g'), 31) AS sheet FROM item_records")
def safe_cells(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").select("item_id", text.safe_cell(F.col("item_name")).alias("cell"), text.safe_sheet_name(F.col("sheet")).alias("sheet"))


@query(f"""WITH t AS (SELECT p_partkey AS a, lead(p_partkey) OVER w AS b, list_distinct(string_split(lower(p_name), ' ')) AS wa, list_distinct(string_split(lower(lead(p_name) OVER w), ' ')) AS wb FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey))
SELECT a, b, {sql4('len(list_intersect(wa, wb))::DOUBLE / greatest(len(list_distinct(list_concat(wa, wb))), 1)')} AS score FROM t WHERE b IS NOT NULL""")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of each part's name and the next one's of its brand and type."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    t = read(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b"), words(F.col("p_name")).alias("wa"), words(F.lead("p_name").over(w)).alias("wb"))
    return t.filter("b is not null").select("a", "b", r4(similarity.jaccard(F.col("wa"), F.col("wb"))).alias("score"))


@query(f"""WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS hit, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT query_id, hit, place, {sql4('c')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(c * 100000000.0e0 + 0.5e0) DESC, hit)::INTEGER AS place FROM s) WHERE place <= 5""")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of the same label, for every query (ids divisible by 50) against all rows."""
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), "label")
    s = q.join(e.select(F.col("vec_id").alias("hit"), "embedding", "label"), "label").filter("query_id <> hit").withColumn("c", similarity.cosine(F.col("qe"), F.col("embedding")))
    return peers.top_per_group(s, ["query_id"], 5, F.desc(F.floor(F.col("c") * 100000000.0 + 0.5)), F.col("hit")).select("query_id", "hit", "place", r4("c").alias("similarity"))


@query("""WITH l AS (SELECT p_partkey AS a, p_size AS at, p_brand FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS b, p_size AS at, p_brand FROM part WHERE p_partkey % 2 = 1)
SELECT a, b, distance, nearness FROM (SELECT a, b, abs(l.at - r.at) AS distance, row_number() OVER (PARTITION BY a ORDER BY abs(l.at - r.at), b)::INTEGER AS nearness FROM l JOIN r ON l.p_brand = r.p_brand AND abs(l.at - r.at) <= 3) WHERE nearness <= 8""")
def nearest_row(spark: SparkSession, d: str) -> DataFrame:
    """Odd parts near each even part in size, within the brand (the two halves stand for two documents)."""
    p = read(spark, d, "part")
    l = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("left_at"), "p_brand")
    r = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), F.col("p_size").alias("right_at"), "p_brand")
    return matching.nearest_rows(l, r, ["p_brand"], "left_at", "right_at", "b", reach=3, k=8).select("a", "b", "distance", "nearness")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_type, p_brand ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_type, p_brand ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1)
SELECT l.p_partkey AS a, r.p_partkey AS b FROM l JOIN r ON l.p_name = r.p_name AND l.p_type = r.p_type AND l.p_brand = r.p_brand AND l.k = r.k""")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches of two documents (even and odd parts) by equal name, type and brand."""
    l, r = _halves(spark, d)
    return matching.match_by_keys(l, r, "a", "b", ["p_name", "p_type", "p_brand"], F.lit(1.0), on=([], [])).select("a", "b")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "a"), p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "b").withColumnRenamed("p_size", "size_b")


@query()
def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Stages from strict to loose; each matches one to one what earlier ones left."""
    l, r = _halves(spark, d)
    gap = F.abs(F.col("p_size") - F.col("size_b"))
    stages = [("exact", ["p_name", "p_type", "p_brand"], 0.99 - gap / 1000), ("name_brand", ["p_name", "p_brand"], 0.9 - gap / 1000), ("name", ["p_name"], 0.8 - gap / 1000)]
    return matching.staged_matches(l, r, "a", "b", stages, on=(["p_size"], ["size_b"]))


@query("""SELECT p_partkey AS key, 'missing' AS kind FROM part p WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 1 AND q.p_name = p.p_name AND q.p_brand = p.p_brand)
UNION ALL SELECT p_partkey, 'extra' FROM part p WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_name = p.p_name AND q.p_brand = p.p_brand)""")
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    l, r = _halves(spark, d)
    both = l.select("a", "p_name", "p_brand").join(r.select("b", "p_name", "p_brand"), ["p_name", "p_brand"]).select("a", "b")
    return matching.unmatched(both, l, r, "a", "b")


GRAMS = "list_concat(" + ", ".join(f"CASE WHEN length(w) <= {n} THEN CASE WHEN greatest(length(w), 3) = {n} THEN [w] ELSE [] END ELSE list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) END" for n in (3, 4, 5)) + ")"


@query(rf"""WITH t AS (SELECT description, min(ref_id) AS first_id, count(*) AS many FROM price_references WHERE description IS NOT NULL GROUP BY description),
w AS (SELECT first_id, many, ' ' || unnest(list_filter(regexp_split_to_array(lower(description), '\s+'), lambda x: x <> '')) || ' ' AS w FROM t),
e AS (SELECT first_id, gram, count(*) AS c, min(many) AS many FROM (SELECT first_id, many, unnest({GRAMS}) AS gram FROM w) GROUP BY first_id, gram),
f AS (SELECT gram, sum(many)::DOUBLE AS df FROM e GROUP BY gram), n AS (SELECT sum(many)::DOUBLE AS n FROM t),
r AS (SELECT first_id, e.gram, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM e JOIN f ON e.gram = f.gram CROSS JOIN n),
v AS (SELECT r.first_id, gram, w / l AS w FROM r JOIN (SELECT first_id, sqrt(sum(w * w)) AS l FROM r GROUP BY first_id) s ON r.first_id = s.first_id),
m AS (SELECT ref_id, first_id FROM price_references p JOIN t ON p.description = t.description), a AS (SELECT * FROM m WHERE right(ref_id, 7)::BIGINT % 50 = 0),
s AS (SELECT q.first_id AS query_text, v.first_id, sum(q.w * v.w) AS similarity FROM v q JOIN v ON q.gram = v.gram WHERE q.first_id IN (SELECT first_id FROM a) GROUP BY q.first_id, v.first_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY floor(similarity * 1e9) DESC, first_id) AS place FROM s)
SELECT a.ref_id AS query_id, m.ref_id, {sql4('similarity')} AS similarity FROM a JOIN k ON a.first_id = k.query_text JOIN m ON k.first_id = m.first_id WHERE place <= 6 AND a.ref_id <> m.ref_id""")
def char_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every fiftieth price reference the other ones with its own or the five most similar other texts by character n-grams under TF-IDF; weights are counted over all rows."""
    return nearest_texts(read(spark, d, "price_references").select("ref_id", "description"))


def nearest_texts(rows: DataFrame) -> DataFrame:
    """Distinct texts are compared, each with its number of rows; every row then stands for its text. Equal similarities: the text with the smaller first id."""
    texts = rows.filter("description is not null").groupBy("description").agg(F.min("ref_id").alias("first_id"), F.count("*").alias("rows"))
    members = rows.join(texts, "description").select("ref_id", "first_id")
    v = similarity.tfidf_vectors(texts, "first_id", "description", rows="rows")
    asked = members.filter(F.substring("ref_id", -7, 7).cast("long") % 50 == 0).withColumnRenamed("ref_id", "query_id")
    q = v.join(asked.select("first_id").distinct(), "first_id", "left_semi").withColumnRenamed("first_id", "query_text")
    top = matching.top_similar(q, v, "query_text", "first_id", k=6, blocks=1 + texts.count() // 15_000)
    hits = asked.withColumnRenamed("first_id", "query_text").join(top, "query_text").join(members, "first_id")
    return hits.filter("query_id <> ref_id").select("query_id", "ref_id", r4("similarity").alias("similarity"))


@query(f"""WITH {QUOTES}, c AS (SELECT DISTINCT item, s_nationkey AS seller FROM quotes JOIN supplier ON seller = s_suppkey)
SELECT i.item AS cluster, n_nationkey AS seller, c.item IS NOT NULL AS present FROM (SELECT DISTINCT item FROM c) i CROSS JOIN nation LEFT JOIN c ON c.item = i.item AND c.seller = n_nationkey""")
def completion(spark: SparkSession, d: str) -> DataFrame:
    """Every part with every nation, offered from there or not."""
    sellers = read(spark, d, "nation").select(F.col("n_nationkey").alias("seller"))
    return peers.completion(national_quotes(spark, d).withColumnRenamed("item", "cluster"), "cluster", "seller", sellers)


@query("""SELECT source_id, sheet, row_number, item_id, last_value(CASE WHEN row_type = 'group' THEN item_name END IGNORE NULLS) OVER (PARTITION BY source_id, sheet ORDER BY row_number, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM item_records""")
def carried_section(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").withColumn("at", F.struct("row_number", "item_id"))
    return ordered.carry_down(rows, ["source_id", "sheet"], "at", F.when(F.col("row_type") == "group", F.col("item_name")), "section").select("source_id", "sheet", "row_number", "item_id", "section")


@query("""WITH g AS (SELECT item_id, source_id, sheet, row_number, row_type, sum(CASE WHEN row_type IN ('group', 'summary') THEN 1 ELSE 0 END) OVER w AS seg FROM item_records WINDOW w AS (PARTITION BY source_id, sheet ORDER BY row_number, item_id ROWS UNBOUNDED PRECEDING))
SELECT item_id, CASE WHEN row_type = 'component' THEN last_value(CASE WHEN row_type = 'detail' THEN row_number END IGNORE NULLS) OVER (PARTITION BY source_id, sheet, seg ORDER BY row_number, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM g QUALIFY parent IS NOT NULL""")
def component_parent(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").withColumn("at", F.struct("row_number", "item_id"))
    kind = F.col("row_type")
    out = ordered.parent_row(rows, ["source_id", "sheet"], "at", kind == "detail", kind.isin("group", "summary"), kind == "component")
    return out.select("item_id", F.col("parent.row_number").alias("parent")).filter("parent is not null")


@query("""WITH b AS (SELECT item_id, source_id, sheet, row_number, coalesce(trim(brand), '') = '' AS blank FROM item_records), g AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, sheet ORDER BY row_number, item_id ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT item_id, cast(sum(blank::INT) OVER (PARTITION BY source_id, sheet, g ORDER BY row_number, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""")
def blank_streak(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "item_records").withColumn("at", F.struct("row_number", "item_id"))
    return ordered.blank_streak(rows, ["source_id", "sheet"], "at", F.coalesce(F.trim("brand"), F.lit("")) == "").select("item_id", "streak")


@query("""WITH g AS (SELECT item_id, source_id, sheet, row_number, item_name, CASE WHEN row_type = 'group' THEN CASE WHEN upper(item_name) = item_name THEN 0 ELSE 1 END END AS lv, row_number * 1000000000::BIGINT + item_id AS pos FROM item_records),
w AS (SELECT item_id, max(CASE WHEN lv = 0 THEN pos END) OVER o AS a0, max(CASE WHEN lv = 1 THEN pos END) OVER o AS a1, last_value(CASE WHEN lv = 0 THEN item_name END IGNORE NULLS) OVER o AS t0, last_value(CASE WHEN lv = 1 THEN item_name END IGNORE NULLS) OVER o AS t1
 FROM g WINDOW o AS (PARTITION BY source_id, sheet ORDER BY row_number, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT item_id, array_to_string(list_filter([CASE WHEN a0 IS NOT NULL THEN t0 END, CASE WHEN a1 IS NOT NULL AND (a0 IS NULL OR a0 < a1) THEN t1 END], lambda x: x IS NOT NULL), ' > ') AS path FROM w""")
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    """Open sections at each row; a heading in capitals counts as level 0, any other as level 1."""
    rows = read(spark, d, "item_records").withColumn("at", F.struct("row_number", "item_id"))
    level = F.when(F.col("row_type") == "group", F.when(F.upper("item_name") == F.col("item_name"), 0).otherwise(1))
    return ordered.section_path(rows, ["source_id", "sheet"], "at", level, F.col("item_name"), levels=2).select("item_id", F.array_join("path", " > ").alias("path"))


@query(f"""WITH v AS (SELECT user_id, epoch_us(ts) / 1000000.0e0 AS x FROM events), n AS (SELECT user_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) <= 3600 THEN 0 ELSE 1 END AS new FROM v),
g AS (SELECT user_id, x, sum(new) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS line FROM n) SELECT user_id, cast(line AS BIGINT) AS line, {sql4('avg(x)')} AS mean, count(*) AS n FROM g GROUP BY user_id, line""")
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Positions (event times) that lie close together, as one line each."""
    v = read(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("x"))
    return ordered.merge_close(v, ["user_id"], "x", 3600).select("user_id", "line", r4("mean").alias("mean"), "n")


@query("""SELECT p_brand, count(*) AS n, cast(sum(levenshtein(lower(p_name), lower(p_type))) AS BIGINT) AS edits, cast(sum(greatest(length(p_type), 1)) AS BIGINT) AS letters, count(*) FILTER (WHERE lower(p_name) = lower(p_type)) AS exact FROM part GROUP BY p_brand""")
def character_error(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of a reading and the truth, summed up per group for a character error rate, and exact readings."""
    return read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.levenshtein(F.lower("p_name"), F.lower("p_type"))).alias("edits"), F.sum(F.greatest(F.length("p_type"), F.lit(1))).alias("letters"), F.count_if(F.lower("p_name") == F.lower("p_type")).alias("exact"))


@query(f"""WITH c AS (SELECT l_orderkey AS cell, lower(trim(l_returnflag)) AS k, l_returnflag AS t, l_discount AS conf, l_linestatus AS engine, l_linenumber AS variant FROM lineitem),
g AS (SELECT cell, k, count(DISTINCT engine) AS e, count(DISTINCT variant) AS v, max(conf) AS best, min_by(t, (-conf, t)) AS reading FROM c GROUP BY cell, k),
s AS (SELECT cell, reading, 2 * e + v AS agreement, least(0.999e0, best + least(0.16e0, 0.025e0 * (2 * e + v - 1))) AS score FROM g)
SELECT cell, reading, agreement, {sql4('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY agreement DESC, score DESC, length(reading) DESC, reading) AS rn FROM s) WHERE rn = 1""")
def reading_vote(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a cell by several engines and image variants, put to the vote."""
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("t"), F.col("l_discount").alias("conf"), F.col("l_linestatus").alias("engine"), F.col("l_linenumber").alias("variant"))
    return peers.vote(c, ["cell"], "t", "conf", "engine", "variant").select("cell", "reading", "agreement", r4("score").alias("score"))


@query("""SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS worst, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS reasons, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '; ') AS notes FROM orders GROUP BY o_custkey""")
def note_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).when(p == "4-NOT SPECIFIED", 1).otherwise(0)
    return peers.rollup_notes(read(spark, d, "orders").withColumn("rank", rank), ["o_custkey"], "rank", "o_orderpriority", "o_orderstatus")


@query(f"""WITH c AS (SELECT l_orderkey, l_returnflag AS field, l_extendedprice * (l_tax - l_discount) AS delta FROM lineitem)
SELECT l_orderkey, count(DISTINCT field) AS fields, min_by(field, (-abs(delta), field, delta)) AS largest_field, {sql4('min_by(delta, (-abs(delta), field, delta))')} AS largest_delta FROM c GROUP BY l_orderkey""")
def largest_change(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("field"), (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("delta"))
    return peers.largest_change(c, ["l_orderkey"], "field", "delta").withColumn("largest_delta", r4("largest_delta"))


@query("""SELECT requirement_id, len(list_filter(map_keys, lambda x: x IS NOT NULL)) AS n FROM (SELECT requirement_id, list_distinct(list_concat(coalesce(allowed_brands, []), coalesce(allowed_origins, []))) AS map_keys FROM material_requirements)""")
def union_of_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entries of two lists that may be null or hold nulls."""
    e = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("allowed_brands", e), F.coalesce("allowed_origins", e))
    return read(spark, d, "material_requirements").select("requirement_id", F.size(F.filter(both, lambda x: x.isNotNull())).cast("long").alias("n"))


@query("""SELECT item_id, k AS label, v AS value FROM (SELECT item_id, unnest(map_entries(technical_specs)) AS e FROM item_records WHERE technical_specs IS NOT NULL), LATERAL (SELECT e.key AS k, e.value AS v)""")
def technical_entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "item_records").select("item_id", F.explode("technical_specs").alias("label", "value"))
