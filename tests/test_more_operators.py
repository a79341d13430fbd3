import numpy as np
from pyspark.sql import functions as F

from bidloom.operators import compare, forest, readings, retrieval
from bidloom.sources import prices
from bidloom.streaming import windows


def test_number_rules(spark):
    rows = [(1, 100.0, 100.0), (2, 100.0, 108.0), (3, 100.0, 135.0), (4, None, None), (5, None, 1.0), (6, 0.0, 5.0), (7, 0.0, 0.0), (7, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, q_ref double, q_bid double")
    got = {r.id: (r.severity, None if r.pct is None else round(r.pct, 3)) for r in compare.numbers(df, ["id"], [compare.NumberSpec("q")]).collect()}
    assert got == {2: ("warning", 0.08), 3: ("critical", 0.35), 5: ("review", None), 6: ("warning", None)}
    capped = compare.numbers(df, ["id"], [compare.NumberSpec("q", cap="warning")]).collect()
    assert {r.severity for r in capped} == {"warning", "review"}
    assert [r.severity for r in compare.numbers(df.filter("id = 6"), ["id"], [compare.NumberSpec("q", critical_abs=5.0)]).collect()] == ["critical"]
    assert df.limit(0).transform(lambda d: compare.numbers(d, ["id"], [compare.NumberSpec("q")])).count() == 0


def test_text_and_map_rules(spark):
    df = spark.createDataFrame([(1, "Cáp điện", "cáp  điện", {"Màu ": "đỏ"}, {"màu": "xanh", "IP": "54"}), (2, "Cáp điện", "Máy bơm chìm", None, None), (3, "x", None, {}, {"a": None})], "id int, n_ref string, n_bid string, a map<string,string>, b map<string,string>")
    got = {r.id: r.severity for r in compare.texts(df, ["id"], [compare.TextSpec("n")]).collect()}
    assert got == {2: "warning", 3: "review"}
    m = sorted((r.id, r.label, r.base, r.value) for r in compare.maps(df, ["id"], "a", "b").collect())
    assert m == [(1, "ip", None, "54"), (1, "mau", "đỏ", "xanh"), (3, "a", None, None)]
    assert [r[0] for r in spark.createDataFrame([("1,5",), ("5 mm",), ("1/2",), (None,)], "v string").select(compare.simple_number(F.col("v"))).collect()] == [1.5, None, None, None]
    assert spark.createDataFrame([("review",), ("critical",), ("ok",)], "s string").agg(compare.worst(F.col("s"))).first()[0] == "critical"


def test_wordings(spark):
    df = spark.createDataFrame([(1, "a", "Cáp điện"), (1, "b", "cap dien"), (1, "c", "Máy bơm"), (1, "d", None), (1, "e", " ")], "g int, s string, v string")
    assert sorted((r.wording, r.sellers) for r in compare.disagreeing_texts(df, ["g"], "s", "v").collect()) == [("cap dien", 2), ("may bom", 1)]


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))] + [(999, 9.0, -9.0), (1000, None, 0.1)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = forest.outlier_signal(forest.isolation_scores(df, "id", ["x", "y"], trees=60)).orderBy(F.desc("isolation")).collect()
    assert out[0].id == 999 and out[0].signal == 1.0 and len(out) == 302
    assert forest.isolation_scores(df.limit(5), "id", ["x", "y"]).filter("isolation is null").count() == 5


def test_readings(spark):
    c = spark.createDataFrame([(1, "q", 10.0, 0.9), (1, "q", 16.0, 0.95), (1, "p", 5.0, 0.9), (1, "a", 50.0, 0.8), (1, "a", None, 0.99), (2, "q", 1.0, 0.9)], "r int, field string, value double, confidence double")
    got = readings.reconcile(c, "r").collect()
    assert [(g.r, g.quantity, g.amount, g.accepted) for g in got] == [(1, 10.0, 50.0, True)]
    cells = spark.createDataFrame([("d", 1, "12", 0.5), ("d", 2, "abc", 0.85), ("d", 3, None, 0.1)], "d string, i int, text string, confidence double")
    s = readings.document_summary(cells, "d").first()
    assert (s.cells, s.blank, s.doubtful) == (3, 1, 2)


def test_lookup(spark):
    refs = spark.createDataFrame([("r1", "Cáp điện đồng 4x10", "m"), ("r2", "Cáp điện nhôm", "mét"), ("r3", "Cáp điện đồng 4x10", "cái"), ("r4", None, "m"), ("r5", "Ống thép", None)], "ref_id string, description string, unit string")
    q = spark.createDataFrame([("q1", "cap dien dong 4x10", "md"), ("q2", None, "m")], "query_id string, description string, unit string")
    got = [(r.query_id, r.ref_id, r.place) for r in retrieval.lookup(q, refs, "query_id", "ref_id").orderBy("place").collect()]
    assert got == [("q1", "r1", 1), ("q1", "r2", 2)]
    assert retrieval.lookup(q, refs.limit(0), "query_id", "ref_id").count() == 0


def test_requirements(spark):
    items = spark.createDataFrame([(1, "Máy bơm nước ly tâm"), (2, "Không liên quan"), (3, None)], "item_id long, name string")
    asked = spark.createDataFrame([(10, "bơm nước ly tâm"), (11, "quạt")], "requirement_id long, wanted string")
    assert [(r.item_id, r.requirement_id) for r in retrieval.best_requirement(items, asked, "item_id", "requirement_id", "name", "wanted").collect()] == [(1, 10)]


def test_price_files(spark, tmp_path):
    src = tmp_path / "p.csv"
    src.write_text('﻿ref_id,description,unit,price,observed_at,vat\nr1,"Cáp, đồng",m,"1.234,5",2024-05-01,10\nr2,x,m,0,,\n,y,m,5,,\n', encoding="utf-8")
    got = prices.read_references(spark, str(src)).collect()
    assert [(r.ref_id, r.description, r.price, r.metadata) for r in got] == [("r1", "Cáp, đồng", 1234.5, {"vat": "10"})]
    prices.write_references(prices.read_references(spark, str(src)), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    name, day = prices.name_and_date("f")
    rows = spark.createDataFrame([("/a/Công ty X_2024-05-12.xlsx",), ("HACO 3.5.2023.xls",), ("plain.xlsx",)], "f string")
    assert [(r[0], str(r[1])) for r in rows.selectExpr(name, day).collect()] == [("Công ty X", "2024-05-12"), ("HACO", "2023-05-03"), ("plain", "None")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 05:00:00", "a", 9.0)], "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windows.windowed_spread(stream, "ts", "k", "v").writeStream.outputMode("append").format("memory").queryName("spread").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.least, r.most) for r in spark.sql("select * from spread").collect()] == [(2, 1.0, 3.0)]


def test_names_and_choices(spark):
    assert retrieval.names_agree("Công ty Cadivi", "CADIVI") and retrieval.names_agree("Schneidr Electric", "Schneider Electric") and not retrieval.names_agree("LS", "Cadivi") and not retrieval.names_agree("", "x")
    df = spark.createDataFrame([(1, "Đức", ["EU", "Nhật Bản"]), (2, "nhat ban", ["EU", "Nhật Bản"]), (3, "Trung Quốc", ["EU", None]), (4, "Ý", None), (5, None, ["EU"])], "id int, origin string, choices array<string>")
    got = {r.id: r.ok for r in df.select("id", retrieval.allowed("origin", "choices", {"EU": ["Đức", "Ý"]}).alias("ok")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None, 5: False}


def test_word_scores(spark):
    from bidloom.functions import number, text

    df = spark.createDataFrame([("Khối lượng đơn giá a b và của",), (None,)], "t string")
    got = [r[0] for r in df.select(text.keyword_score(F.col("t"), {"luong": 3, "gia": 4}, ["va", "cua"])).collect()]
    assert got == [7, None] or got[0] == 7
    assert df.select(text.content_tokens(F.col("t"), ["va"])).first()[0] == ["khoi", "luong", "don", "gia", "cua"]
    assert df.select(text.retrieval_text(F.lit("Cáp điện"), F.lit("mét"))).first()[0] == "cap dien | unit:m"
    assert spark.createDataFrame([("1,5",), ("-2",), ("x",)], "v string").select(number.positive(F.col("v"))).collect() == [(1.5,), (None,), (None,)]
