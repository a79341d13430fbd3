from pyspark.sql import functions as F

from bidloom.operators import readings
from bidloom.sources import reports, requirements

ROWS = "workbook string, sheet string, row_number int, cells array<string>"


def test_requirement_sheets(spark):
    rows = [["PHỤ LỤC 2"], ["STT", "Tên vật tư", "Thương hiệu - xuất xứ", "Ghi chú"], [None, "Hệ thống điện", None], ["1", "Cáp", "Cadivi/LS; Taya - Việt Nam, Hàn Quốc", "x"], ["2", "Đèn", None], [None, "Hệ thống nước"], ["3", "Ống", "Tiền Phong"]]
    df = spark.createDataFrame([("w", "PL2 toà A", i, r) for i, r in enumerate(rows, 1)] + [("w", "Khác", 1, ["gì đó"])], ROWS)
    got = requirements.requirements(df).orderBy("row_number").collect()
    assert [(r.system, r.item_name, r.allowed_brands, r.allowed_origins, r.note) for r in got] == [("Hệ thống điện", "Cáp", ["Cadivi", "LS", "Taya"], ["Việt Nam", "Hàn Quốc"], "x"), ("Hệ thống nước", "Ống", ["Tiền Phong"], [], None)]
    assert requirements.requirements(df, ["phu luc"]).count() == 0 and requirements.requirements(df, ["toa a"]).count() == 2


def test_historical_quotes(spark):
    head = ["STT", "Nội dung", "ĐVT", "KL mời thầu", "Ghi chú", "KL nhà thầu", "Vật liệu", "Mã", "Thương hiệu", "Xuất xứ", "a", "b", "c", "d", "e", "Đơn giá", "Thành tiền BOQ"]
    line = ["1", "Cáp điện 4x10", "m", "5", None, "6", "Cu", "M1", "Cadivi", "VN", "1", "2", "3", "4", "5", "100.000", "600.000"]
    df = spark.createDataFrame([("w", "s", 6, head), ("w", "s", 8, line), ("w", "s", 9, [None, "HỆ THỐNG", "m", *line[3:]]), ("w", "s", 10, [*line[:15], None, None])], ROWS)
    got = requirements.historical_quotes(df).collect()
    assert [(r.description, r.unit, r.quantity, r.brand, r.price, r.amount, r.out_of_range) for r in got] == [("Cáp điện 4x10", "m", 6.0, "Cadivi", 100000.0, 600000.0, False)]


def test_reports(spark, tmp_path):
    df = spark.range(25).select("id", F.concat(F.lit("="), "id").alias("t"), F.array(*[F.lit(i) for i in range(12)]).alias("a"))
    p = reports.parts(df, ["id"], 10).groupBy("part").agg(F.count("*"), F.min("id")).orderBy("part").collect()
    assert [tuple(r) for r in p] == [(0, 10, 0), (1, 10, 10), (2, 5, 20)]
    assert reports.parts(df.limit(0), ["id"], 10).count() == 0
    reports.write_report({"x": df}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/x")).filter("t like \"'=%\"").count() == 25
    v = reports.preview(df, F.desc("id"), rows=3).collect()
    assert [r.id for r in v] == [24, 23, 22] and len(v[0].a) == 8
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_bytes(b"abc")
    assert reports.file_hashes(spark, str(tmp_path / "f")).first().source_id == "ba7816bf8f01cfea"
    reports.write_manifest(str(tmp_path / "m.json"), {"a": 1})
    reports.audit(spark, str(tmp_path / "log"), {"a": 1})
    reports.audit(spark, str(tmp_path / "log"), {"a": 2})
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_boxes_and_fields(spark):
    b = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0, 1000.0), ("p", 1.0, 15.0, 10.0, 20.0, 1000.0), ("p", 50.0, 15.0, 60.0, 20.0, 1000.0), ("p", 0.0, 300.0, 10.0, 310.0, 1000.0)], "page string, x0 double, y0 double, x1 double, y1 double, height double")
    assert sorted((r.x0, r.y1, r.n) for r in readings.merge_boxes(b, "page").collect()) == [(0.0, 20.0, 2), (0.0, 310.0, 1), (50.0, 20.0, 1)]
    s = spark.createDataFrame([("t", 0, "name", 9), ("t", 0, "unit", 8), ("t", 1, "name", 9), ("t", 2, "unit", 3)], "t string, col int, field string, score int")
    assert sorted((r.col, r.field) for r in readings.assign_fields(s, "t").collect()) == [(0, "name"), (2, "unit")]
    c = spark.createDataFrame([(1, "name", "Cáp", 0.9), (1, "q", "1,5", 0.7), (1, "q", "15", 0.6), (2, "q", "x", 0.8)], "r int, field string, text string, confidence double")
    got = {r.r: r for r in readings.assemble_rows(c, ["r"], ["name", "q"], ["q"], ["name"]).collect()}
    assert (got[1].q, got[1].flags, got[1].least_confidence) == (1.5, [], 0.6) and got[2].flags == ["missing name", "unreadable q"]
