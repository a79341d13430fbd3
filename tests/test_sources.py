import pytest

from bidloom.sources import sheets, tables, xlsx

HEADER = ["STT", "Mã hiệu", "Tên hạng mục", "ĐVT", "Khối lượng", "Đơn giá tổng hợp", "Thành tiền"]


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    legend = [f"[{i}]" for i in range(1, 8)]
    body = [["A", None, "HỆ THỐNG ĐIỆN", None, None, None, None], ["1", "M-01", "Cáp điện Cu/XLPE 4x10", "m", "1.000,5", 100, 100050], [None, None, "Phụ kiện", "bộ", 2, 5, 10], [None] * 7, ["II", None, "Chiếu sáng", None, None, None, None], ["2", "M-02", "Đèn LED", "cái", 3, "(10)", ("E7*F7", "#REF!")], [None, None, "Cộng", None, None, None, 9]]
    xlsx.write_xlsx(str(d / "a.xlsx"), {"1. HT điện": [HEADER, legend, *body], "Tổng hợp": [HEADER, ["1", "X", "không đọc", "m", 1, 1, 1]]})
    xlsx.write_xlsx(str(d / "b.xlsx"), {"Sheet": [["Bảng dự thầu"], ["Thông tin công việc", None, None, "Khối lượng", "Đơn giá", "Thành tiền"], ["Mã hiệu", "Tên hạng mục", "ĐVT", "Nhà thầu", "Tổng hợp", "Nhà thầu"], ["C1", "Ống", "m", 5, 2, ("[1]Sheet!A1", "10")]]})
    (d / "broken.xlsx").write_bytes(b"not a zip")
    (d / "empty.xlsx").write_bytes(b"")
    return str(d)


def test_rows_keep_coordinates(spark, books):
    xlsx.register(spark)
    rows = spark.read.format("xlsx_rows").load(books)
    got = {(r.workbook, r.sheet, r.row_number): r.cells for r in rows.collect()}
    assert got["a.xlsx", "1. HT điện", 1] == HEADER and ("a.xlsx", "1. HT điện", 6) not in got and got["a.xlsx", "1. HT điện", 3] == ["A", None, "HỆ THỐNG ĐIỆN"]
    assert {k[0] for k in got} == {"a.xlsx", "b.xlsx"}
    assert spark.read.format("xlsx_rows").option("sheets", "Sheet").option("max_rows", 2).load(books).count() == 2
    with pytest.raises(Exception, match="zip|Zip|file"):
        spark.read.format("xlsx_rows").option("mode", "FAILFAST").load(books).count()


def test_issues(spark, books):
    xlsx.register(spark)
    got = sorted((r.workbook, r.cell, r.kind) for r in spark.read.format("xlsx_issues").load(books).collect())
    assert got == [("a.xlsx", "G8", "error"), ("b.xlsx", "F4", "external link")]


def test_line_items(spark, books):
    xlsx.register(spark)
    items = sheets.line_items(spark.read.format("xlsx_rows").load(books))
    got = {(r.workbook, r.row_number): r for r in items.collect()}
    a = got["a.xlsx", 4]
    assert (a.item_code, a.unit, a.reference_quantity, a.row_type, a.path) == ("M-01", "m", 1000.5, "detail", ["HỆ THỐNG ĐIỆN"])
    assert got["a.xlsx", 8].unit_price_total == -10.0 and got["a.xlsx", 8].path == ["HỆ THỐNG ĐIỆN", "Chiếu sáng"]
    assert got["a.xlsx", 5].row_type == "component" and got["a.xlsx", 9].row_type == "summary" and ("a.xlsx", 2) not in got
    b = got["b.xlsx", 4]
    assert (b.item_code, b.item_name, b.bid_quantity, b.bid_amount) == ("C1", "Ống", 5.0, 10.0)
    assert {r.sheet for r in got.values()} == {"1. HT điện", "Sheet"}


def test_one_letter_ordinals_open_the_topmost_level(spark):
    """I, V and X are read as letters before they are read as roman numbers; only longer ones count as roman."""
    rows = spark.createDataFrame([("w", "s", i, r) for i, r in enumerate([HEADER, ["A", None, "Điện", None, None, None, None], ["I", None, "Chiếu sáng", None, None, None, None], ["1", "M", "Đèn", "cái", "1", "2", "2"]], 1)], "workbook string, sheet string, row_number int, cells array<string>")
    assert [r.path for r in sheets.line_items(rows).filter("row_type = 'detail'").collect()] == [["Chiếu sáng"]]


def test_sheet_list_and_columns(books):
    assert xlsx.list_sheets(books + "/a.xlsx") == ["1. HT điện", "Tổng hợp"]
    assert [xlsx.column_number(c) for c in ("A1", "Z9", "AA1", "12")] == [1, 26, 27, 0]


def test_html(spark):
    html = "<table><tr><th>a<td>b<br>c</tr><tr><td> </td></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table><p>no</p><table></table>"
    assert tables.html_tables(html) == [[["a", "b c"], ["x in"]]] or tables.html_tables(html) == [[["a", "b c"], ["xin"]]] or tables.html_tables(html)[0][0] == ["a", "b c"]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert [(r.id, r.table_no, r.row_no) for r in tables.explode_html(df, "html").collect()] == [(1, 1, 1), (1, 1, 2)]


def test_markdown(spark):
    md = "text\n| a | b |\n|---|:--|\n| 1 | 2 |\n\n| alone |\nmore\n| x |\n| y |"
    df = spark.createDataFrame([(1, md), (2, None)], "id int, md string")
    got = sorted((r.id, r.table_no, r.row_no, tuple(r.cells)) for r in tables.explode_markdown(df, "id", "md").collect())
    assert got == [(1, 1, 1, ("a", "b")), (1, 1, 2, ("1", "2")), (1, 2, 1, ("x",)), (1, 2, 2, ("y",))]


@pytest.mark.parametrize(("text", "told"), [('so: ```json\n{"a": {"b": "}"}}\n``` end', '{"a": {"b": "}"}}'), ("{broken {\"x\": 1}", '{"x": 1}'), ("none", None), (None, None), ("", None)])
def test_json(text, told):
    assert tables.first_json(text) == told
