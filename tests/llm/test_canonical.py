import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidloom.llm import canonical

BRANDS = canonical.brand_mapper([(1, "Thoro Thermo"), (2, "Ostlin, Nono"), (3, "Bạch Vân"), (4, "Thạch Giang"), (5, "Velpex/Gepex"), (6, "Zennoberg"), (7, "Siltri Thermo")])
ORIGINS = canonical.origin_mapper([(1, "Việt Nam", "Vietnam", "VN"), (2, "Trung Quốc", "China", "CN"), (3, "Ý", "Italy", "IT"), (4, "Áo", "Austria", "AT"), (5, "Malaysia", "Malaysia", "MY"), (6, "Hoa Kỳ", "United States", "US"), (7, "Úc", "Australia", "AU"), (8, "Hàn Quốc", "South Korea", "KR")])


@pytest.mark.parametrize(("value", "told"), [("Thoro Thrmo", 1), ("CTCP Thoro Thermo", 1), ("thermo thoro", 1), ("Ostlin,-Nono", 2), ("ostln, nono jsc", 2), ("BACH VAN", 3), ("Thạch Vân", -1), ("velpex gepex", 5), ("Znnoerg", 6), ("Kosge Thermo", -1), ("OEM", -1), ("???", -1), ("Zennoberg " * 3000, 6)])
def test_brands(value, told):
    assert BRANDS.map(value) == told


@pytest.mark.parametrize(("value", "told"), [("VN", 1), ("vietnam", 1), ("Made in Vietnam", 1), ("Vệt Nam", 1), ("P.R. China", 2), ("TrungQuốc", 2), ("Y", 3), ("nhập từ Áo", 4), ("my", 5), ("Mỹ", 6), ("USA", 6), ("Uc", 7), ("Nam Hàn", 8), ("Ai Cập", -1), ("Châu Á", -1), ("EU", -1), ("n/a", -1)])
def test_origins(value, told):
    assert ORIGINS.map(value) == told


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_text_maps(value):
    assert BRANDS.map(value) in (-1, 1, 2, 3, 4, 5, 6, 7)


def test_rows(spark):
    df = spark.createDataFrame([("Zennoberg",), (None,), ("  ",), ("x",), ("x",)], "v string")
    assert [r[0] for r in df.select(canonical.map_column(F.col("v"), BRANDS)).collect()] == [6, None, None, -1, -1]
    assert df.limit(0).select(canonical.map_column(F.col("v"), BRANDS)).count() == 0
    assert canonical.brand_mapper([]).map("a") == -1


SHORT = canonical.brand_mapper([(1, "ABB"), (2, "LG"), (3, "Zennoberg"), (4, "Kosvino")])
PLACES = canonical.origin_mapper([(1, "Hoa Kỳ", "United States", "US"), (2, "Nhật Bản", "Japan", "JP"), (3, "Đức", "Germany", "DE"), (4, "Ý", "Italy", "IT"), (5, "Ấn Độ", "India", "IN"), (6, "Thái Lan", "Thailand", "TH")])


@pytest.mark.parametrize(("value", "told"), [("thiết bị ABB chính hãng loại tốt", 1), ("điều hoà LG inverter", 2), ("loại abb hay lg gì đó", -1), ("máy Zennoberg hoặc Kosvino ABB", 3), ("LG", 2)])
def test_short_brands_inside(value, told):
    assert SHORT.map(value) == told


@pytest.mark.parametrize(("value", "told"), [("hàng loại 1 của Mỹ sản xuất", 1), ("máy từ Nhật rất tốt", 2), ("thiết bị Deutschland lắp ráp", 3), ("động cơ Ý nguyên chiếc", 4), ("sản phẩm Đức cao cấp", 3), ("đã xử lý nước thải in ấn", -1), ("hàng của Ý và Mỹ", 1), ("lắp tại Germany cùng Thailand", 6), ("máy Italia hoặc Nippon", -1)])
def test_aliases_inside(value, told):
    assert PLACES.map(value) == told


def test_very_long_values():
    import time

    began = time.time()
    assert SHORT.map("kosvinoo" * 500) == -1 and SHORT.map("x" * 100_000 + " ABB") == 1
    assert time.time() - began < 5
