import pytest

from bidloom.operators.units import parse_unit, predict_units, read_units, stated_unit
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("m2", ("area", 10**6, True)), ("㎡", ("area", 10**6, True)), ("mét dài", ("length", 10**6, True)), ("cuộn 100m", ("length", 10**8, False)), ("rulo 0,5km", ("length", 5 * 10**8, False)),
        ("tấm (600x600mm)", ("area", 360_000, False)), ("tấm 1,22x2,44m", ("area", 2_976_800, False)), ("hộp/50 chiếc", ("count", 5 * 10**7, False)), ("tá", ("count", 12 * 10**6, False)), ("tạ", ("mass", 10**8, False)),
        ("bó 2 tấn", ("mass", 2 * 10**9, False)), ("bộ", ("none", 0, False)), ("can 5L", ("volume", 5000, False)), ("ống (4 mét)", ("length", 4 * 10**6, False)), ("inch", ("length", 25_400, False)), ("ta", None), ("?", None), ("-", None), (None, None), ("", None),
    ],
)
def test_parse(text, told):
    assert parse_unit(text) == told


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("Cáp, đvt cuộn 100m", 10**8), ("Gạch [unit: 100 m²]", 10**8), ("Ống (ĐVT: kilomet)", 10**9), ("x / khối lượng tính bằng feet", 304_800), ("ĐVT hộp 100 cái như hồ sơ mời", 10**8),
        ("Unit of measure = chiec", 10**6), ("chào theo cặp", 2 * 10**6), ("Air handling unit, 50 kW", None), ("Theo chỉ dẫn kỹ thuật", None), (None, None), ("đvt " + "x" * 5000, None),
    ],
)
def test_stated(text, told):
    got = stated_unit(text)
    assert (got and got[1]) == told


SCHEMA = "id string, unit string, name string, note string, quantity double, price double, source string"


def test_read_and_predict(spark):
    rows = [(f"a{i}", "m2", f"Gạch số {i}", None, 10.0 + i % 7, 2e5, "s") for i in range(200)] + [(f"b{i}", "cái", f"Bơm số {i}", None, 3.0, 5e6, "s") for i in range(200)]
    rows += [("c", None, "Gạch lát", None, 12.0, 2e5, "s"), ("d", "", "Bơm nước", "ĐVT: cặp", 1.0, 1e7, "s"), ("e", "-", None, None, None, None, None), ("e", "-", None, None, None, None, None)]
    df = read_units(spark.createDataFrame(rows, SCHEMA), "unit", "name", "note")
    out = {r.id: r for r in predict_units(df, "id", {c: F.col(c) for c in ("quantity", "price", "source", "name")}).collect()}
    assert len(out) == 403 and out["d"].told_by == "text" and out["d"].factor_micro == 2 * 10**6
    assert out["c"].predicted_kind == "area" and out["c"].route == "convert" and out["a0"].route == "known"
    assert out["e"].route in ("review", "convert")


def test_few_or_no_rows(spark):
    df = read_units(spark.createDataFrame([("a", None, None, None, None, None, None)], SCHEMA), "unit", "name", "note")
    cols = {c: F.col(c) for c in ("quantity", "price", "source", "name")}
    assert [r.route for r in predict_units(df, "id", cols).collect()] == ["review"]
    assert predict_units(df.limit(0), "id", cols).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "cuộn 100m", None, None, 1.0, None, None, "old", -1)], SCHEMA + ", kind string, factor_micro int")
    r = read_units(df, "unit", "name", "note").first()
    assert (r.kind, r.factor_micro, r.told_by) == ("length", 10**8, "unit")


def test_masked_accuracy(spark):
    """Units hidden from a forest that can tell them by the name come back right."""
    from bidloom.operators import units

    rows = [(f"r{i}", ("cáp điện ruột đồng", "m", "sơn nước", "lít", "thép hình", "kg")[2 * (i % 3)], ("m", "lit", "kg")[i % 3], float(10 ** (i % 3)) + i % 7, "s") for i in range(900)]
    df = units.read_units(spark.createDataFrame(rows, "id string, name string, unit string, q double, src string"), "unit", "name")
    got = units.masked_accuracy(df, "id", {"quantity": F.col("q"), "price": F.lit(None).cast("double"), "source": F.col("src"), "name": F.col("name")})
    assert got["rows"] > 300 and got["converted"] > 0.9 and got["right"] > 0.95
    assert units.masked_accuracy(df.limit(50), "id", {"quantity": F.col("q"), "price": F.lit(None).cast("double"), "source": F.col("src"), "name": F.col("name")})["rows"] == 0
