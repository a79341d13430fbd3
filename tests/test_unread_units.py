from pyspark.sql import functions as F

from bidloom.operators import units
from bidloom.plans import data_queries


def test_unread_units_come_from_the_classifier(spark):
    rows = [(f"a{i}", "tạ", f"Thép số {i}", None, 10.0 + i % 7, 2e5, "s") for i in range(200)] + [(f"b{i}", "cái", f"Bơm số {i}", None, 3.0, 5e6, "s") for i in range(200)]
    rows += [("c", "ta", "Thép số", None, 12.0, 2e5, "s"), ("d", None, "Thép số", None, 12.0, 2e5, "s"), ("e", "ta", "Bơm số", None, 3.0, 5e6, "s")]
    df = units.read_units(spark.createDataFrame(rows, "id string, unit string, name string, note string, quantity double, price double, source string"), "unit", "name", "note")
    out = data_queries.found_units(units.predict_units(df, "id", {c: F.col(c) for c in ("quantity", "price", "source", "name")})).collect()
    got = {r.id: (r.kind, r.factor_micro) for r in out if r.id in "cde"}
    assert got == {"c": ("mass", 10**8)} and len(out) == 201
