import pytest

from bidloom.operators.packed import Segmenter, is_packed, split_values
from pyspark.sql import functions as F

CUT = Segmenter([("brand", b) for b in ("Ostlin, Nono", "Velpex/Gepex", "Norpex & Bason", "Thomo Flow", "Sơn Điền", "Raskura", "Kosvino")] + [("origin", o) for o in ("Ý", "Việt Nam", "Vietnam", "Hàn Quốc")])


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("Thomo Flow / Velpex/Gepex", ["b:Thomo Flow", "b:Velpex/Gepex"]), ("Ostlin, Nono, Raskura", ["b:Ostlin, Nono", "b:Raskura"]), ("(1) Raskura\n(2) KOSVINO", ["b:Raskura", "b:KOSVINO"]),
        ('"Norpex & Bason ""Pro""" or Sơn Điền', ['b:Norpex & Bason "Pro"', "b:Sơn Điền"]), ("Hãng Raskura - xuất xứ Ý (hoặc tương đương)", ["b:Raskura", "o:Ý"]), ("TH: Raskura | Kosvino\nXX: Vietnam", ["b:Raskura", "b:Kosvino", "o:Vietnam"]),
        ("Raskura ; ;Kosvino, Ltd", ["b:Raskura", "b:Kosvino, Ltd"]), ("Raskura (xuất xứ: Hàn Quốc)", ["b:Raskura", "o:Hàn Quốc"]), ("Raskura;Raskura", ["b:Raskura", "b:Raskura"]), ("Ostln, Noono", []), ("Raskura hoặc tương đương", ["b:Raskura"]),
        ("Thiết bị phải mới nguyên, có chứng chỉ CO, CQ và biên bản thử tại nhà máy.", []), ("", []), ("   ", []), (None, []), (",;|", []), ("Raskura; " * 2000, ["b:Raskura"] * 2000),
    ],
)
def test_split(text, told):
    got = [f"{k[0]}:{v}" for k, _, v in CUT.split(text)]
    assert got == told or (len(told) < 2 and len(got) < 2)


def test_rows(spark):
    df = spark.createDataFrame([(1, "Raskura, Kosvino", "x"), (2, "Raskura", "y"), (3, None, "z"), (1, "Raskura, Kosvino", "x")], "id int, f string, value_extra string")
    got = sorted((r.id, r.list_kind, r.value_no, r.value_text) for r in split_values(df, "f", CUT).collect())
    assert got == sorted([(1, "brand", 1, "Raskura"), (1, "brand", 2, "Kosvino")] * 2)
    assert split_values(df.limit(0), "f", CUT).count() == 0
    assert [r[0] for r in df.orderBy("id").select(is_packed(F.col("f"), CUT)).collect()] == [True, True, False, False]


def test_without_dictionary():
    assert Segmenter([("brand", "x")]).split("A, B") == []


def test_clashing_names(spark):
    df = spark.createDataFrame([("Raskura, Kosvino", 9, "x")], "f string, value_no int, LIST_KIND string")
    out = split_values(df, "f", CUT)
    assert out.columns == ["f", "list_kind", "value_no", "value_text"] and sorted(r.value_no for r in out.collect()) == [1, 2]


def test_long_values_prose_and_rows_of_names():
    from bidloom.operators.packed import Segmenter

    s = Segmenter([("brand", "A/B/C/D/E/F"), ("brand", "Raskura"), ("brand", "Kosvino"), ("brand", "Kosvino Prime"), ("origin", "Đức")])
    assert s.split("A/B/C/D/E/F; Raskura") == [("brand", 1, "A/B/C/D/E/F"), ("brand", 2, "Raskura")]
    assert s.split("Raskura Kosvino") == [("brand", 1, "Raskura"), ("brand", 2, "Kosvino")]
    assert s.split("Raskura Kosvino Prime Đức") == [("brand", 1, "Raskura"), ("brand", 2, "Kosvino Prime"), ("origin", 1, "Đức")]
    assert s.split("Raskura; Kosvino; a piece of prose that has more than six words") == [("brand", 1, "Raskura"), ("brand", 2, "Kosvino")]
    assert s.split("All the pipes must be by Raskura, and every valve has to be checked before delivery") == []
    assert s.split("Raskura Kosvino" * 3000) is not None


def test_rows_without_delimiter(spark):
    df = spark.createDataFrame([(1, "Raskura Kosvino"), (2, "Raskura"), (3, "Raskura Đức"), (4, " Raskura ")], "id int, f string")
    cut = Segmenter([("brand", "Raskura"), ("brand", "Kosvino"), ("origin", "Đức")])
    assert sorted((r.id, r.list_kind, r.value_text) for r in split_values(df, "f", cut).collect()) == [(1, "brand", "Kosvino"), (1, "brand", "Raskura"), (3, "brand", "Raskura"), (3, "origin", "Đức")]
