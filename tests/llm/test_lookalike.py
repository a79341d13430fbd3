import pytest

from bidloom.llm import lookalike


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("сáі", "cái"), ("ｂộ", "bộ"), ("m\xa0", "m "), ("Va​n", "Van"), ("bộ", "bộ"), ("PP‐R", "PP-R"), ("㎡", "m2"), ("Ɖiện", "Điện"), ("КHỐI Ρ", "KHỐI P"),
        ("(Насос водяной)", "(Насос водяной)"), ("28 mm² ±2° ®", "28 mm² ±2° ®"), ("Façade São", "Façade São"), ("", ""),
    ],
)
def test_one_form(text, told):
    assert lookalike.unified(text) == told
    assert lookalike.skeleton(text) == lookalike.skeleton(told)
    assert lookalike.unified(told) == told


def test_rows(spark):
    df = spark.createDataFrame([(1, "bộ", "a"), (2, "ｂộ", "b"), (3, None, "c"), (4, "", "d"), (5, "b​ộ", "e"), (5, "b​ộ", "e"), (6, "x" * 50000 + "​", "f")], "id int, t string, unified string")
    assert sorted(r.id for r in lookalike.disguised(df, "t").collect()) == [2, 5, 5, 6]
    assert [r.unified for r in lookalike.unify(df, "t").orderBy("id").limit(4).collect()] == ["bộ", "bộ", None, ""]
    g = lookalike.look_alikes(df.filter("id < 6"), "t").collect()
    assert [(r.unified, r.spellings, r.n) for r in g] == [("bộ", 3, 4)]
    assert lookalike.disguised(df.limit(0), "t").count() == 0


def test_full_table(spark):
    looks = lookalike.Looks(lookalike.confusables(spark))
    for text, told in (("Ϲable", "Cable"), ("ᴄable", "cable"), ("Ꮯable", "Cable"), ("ⲟpen", "open"), ("Cаble", "Cable"), ("Щит учёта", "Щит учёта"), ("кВт", "кВт"), ("ВЕТОН", "BETOH"), ("β-ray", "β-ray"), ("Đ Ð", "Đ Đ"), ("m²³×Ø°±®©–“”", "m²³×Ø°±®©–“”"), ("Việt Nam çã", "Việt Nam çã"), ("漢字", "漢字")):
        assert looks.unified(text) == told and looks.unified(told) == told and looks.skeleton(text) == looks.skeleton(told)
    df = spark.createDataFrame([(1, "Ϲable"), (2, "Ꮯable"), (3, "Cable"), (4, "Cable x")], "id int, t string")
    assert sorted(r.id for r in lookalike.disguised(df, "t").collect()) == [1, 2]
    assert [(r.unified, r.spellings) for r in lookalike.look_alikes(df, "t").collect()] == [("Cable", 3)]
