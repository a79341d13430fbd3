import random

from bidloom.llm import listing, products
from bidloom.llm.listing import describe, part_number, part_numbers, valid_gtin

SCHEMA = "item_id long, bidder string, item_name string, material string, item_code string"


def test_what_a_listing_tells():
    a = describe("Thang cáp mạ kẽm (942.5*112*2.24)mm chính hãng", "Thép", "TC344-W17D")
    assert a == describe("Cable ladder; model TC.344.W17.D; C112mm; thickness 0,224 cm, bảo hành 24 tháng", "R94,25 cm", "K-12")
    assert a[0] == "tc344w17d" and describe("Thang cáp", None, None) == (None, None) and describe(None, None, None) == (None, None)
    assert describe("Bơm LL 181500 l/h, P=13,75kW; head 54 m", None, None)[1] == describe("Q=181.5m³/h H=54000mm công suất 13750 W", None, None)[1]
    assert describe("Ống (ĐVT: cuộn 100m)", None, None) == (None, None)


def test_check_digits():
    assert valid_gtin("4006381333931") and not valid_gtin("4006381333932") and not valid_gtin("123")
    assert describe("EAN 4006381333931", None, None)[0] == "gtin:4006381333931"


def brute(rows):
    told = {r[0]: (r[1], *describe(*r[2:])) for r in rows}
    owner: dict = {}
    for _, ident, attrs in told.values():
        if ident and attrs:
            owner.setdefault(attrs, set()).add(ident)
    label = {}
    for k, (s, ident, attrs) in told.items():
        if ident:
            label[k] = (s, ident)
        elif attrs and len(owner.get(attrs, ())) == 1:
            label[k] = (s, next(iter(owner[attrs])))
        elif attrs and attrs.count("|") >= 2:
            label[k] = (s, attrs)
    return sorted((a, b) for a in label for b in label if a < b and label[a][1] == label[b][1] and label[a][0] != label[b][0])


def test_pairs_against_brute_force(spark):
    rows = [
        (1, "x", "Thang cáp 942.5x112x2.24mm", None, None), (2, "y", "Cable ladder", "TC344-W17D", None), (3, "z", "Ladder TC344W17D", "(0,9425 x 0,112 x 0,00224)m", "B.1"), (4, "x", "Thang 945x112x2.24mm", "TC344-W17K", None),
        (5, "y", "Thang", None, None), (6, "y", None, None, None), (7, "z", "Thang 94,5x11,2x0,224cm", None, "C2"), (7, "z", "Thang 94,5x11,2x0,224cm", None, "C2"), (8, "x", "Ống 1x2x3mm", None, None), (9, "y", "Ống 3 x 2 x 1 mm", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    g = products.grouped(df, "item_id", "item_name", "material", "item_code", "bidder")
    got = sorted(set((r.item_id_a, r.item_id_b) for r in products.pairs(g, "item_id", "bidder").collect()))
    assert got == sorted(set(brute(rows))) and (1, 2) in got and (1, 3) in got and (1, 4) not in got and (8, 9) in got
    assert products.grouped(df.limit(0), "item_id", "item_name", "material", "item_code", "bidder").count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", "Thang TC344-W17D", None, None, "?"), (2, "y", "TC344W17D", None, None, "?")], SCHEMA + ", product string")
    g = products.grouped(df, "item_id", "item_name", "material", "item_code", "bidder", "product")
    assert sorted((r.item_id, r["product"]) for r in g.collect()) == [(1, "tc344w17d"), (2, "tc344w17d")]


def test_part_numbers_of_any_make():
    for text, told in (("LC1D09M7", "lc1d09m7"), ("6ES7214-1AG40-0XB0", "6es72141ag400xb0"), ("TC.344.W17.D", "tc344w17d"), ("ABE-103B/C2", "abe103bc2"), ("4x10mm2", None), ("18kw/380v/50hz", None), ("304L", None), ("z275", None), ("m3/h", None), ("DN200", None), ("20.2x10.8", None), ("2020/12/31", None)):
        assert part_number(text.lower()) == told
    assert set(part_numbers("contactor lc1d09m7, 18.5kw 380v")) == {"lc1d09m7"}
    assert set(part_numbers("tu dien ma td 929 c43b - gia tot")) == {"td929c43b"} and set(part_numbers("bom ; og 720 b48b ; 12 kw")) == {"og720b48b"}
    assert describe("Khởi động từ LC1D09M7", None, "K-1")[0] == describe("Contactor, model LC1-D09-M7", None, None)[0] == "lc1d09m7"
    assert describe("Module LC1D09M7 cho 6ES7214-1AG40-0XB0", None, None)[0].startswith("?")


def test_trade_numbers_group(spark):
    """Trade numbers with and without the right check digit, in three places; the wrong one links nothing."""
    rows = [(1, "x", "Dao rọc EAN 4006381333931", None, None), (2, "y", "Cutter knife", None, "4006381333931"), (3, "z", "Knife; barcode: 4006381333931", None, None), (4, "y", "Knife EAN 4006381333932", None, None), (5, "z", "Cutter EAN 4006381333932", None, None), (6, "x", "Ổ cắm, GTIN 00012345600012", None, None), (7, "y", "Socket UPC 012345600012", None, None)]
    g = products.grouped(spark.createDataFrame(rows, SCHEMA), "item_id", "item_name", "material", "item_code", "bidder")
    assert {(r.item_id_a, r.item_id_b) for r in products.pairs(g, "item_id", "bidder").collect()} == {(1, 2), (1, 3), (2, 3), (6, 7)}


def test_hot_product_is_split(spark):
    rows = [(i, f"s{i % 3}", "Thang TC344-W17D", None, None) for i in range(50)]
    g = products.grouped(spark.createDataFrame(rows, SCHEMA), "item_id", "item_name", "material", "item_code", "bidder")
    got = [(r.item_id_a, r.item_id_b) for r in products.pairs(g, "item_id", "bidder", part_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 != b % 3}


def test_searches_find_what_their_patterns_say():
    """The quick searches of ``describe`` against the patterns that define them, over random texts."""
    r = random.Random(5)
    some = ["5", "12", "1.5", "2,25", "m", "m2", "m3/h", "kg", "ma", "x", "*", " ", " ", " ", ".", ",", "/", "=", ":", "-", " - ", ";", "(", "]", "|", "a", "bc", "abcd", "abcde", "c43b", "td", "n/mm2", "\n", "٣", "bao hanh 24 thang", "unit: ", "3 phase", " 2 pha", "tinh theo ", "lt"]
    for _ in range(20_000):
        line = "".join(r.choice(some) for _ in range(r.randint(1, 12)))
        assert list(listing.measured(line)) == [(m[1], m[2], m.start(2)) for m in listing.VALUE.finditer(line)]
        assert listing.noisy(line) or not listing.NOISE.search(line)
        assert listing.SIDE.search(line) or not listing.DIMS.search(line)
        assert listing.SPACE_BETWEEN.search(line) or not listing.SPACED.search(line)
    line = "5 m 6kg a7m abcde8m 1.5.7m 9 m3/h2 kg, 5 m2 m"
    assert list(listing.measured(line)) == [("5", "m", 2), ("6", "kg", 5), ("7", "m", 10), ("5", "m2", 41)] == [(m[1], m[2], m.start(2)) for m in listing.VALUE.finditer(line)]


def test_cipher_is_looked_for_once(monkeypatch):
    calls = []
    cipher_of = listing.garbled.cipher_of
    monkeypatch.setattr(listing.garbled, "cipher_of", lambda t: calls.append(t) or cipher_of(t))
    assert listing._describe("Thang cáp Ж TC344-W17D", None, None) == ("tc344w17d", None) and len(calls) == 1
    assert listing._describe("Ống dài 5 mét".encode().decode("cp1252", "replace"), None, None)[1] == "length:5" and len(calls) <= 3
