import random
import unicodedata

import pytest

from bidloom.llm import garbled

CLEAN = ["Ống thép mạ kẽm nhúng nóng", "Quạt hướng trục lưu lượng gió", "Máy bơm nước ly tâm trục ngang", "Tủ điện phân phối, vỏ thép", "Cáp điện đồng bọc cách điện", "Vữa chống thấm gốc xi măng", "Thiết bị xử lý không khí", "Độ ồn đo cách một mét không vượt quá", "Nhà thầu nộp bản tính chọn thiết bị", "Kính cường lực an toàn", "Đèn LED âm trần văn phòng", "Mối hàn kiểm tra siêu âm, thử kín"]
# A letterwise cipher of the kind old fonts have, for these texts' letters only.
FONT = {c: chr(0xA1 + i if i < 12 else 0xB5 + i - 12) for i, c in enumerate("áàảãạăắằặâấầẩẫậđéèẻẽẹêếềểễệíìỉịóòỏõọôốồổộơớờởợúùủũụưứừửữựýỳỷỹỵ")}


def font(text):
    return "".join(FONT.get(c, c) for c in text.lower())


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(1500):
        t = " ".join(r.sample(CLEAN, 2))
        if i % 10 == 0:
            t = t.encode().decode(("cp1251", "mac_roman", "cp437")[i % 3], "replace") if i % 20 else "".join(chr(b) if b < 128 or b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in t.encode())
        out.append((i, t))
    return spark.createDataFrame(out, "id long, text string"), [i for i, _ in out if i % 10 == 0]


def test_finds_and_restores(spark, rows):
    df, bad = rows
    r = garbled.fit(df)
    got = {x.id: x for x in garbled.damaged(df, "text", r).collect()}
    assert sorted(got) == bad
    clean = {unicodedata.normalize("NFC", t) for t in CLEAN}
    whole = [x for x in got.values() if "lost" not in x.damage]
    assert sum(any(c in x.restored for c in clean) for x in whole) > 0.9 * len(whole)


def test_learns_an_unknown_font(spark):
    r = random.Random(2)
    rows = [(i, font(" ".join(r.sample(CLEAN, 2))) if i % 8 == 0 else " ".join(r.sample(CLEAN, 2))) for i in range(2400)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {x.id for x in garbled.damaged(df, "text", garbled.fit(df)).collect()}
    bad = {i for i, _ in rows if i % 8 == 0}
    assert len(got & bad) > 0.9 * len(bad) and not got - bad


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "C?p l?c ru?t"), (5, "B�ng"), (6, "kiểu Façade, São Vale ©2024 ®"), (7, "Ống " * 20000), (8, "Có nên không?"), (8, "C?p l?c"), (9, "Đã gửi chưa? Chưa.")], "id int, text string")
    r = garbled.Repairer([])
    assert {4, 5} <= {x.id for x in garbled.damaged(df, "text", r).collect()}
    assert garbled.repair(df, "text", r).count() == 10
    assert 9 not in {x.id for x in garbled.damaged(df, "text", r).collect() if "lost" in x.damage}
    fitted = garbled.fit(df)
    assert {4, 5} <= {x.id for x in garbled.damaged(df, "text", fitted).collect()}
    assert garbled.fit(df.limit(0)).map and garbled.damaged(df.limit(0), "text", fitted).count() == 0
    extra = df.withColumnRenamed("id", "damage")
    assert "damage" in garbled.damaged(extra, "text", fitted).columns
