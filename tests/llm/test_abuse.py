import glob

import numpy as np
import pandas as pd
import pytest

from bidloom.llm import abuse


@pytest.fixture(scope="module")
def parts(spark):
    texts = ["Đơn giá tủ phân phối lệch 42% so với trung vị. Hàng mẫu để tại tháp B trong 184 ngày.", "Freight to tower B is included while value added tax is not."] * 30
    texts += ["Shut up, y0u s-t-u-p-i-d pig, nobody asked you!", "CÂM MỒM LẠI con lợn ơi, không ai cần nghe mày", "Mày là đồ rác rưởi, tao gặp ở đâu tao đập vỡ mặt ở đó", "Send me your nuuude pictures and we will have sex", "Con chó robot kiểm tra đường ống bị hỏng pin.", "Sex-segregated changing rooms are required.", None, "", "...", "Giá tốt. " * 20000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(0, " OK "), (1, "ok"), (60, "Reject"), (2, "reject"), (2, "ok"), (3, "unsure"), (None, "ok")], "doc_id long, verdict string")
    return docs, marks


def test_scores(spark, parts):
    docs, marks = parts
    scorer = abuse.fit(docs, "doc_id", "text", marks, "doc_id", "verdict")
    got = {r.doc_id: r for r in abuse.scores(docs, "doc_id", "text", scorer, "source").collect()}
    assert len(got) == docs.count()
    assert {i for i, r in got.items() if r.score >= abuse.FOUND} == {60, 61, 62, 63}
    assert got[66].vote == 0 and got[66].evidence is None and "stupid pig" in got[60].evidence
    none = abuse.fit(docs, "doc_id", "text", marks.limit(0), "doc_id", "verdict")
    assert sum(r.vote >= abuse.FOUND for r in abuse.scores(docs, "doc_id", "text", none).collect()) == 4
    assert abuse.scores(docs.limit(0), "doc_id", "text", none).count() == 0


def test_index_is_exact(parts):
    import random

    r = random.Random(1)
    topics = [[f"{t}{chr(97 + i)}" for i in range(20)] for t in "abcdefgh"]
    ex = [(tuple(r.choices(topics[i % 8], k=6)), float(i % 2), i) for i in range(2000)]
    df = {t: 3 for e in ex for t in abuse.terms(e[0])}
    index = abuse.Index(ex, df, 1000)
    read, looked, scored = [], [], index._scored
    index._scored = lambda *x: looked.append(x[0]) or scored(*x)
    for _ in range(30):
        q = tuple(r.choices(r.choice(topics), k=6))
        v = index.vector(q)
        told = sorted(((sum(v.get(t, 0) * w for t, w in index.vector(e[0]).items()), i) for i, e in enumerate(index.examples)), key=lambda x: (-x[0], x[1]))
        told = [(s, i) for s, i in told if s >= abuse.FLOOR - 1e-9][: abuse.NEAREST]
        got = index.nearest(q)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in told]
        read.append(len(looked))
        looked.clear()
    assert sum(read) < 0.5 * 30 * len(index.blocks)  # blocks that can't matter are never read


def test_disguises():
    assert list(abuse.passages("Y0u f-i-l-t-h-y l1@r!!! Nguuu như bò")) == [("you", "filthy", "liar"), ("ngu", "nhu", "bo")]
    assert abuse.isotonic(np.array([0.0, 1.0, 2.0]), np.array([1.0, 0.0, 1.0]))[0][1] == 0.5


def test_equal_votes_are_one_step():
    assert abuse.isotonic(np.array([0.0, 0.5, 0.5, 0.5, 0.9]), np.array([0.0, 0.0, 1.0, 0.0, 1.0])) == [(0.0, 0.0), (0.5, 1 / 3), (0.9, 1.0)]


def found(spark, texts, marks):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = abuse.fit(docs, "doc_id", "text", spark.createDataFrame(marks, "doc_id long, verdict string"), "doc_id", "verdict")
    return {r.doc_id for r in abuse.scores(docs, "doc_id", "text", scorer).collect() if r.score >= abuse.FOUND}


def test_rejected_wording_unlike_the_seeds(spark):
    texts = ["Nguyên vật liệu đến kho chiều thứ hai.", "Concrete was poured on level three."] * 30 + ["Zarnok vublit grimple snorf wextor.", "Zarnok vublit grimple snorf wextor today.", "Zarnok vublit grimple snorf wextor.", "The grout was tested."]
    assert found(spark, texts, [(60, "reject"), (61, "reject"), (0, "ok"), (1, "ok"), (63, "reject")]) == {60, 61, 62}


def test_wrong_verdicts(spark):
    """A wording that many rejected documents share stays abuse if one of its documents was waved through, and the other way round."""
    texts = [f"Zarnok vublit grimple snorf wextor. Item {i} was tested." for i in range(8)] + [f"The pump of item {i} came late." for i in range(8)] + ["Zarnok vublit grimple snorf wextor.", "The pump of item 9 came late."]
    marks = [(i, "reject") for i in range(7)] + [(7, "ok")] + [(i, "ok") for i in range(8, 15)] + [(15, "reject")]
    assert found(spark, texts, marks) == {*range(8), 16}


UNSEEN = [
    "You are nothing but a lying bastard and everybody here knows it", "Only a complete imbecile would sign this drawing", "Shut up, you miserable bitch", "One more word and I will cut your throat", "Our foreigners here are parasites, kick them out", "What a dirty slut she is", "I am going to beat you to death, wait outside",
    "Refugees are savages who should be exterminated", "Send me naked pictures of yourself tonight", "Suck my dick, boss", "Thằng khốn kiếp này lại chấm sai", "Mày đúng là đồ súc sinh, cút đi", "Lũ chó má chúng mày ăn cắp vật tư", "Tao sẽ giết mày nếu còn bén mảng tới đây", "Đàn bà là lũ hạ đẳng", "Cho anh xem ảnh nóng của em đi", "Địt mẹ mày, trả tiền đây", "Đồ vô học, cút đi",
]
CALM = ["The foreman will cut the cable tonight", "You are right, send me the drawing", "Women and men work here in two shifts", "Cổng phụ đóng lúc sáu giờ tối", "Anh gửi giúp em bản vẽ tầng hai", "Con lăn băng tải bị mòn", "The kill switch works", "Watch the video of the installation", "Danger of death, high voltage", "Thank you for the photos of the site", "Đồ bảo hộ đã phát đủ"]


def test_abuse_that_stands_in_no_table(spark):
    texts = [*UNSEEN, *CALM, *["Giá chào đã gồm vận chuyển và lắp đặt tại công trường.", "The quantity of the cable tray differs from the drawing.", "Can you check whether the price is right?"] * 20]
    got = found(spark, texts, [])
    assert len(got & set(range(len(UNSEEN)))) >= 0.8 * len(UNSEEN) and not got - set(range(len(UNSEEN)))


def test_no_seed_stands_in_a_test_document():
    """No seed is a passage of any test document, and none of four words and more stands inside one."""
    whole = {ws for ws, _, _ in abuse.seeds() if len(ws) > 1}
    bad = {ws for ws, y, _ in abuse.seeds() if y > 0.5 and len(ws) >= 4}
    sizes = {len(ws) for ws in bad}
    for f in glob.glob("/root/testdata/sf*/documents.parquet"):
        for t in pd.read_parquet(f, columns=["text"])["text"]:
            for p in abuse.passages(t):
                assert p not in whole
                assert not any(p[i : i + n] in bad for n in sizes for i in range(len(p) - n + 1)), p


def test_long_mark_up_goes():
    assert list(abuse.passages("<a href='" + "x" * 5000 + "'>Thang ngu</a>")) == [("thang", "ngu")]
    assert list(abuse.passages("a < b and c > d")) == [("a", "b", "and", "c", "d")]


def test_short_passages(spark):
    assert list(abuse.passages("Thằng ngu. Idiot! 12. Tầng 3.")) == [("thang", "ngu"), ("idiot",), ("tang", "0")]
    assert {("thang", "ngu"), ("fuck", "you"), ("idiot",)} <= {s[0] for s in abuse.seeds()}
    assert found(spark, ["Thang ngu.", "The valve is shut. F-u-c-k you!", "Con lợn đất. Pump two.", "Thank you."], []) == {0, 1}
