import random

from hypothesis import given, settings
from hypothesis import strategies as st

from bidloom.llm import packing


@given(st.dictionaries(st.integers(1, 99), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_item_once(histogram):
    plan = packing.plan(histogram, 100)
    made: dict = {}
    for lengths, n in plan:
        assert sum(lengths) <= 100 and n > 0
        for x in lengths:
            made[x] = made.get(x, 0) + n
    assert made == histogram


def test_plan_is_tight():
    r = random.Random(4)
    h: dict = {}
    for _ in range(5000):
        x = min(2047, int(r.expovariate(1 / 400)) + 1)
        h[x] = h.get(x, 0) + 1
    used = sum(n for _, n in packing.plan(h, 2048))
    assert used <= 1.01 * sum(k * v for k, v in h.items()) / 2048 + 1


def test_fill(spark):
    rows = [(i, n) for i, n in enumerate([1, 2048, 2047, 5000, 100, 100, 100, 4096, 1024, 1024])]
    out = packing.fill(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id").collect()
    size: dict = {}
    pieces: dict = {}
    for r in out:
        size[r.container] = size.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
    assert max(size.values()) <= 2048 and len({(r.doc_id, r.piece_no) for r in out}) == len(out)
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == dict(rows)
    assert sorted(pieces[3]) == [(1, 2048), (2, 2048), (3, 904)] and len(size) == sorted(size)[-1] + 1
    assert packing.fill(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Khối lượng bu lông neo"), (2, None), (3, ""), (4, "a " * 300000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert set(got) == {1, 4} and 5 <= got[1] <= 25 and got[4] >= 250000


def test_stretches_count_as_the_whole(spark):
    """Very long texts, with and without blanks near the cuts, have the tokens of the whole text."""
    import random

    r = random.Random(3)
    path = packing.vocabulary_path()
    texts = [" ".join(r.choice(["cáp", "điện  đôi", "pump,", "12.5", "the", "\n\nvan", "x" * 90]) for _ in range(60_000)), "12 34. " * 60_000, "no blank between letters 1 " + "7 8 " * 100_000 + "then some words"]
    got = {x.k: x.n_tokens for x in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()}
    assert got == {i: len(packing.encoder(path).encode_ordinary(t)) for i, t in enumerate(texts)} and min(map(len, texts)) > packing.STRETCH
