import random

from bidloom.functions import similarity
from bidloom.operators import retrieval


def told(x, y):
    a, b = set(x.split()), set(y.split())
    lexical = (0.35 * similarity.weighted_ratio(x, y) + 0.35 * similarity.token_set_ratio(x, y) + 0.30 * similarity.partial_ratio(x, y)) / 100
    return min(1.0, 0.72 * lexical + 0.28 * len(a & b) / max(len(a | b), 1))


def test_best_of_all_requirements():
    r = random.Random(2)
    words = ["cap", "dien", "dong", "ong", "thep", "van", "cong", "bom", "nuoc", "quat", "dn25", "pn16", "xk7q9", "4x10", "capdien", "thp"]
    asked = [(t, i) for i, t in enumerate(dict.fromkeys(" ".join(r.sample(words, r.randint(1, 5))) for _ in range(60)))]
    items = [" ".join(r.sample(words, r.randint(1, 9))) for _ in range(150)] + ["", "zzzz"]
    table = retrieval.Requirements(asked, 0.54)
    for x in items:
        scores = [(-told(x, y), i) for y, i in asked] if x else []
        if x:
            assert all(b >= -s - 1e-9 for b, (s, _) in zip(table.bounds(x)[0], scores, strict=True))
        best = min((s for s in scores if s[0] <= -0.54), default=None)
        got = table.best(x)
        assert (got is None) == (best is None) and (got is None or (abs(got[1] + best[0]) < 1e-9 and got[0] == best[1]))


def test_short_requirement_in_a_long_name(spark):
    name = "Van cổng " + " ".join(f"xk{i}q{i * 7}" for i in range(9))
    items = spark.createDataFrame([(i, name) for i in (1, 2)] + [(3, "capdien"), (9, None)], "item_id long, name string")
    asked = spark.createDataFrame([(10, "Van cổng"), (11, "Cáp điện"), (12, None)], "requirement_id long, wanted string")
    got = {r.item_id: r.requirement_id for r in retrieval.best_requirement(items, asked, "item_id", "requirement_id", "name", "wanted").collect()}
    assert got == {1: 10, 2: 10, 3: 11}
