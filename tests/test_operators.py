import random

from pyspark.sql import functions as F

from bidloom.operators import matching, ordered, peers


def greedy(rows):
    out, left, right = [], set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in rows):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return sorted(out)


def test_assignment_is_the_greedy_one(spark):
    r = random.Random(5)
    for _ in range(3):
        rows = list({(r.randrange(25), r.randrange(25)): None for _ in range(120)})
        rows = [(a, b, r.choice([0.5, 0.7, 0.9])) for a, b in rows]
        df = spark.createDataFrame(rows, "a long, b long, s double").withColumn("o", -F.col("s"))
        got = sorted((x.a, x.b) for x in matching.assign_one_to_one(df, "a", "b", ["o"]).collect())
        assert got == greedy(rows)
    assert matching.assign_one_to_one(spark.createDataFrame([], "a long, b long, o double"), "a", "b", ["o"]).count() == 0


def test_nearest_rows_against_brute_force(spark):
    r = random.Random(3)
    left, right = [(i, "s", r.randrange(300)) for i in range(30)], [(i, "s", r.randrange(300)) for i in range(60)]
    got = {(x.a, x.b) for x in matching.nearest_rows(spark.createDataFrame(left, "a long, sheet string, p int"), spark.createDataFrame(right, "b long, sheet string, q int"), ["sheet"], "p", "q", "b", 35, 8).collect()}
    told = {(a, b) for a, _, p in left for _, b in sorted((abs(p - q), b) for b, _, q in right if abs(p - q) <= 35)[:8]}
    assert got == told


def test_components_and_clusters(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 9), (None, 4), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r.node: r.component for r in matching.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert (got[1], got[3], got[6], got[9], got[140]) == (1, 1, 5, 9, 100) and 4 not in got
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 4, 0.7)], "a long, b long, score double")
    who = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "node long, bidder string")
    assert {r.node: r.cluster for r in matching.constrained_clusters(edges, who).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_unmatched_and_duplicates(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "a long"), spark.createDataFrame([(7,), (8,)], "b long")
    m = spark.createDataFrame([(1, 8)], "a long, b long")
    assert sorted(matching.unmatched(m, l, r, "a", "b").collect()) == [(2, "missing"), (7, "extra")]
    assert matching.keyed_candidates(l.withColumn("k", F.lit("")), r.withColumn("k", F.lit("")), ["k"]).count() == 0


def test_peer_statistics(spark):
    df = spark.createDataFrame([(1, "a", 100.0), (1, "b", 105.0), (1, "c", 95.0), (1, "d", 500.0), (2, "a", 5.0), (3, "a", None)], "item int, seller string, price double")
    s = peers.spread(df, ["item"], "seller", "price").collect()
    assert len(s) == 1 and (s[0].middle, s[0].lowest, s[0].highest, s[0].offers) == (102.5, "c", "d", 4)
    z = {r.seller: round(r.z, 3) for r in peers.robust_z(df, ["item"], "price").collect()}
    assert set(z) == {"a", "b", "c", "d"} and z["d"] > 3.5 and abs(z["a"]) < 1
    m = peers.matrix(df, ["item"], "seller", "price", ["a", "d"]).orderBy("item").collect()
    assert (m[0].a, m[0].d, m[0].middle, m[1].d) == (100.0, 500.0, 300.0, None)
    assert peers.robust_z(df.limit(0), ["item"], "price").count() == 0


def test_consensus_and_vote(spark):
    df = spark.createDataFrame([(1, "Bơm", 3), (1, "bơm ", 1), (1, "Quạt", 2), (1, " ", 0), (1, None, 9)], "g int, v string, at int")
    assert [tuple(r) for r in peers.consensus(df, ["g"], "v", "at").collect()] == [(1, "bơm ", 2)]
    c = spark.createDataFrame([(1, "12", 0.8, "x", 1), (1, "12", 0.7, "y", 1), (1, "13", 0.99, "x", 2)], "cell int, t string, conf double, engine string, variant int")
    assert peers.vote(c, ["cell"], "t", "conf", "engine", "variant").collect()[0].reading == "12"


def test_ordered_rows(spark):
    df = spark.createDataFrame([("s", i, k, t) for i, (k, t) in enumerate([(0, "A"), (None, None), (1, "A1"), (None, None), (2, "x"), (1, "A2"), (None, None), (0, "B"), (None, None)])], "s string, at int, level int, title string")
    paths = [r.path for r in ordered.section_path(df, ["s"], "at", F.col("level"), F.col("title"), 3).orderBy("at").collect()]
    assert paths == [["A"], ["A"], ["A", "A1"], ["A", "A1"], ["A", "A1", "x"], ["A", "A2"], ["A", "A2"], ["B"], ["B"]]
    b = ordered.blank_streak(df, ["s"], "at", F.col("title").isNull()).orderBy("at").collect()
    assert [r.streak for r in b] == [0, 1, 0, 1, 0, 0, 1, 0, 1]
    long_ = spark.createDataFrame([("s", i, "x" if i in (0, 1, 5, 9) else None) for i in range(10)], "s string, at int, v string")
    assert sorted(r.at for r in ordered.before_long_gap(long_, ["s"], "at", F.col("v").isNull(), 2).collect()) == [0, 1]
    lines = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 10.0)], "p string, y double")
    assert sorted((r.mean, r.n) for r in ordered.merge_close(lines, ["p"], "y", 1.5).collect()) == [(1.5, 2), (10.0, 1)]


def test_legend(spark):
    rows = spark.createDataFrame([(["[1]", "[2]", "3", "4.0", "(5)=(3)*(4)"],), (["1", "Cáp", "3", "4"],), ([None, "1"],), (None,)], "c array<string>")
    assert [bool(r[0]) for r in rows.select(ordered.is_legend(F.col("c"))).collect()] == [True, False, False, False]


def test_hot_keys_match_in_order(spark):
    left = spark.createDataFrame([(i, "hot", i % 5) for i in range(400)] + [(1000, "cold", 1), (1001, None, 2), (1002, "", 3)], "a long, k string, x int")
    right = spark.createDataFrame([(i, "hot") for i in range(250)] + [(2000, "cold"), (2001, "cold"), (2002, None), (2003, "")], "b long, k string")
    got = matching.match_by_keys(left, right, "a", "b", ["k"], F.lit(1.0)).collect()
    assert len(got) == 251 and len({r.a for r in got}) == 251 and len({r.b for r in got}) == 251
    assert [r.b for r in got if r.a == 1000] == [2000]
    n = matching.numbered(left.filter("k = 'hot'"), ["k"], "a").select("at").collect()
    assert sorted(r.at for r in n) == list(range(1, 401))


def test_similar_pairs_against_brute_force(spark):
    from bidloom.functions import similarity

    r = random.Random(8)
    texts = [(i, " ".join(r.choices([*"abcdefgh", "thép", "cáp"], weights=[1] * 8 + [12, 12], k=6))) for i in range(60)]
    v = similarity.word_vectors(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    vec: dict = {}
    for x in v.collect():
        vec.setdefault(x.k, {})[x.gram] = x.w
    told = {(a, b) for a in vec for b in vec if sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= 0.7}
    got = {(x.a, x.b) for x in matching.similar_above(v.withColumnRenamed("k", "a"), v.withColumnRenamed("k", "b"), "a", "b", 0.7).collect()}
    assert got == told and len(got) > 60


def test_large_keys_match_by_score(spark):
    left = spark.createDataFrame([(i, "k", i % 10) for i in range(400)], "a long, k string, x int")
    right = spark.createDataFrame([(i, "k", 9 - i % 10) for i in range(400)], "b long, k string, y int")
    got = matching.match_by_keys(left, right, "a", "b", ["k"], 1 - F.abs(F.col("x") - F.col("y")) / 100).collect()
    assert len(got) == len({r.a for r in got}) == len({r.b for r in got}) == 400 and {r.score for r in got} == {1.0}
    few = matching.match_by_keys(left, right.filter("b < 45"), "a", "b", ["k"], 1 - F.abs(F.col("x") - F.col("y")) / 100, on=(["x"], ["y"])).collect()
    assert len(few) == len({r.b for r in few}) == 45 and all(r.a % 10 == 9 - r.b % 10 for r in few)
    uneven = matching.match_by_keys(left.filter("x = 3 and a < 30 or x = 5"), right.filter("y = 3 or y = 4 and b < 30"), "a", "b", ["k"], 1 - F.abs(F.col("x") - F.col("y")) / 100).collect()
    assert sorted(round(r.score, 2) for r in uneven) == [0.98] * 37 + [0.99] * 3 + [1.0] * 3


def test_one_to_one_with_ties(spark):
    """Ties of a whole key end in a few rounds; the result is that of the sequential rule."""
    rows = [(a, 100 + b, 0.0) for a in range(40) for b in range(40)] + [(a, 200 + b, 1.0) for a in range(50, 55) for b in range(3)] + [(60, 300, 0.0), (60, 301, 0.0), (61, 301, 0.0), (62, 302, 2.0), (None, 303, 0.0)]
    got = sorted((r.a, r.b) for r in matching.assign_one_to_one(spark.createDataFrame(rows, "a long, b long, o double"), "a", "b", ["o"]).collect())
    told, lefts, rights = [], set(), set()
    for o, a, b in sorted((o, a, b) for a, b, o in rows if a is not None):
        if a not in lefts and b not in rights:
            told.append((a, b))
            lefts.add(a)
            rights.add(b)
    assert got == sorted(told) and len(told) == 40 + 3 + 2 + 1


def test_too_many_sellers(spark):
    import pytest

    from bidloom.operators import peers

    have = spark.createDataFrame([(1, 5)], "cluster long, seller long")
    with pytest.raises(ValueError):
        peers.completion(have, "cluster", "seller", spark.range(peers.MOST_SELLERS + 1).withColumnRenamed("id", "seller"))
    assert peers.completion(have, "cluster", "seller", have.select("seller").limit(0)).count() == 0


def test_rows_after_a_long_gap_go(spark):
    from bidloom.operators import ordered

    df = spark.createDataFrame([("s", i) for i in (10, 11, 12, 300, 301)] + [("t", 5), ("t", 255), ("u", 1), ("u", 253)], "sheet string, row_number int")
    got = [(r.sheet, r.row_number) for r in ordered.before_number_gap(df, ["sheet"], "row_number", 250).collect()]
    assert sorted(got) == [("s", 10), ("s", 11), ("s", 12), ("t", 5), ("t", 255), ("u", 1)]
    assert len(ordered.before_number_gap(df, ["sheet"], "row_number", 287).collect()) == 9
