import random

from bidloom.operators import matching


def test_blocks_give_the_most_similar_rows(spark):
    r = random.Random(9)
    vec = lambda n, p: {f"{p}{i}": {g: r.choice([0.25, 0.5, 1.0]) for g in r.sample("abcdefghij", 3)} for i in range(n)}
    left, right = vec(20, "l"), vec(200, "r")
    left["l99"] = {"z": 1.0}
    df = lambda v, key: spark.createDataFrame([(k, g, w) for k, x in v.items() for g, w in x.items()], f"{key} string, gram string, w double")
    told = {(a, b) for a, x in left.items() for _, b in sorted((-sum(w * right[b].get(g, 0) for g, w in x.items()), b) for b in right if set(x) & set(right[b]))[:4]}
    for blocks in (1, 7, None):
        got = matching.top_similar(df(left, "a"), df(right, "b"), "a", "b", 4, blocks=blocks).collect()
        assert {(x.a, x.b) for x in got} == told and len(got) == 80
        assert all(abs(x.similarity - sum(w * right[x.b].get(g, 0) for g, w in left[x.a].items())) < 1e-12 for x in got)


def test_pairs_over_common_grams_are_not_written(spark):
    """One gram that all rows share: the plan has no join of the two sides on it."""
    v = spark.createDataFrame([(str(i), g, 1.0) for i in range(50) for g in ("x", f"y{i}")], "k string, gram string, w double")
    top = matching.top_similar(v.withColumnRenamed("k", "a"), v.withColumnRenamed("k", "b"), "a", "b", 2, blocks=2)
    assert "Join" not in top._jdf.queryExecution().toString() and top.count() == 100


def test_lookup_within_units_against_brute_force(spark):
    import math

    from bidloom.operators import retrieval

    r = random.Random(1)
    refs = [(f"R{i:03d}", " ".join(["ong", *r.sample(["thep", "nhua", "van", "cap", "dong", "bom"], 2)]), r.choice(["m", "kg", None])) for i in range(80)]
    words = {i: set(t.split()) for i, t, u in refs if u}
    unit = {i: u for i, _, u in refs}
    idf = {w: math.log((1 + len(words)) / (1 + sum(w in x for x in words.values()))) + 1 for x in words.values() for w in x}
    size = lambda x: math.sqrt(sum(idf[w] ** 2 for w in x))
    like = lambda a, b: sum(idf[w] ** 2 for w in words[a] & words[b]) / size(words[a]) / size(words[b])
    df = spark.createDataFrame(refs, "ref_id string, description string, unit string").filter("unit is not null")
    found = retrieval.lookup(df.withColumnRenamed("ref_id", "query_id"), df, "query_id", "ref_id", k=3)
    told = {(q, b, n) for q in words for n, (_, b) in enumerate(sorted((-round(like(q, b), 9), b) for b in words if b != q and unit[b] == unit[q])[:3], 1)}
    got = found.collect()
    assert "CoGroup" in found._jdf.queryExecution().toString()
    assert {(x.query_id, x.ref_id, x.place) for x in got} == told and all(abs(x.similarity - like(x.query_id, x.ref_id)) < 1e-9 for x in got)
