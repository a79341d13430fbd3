from pyspark.sql import functions as F

from bidloom.operators import flags


def test_peers_that_stand_out(spark):
    rows = [("a", s, p) for s, p in (("w", 100.0), ("x", 105.0), ("y", 95.0), ("z", 200.0))] + [("b", "w", 100.0), ("b", "x", 102.0), ("b", "y", 98.0), ("c", "w", 5.0), ("d", "w", 10.0), ("d", "x", 12.0), ("e", "w", None), ("e", "x", 1.0), ("f", "w", 0.0), ("f", "x", 0.0)]
    got = {(r.item, r.seller): r.severity for r in flags.peer_flags(spark.createDataFrame(rows, "item string, seller string, price double"), ["item"], "seller", "price").collect()}
    assert got == {("a", "y"): "critical", ("a", "z"): "critical", ("d", "w"): "warning", ("d", "x"): "warning"}
    assert flags.peer_flags(spark.createDataFrame([], "item string, seller string, price double"), ["item"], "seller", "price").count() == 0


def test_scores(spark):
    rows = [(1, "#REF! in D4", "exact_code", 0.5, 0.9), (1, "formula", "exact_code", 0.7, 0.9), (2, "no price", "fuzzy", 0.9, 0.6), (3, "product", "fuzzy", 0.9, 0.9)]
    df = spark.createDataFrame(rows, "id long, flag string, kind string, l double, s double")
    sev, pts = flags.flag_severity(F.col("flag"))
    got = {r.id: (r.flags, r.severity, r.score) for r in flags.totals(df.withColumns({"severity": sev, "score": pts}), ["id"]).collect()}
    assert got == {1: (2, "critical", 44.0), 2: (1, "review", 5.0), 3: (1, "critical", 22.0)}
    sev, pts = flags.name_severity(F.col("kind"), F.col("l"), F.col("s"))
    assert [(r[0], round(r[1], 6)) for r in df.orderBy("id", F.desc("flag")).select(sev, pts).collect()] == [("warning", 20.0), ("critical", 32.0), ("review", 18.0), ("ok", 0.0)]
    many = df.withColumns({"severity": F.lit("warning"), "score": F.lit(60.0)})
    assert flags.totals(many, ["kind"]).filter("kind = 'fuzzy'").first().score == 100.0
