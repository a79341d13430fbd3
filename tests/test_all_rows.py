import random

import pytest

from bidloom.plans import catalogue, engine_queries, more_queries


def test_all_lines_of_an_order(spark):
    r = random.Random(4)
    rows = [(o, k, float(r.randint(1, 50)), r.randint(100, 9999) / 7, r.choice([0.0, 0.02, 0.05, 0.1])) for o in range(12) for k in range(1, 8)]
    rows += [(99, k, 10.0, 100.0, 0.1 if k < 6 else 0.0) for k in range(1, 8)]
    got = {x.record: x.cost for x in more_queries.reconciled(spark.createDataFrame(rows, "l_orderkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")).collect()}
    for o in {x[0] for x in rows}:
        side = lambda v: sorted(((1 - d, v(q, p)) for k, _, q, p, d in rows if k == o), reverse=True)[:5]  # noqa: E731, B023
        made = [5 * abs(q * p - a) / max(q * p, a, 1.0) + 0.15 * (1 - (c1 + c2 + c3) / 3) for c1, q in side(lambda q, p: q) for c2, p in side(lambda q, p: p / q) for c3, a in side(lambda q, p: p)]
        assert got[o] == pytest.approx(min(made), abs=2e-4)
    assert got[99] == 0.0 and "reconciled_orders" in catalogue.QUERIES


def test_texts_with_raised_digits_are_folded(spark, tmp_path):
    spark.createDataFrame([(1, "Sàn 20 m² × 3"), (2, "Ống ø20"), (3, "Tường"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in engine_queries.folded_text(spark, str(tmp_path)).collect()) == [1, 2, 3]
