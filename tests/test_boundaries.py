"""Boundaries matched in order; conversations go to Python many at once."""

from threadlake.operators import facts


def test_matched_in_order(spark):
    d = [(1, 0), (1, 5), (1, 6), (2, 9), (3, 10), (3, 4)]
    g = [(1, 1), (1, 6), (1, 6), (1, 20), (3, 3), (3, 12), (4, 1)]
    both = [spark.createDataFrame(x, "conv_id long, pos long") for x in (d, g)]
    out = facts.match_boundaries(*both)
    assert sorted(map(tuple, out.collect())) == [(1, 3, 3, 4), (2, 0, 1, 0), (3, 1, 2, 2), (4, 0, 0, 1)]
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
