import random

from genoloom.operators.intervals import merge


def test_unions_are_a_loop_and_nothing_is_grouped(spark):
    rng = random.Random(6)
    rows = [(k, s, s + rng.randrange(12)) for k in range(20) for s in rng.choices(range(120), k=rng.randrange(1, 25))] + [(99, 5, 5), (99, 6, 6), (99, 6, 6), (99, 8, 9)]
    want = []
    for k, s, e in sorted(rows):
        if want and want[-1][0] == k and s <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([k, s, e])
    got = merge(spark.createDataFrame(rows, "k int, start int, gend int"), "k", "start", "gend")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # before, unions were groups of a hash table
