import random

from pyspark.sql import functions as F

from playframe.llm.common import most_frequent, spread_join


def test_most_frequent_takes_whole_steps_from_the_top(spark):
    rng = random.Random(2)
    counts = [int(rng.paretovariate(0.8)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(counts)), "id long, n long")
    for most in (0, 1, 10, 200, 2999, 3000, 10 ** 6):
        taken = [r["n"] for r in most_frequent(df, "n", most).collect()]
        assert len(taken) <= most
        rest = sorted(counts)[:len(counts) - len(taken)]
        assert sorted(rest + taken) == sorted(counts) and (not taken or not rest or min(taken) > max(rest))
    assert len(most_frequent(df, "n", 3000).collect()) == 3000
    assert most_frequent(df.filter(F.lit(False)), "n", 5).count() == 0


def test_spread_join_is_a_left_join(spark):
    many = [(i, None if i % 7 == 0 else i % 3 * (i % 11) if i % 2 else 5, f"v{i}") for i in range(3000)]
    few = [(k, f"w{k}") for k in range(0, 40, 2)] + [(5, "hot")]
    left = spark.createDataFrame(many, "id long, k long, v string")
    right = spark.createDataFrame(few, "k long, w string")
    want = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v", "w").collect()), key=str)
    for parts in (1, 4, 1024):
        got = spread_join(left, right, "k", ["id"], parts)
        assert got.columns == ["k", "id", "v", "w"]
        assert sorted(map(tuple, got.select("id", "k", "v", "w").collect()), key=str) == want
    assert spread_join(left.limit(0), right, "k", ["id"]).count() == 0
    assert spread_join(left, right.limit(0), "k", ["id"]).filter("w is not null").count() == 0
