import pytest

from tidewatch.operators import skew


@pytest.mark.parametrize("hot_rows", [3, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, rows, how, hot_rows):
    """Hot keys, keys on one side only, repeated and missing keys: the rows of a plain join."""
    big = spark.createDataFrame([(i, "a" if i % 3 else f"k{i % 7}" if i % 2 else None) for i in range(60)], "i int, k string")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("k3", 3), (None, 4), ("z", 5)], "k string, v int")
    got = skew.salted_join(big, small, ["k"], how, salts=4, hot_rows=hot_rows)
    assert rows(got, "i", "k", "v") == rows(big.join(small, "k", how), "i", "k", "v")


def test_only_hot_keys_are_repeated(spark):
    """The small side keeps its size: it may be broadcast, and the plan does not see how often its rows are repeated."""
    small = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    hot = spark.createDataFrame([("k7", True)], "k string, __hot boolean")
    assert skew.repeated(small, hot, ["k"], 16).count() == 49 + 16
    big = spark.createDataFrame([("k7",)] * 40 + [("k8",)], "k string")
    joined = skew.salted_join(big, small, ["k"])  # no key is hot
    assert joined.count() == 41
