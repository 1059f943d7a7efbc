from breezeline.operators import skew


def rows_of(spark, counts):
    cities = [c for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(list(enumerate(cities)), "seq long, city string")


def test_pieces_follow_the_size_of_a_key(spark):
    rows = rows_of(spark, {"hot": 405, "warm": 25, "a": 3})
    hot = skew.hot_keys(rows, "city", "seq", split_rows=10)
    assert sorted(r["_pieces"] for r in hot.collect()) == [3, 41]


def test_salted_semi_join(spark):
    rows = rows_of(spark, {"hot": 405, "warm": 25, "a": 3, "b": 2})
    names = spark.createDataFrame([("hot",), ("a",)], "city string")
    got = skew.semi_join(rows, names, "city", "seq", split_rows=10, broadcast_bytes=0)
    assert got.columns == ["seq", "city"]
    assert sorted(got.collect()) == sorted(rows.where("city in ('hot', 'a')").collect())
