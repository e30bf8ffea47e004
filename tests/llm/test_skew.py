"""A join whose left side has a hot key and null keys equals the plain join."""

from pyspark.sql import functions as F

from tessera.llm.skew import FEW, keyed_join


def test_hot_and_null_keys_join_like_all_others(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 != 1, F.col("id") % 15_000)
    left = spark.range(2 * FEW).select("id", key.cast("long").alias("key"))
    right = spark.range(0, 15_000, 2).select(F.col("id").alias("key"), F.lit("x").alias("value")).unionByName(spark.sql("select 7L as key, 'hot' as value"))
    for how in ("inner", "left"):
        got = keyed_join(left, right, "key", how).select("id", "key", "value")
        want = left.join(right, "key", how).select("id", "key", "value")
        assert got.count() == want.count() and not got.exceptAll(want).limit(1).count()
