"""Digests first, whole rows only where they recur."""

import math

from pyspark.sql import functions as F

from variantloom.operators import dedupe, profile


def table(spark):
    rows = [(i, f"text {i}", float(i), None) for i in range(200)]
    rows += rows[:20] * 3 + [(1, None, math.nan, "x"), (1, None, math.nan, "x"), (None, None, None, None), (None, None, None, None), (None, "a", None, None), (None, None, None, "a")]
    rows += [(7, "z", 0.0, None), (7, "z", -0.0, None)]
    return spark.createDataFrame(rows, "id bigint, name string, x double, other string").repartition(3)


def weak(columns):
    """A digest that many different rows share."""
    return F.pmod(F.coalesce("id", F.lit(0)), F.lit(5)), F.lit(0).cast("bigint")


def test_distinct_rows_whatever_the_digest(spark):
    df = table(spark)
    want = df.dropDuplicates()
    for settings in ({}, {"digest": weak}, {"most": 3}):
        got = dedupe.distinct_rows(df, **settings)
        assert got.columns == df.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
        counts = dedupe.duplicate_count(df, **settings).first()
        plain = profile.duplicate_count(df).first()
        assert tuple(counts) == tuple(plain)
    empty = df.limit(0)
    assert dedupe.distinct_rows(empty).count() == 0 and tuple(dedupe.duplicate_count(empty).first())[:2] == (0, 0)


def test_nulls_in_other_columns_have_other_digests(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "p string, q string")
    marked, seen, names = dedupe.recurring_digests(df)
    assert marked.select(*names).distinct().count() == 2 and seen.count() == 0


def shuffled_bytes(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan


def test_rows_of_their_own_are_not_shuffled(spark):
    wide = spark.range(5000).select("id", *[F.sha2((F.col("id") + i).cast("string"), 256).alias(f"c{i}") for i in range(6)])
    df = wide.unionByName(wide.limit(50))
    plan = shuffled_bytes(dedupe.distinct_rows(df))
    # the one exchange of whole rows lies behind the semi join with the digests that recur
    assert plan.split("== Initial Plan")[0].count("Exchange hashpartitioning(id") <= 1
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
