"""Ordered target statistics: exact sums, no row sees its own label, bins do not follow the categories."""

import hashlib

import pytest
from pyspark.sql import functions as F

from variantloom.contract import FEATURE_CONTRACT, TARGET
from variantloom.operators import models, statistics


def slice_of(*key):
    return int(hashlib.md5("|".join(["7", *map(str, key)]).encode()).hexdigest()[:2], 16)


def rows(n):
    return [(i, None if i % 11 == 0 else f"c{(i * i) % 7}", int(i * 7919 % 13 < 6)) for i in range(n)]


def test_values_are_means_of_earlier_slices(spark):
    data = rows(3000)
    df = spark.createDataFrame(data, "id bigint, c string, y int").repartition(3)
    fitted = statistics.fit_statistics(df, ["c"], "y", ["id"])
    got = {r["id"]: r["c_mean"] for r in fitted.encode(df, F.lit(True)).collect()}
    by_slice = {}
    for i, c, y in data:
        by_slice.setdefault(slice_of(i), []).append((c, y))
    for i, c, _ in data[:400]:
        before = [x for s, rs in by_slice.items() if s < slice_of(i) for x in rs]
        own = [y for k, y in before if k == c]
        base = sum(y for _, y in before) / len(before) if before else 0.5
        assert got[i] == pytest.approx((sum(own) + 10 * base) / (len(own) + 10))
    later = fitted.encode(spark.createDataFrame([(1, "c1", 0), (2, "new", 0)], "id bigint, c string, y int")).collect()
    whole = sum(y for _, _, y in data) / len(data)
    own = [y for _, c, y in data if c == "c1"]
    assert {r["c"]: pytest.approx(r["c_mean"]) for r in later} == {"c1": (sum(own) + 10 * whole) / (len(own) + 10), "new": whole}


def test_no_row_sees_its_own_label(spark):
    data = rows(300)
    changed = [(i, c, 1 - y if i == 42 else y) for i, c, y in data]
    values = []
    for table in (data, changed):
        df = spark.createDataFrame(table, "id bigint, c string, y int")
        values.append({r["id"]: r["c_mean"] for r in statistics.fit_statistics(df, ["c"], "y", ["id"]).encode(df, F.lit(True)).collect()})
    assert values[0][42] == values[1][42] and values[0] != values[1]
    empty = spark.createDataFrame([], "id bigint, c string, y int")
    assert statistics.fit_statistics(empty, ["c"], "y", ["id"]).encode(empty, F.lit(True)).count() == 0


def test_bins_do_not_follow_the_categories(spark):
    wide = spark.range(6000)
    cells = []
    for name, kind, _ in FEATURE_CONTRACT:
        own = F.concat(F.lit("k"), F.col("id").cast("string")) if kind == "string" else (F.xxhash64("id", F.lit(name)) % 100).cast("double")
        cells.append(own.alias(name))
    split = F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test")
    table = wide.select(*cells, (F.col("id") % 3 == 0).cast("int").alias(TARGET), split.alias("split"))
    model = models.train_gbt_ordered(table, max_iter=1, max_depth=2, bins=16)
    scored = models.model_scorer(model)(table.where("split = 'test'"))
    assert scored.where("probability BETWEEN 0 AND 1").count() == 1200
