"""Mergeable profiles: parts are read once, and merges equal one sketch of all rows within the rank error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantloom.operators import sketches
from variantloom.session import fresh_path


def part(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(rng.normal(1e6, 1, n), rng.exponential(5, n), rng.integers(0, 2, n))]
    return spark.createDataFrame([*rows, (None, float("nan"), 1)], "a double, b double, target int")


def test_merged_parts_describe_the_whole(spark):
    paths, frames = [], []
    for i in range(3):
        frames.append(part(spark, i, 4000))
        paths.append(fresh_path(spark, "part"))
        frames[i].write.parquet(paths[i])
    read = []

    def reader(i):
        return lambda: (read.append(i), spark.read.parquet(paths[i]))[1]

    out = fresh_path(spark, "sketches")
    first = {f"p{i}": (reader(i), [paths[i]]) for i in range(2)}
    sketches.update_sketches(spark, out, first, ["a", "b"])
    assert sorted(read) == [0, 1]
    stored = sketches.update_sketches(spark, out, first | {"p2": (reader(2), [paths[2]])}, ["a", "b"])
    assert sorted(read) == [0, 1, 2]  # only the new part was read
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = {r["feature"]: r for r in sketches.describe_sketched(sketches.merge_sketches(stored)).collect()}
    for c in ("a", "b"):
        values = np.sort([r[0] for r in whole.select(c).collect() if r[0] is not None and not np.isnan(r[0])])
        r = got[c]
        assert (r["rows"], r["missing"], r["count"], r["low"], r["high"]) == (12003, 3, 12000, values[0], values[-1])
        assert r["mean"] == pytest.approx(values.mean(), rel=1e-12) and r["std"] == pytest.approx(values.std(ddof=1), rel=1e-6)
        for q in (25, 50, 75):
            assert abs(np.searchsorted(values, r[f"q{q}"]) / len(values) - q / 100) < 0.03
    fences = {r["feature"]: r for r in sketches.outliers_sketched(sketches.merge_sketches(stored)).collect()}
    values = np.array([r[0] for r in whole.select("b").collect() if not np.isnan(r[0])])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    exact = 100 * ((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).mean()
    assert abs(fences["b"]["percent"] - exact) < 3


def test_classes_and_no_rows(spark):
    df = part(spark, 9, 500)
    merged = sketches.merge_sketches(sketches.column_sketches(df, ["a", "b"], ["target"]), ["target"])
    got = {r["feature"]: r for r in sketches.separation_sketched(merged, "target").collect()}
    means = {r["target"]: r["m"] for r in df.groupBy("target").agg(F.avg("a").alias("m")).collect()}
    assert got["a"]["mean_0"] == pytest.approx(means[0]) and got["a"]["mean_1"] == pytest.approx(means[1]) and abs(got["a"]["separation"]) < 1
    nothing = df.select(F.lit(None).cast("double").alias("a"))
    row = sketches.describe_sketched(sketches.merge_sketches(sketches.column_sketches(nothing, ["a"]))).first()
    assert (row["count"], row["missing"], row["mean"], row["q50"], row["low"]) == (0, 501, None, None, None)
    assert sketches.column_sketches(df.limit(0), ["a"]).count() == 0
