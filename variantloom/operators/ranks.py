"""Running sums and order statistics over value histograms, without a single-task sort.

A histogram row is one distinct value of one group with its counts. The values of a group are
cut into buckets at approximate quantiles; the bucket totals (a small table) give each bucket
its starting sum, and the running sum inside a bucket is an ordinary window over
(group, bucket). The bounds are stored before use, so a recomputed task sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.functions.values import finite
from variantloom.session import materialize

# buckets are powers of two; more are used only when one would hold too many distinct values
MIN_BUCKETS, ROWS_PER_BUCKET = 64, 1_000_000


def bucket_count(rows: int) -> int:
    buckets = MIN_BUCKETS
    while rows > buckets * ROWS_PER_BUCKET:
        buckets *= 2
    return buckets


def unpivoted(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per cell: (by..., feature, value). An Expand in the same stage, not a shuffle.

    Grouping these rows by ``feature`` keeps one short aggregation loop, where one aggregate per
    column would generate code too long to be compiled.
    """
    wide = df.select(*by, *[finite(F.col(c)).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "feature", "value")


def value_histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per distinct finite value of each column: (by..., feature, value, n), in one shuffle.

    Equal values are combined before the shuffle, so a value that fills a third of a column
    costs one row per task.
    """
    long = unpivoted(df, columns, by).where(F.col("value").isNotNull())
    return long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def prefix_sums(
    hist: DataFrame, group: Sequence[str], value: str, sums: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Adds ``cum_<s>`` (running sum up to and including this value) and ``tot_<s>`` per group.

    ``hist`` has one row per (group, value) and should be a stored table: it is read several
    times. ``buckets`` is a power of two, by default chosen from the largest group.
    """
    # a struct of the group columns is never NULL itself, so a NULL group is kept by the joins
    keys = ["_group"]
    hist = hist.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0)))
    buckets = buckets or bucket_count(hist.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = hist.groupBy(*keys).agg(F.percentile_approx(value, cuts, max(1000, 16 * buckets)).alias("_bounds"))
    bounds = materialize(bounds, "bucket-bounds")
    bucketed = _place(hist.join(bounds, keys, "left"), value, buckets).drop("_bounds")

    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_start_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    # the join key is the window key: the histogram is shuffled once for both
    joined = bucketed.join(starts, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = joined.withColumns({f"cum_{s}": F.col(f"_start_{s}") + F.sum(s).over(inside) for s in sums})
    return running.drop(*[f"_start_{s}" for s in sums], "_bucket", "_group")


def _place(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds ``_bucket``: how many of the sorted ``_bounds`` lie below the value, by halving steps.

    Six compiled comparisons for 64 buckets; a filter over the array would be interpreted.
    """
    df = df.withColumn("_bucket", F.lit(0))
    step = buckets // 2
    while step:
        edge = F.col("_bounds")[F.col("_bucket") + (step - 1)]
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(edge < F.col(value), step).otherwise(0))
        step //= 2
    return df


def order_statistic(rank: Column, value: str) -> Column:
    """Value at a zero-based rank, inside an aggregate over ``prefix_sums`` of the count ``n``."""
    return F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), F.col(value)))


def exact_quantiles(
    hist: DataFrame, group: Sequence[str], quantiles: dict[str, float], value: str = "value"
) -> DataFrame:
    """Exact linear-interpolated quantiles per group from a histogram with counts ``n``."""
    running = prefix_sums(hist, group, value, ["n"])
    parts = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("tot_n") - 1)
        parts += [
            order_statistic(F.floor(position), value).alias(f"_lo_{name}"),
            order_statistic(F.ceil(position), value).alias(f"_hi_{name}"),
        ]
    stats = running.groupBy(*group).agg(F.max("tot_n").alias("_n"), *parts)

    def interpolated(name: str, q: float) -> Column:
        position = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return stats.select(*group, F.col("_n").alias("n"), *[interpolated(name, q) for name, q in quantiles.items()])


def approx_quantiles(df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """One-pass approximate alternative to ``exact_quantiles`` for very wide value ranges."""
    probes = list(quantiles.values())
    one_row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probes, accuracy).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(c).alias("feature"), *[F.col(c)[i].alias(n) for i, n in enumerate(quantiles)]) for c in columns
    ]
    return one_row.select(F.inline(F.array(*entries)))
