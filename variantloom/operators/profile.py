"""Data-quality and feature profiles, each from one pass over the table where possible."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantloom.contract import CATEGORICAL_FEATURES, TARGET
from variantloom.functions.values import count_if, finite, ratio
from variantloom.operators.ingest import numeric_columns
from variantloom.operators.ranks import exact_quantiles, unpivoted, value_histogram
from variantloom.session import materialize

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
FEATURE_GROUPS = {
    "context": ["CHROM", "REF_Base", "ALT_Base", "mutation_type", "normalized_pos", "pos_bin"],
    "annotation": ["SIFT", "PolyPhen", "CADD"],
    "frequency": ["ALT_FREQ", "freq_log", "rare_variant", "is_ultra_rare"],
    "engineered": [
        "Is_InDel", "Delta_Length", "indel_size", "Is_Frameshift", "is_large_indel", "CADD_high", "CADD_very_high",
        "SIFT_damaging", "PolyPhen_damaging", "CADD_x_rare", "Impact_Score", "rare_impact", "pos_freq_interaction",
        "is_transition", "is_transversion", "chrom_freq_mean", "chrom_rare_rate",
    ],
}
SENTINELS_NUMERIC = [-1, 0]
SENTINELS_TEXT = ["N", "-"]


def _long(one_row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """A wide one-row aggregate turned into one row per entry (the width is that of the schema)."""
    return one_row.select(F.inline(F.array(*entries)))


def feature_columns(df: DataFrame, target: str = TARGET) -> list[str]:
    return [c for c in numeric_columns(df) if c != target]


def feature_type_split(df: DataFrame, target: str = TARGET) -> dict[str, list[str]]:
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    groups = {name: [c for c in columns if c in df.columns] for name, columns in FEATURE_GROUPS.items()}
    return {"numeric": feature_columns(df, target), "categorical": [c for c in text if c != target], **groups}


def missing_report(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).alias("missing_count"), F.round(ratio(F.col(c), F.col("_n")) * 100, 2).alias("percentage")
        )
        for c in df.columns
    ]
    return _long(counts, entries).where("missing_count > 0").orderBy(F.desc("missing_count"), "feature")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Repeats of a full row beyond its first copy; copies are combined before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    n = F.coalesce(F.sum("_copies"), F.lit(0))
    repeats = n - F.count(F.lit(1))
    return groups.agg(n.alias("rows"), repeats.alias("duplicates"), (ratio(repeats, n, 0.0) * 100).alias("percent"))


def schema_audit(df: DataFrame, samples: int = 4, approximate: bool = False) -> DataFrame:
    """Per column: type, non-null and null counts, distinct values (NULL counts as one) and samples.

    Samples are the smallest values as text. The exact form counts distinct (column, value)
    pairs in one shuffle with map-side combining; ``approximate`` replaces that by sketches.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if approximate:
        stats = []
        for c in df.columns:
            nulls = count_if(F.col(c).isNull())
            stats.append(
                F.struct(
                    F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.count(F.col(c)).alias("non_null"),
                    nulls.alias("null_count"),
                    (F.approx_count_distinct(F.col(c)) + F.least(nulls, F.lit(1))).alias("unique_values"),
                    F.min(F.col(c).cast("string")).alias("sample_values"),
                )
            )
        return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])
    pairs = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs, "column-values")
    counts = pairs.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("unique_values"),
    )
    # planned as a per-task limit: at most `samples` values per column and task are shuffled
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    smallest = pairs.where(F.col("value").isNotNull()).withColumn("_i", first).where(F.col("_i") <= samples)
    shown = smallest.groupBy("column").agg(F.concat_ws("|", F.array_sort(F.collect_list("value"))).alias("sample_values"))
    dtype = F.create_map(*[F.lit(x) for item in types.items() for x in item])
    return counts.join(shown, "column", "left").select(
        "column", dtype[F.col("column")].alias("dtype"), "non_null", "null_count", "unique_values",
        F.coalesce("sample_values", F.lit("")).alias("sample_values"),
    )


def sentinel_report(df: DataFrame, top: int = 40) -> DataFrame:
    """How often each column holds a value that may stand for "missing"."""
    probes = []
    for f in df.schema:
        numeric = isinstance(f.dataType, T.NumericType)
        for value in SENTINELS_NUMERIC if numeric else SENTINELS_TEXT:
            probes.append((f.name, value))
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c) == F.lit(v)).alias(f"_p{i}") for i, (c, v) in enumerate(probes)]
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(str(v)).alias("sentinel_value"), F.col(f"_p{i}").alias("count"),
            (ratio(F.col(f"_p{i}"), F.col("_n")) * 100).alias("percent"),
        )
        for i, (c, v) in enumerate(probes)
    ]
    found = _long(counts, entries).where("count > 0")
    return found.orderBy(F.desc("percent"), "feature", "sentinel_value").limit(top)


def infinite_count(df: DataFrame) -> DataFrame:
    total = F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            total = total + count_if(F.abs(F.col(f.name)) == float("inf"))
    return df.agg(total.cast("bigint").alias("infinite_cells"))


def class_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Count and share per class; the classes are two, so the window is over two rows."""
    counts = df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", ratio(F.col("count"), total))


def imbalance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: class counts, n1/n0 and the positive-class weight n0/n1."""
    n1, n0 = count_if(F.col(target) == 1), count_if(F.col(target) == 0)
    return df.agg(
        n0.alias("negatives"), n1.alias("positives"), ratio(n1, n0).alias("imbalance_ratio"), ratio(n0, n1).alias("scale_pos_weight")
    )


def histogram_moments(hist: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """count, mean, std, min and max per column from counts of distinct values; the deviation is centred."""
    n, x = F.col("n"), F.col("value")
    first = hist.groupBy(*by).agg(F.sum("n").alias("count"), ratio(F.sum(n * x), F.sum("n")).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    spread = hist.join(first.select(*by, "mean"), list(by)).groupBy(*by).agg(F.sum(n * F.pow(x - F.col("mean"), F.lit(2))).alias("_ss"))
    return first.join(spread, list(by)).withColumn("std", F.sqrt(F.try_divide("_ss", F.col("count") - 1))).drop("_ss")


def histogram_of(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Stored value histogram, the shared input of the quantile-based profiles."""
    return materialize(value_histogram(df, columns, by), "value-histogram")


def _overall(hist: DataFrame) -> DataFrame:
    return hist.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def describe_numeric(df: DataFrame, hist: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = feature_columns(df)
    hist = materialize(_overall(hist), "value-histogram") if hist is not None else histogram_of(df, columns)
    quartiles = exact_quantiles(hist, ["feature"], QUARTILES).drop("n")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = names.join(histogram_moments(hist), "feature", "left").join(quartiles, "feature", "left")
    shown = ["mean", "std", "min", "q1", "median", "q3", "max"]
    return joined.select("feature", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), *[F.round(c, digits).alias(c) for c in shown])


def iqr_outliers(hist: DataFrame, top: int | None = 10) -> DataFrame:
    """Values beyond 1.5 interquartile ranges per column, from the histogram alone."""
    overall = materialize(_overall(hist), "value-histogram")
    bounds = exact_quantiles(overall, ["feature"], {"q1": 0.25, "q3": 0.75}).drop("n")
    spread = F.col("q3") - F.col("q1")
    bounds = bounds.withColumns({"low": F.col("q1") - 1.5 * spread, "high": F.col("q3") + 1.5 * spread})
    # one row of bounds per column of the table: broadcast size is fixed by the schema
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counts = overall.join(F.broadcast(bounds), "feature").groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers")
    )
    report = counts.withColumn("percent", ratio(F.col("outliers"), F.col("rows")) * 100)
    report = report.withColumn("flagged", F.col("percent") > 5.0)
    return report if top is None else report.orderBy(F.desc("outliers"), "feature").limit(top)


def boxplot_stats(hist: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Five-number summary per column and class; ``hist`` is taken by ``target``."""
    five = {"low": 0.0, **QUARTILES, "high": 1.0}
    return exact_quantiles(hist.where(F.col("feature").isin(list(columns))), [target, "feature"], five)


def category_lift(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES, target: str = TARGET, top: int | None = 15
) -> DataFrame:
    """Count, positive rate and share of each category, the ``top`` most frequent per column (None: all)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category")) for c in columns])
    groups = df.select(target, F.inline(cells)).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("count"), F.avg(target).alias("pathogenic_rate")
    )
    total = F.sum("count").over(Window.partitionBy("feature"))
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "category"))
    ranked = groups.withColumns({"dataset_share": ratio(F.col("count"), total), "place": place})
    return (ranked if top is None else ranked.where(F.col("place") <= top)).orderBy("feature", "place")


def dataset_share(df: DataFrame, column: str) -> DataFrame:
    groups = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return groups.withColumn("dataset_share", ratio(F.col("count"), total))


def rate_by_chrom(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy("CHROM").agg(F.avg(target).alias("pathogenic_rate")).orderBy("CHROM")


def top_mutation_types(df: DataFrame, target: str = TARGET, minimum: int = 100, top: int | None = 15) -> DataFrame:
    groups = df.groupBy("mutation_type").agg(F.count(F.lit(1)).alias("count"), F.avg(target).alias("pathogenic_rate"))
    frequent = groups.where(F.col("count") >= minimum)
    ordered = frequent.orderBy(F.desc(F.round("pathogenic_rate", 9)), "mutation_type")
    return ordered if top is None else ordered.limit(top)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def target_correlation(df: DataFrame, target: str = TARGET, top: int | None = 15, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric column with the target, highest first."""
    names = list(columns) if columns is not None else feature_columns(df, target)
    # a pair with a missing side is left out on both
    pairs = unpivoted(df, names, [target]).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    r = safe_corr(F.col("value"), F.col(target).cast("double"))
    report = pairs.groupBy("feature").agg(F.round(r, 6).alias("correlation"))
    report = report.orderBy(F.desc_nulls_last("correlation"), "feature")
    return report if top is None else report.limit(top)


def masked_sums(df: DataFrame, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Over the rows where both columns have a value, for each pair: n, x, xx, xy, as matrices with one line for each column.

    Values are taken from their column's mean, so large ones lose no digits; gaps are zeros under a mask, so no row is
    taken apart into its pairs. A task sends one line of sums a column, and Spark adds equal lines up.
    """
    means = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.avg(F.col(c)), F.lit(0.0)).alias(c) for c in names]).first()
    shift, k = np.array([means[c] for c in names]), len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 4 * k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - shift
            held = ~np.isnan(x)
            x, held = np.where(held, x, 0.0), held.astype(float)
            total += np.concatenate([held.T @ held, x.T @ held, (x * x).T @ held, x.T @ x], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["line", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, cells in zip(batch.column("line").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                lines[line] = lines.get(line, 0.0) + np.array(cells)
        yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array(list(lines.values()), pa.list_(pa.float64()))], ["line", "cells"])

    schema = "line int, cells array<double>"
    rows = df.select(*names).mapInArrow(sums, schema).repartition("line").mapInArrow(added, schema).collect()  # one a column
    whole = np.zeros((k, 4 * k))
    for r in rows:
        whole[r["line"]] = r["cells"]
    return dict(zip(("n", "x", "xx", "xy"), np.split(whole, 4, axis=1), strict=True))


def high_correlation_pairs(df: DataFrame, target: str = TARGET, minimum: float = 0.9) -> DataFrame:
    """Column pairs with ``abs(r)`` above ``minimum``, strongest first. A row counts for a pair when both values are there."""
    names = feature_columns(df, target)
    numbers = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in names])
    found: list[tuple[str, str, float]] = []
    if len(names) > 1:
        m = masked_sums(numbers, names)
        n = np.maximum(m["n"], 1.0)
        spread = m["xx"] - m["x"] ** 2 / n  # of the line's column, where the other has a value
        flat = (spread <= 1e-9 * m["xx"]) | (m["n"] < 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(flat | flat.T, np.nan, (m["xy"] - m["x"] * m["x"].T / n) / np.sqrt(spread * spread.T))
        found = [(a, b, float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and abs(r[i, j]) > minimum]
    table = df.sparkSession.createDataFrame(found, "feature_a string, feature_b string, r double")
    return table.orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")


def class_separation(hist: DataFrame, target: str = TARGET, top: int | None = 20) -> DataFrame:
    """Class means and medians per column and their difference in overall standard deviations, from the
    histogram by class alone."""
    n, x = F.col("n"), F.col("value")
    stored = materialize(hist.groupBy(target, "feature").agg(F.sum("n").alias("n"), F.sum(n * x).alias("total")), "class-totals")

    def class_mean(label: int) -> Column:
        inside = F.col(target) == label
        return ratio(F.sum(F.when(inside, F.col("total"))), F.sum(F.when(inside, n)))

    means = stored.groupBy("feature").agg(class_mean(0).alias("benign_mean"), class_mean(1).alias("pathogenic_mean"))
    means = means.join(histogram_moments(_overall(hist)).select("feature", F.col("std").alias("_std")), "feature")
    medians = exact_quantiles(hist.where(F.col(target).isin(0, 1)), [target, "feature"], {"median": 0.5})
    wide = medians.groupBy("feature").agg(
        F.max(F.when(F.col(target) == 0, F.col("median"))).alias("benign_median"),
        F.max(F.when(F.col(target) == 1, F.col("median"))).alias("pathogenic_median"),
    )
    delta = F.col("pathogenic_mean") - F.col("benign_mean")
    joined = means.join(wide, "feature", "left").withColumn("mean_delta", delta)
    joined = joined.withColumn("standardized_delta", ratio(F.col("mean_delta"), F.col("_std"), 0.0)).drop("_std")
    joined = joined.withColumn("abs_standardized_delta", F.round(F.abs("standardized_delta"), 6))
    ordered = joined.orderBy(F.desc("abs_standardized_delta"), "feature")
    return ordered if top is None else ordered.limit(top)


def cumulative_importance(importance: DataFrame, share: float = 0.9) -> DataFrame:
    """Running share of an importance table (one row per feature) and how many features reach ``share``."""
    order = Window.partitionBy().orderBy(F.desc("importance"), "feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    cumulative = ratio(F.sum("importance").over(running), F.sum("importance").over(whole))
    shares = importance.withColumns({"place": F.row_number().over(order), "cumulative_share": cumulative})
    below = F.count(F.when(F.col("cumulative_share") <= share, 1)).over(whole)
    return shares.withColumn("features_needed", below + 1)


def recommendations(df: DataFrame, hist: DataFrame, target: str = TARGET) -> DataFrame:
    """Quality checks as rows (check, severity, message)."""

    def row(source: DataFrame, check: str, bad: Column, warn_text: Column, good_text: str, severity: Column | None = None):
        level = severity if severity is not None else F.lit("warning")
        return source.select(
            F.lit(check).alias("check"),
            F.when(bad, level).otherwise("ok").alias("severity"),
            F.when(bad, warn_text).otherwise(good_text).alias("message"),
        )

    text = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    missing = missing_report(df).agg(F.count(F.lit(1)).alias("n"))
    duplicates = duplicate_count(df)
    balance = imbalance(df, target)
    pairs = high_correlation_pairs(df, target).agg(F.count(F.lit(1)).alias("n"))
    outliers = iqr_outliers(hist, top=None).where("flagged").agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws(", ", F.array_sort(F.collect_list("feature"))).alias("names")
    )
    skew = F.col("imbalance_ratio")
    parts = [
        row(missing, "missing values", F.col("n") > 0, text(F.col("n"), " columns have missing values; impute or remove"), "no missing values"),
        row(duplicates, "duplicates", F.col("duplicates") > 0, text(F.col("duplicates"), " duplicate rows to remove"), "no duplicate rows"),
        row(
            balance, "class imbalance", skew > 1.5,
            F.concat(F.format_string("%.2f", skew), F.lit(":1 positives to negatives; weight the classes")), "classes are balanced",
            F.when(skew > 2, "severe").otherwise("moderate"),
        ),
        row(pairs, "multicollinearity", F.col("n") > 0, text(F.col("n"), " feature pairs with |r| > 0.9"), "no strongly correlated pairs"),
        row(outliers, "outliers", F.col("n") > 0, F.concat(F.lit("more than 5% outliers: "), F.col("names")), "outlier levels are reasonable"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def head_preview(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)
