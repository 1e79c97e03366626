"""Evaluation of scored tables: splits, threshold sweep, ranking metrics, calibration, selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.functions.values import count_if, finite, ratio
from variantloom.operators.ranks import prefix_sums
from variantloom.session import materialize

SEED = 42
# leading hex digits of the md5: 65536 even slices, known without looking at the data
SLICE_DIGITS = 4


# --- splits and samples -----------------------------------------------------------------


def row_hash(key: Sequence[str], seed: int = SEED) -> Column:
    """Portable hash of a row key: 32 hex digits, uniform for any key."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _digits(share: float) -> str:
    return f"{min(int(share * 0x100000000), 0xFFFFFFFF):08x}"


def stratified_split(
    df: DataFrame, key: Sequence[str], shares: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "validation", "test"), seed: int = SEED
) -> DataFrame:
    """Adds ``split`` by hash range: no shuffle, and every class is cut in the same shares.

    A key always lands in the same split, so copies of a variant never straddle two of them.
    """
    prefix = F.substring(row_hash(key, seed), 1, 8)
    edges = np.cumsum(shares)[:-1]
    split = F.when(prefix < _digits(edges[0]), names[0])
    for edge, name in zip(edges[1:], names[1:]):
        split = split.when(prefix < _digits(edge), name)
    return df.withColumn("split", split.otherwise(names[-1]))


def stratified_kfold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` (1..k) by hash range, without a shuffle."""
    prefix = F.substring(row_hash(key, seed), 1, 8)
    fold = F.lit(1)
    for i in range(1, k):
        fold = fold + F.when(prefix >= _digits(i / k), 1).otherwise(0)
    return df.withColumn("fold", fold)


def hash_cutoffs(df: DataFrame, group: str, key: Sequence[str], quotas: dict[str, Column], seed: int = SEED) -> DataFrame:
    """Per group, the largest row hash inside each quota of rows (one row for each group).

    Rows are counted per hash slice; only the slices in which quotas end are looked at row by row, in one
    pass for all quotas. ``quotas`` maps a name to a column over the group size ``n``.
    """
    hashed = df.select(F.struct(F.col(group).alias("v")).alias("_g"), row_hash(key, seed).alias("_h"))
    counts = hashed.groupBy("_g", F.substring("_h", 1, SLICE_DIGITS).alias("_slice")).agg(F.count(F.lit(1)).alias("_c"))
    counts = materialize(counts, "hash-slices")
    by_group = Window.partitionBy("_g")
    sizes = counts.withColumns(
        {"n": F.sum("_c").over(by_group), "_upto": F.sum("_c").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))}
    )
    names = list(quotas)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), quota.cast("bigint").alias("quota")) for name, quota in quotas.items()])
    each = sizes.select("_g", "_slice", "_c", "_upto", F.inline(wanted))
    ends = each.where((F.col("_upto") - F.col("_c") < F.col("quota")) & (F.col("quota") <= F.col("_upto")))
    ends = materialize(ends.select("_g", "_slice", "name", (F.col("quota") - (F.col("_upto") - F.col("_c"))).alias("_inside")), "quota-ends")
    slices = ends.select("_g", "_slice").distinct()
    candidates = hashed.withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS)).join(slices, ["_g", "_slice"], "left_semi")
    per_hash = candidates.groupBy("_g", "_slice", "_h").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("_g", "_slice").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    reached = per_hash.withColumn("_u", upto).join(ends, ["_g", "_slice"]).where(F.col("_u") <= F.col("_inside"))
    cuts = reached.groupBy("_g", "name").agg(F.max("_h").alias("_cut"))
    # a quota smaller than the first group of copies ends before the slice
    cuts = ends.join(cuts, ["_g", "name"], "left").select("_g", "name", F.coalesce("_cut", "_slice").alias("_cut"))
    found = cuts.groupBy("_g").agg(*[F.max(F.when(F.col("name") == n, F.col("_cut"))).alias(n) for n in names])
    return found.select(F.col("_g.v").alias(f"_cut_{group}"), *names)


def stratified_split_exact(
    df: DataFrame, target: str, key: Sequence[str], shares: Sequence[float] = (0.7, 0.15), names: Sequence[str] = ("train", "validation", "test"), seed: int = SEED
) -> DataFrame:
    """Adds ``split`` with class counts rounded from the shares; ranks rows by hash within a class."""
    edges = np.cumsum(shares)
    quotas = {f"_cut{i}": F.floor(F.col("n") * F.lit(float(e)) + 0.5) for i, e in enumerate(edges)}
    cutoffs = materialize(hash_cutoffs(df, target, key, quotas, seed), "split-cutoffs")
    joined = df.join(cutoffs, F.col(target).eqNullSafe(F.col(f"_cut_{target}")), "left").withColumn("_h", row_hash(key, seed))
    split = F.when(F.col("_h") <= F.col("_cut0"), names[0])
    for i in range(1, len(edges)):
        split = split.when(F.col("_h") <= F.col(f"_cut{i}"), names[i])
    return joined.withColumn("split", split.otherwise(names[-1])).drop("_h", f"_cut_{target}", *quotas)


def random_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """``n`` rows by hash order; the same rows on every run.

    Rows are counted per hash slice first, so that only the rows up to the slice in which the sample ends are
    sorted, not ``n`` rows of every task.
    """
    hashed = df.withColumn("_h", row_hash(key, seed))
    counts = hashed.groupBy(F.substring("_h", 1, SLICE_DIGITS).alias("_slice")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))  # 65536 rows at most
    last = counts.withColumn("_upto", upto).where(F.col("_upto") - F.col("_c") < n).agg(F.max("_slice")).scalar()
    return hashed.where(F.substring("_h", 1, SLICE_DIGITS) <= last).orderBy("_h", *key).limit(n).drop("_h")


def stratified_sample(df: DataFrame, n: int, target: str, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """About ``n`` rows keeping the class shares: per class, the rows up to a hash cut-off."""
    total = df.count()
    share = min(1.0, n / total) if total else 0.0
    cutoffs = hash_cutoffs(df, target, key, {"_cut": F.floor(F.col("n") * F.lit(share) + 0.5)}, seed)
    cutoffs = materialize(cutoffs, "sample-cutoffs")
    joined = df.join(cutoffs, F.col(target).eqNullSafe(F.col(f"_cut_{target}")))
    return joined.where(row_hash(key, seed) <= F.col("_cut")).drop("_cut", f"_cut_{target}")


def holdout_by_chromosome(df: DataFrame, chromosomes: Sequence[str], chrom: str = "chrom") -> DataFrame:
    return df.withColumn("split", F.when(F.col(chrom).isin(list(chromosomes)), "holdout").otherwise("train"))


def leakage(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Variant keys that occur in more than one split."""
    sides = df.groupBy(*key).agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    return sides.where(F.col("_a") != F.col("_b")).select(*key)


# --- threshold metrics ------------------------------------------------------------------


def thresholds(n: int = 50) -> list[float]:
    return [float(x) for x in np.linspace(0.05, 0.95, n)]


def threshold_sweep(df: DataFrame, n: int = 50, target: str = "target", p: str = "probability") -> DataFrame:
    """F1 at each of ``n`` thresholds (a row is positive from ``p >= threshold``).

    Each row falls into one slot between neighbouring thresholds; the sweep itself runs over
    the slot counts, so no row meets more than one threshold.
    """
    cuts = thresholds(n)
    slots = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_p", outputCol="_slot", handleInvalid="skip")
    placed = slots.transform(df.select(F.col(target).alias("_y"), finite(F.col(p)).alias("_p")))
    counts = placed.groupBy(F.col("_slot").cast("int").alias("_slot")).agg(
        F.coalesce(F.sum("_y"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("_slot"), F.lit(0).alias("pos"), F.lit(0).alias("rows"))
    slots_full = counts.unionByName(every).groupBy("_slot").agg(F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
    # the window runs over the n + 1 slot totals only
    above = Window.partitionBy().orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, 0)
    at_or_above = slots_full.withColumns(
        {"tp": F.sum("pos").over(above), "hits": F.sum("rows").over(above), "positives": F.sum("pos").over(Window.partitionBy())}
    )
    cut = F.array(*[F.lit(c) for c in cuts])
    sweep = at_or_above.where("_slot > 0").select(
        (F.col("_slot") - 1).alias("slot"), F.element_at(cut, F.col("_slot")).alias("threshold"), "tp",
        (F.col("hits") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"),
    )
    return sweep.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1; 0.5 and 0.0 when no threshold gives any."""
    best = sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("slot"))).alias("b"))
    useful = F.col("b.f1") > 0
    return best.select(
        F.when(useful, F.col("b.threshold")).otherwise(0.5).alias("best_threshold"), F.when(useful, F.col("b.f1")).otherwise(0.0).alias("best_f1")
    )


def confusion_at_threshold(
    df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), target: str = "target", p: str = "probability"
) -> DataFrame:
    hit, positive = finite(F.col(p)) >= threshold, F.col(target) == 1
    counts = df.groupBy(*by).agg(
        count_if(hit & positive).alias("tp"), count_if(hit & ~positive).alias("fp"),
        count_if(~hit & ~positive).alias("tn"), count_if(~hit & positive).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp, 0.0),
            "recall": ratio(tp, tp + fn, 0.0),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn, 0.0),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn, 0.0),
        }
    )


# --- ranking metrics --------------------------------------------------------------------


def score_histogram(df: DataFrame, by: Sequence[str] = (), target: str = "target", p: str = "probability") -> DataFrame:
    """Positives and negatives per distinct score, stored: all ranking metrics start here."""
    positive = F.col(target) == 1
    counts = df.where(finite(F.col(p)).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        count_if(positive).alias("tp"), count_if(~positive).alias("fp")
    )
    return materialize(counts, "score-histogram")


def ranked_scores(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histogram with true and false positives at and above each score."""
    running = prefix_sums(hist, by, "p", ["tp", "fp"])
    return running.withColumns(
        {
            "ctp": (F.col("tot_tp") - F.col("cum_tp") + F.col("tp")).cast("double"),
            "cfp": (F.col("tot_fp") - F.col("cum_fp") + F.col("fp")).cast("double"),
        }
    )


def ranking_metrics(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (a step sum, not a trapezoid) and ROC AUC (ties count half)."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    precision = F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    step = ratio(tp, F.col("tot_tp")) * precision
    area = ratio(fp, F.col("tot_fp")) * ratio((F.col("ctp") - tp) + F.col("ctp"), 2.0 * F.col("tot_tp"))
    return ranked.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("pr_auc"), F.sum(area).alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), target: str = "target", p: str = "probability") -> DataFrame:
    return ranking_metrics(ranked_scores(score_histogram(df, by, target, p), by), by).drop("roc_auc")


def roc_auc(df: DataFrame, by: Sequence[str] = (), target: str = "target", p: str = "probability") -> DataFrame:
    return ranking_metrics(ranked_scores(score_histogram(df, by, target, p), by), by).drop("pr_auc")


def operating_points(
    df: DataFrame, by: Sequence[str] = (), min_recall: float = 0.9, min_precision: float = 0.9, target: str = "target", p: str = "probability"
) -> DataFrame:
    """Best precision at a recall of at least ``min_recall``, and best recall at ``min_precision``."""
    ranked = ranked_scores(score_histogram(df, by, target, p), by)
    precision = F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    recall = ratio(F.col("ctp"), F.col("tot_tp"), 0.0)
    return ranked.groupBy(*by).agg(
        F.coalesce(F.max(F.when(recall >= min_recall, precision)), F.lit(0.0)).alias("precision_at_recall"),
        F.coalesce(F.max(F.when(precision >= min_precision, recall)), F.lit(0.0)).alias("recall_at_precision"),
    )


# --- probability quality ----------------------------------------------------------------


def probability_losses(df: DataFrame, by: Sequence[str] = (), target: str = "target", p: str = "probability") -> DataFrame:
    y, q = F.col(target).cast("double"), finite(F.col(p))
    safe = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), q))
    loss = F.when(q.isNotNull(), -(y * F.log(safe) + (1 - y) * F.log(1 - safe)))
    return df.groupBy(*by).agg(F.avg((q - y) * (q - y)).alias("brier_score"), F.avg(loss).alias("log_loss"))


def brier_score(df: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    return probability_losses(df, by, **names).drop("log_loss")


def log_loss(df: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    return probability_losses(df, by, **names).drop("brier_score")


def right_closed_bin(p: Column, bins: int = 10) -> Column:
    """Bin number of a probability in equal bins that include their upper edge; 0 is in the first."""
    edges = [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + F.when(p > edge, 1).otherwise(0)
    return F.when((p >= edges[0]) & (p <= edges[-1]), number)


def calibration_table(
    df: DataFrame, bins: int = 10, by: Sequence[str] = (), target: str = "target", p: str = "probability"
) -> DataFrame:
    binned = df.withColumn("bin", right_closed_bin(F.col(p).cast("double"), bins)).where(F.col("bin").isNotNull())
    table = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_predicted_probability"), F.avg(target).alias("observed_pathogenic_rate")
    )
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_pathogenic_rate"))
    return table.withColumn("absolute_calibration_error", gap)


def expected_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    weighted = F.sum(F.col("count") * F.col("absolute_calibration_error"))
    return table.groupBy(*by).agg(ratio(weighted, F.sum("count"), 0.0).alias("expected_calibration_error"))


def classification_metrics(
    df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), target: str = "target", p: str = "probability"
) -> DataFrame:
    """All metrics per group: ranking, threshold and probability quality."""
    confusion = confusion_at_threshold(df, threshold, by, target, p)
    ranking = ranking_metrics(ranked_scores(score_histogram(df, by, target, p), by), by)
    losses = probability_losses(df, by, target, p)
    ece = expected_calibration_error(calibration_table(df, 10, by, target, p), by)
    # joined on a struct of the group columns, which keeps a NULL group
    key = F.struct(*by) if by else F.struct(F.lit(0))
    out = confusion.withColumn("_group", key)
    for table in (ranking, losses, ece):
        out = out.join(table.withColumn("_group", key).drop(*by), "_group", "left")
    return out.drop("_group").withColumn("best_threshold", F.lit(float(threshold)))


def metrics_by_group(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return classification_metrics(df, threshold, by)


def calibration_by_group(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    return calibration_table(df, bins, by)


CV_METRICS = ["roc_auc", "pr_auc", "accuracy", "brier_score", "precision", "recall", "f1_score"]


def cv_folds(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of each fold of a table scored out of fold."""
    return classification_metrics(scored, threshold, ["fold"]).select("fold", *CV_METRICS)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and range of each metric over the folds."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in CV_METRICS])
    long = folds.select(F.inline(cells))
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")
    )


# --- tables of models and runs ----------------------------------------------------------


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_code``: position among the sorted categories, -1 for NULL.

    The categories are sorted by range partitions and stored; a code is the place in the partition plus the
    sizes of the partitions before it. Labels never come to the driver.
    """
    for c in columns:
        labels = df.select(F.col(f"`{c}`").alias("_label")).where("_label IS NOT NULL").distinct().orderBy("_label")
        labels = materialize(labels.withColumn("_part", F.spark_partition_id()), "sorted-categories")
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_label"))
        sizes = labels.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
        starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
        codes = labels.withColumn("_place", place).join(starts, "_part").select("_label", (F.col("_start") + F.col("_place") - 1).cast("int").alias("_code"))
        joined = df.join(codes, F.col(f"`{c}`") == F.col("_label"), "left").drop("_label")
        df = joined.withColumn(f"{c}_code", F.coalesce("_code", F.lit(-1))).drop("_code")
    return df


def rank_models(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("pr_auc"), F.desc("f1_score"), "model")


def winner(table: DataFrame) -> DataFrame:
    return rank_models(table).limit(1)


def select_best_run(
    runs: DataFrame, metric: str = "pr_auc", minimum: float = 0.80, stage: str = "training"
) -> DataFrame:
    """The finished run of a stage with the best metric, newest first among equals; none below the gate."""
    finished = runs.where((F.col("stage") == stage) & (F.col("status") == "FINISHED"))
    order = [F.desc_nulls_last(metric), F.desc_nulls_last("start_time"), F.asc("run_id")]
    return finished.where(F.col(metric) >= minimum).orderBy(*order).limit(1)


def reuse_or_new_version(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """Per wanted (run_id, source): the highest registered version, or ``new``.

    The versions are combined per key before the join, so a run with very many versions is one row.
    """
    latest = versions.groupBy("run_id", "source").agg(F.max(F.col("version").cast("bigint")).alias("version"))
    joined = wanted.join(latest, ["run_id", "source"], "left")
    return joined.withColumn("action", F.when(F.col("version").isNull(), "new").otherwise("reuse"))
