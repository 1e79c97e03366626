"""Training queries with the operators' own settings (tree and optimiser results have no SQL form).

A model that several queries use is trained once per application, like any stored stage.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, rounded
from catalog.ingest import encoded
from catalog.lookup import resolved_store
from variantloom.operators import evaluate, models, scoring, statistics
from variantloom.session import path_exists


def split_table(t: Tables) -> DataFrame:
    return t.stored("training_split", lambda: models.split_training_table(encoded(t)))


def fitted(t: Tables, name: str, train) -> PipelineModel:
    """The model of one training run, saved once like any stage output."""
    path = t.stored_path(f"model_{name}")
    if not path_exists(t.spark, f"{path}/metadata/_SUCCESS"):
        train(split_table(t)).write().overwrite().save(path)
    return PipelineModel.load(path)


def gbt(t: Tables) -> PipelineModel:
    return fitted(t, "gbt", models.train_gbt)


def logistic(t: Tables) -> PipelineModel:
    return fitted(t, "logistic", models.train_logistic)


def forest(t: Tables) -> PipelineModel:
    return fitted(t, "forest", models.train_forest)


@query("train_gbt")
def train_gbt(t: Tables):
    return models.evaluate_model("gradient boosted trees", gbt(t), split_table(t))


@query("train_gbt_ordered")
def train_gbt_ordered(t: Tables):
    rows = split_table(t)
    return models.evaluate_model("ordered boosted trees", models.train_gbt_ordered(rows), rows)


_SLICED = "(SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '7', chrom, CAST(pos AS VARCHAR), ref, alt)), 1, 2)) AS INT) AS slice FROM variants_clean)"


def _statistic_sql(column: str) -> str:
    before = f"PARTITION BY {column} ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""(coalesce(sum(target) OVER ({before}), 0) + 10 * coalesce(avg(target) OVER (ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5))
      / (count(*) OVER ({before}) + 10)"""


@query(
    "target_statistics",
    f"SELECT chrom, pos, ref, alt, round({_statistic_sql('chrom')}, 9) AS chrom_mean, round({_statistic_sql('ref')}, 9) AS ref_mean FROM {_SLICED} x",
)
def target_statistics(t: Tables):
    """Two text columns of the training rows as means of the rows in the slices before theirs."""
    rows = t.variants_clean.select("chrom", "pos", "ref", "alt", "target")
    fitted_means = statistics.fit_statistics(rows, ["chrom", "ref"], "target", ["chrom", "pos", "ref", "alt"])
    return rounded(fitted_means.encode(rows, F.lit(True)).drop("target"), 9)


@query("train_baselines")
def train_baselines(t: Tables):
    rows = split_table(t)
    baselines = {"logistic regression": logistic(t), "random forest": forest(t)}
    first, second = (models.evaluate_model(name, model, rows) for name, model in baselines.items())
    return first.unionByName(second)


@query("benchmark_models")
def benchmark_models(t: Tables):
    return models.benchmark_models(
        split_table(t),
        {
            "logistic regression": lambda split: logistic(t),
            "random forest": lambda split: forest(t),
            "gradient boosted trees": lambda split: gbt(t),
        },
    )


@query("feature_importance")
def feature_importance(t: Tables):
    return models.feature_importance(gbt(t), split_table(t))


@query("permutation_importance")
def permutation_importance(t: Tables):
    return models.permutation_importance(gbt(t), encoded(t))


@query("ablation")
def ablation(t: Tables):
    whole = list(models.FEATURE_ORDER)
    return models.ablation(split_table(t), lambda rows, columns: gbt(t) if list(columns) == whole else models.train_gbt(rows, columns))


@query("vcf_batch_score_model")
def vcf_batch_score_model(t: Tables):
    """Batch scoring with the trained pipeline instead of the formula."""
    stats = t.stored("model_chrom_stats", lambda: encoded(t).groupBy("CHROM").agg(
        F.first("chrom_freq_mean").cast("double").alias("chrom_freq_mean"), F.first("chrom_rare_rate").cast("double").alias("chrom_rare_rate")))
    return scoring.vcf_batch_score(t.variant_requests, resolved_store(t), models.model_scorer(gbt(t)), stats)


def folded_table(t: Tables) -> DataFrame:
    return t.stored("folds", lambda: evaluate.stratified_kfold(encoded(t), models.FEATURE_ORDER))


def out_of_fold(t: Tables, name: str, train) -> DataFrame:
    """Every row with the probability of the model that did not see its fold."""
    return t.stored(f"out_of_fold_{name}", lambda: models.cross_validate(folded_table(t), train))


@query("cv_model_folds")
def cv_model_folds(t: Tables):
    """Five-fold cross-validation of the logistic baseline."""
    return evaluate.cv_summary(evaluate.cv_folds(out_of_fold(t, "logistic", models.train_logistic)))


@query("cv_gbt_folds")
def cv_gbt_folds(t: Tables):
    """Five-fold cross-validation of the boosted trees."""
    return evaluate.cv_summary(evaluate.cv_folds(out_of_fold(t, "gbt", models.train_gbt)))


@query(
    "cv_totals",
    """SELECT name AS model, CAST(5 AS BIGINT) AS folds, CAST(sum(Target) AS BIGINT) AS positives, CAST(sum(1 - Target) AS BIGINT) AS negatives,
      TRUE AS in_range, TRUE AS beats_chance FROM o_encoded CROSS JOIN (VALUES ('logistic'), ('gbt')) m(name) GROUP BY name""",
)
def cv_totals(t: Tables):
    """What any cross-validation must add up to: each row is judged once, and every metric is a share."""
    parts = []
    for name, train in (("logistic", models.train_logistic), ("gbt", models.train_gbt)):
        folds = evaluate.classification_metrics(out_of_fold(t, name, train), 0.5, ["fold"])
        inside = F.lit(True)
        for m in evaluate.CV_METRICS:
            inside = inside & F.col(m).between(0, 1)
        parts.append(folds.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("folds"), F.sum(F.col("tp") + F.col("fn")).cast("bigint").alias("positives"),
            F.sum(F.col("fp") + F.col("tn")).cast("bigint").alias("negatives"), F.bool_and(inside).alias("in_range"), (F.avg("roc_auc") > 0.5).alias("beats_chance"),
        ))
    return parts[0].unionByName(parts[1])
