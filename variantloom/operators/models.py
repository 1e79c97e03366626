"""Training, benchmarking and explanation of classifiers with spark.ml pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantloom.contract import CATEGORICAL_FEATURES, FEATURE_ORDER, TARGET
from variantloom.operators import evaluate
from variantloom.operators.statistics import TargetStatistics, fit_statistics
from variantloom.session import materialize, shared_dir

ANNOTATION_SCORES = ("SIFT", "PolyPhen", "CADD")
SLICE_ROWS = 4096  # rows that trade values with each other, about


def split_training_table(encoded: DataFrame) -> DataFrame:
    """Encoded rows with ``split``; equal rows share a hash, so duplicates never cross splits.

    Stored, because training reads the rows many times and must not encode them each time.
    """
    return materialize(evaluate.stratified_split(encoded, FEATURE_ORDER), "training-split")


def with_class_weight(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Balanced weights: each class adds up to half of the training rows; other splits take the same weights."""
    train = rows.where("split = 'train'")
    sizes = train.agg(F.sum(F.col(target)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, n = float(sizes["p"] or 0), float(sizes["n"])
    weights = [n / (2 * max(1.0, n - positives)), n / (2 * max(1.0, positives))]
    return rows.withColumn("weight", F.when(F.col(target) == 1, weights[1]).otherwise(weights[0]))


def _split_kinds(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    text = [c for c in columns if c in CATEGORICAL_FEATURES]
    return [c for c in columns if c not in text], text


def _tree_inputs(columns: Sequence[str]) -> list:
    numeric, text = _split_kinds(columns)
    stages = []
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"{c}_ix" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_ix" for c in text]], outputCol="features", handleInvalid="keep"))
    return stages


def _dense_inputs(columns: Sequence[str], scaled: bool) -> list:
    numeric, text = _split_kinds(columns)
    stages = []
    if text:
        stages += [
            StringIndexer(inputCols=text, outputCols=[f"{c}_ix" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}_ix" for c in text], outputCols=[f"{c}_oh" for c in text], handleInvalid="keep", dropLast=False),
        ]
    stages.append(VectorAssembler(inputCols=numeric, outputCol="numeric_raw" if scaled else "numeric"))
    if scaled:
        stages.append(StandardScaler(inputCol="numeric_raw", outputCol="numeric", withMean=True))
    stages.append(VectorAssembler(inputCols=["numeric", *[f"{c}_oh" for c in text]], outputCol="features"))
    return stages


def train_gbt(
    split: DataFrame, columns: Sequence[str] = FEATURE_ORDER, max_iter: int = 200, step: float = 0.1, max_depth: int = 6, min_bins: int = 64
) -> PipelineModel:
    """Gradient-boosted trees with class weights, stopped early on the validation split.

    A tree needs a bin for each category, so the most varied text column sets how many bins there are.
    """
    text = _split_kinds(columns)[1]
    seen = split.where(F.col("split") != "test").agg(F.lit(0).alias("_none"), *[F.count_distinct(c).alias(c) for c in text]).first()
    max_bins = max([min_bins, *[seen[c] + 2 for c in text]])
    rows = with_class_weight(split.where(F.col("split") != "test")).withColumn("is_validation", F.col("split") == "validation")
    gbt = GBTClassifier(
        labelCol=TARGET, featuresCol="features", weightCol="weight", validationIndicatorCol="is_validation", validationTol=0.001,
        maxIter=max_iter, stepSize=step, maxDepth=max_depth, maxBins=max_bins, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42,
    )
    return Pipeline(stages=[*_tree_inputs(columns), gbt]).fit(rows)


class OrderedModel:
    """Boosted trees over numbers alone: text columns go in as ordered target statistics."""

    def __init__(self, statistics: TargetStatistics, model: PipelineModel):
        self.statistics, self.model = statistics, model

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.statistics.encode(rows))


def train_gbt_ordered(
    split: DataFrame, columns: Sequence[str] = FEATURE_ORDER, max_iter: int = 200, step: float = 0.1, max_depth: int = 6, bins: int = 64
) -> OrderedModel:
    """``train_gbt`` with ordered target statistics for text columns, so the bins of a node do not grow with the categories."""
    numeric, text = _split_kinds(columns)
    train = F.col("split") == "train"
    statistics = fit_statistics(split.where(train), text, TARGET, columns)
    encoded = statistics.encode(split.where(F.col("split") != "test"), train)
    rows = materialize(with_class_weight(encoded).withColumn("is_validation", F.col("split") == "validation"), "ordered-rows")
    inputs = VectorAssembler(inputCols=[*numeric, *[f"{c}_mean" for c in text]], outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(
        labelCol=TARGET, featuresCol="features", weightCol="weight", validationIndicatorCol="is_validation", validationTol=0.001,
        maxIter=max_iter, stepSize=step, maxDepth=max_depth, maxBins=bins, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42,
    )
    return OrderedModel(statistics, Pipeline(stages=[inputs, gbt]).fit(rows))


def train_logistic(split: DataFrame, columns: Sequence[str] = FEATURE_ORDER, max_iter: int = 1000) -> PipelineModel:
    rows = with_class_weight(split.where(F.col("split") == "train"))
    model = LogisticRegression(labelCol=TARGET, featuresCol="features", weightCol="weight", maxIter=max_iter, standardization=False)
    return Pipeline(stages=[*_dense_inputs(columns, scaled=True), model]).fit(rows)


def train_forest(
    split: DataFrame, columns: Sequence[str] = FEATURE_ORDER, trees: int = 220, max_depth: int = 18, min_leaf: int = 4, node_memory_mb: int = 256
) -> PipelineModel:
    """Random forest with class weights.

    Each row keeps the number of its node in every tree, so no round sends the trees out again; the lists of numbers are
    checkpointed every few rounds. ``node_memory_mb`` bounds the statistics of the nodes that are split in one round.
    """
    sc = split.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"{shared_dir(split.sparkSession)}/checkpoints")
    rows = with_class_weight(split.where(F.col("split") == "train"))
    model = RandomForestClassifier(
        labelCol=TARGET, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
        cacheNodeIds=True, checkpointInterval=5, maxMemoryInMB=node_memory_mb, seed=42,
    )
    return Pipeline(stages=[*_dense_inputs(columns, scaled=False), model]).fit(rows)


def model_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Adds ``probability`` of the positive class; the pipeline's own columns are dropped."""

    def score(features: DataFrame) -> DataFrame:
        scored = model.transform(features)
        kept = [F.col(f"`{c}`") for c in features.columns if c != "probability"]
        return scored.select(*kept, vector_to_array("probability")[1].alias("probability"))

    return score


def evaluate_model(name: str, model: PipelineModel, split: DataFrame) -> DataFrame:
    """Threshold picked on the validation split, metrics on the test split."""
    scored = model_scorer(model)(split.where(F.col("split") != "train"))
    scored = materialize(scored.select("split", F.col(TARGET).alias("target"), "probability"), f"scored-{name}")
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored.where("split = 'validation'"))).first()
    metrics = evaluate.classification_metrics(scored.where("split = 'test'"), threshold=best["best_threshold"])
    return metrics.withColumns({"model": F.lit(name), "validation_f1_at_threshold": F.lit(float(best["best_f1"]))})


def benchmark_models(split: DataFrame, trainers: dict[str, Callable[[DataFrame], PipelineModel]]) -> DataFrame:
    """Several classifiers on the same split, trained side by side, ranked by AP then F1."""

    def one(item):
        name, train = item
        return materialize(evaluate_model(name, train(split), split), f"metrics-{name}")

    with ThreadPoolExecutor(max_workers=len(trainers)) as pool:
        rows = list(pool.map(inheritable_thread_target(split.sparkSession)(one), trainers.items()))
    table = rows[0]
    for row in rows[1:]:
        table = table.unionByName(row)
    return evaluate.rank_models(table)


def cross_validate(
    folded: DataFrame, train: Callable[[DataFrame], PipelineModel], folds: int = 5, target: str = TARGET, side_by_side: int = 5, hold_back: int = 10
) -> DataFrame:
    """``fold, target, probability`` of every row of ``folded``, each scored by a model that never saw its fold.

    The models of the folds are trained side by side from the one stored table. One in ``hold_back`` rows of the other
    folds, by hash of the row, is their ``validation`` split, by which a classifier that boosts can stop.
    """
    held = F.pmod(F.xxhash64(*FEATURE_ORDER), F.lit(hold_back)) == 0

    def one(fold: int) -> DataFrame:
        split = folded.withColumn("split", F.when(F.col("fold") == fold, "test").when(held, "validation").otherwise("train"))
        scored = model_scorer(train(split))(split.where("split = 'test'"))
        return materialize(scored.select("fold", F.col(target).alias("target"), "probability"), f"fold-{fold}")

    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        parts = list(pool.map(inheritable_thread_target(folded.sparkSession)(one), range(1, folds + 1)))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def feature_importance(model: PipelineModel, sample: DataFrame, top: int | None = 20) -> DataFrame:
    """Importance per input feature; one-hot slots are summed back to their column."""
    schema = model.transform(sample.limit(0)).schema
    attributes = schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    base = [c for c in sorted(CATEGORICAL_FEATURES, key=len, reverse=True)]

    def column(name: str) -> str:
        name = name.removeprefix("numeric_")
        return next((c for c in base if name.startswith(f"{c}_ix") or name.startswith(f"{c}_oh")), name)

    numeric = [c for c in FEATURE_ORDER if c not in CATEGORICAL_FEATURES]
    totals: dict[str, float] = {}
    for i, weight in enumerate(model.stages[-1].featureImportances.toArray()):
        name = column(names.get(i, str(i)))
        name = numeric[int(name)] if name.isdigit() else name
        totals[name] = totals.get(name, 0.0) + float(weight)
    table = sample.sparkSession.createDataFrame(list(totals.items()), "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


def permutation_importance(model: PipelineModel, encoded: DataFrame, columns: Sequence[str] = FEATURE_ORDER) -> DataFrame:
    """Loss of average precision when one column is permuted, over all rows.

    Rows are numbered by hash inside hash slices, and each borrows the column from the row half a slice
    further on. The number of slices follows the number of rows, so none grows with the table. All
    variants are scored in one pass of the model.
    """
    rows = encoded.select(*FEATURE_ORDER, TARGET, evaluate.row_hash(FEATURE_ORDER).alias("_h"))
    digits = int(math.log(max(1.0, encoded.count() / SLICE_ROWS), 16))
    sliced = rows.withColumn("_slice", F.substring("_h", 1, digits))
    order = Window.partitionBy("_slice").orderBy("_h", *FEATURE_ORDER, TARGET)
    numbered = sliced.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("_slice"))})
    numbered = materialize(numbered.drop("_h"), "importance-rows")
    donors = numbered.select("_slice", F.pmod(F.col("_i") + F.expr("_n div 2"), F.col("_n")).alias("_i"), F.struct(*FEATURE_ORDER).alias("_d"))
    paired = numbered.join(donors, ["_slice", "_i"])

    def version(changed: str | None):
        cells = [(F.col(f"_d.{c}") if c == changed else F.col(c)).alias(c) for c in FEATURE_ORDER]
        return F.struct(F.lit(changed or "").alias("permuted"), F.col(TARGET).alias("target"), *cells)

    versions = paired.select(F.inline(F.array(version(None), *[version(c) for c in columns])))
    scored = model_scorer(model)(versions).select("permuted", "target", "probability")
    quality = materialize(evaluate.average_precision(scored, by=["permuted"]), "permuted-quality")
    whole = quality.where("permuted = ''").select("pr_auc").scalar()
    return quality.where("permuted <> ''").select(
        F.col("permuted").alias("feature"), F.col("pr_auc").alias("permuted_pr_auc"), (whole - F.col("pr_auc")).alias("importance")
    ).orderBy(F.desc("importance"), "feature")


def ablation(
    split: DataFrame, train: Callable[[DataFrame, Sequence[str]], PipelineModel], left_out: Sequence[str] = ANNOTATION_SCORES
) -> DataFrame:
    """Metrics of the same classifier with and without a group of columns."""
    reduced = [c for c in FEATURE_ORDER if c not in left_out]
    trainers = {
        "all features": lambda rows: train(rows, FEATURE_ORDER),
        "without " + ", ".join(left_out): lambda rows: train(rows, reduced),
    }
    return benchmark_models(split, trainers)
