"""Raw annotation files to training tables and a selected model, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from variantloom.operators import features, ingest, models
from variantloom.sources.annotations import stitch_parts
from variantloom.sources.sinks import skip_if_materialized


@dataclass
class TrainingTables:
    model_ready: DataFrame
    chrom_stats: DataFrame
    encoded: DataFrame
    optimized: DataFrame
    report: DataFrame  # part, status, message
    complete: bool  # no part failed


def build_training_tables(spark: SparkSession, sources: dict[str, str], work: str) -> TrainingTables:
    """Each stage is a table under ``work``; a stage made from the same input is read, not computed again.

    While a part fails, the tables hold the landed parts and are not ``complete``; the next run tries
    that part again, and a part that lands then renews the stages after it.
    """
    parts, report = stitch_parts(spark, sources, f"{work}/parts", ingest.model_ready)
    states = {row["part"]: row["status"] for row in report.collect()}  # one row for each source file
    landed = [f"{work}/parts/part={name}" for name, status in states.items() if status == "landed"]

    def stage(name: str, build: Callable[[], DataFrame], inputs: list[str]) -> DataFrame:
        return skip_if_materialized(spark, f"{work}/{name}", build, inputs)

    ready = stage("model_ready", lambda: parts, landed)
    stats = stage("chrom_stats", lambda: features.chrom_stats(features.training_rows(ready)), [f"{work}/model_ready"])
    encoded = stage("encoded", lambda: features.encode_features(ready, stats), [f"{work}/model_ready", f"{work}/chrom_stats"])
    optimized = stage("optimized", lambda: features.optimize_dataset(encoded), [f"{work}/encoded"])
    return TrainingTables(ready, stats, encoded, optimized, report, set(states.values()) == {"landed"})


def train_and_rank(
    encoded: DataFrame, work: str, trainers: dict[str, Callable[[DataFrame], PipelineModel]] | None = None
) -> DataFrame:
    """Benchmark the classifiers on one stored split; the first row is the winner."""
    spark = encoded.sparkSession
    split = skip_if_materialized(spark, f"{work}/split", lambda: models.split_training_table(encoded))
    chosen = trainers or {
        "logistic regression": models.train_logistic,
        "random forest": models.train_forest,
        "gradient boosted trees": models.train_gbt,
    }
    return models.benchmark_models(split, chosen)
