"""Scoring of variant batches, and the review views over the results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.contract import LEGAL_RANGES, LOW_CONFIDENCE, REVIEW_STATUSES
from variantloom.functions import scoring as calls
from variantloom.functions.genomic import normalize_chrom, variant_label
from variantloom.functions.values import count_if, ratio
from variantloom.operators.features import build_serving_features
from variantloom.operators.ingest import validate_ranges
from variantloom.operators.lookup import SCORES, lookup

Scorer = Callable[[DataFrame], DataFrame]
RESULT_COLUMNS = [
    "chrom", "pos", "ref", "alt", "found_in_store", "feature_source", "status",
    "prediction", "label", "probability", "confidence_score", "message",
]


def formula_scorer(features: DataFrame) -> DataFrame:
    """Adds ``probability`` from the built-in transparent weights."""
    return features.withColumn("probability", calls.formula_probability())


def score_postprocess(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Clipped probability, class, label and confidence; a missing probability has confidence 0.5.

    A given threshold belongs to the positive class, as in the metrics that choose it; without one the
    model's own class stands, which is positive above one half.
    """
    p = calls.clipped_probability(F.col("probability"))
    out = df.withColumn("probability", p)
    if threshold is not None:
        out = out.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    elif "prediction" not in df.columns:
        out = out.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return out.withColumns(
        {"confidence_score": calls.confidence(F.col("probability")), "label": calls.call_label(F.col("prediction"))}
    )


def vcf_batch_score(
    requests: DataFrame,
    store: DataFrame,
    scorer: Scorer = formula_scorer,
    stats: DataFrame | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """Look up, encode, score and label a whole batch in one plan with one join.

    Each request ends as ``predicted``, ``not_found`` or ``failed``; a request that cannot be
    scored carries its message instead of stopping the batch. ``store`` has unique keys.
    """
    own = [c for c in requests.columns if c not in ("chrom", "pos", "ref", "alt", *SCORES)]
    batch = requests.withColumns(
        {
            "chrom": normalize_chrom(F.col("chrom").cast("string"), "batch"),
            "pos": F.trim(F.col("pos").cast("string")),
            "ref": F.upper("ref"),
            "alt": F.upper("alt"),
        }
    )
    found = validate_ranges(lookup(batch, store), LEGAL_RANGES)
    message = (
        F.when(F.col("pos").try_cast("bigint").isNull(), "Position is not a whole number.")
        .when(~F.col("found"), "Variant not found in feature store.")
        .when(~F.col("accepted"), F.concat(F.lit("Score out of range: "), F.concat_ws(", ", "violations")))
    )
    status = (
        F.when(F.col("pos").try_cast("bigint").isNull(), "failed")
        .when(~F.col("found"), "not_found")
        .when(~F.col("accepted"), "failed")
        .otherwise("predicted")
    )
    kept = found.withColumns(
        {"status": status, "message": message, "in_chrom": F.col("chrom"), "in_scores": F.struct(*SCORES)}
    ).drop("violations", "accepted")
    scored = score_postprocess(scorer(build_serving_features(kept, stats)), threshold)
    predicted = F.col("status") == "predicted"
    only = lambda c: F.when(predicted, F.col(c)).alias(c)
    return scored.select(
        *own,
        F.col("in_chrom").alias("chrom"), "pos", "ref", "alt",
        F.col("found").alias("found_in_store"), "feature_source", "status",
        only("prediction"), only("label"), only("probability"), only("confidence_score"),
        "message",
        *[F.col(f"in_scores.{s}").alias(s) for s in SCORES],
    )


def batch_counters(results: DataFrame, total_input: int | None = None) -> DataFrame:
    """One row: how many requests came in, were processed, and how they ended."""
    n = F.count(F.lit(1))
    return results.agg(
        (F.lit(total_input).cast("bigint") if total_input is not None else n).alias("total_input"),
        n.alias("processed"),
        *[count_if(F.col("status") == s).alias(s) for s in ("predicted", "not_found", "failed")],
    )


def batch_events(
    results: DataFrame, endpoint: str = "/api/vcf-batch-predict", source: str = "vcf_batch", model_uri: str | None = None, latency_ms: float | None = None
) -> DataFrame:
    """Prediction events of a batch: one per predicted or failed request, none for a miss.

    ``latency_ms`` is the time of one request, for a batch its time divided by its requests.
    """
    scored = F.col("status") == "predicted"
    return results.where(F.col("status") != "not_found").select(
        F.lit(endpoint).alias("endpoint"),
        F.lit(source).alias("source"),
        F.when(scored, "success").otherwise("error").alias("status"),
        "chrom", "pos", "ref", "alt", *SCORES,
        "prediction", "probability", "confidence_score",
        F.when(~scored, F.col("message")).alias("error"),
        F.lit(model_uri).cast("string").alias("model_uri"),
        F.lit(latency_ms).cast("double").alias("latency_ms"),
    )


def triage(df: DataFrame, confidence: str = "confidence_score") -> DataFrame:
    return df.withColumns(
        {
            "triage": calls.triage_label(F.col("label"), F.col("probability"), F.col(confidence)),
            "confidence_band": calls.confidence_band(F.col(confidence)),
        }
    )


def abstain_flag(df: DataFrame, confidence: str = "confidence_score", minimum: float = LOW_CONFIDENCE) -> DataFrame:
    """Withhold the call when confidence is low or any score is missing."""
    incomplete = F.lit(False)
    for s in SCORES:
        incomplete = incomplete | F.col(s).isNull()
    low = F.coalesce(F.col(confidence), F.lit(0.0)) < minimum
    reason = F.when(incomplete, "incomplete features").when(low, "low confidence")
    return df.withColumns({"abstain": reason.isNotNull(), "abstain_reason": reason})


def evidence_drivers_topk(df: DataFrame, k: int = 4) -> DataFrame:
    """One row per variant and driver, strongest first (``rank`` from 1)."""
    drivers = calls.evidence_drivers(F.col("sift"), F.col("polyphen"), F.col("cadd"), F.col("alt_freq"), k)
    keep = [c for c in df.columns if c not in SCORES]
    exploded = df.select(*keep, F.posexplode(drivers).alias("_i", "_d"))
    return exploded.select(*keep, (F.col("_i") + 1).alias("rank"), "_d.name", "_d.direction", "_d.strength")


def filter_batch_results(
    results: DataFrame, show: str = "all", min_confidence: float = 0.0, search: str = ""
) -> DataFrame:
    """Results by label or status, minimum confidence (missing counts as 0) and search text."""
    conditions = {
        "all": F.lit(True),
        "pathogenic": F.col("label") == "PATHOGENIC",
        "benign": F.col("label") == "BENIGN",
        "predicted": F.col("status") == "predicted",
        "not_found": F.col("status") == "not_found",
        "failed": F.col("status") == "failed",
    }
    if show not in conditions:
        raise ValueError(f"show must be one of {sorted(conditions)}")
    kept = results.where(conditions[show]).where(F.coalesce("confidence_score", F.lit(0.0)) >= min_confidence)
    if not search.strip():
        return kept
    label = variant_label(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    text = F.concat_ws(" ", label, F.col("status"), F.coalesce("label", F.lit("")))
    return kept.where(F.contains(F.lower(text), F.lit(search.strip().lower())))


SORT_MODES = ("probability_desc", "probability_asc", "confidence_desc", "variant_asc")


def sort_batch_results(results: DataFrame, mode: str = "probability_desc", ties: Sequence[str] = ()) -> DataFrame:
    """Fully sorted results (a range exchange, no single task); missing values always come last."""
    label = variant_label(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    orders: dict[str, Column] = {
        "probability_desc": F.desc_nulls_last("probability"),
        "probability_asc": F.asc_nulls_last("probability"),
        "confidence_desc": F.desc_nulls_last("confidence_score"),
        "variant_asc": label.asc(),
    }
    if mode not in orders:
        raise ValueError(f"mode must be one of {SORT_MODES}")
    return results.orderBy(orders[mode], *ties)


def shown_status() -> Column:
    return F.coalesce(F.nullif(F.col("review_status"), F.lit("")), F.lit("Needs review"))


def filter_review_queue(queue: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    kept = queue if status == "all" else queue.where(shown_status() == status)
    if not search.strip():
        return kept
    text = F.concat_ws(" ", "variant", "source", "label", shown_status())
    return kept.where(F.contains(F.lower(text), F.lit(search.strip().lower())))


def review_queue_latest(queue: DataFrame, n: int = 200, ties: Sequence[str] = ("id",)) -> DataFrame:
    return queue.orderBy(F.desc("ts"), *[F.desc(c) for c in ties]).limit(n)


def review_status_counts(queue: DataFrame) -> DataFrame:
    """Rows per review status, with a zero for a status nobody has."""
    one_row = queue.agg(*[count_if(shown_status() == s).alias(f"s{i}") for i, s in enumerate(REVIEW_STATUSES)])
    entries = [F.struct(F.lit(s).alias("status"), F.col(f"s{i}").alias("count")) for i, s in enumerate(REVIEW_STATUSES)]
    return one_row.select(F.inline(F.array(*entries)))


def review_dashboard(queue: DataFrame) -> DataFrame:
    pathogenic = count_if(F.col("label") == "PATHOGENIC")
    n = F.count(F.lit(1))
    return queue.agg(
        n.alias("total"),
        pathogenic.alias("pathogenic"),
        (ratio(pathogenic, n, 0.0) * 100).alias("pathogenic_rate"),
        (F.coalesce(F.avg("probability"), F.lit(0.0)) * 100).alias("avg_probability"),
    )
