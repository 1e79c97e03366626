"""VCF files to scored results, counters, prediction events and a report."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from variantloom.operators import scoring
from variantloom.sources import vcf
from variantloom.sources.events import append_event_log
from variantloom.sources.sinks import batch_report, sink_csv_report, sink_parquet


@dataclass
class BatchRun:
    results: DataFrame
    counters: DataFrame
    report: DataFrame


def score_vcf(
    spark: SparkSession,
    paths: str | Sequence[str],
    store: DataFrame,
    work: str,
    scorer: scoring.Scorer = scoring.formula_scorer,
    stats: DataFrame | None = None,
    max_records: int | None = None,
    event_log: str | None = None,
    model_uri: str | None = None,
) -> BatchRun:
    """Score whole VCF files against a store with unique keys.

    ``max_records`` takes only the first allele rows, as one interactive request does; without it
    the files are scored to the end. The results are written once and every output is derived from that table.
    """
    records = vcf.scan_vcf(spark, paths)
    if max_records is not None:
        records = vcf.vcf_limit(records, max_records)
    requests = records.select("chrom", "pos", "ref", "alt")
    scored = scoring.vcf_batch_score(requests, store, scorer, stats)
    started = time.monotonic()
    results = sink_parquet(scored, f"{work}/results")
    counters = sink_parquet(scoring.batch_counters(results), f"{work}/counters")
    if event_log is not None:
        each = 1000 * (time.monotonic() - started) / max(1, counters.first()["processed"])
        append_event_log(scoring.batch_events(results, model_uri=model_uri or getattr(scorer, "__name__", None), latency_ms=each), event_log)
    return BatchRun(results, counters, sink_csv_report(batch_report(results, counters), f"{work}/report"))
