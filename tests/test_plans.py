import gzip

import pytest

from variantloom.operators import lookup
from variantloom.plans import batch, monitoring, offline
from variantloom.session import fingerprint, fresh_path
from variantloom.sources.annotations import stitch_parts

HEADER = "#chr\tpos(1-based)\tref\talt\tSIFT_score\tPolyphen2_HDIV_score\tCADD_phred\tgnomAD_exomes_AF\tclinvar_clnsig"


def test_files_to_training_table_to_scored_vcf_to_drift(spark, tmp_path):
    for chrom in ("1", "X"):
        lines = [HEADER] + [
            f"{chrom}\t{100 + i}\tA\tG\t0.{i:02d};0.5\t0.{i:02d}\t{i}.5\t0.00{i:02d}\t{'Pathogenic' if i % 3 else 'Benign'}" for i in range(40)
        ]
        with gzip.open(tmp_path / f"chr{chrom}.gz", "wt") as handle:
            handle.write("\n".join(lines))
    work = fresh_path(spark, "offline")
    sources = {c: str(tmp_path / f"chr{c}.gz") for c in ("1", "X")}
    tables = offline.build_training_tables(spark, sources, work)
    assert tables.encoded.count() == 80 and tables.chrom_stats.count() == 2
    assert tables.complete
    made = fingerprint(spark, [f"{work}/optimized"])
    offline.build_training_tables(spark, sources, work)  # finished stages are read back
    assert fingerprint(spark, [f"{work}/optimized"]) == made

    (tmp_path / "in.vcf").write_text("#h\n" + "\n".join(f"chr1\t{100 + i}\t.\tA\tG,T" for i in range(10)))
    store = lookup.resolve_store({"local": tables.model_ready})
    log = fresh_path(spark, "log")
    run = batch.score_vcf(spark, str(tmp_path / "in.vcf"), store, fresh_path(spark, "batch"), event_log=log)
    counters = run.counters.first()
    assert (counters.processed, counters.predicted, counters.not_found, counters.failed) == (20, 10, 10, 0)
    assert run.report.count() == 20
    capped = batch.score_vcf(spark, str(tmp_path / "in.vcf"), store, fresh_path(spark, "batch"), max_records=4)
    assert capped.counters.first().processed == 4

    done = monitoring.run_once(spark, log, tables.encoded, fresh_path(spark, "summary"))
    assert done.summary.first().total_predictions == 10
    assert done.drift.first().status == "ok" and done.alerts.count() == 4
    events = spark.read.json(log)
    assert events.where("latency_ms > 0 AND model_uri = 'formula_scorer'").count() == 10


def annotation_file(path, chrom, rows):
    lines = [HEADER] + [f"{chrom}\t{100 + i}\tA\tG\t0.1\t0.2\t{i}.5\t0.001\t{'Pathogenic' if i % 3 else 'Benign'}" for i in range(rows)]
    with gzip.open(path, "wt") as handle:
        handle.write("\n".join(lines))


def test_failed_part_is_reported_and_retried(spark, tmp_path):
    work = fresh_path(spark, "offline")
    sources = {c: str(tmp_path / f"chr{c}.gz") for c in ("1", "2")}
    annotation_file(sources["1"], "1", 20)
    (tmp_path / "chr2.gz").write_bytes(b"not a gzip file at all")
    first = offline.build_training_tables(spark, sources, work)
    assert not first.complete and first.model_ready.count() == 20
    assert {r.part: r.status for r in first.report.collect()} == {"1": "landed", "2": "failed"}
    annotation_file(sources["2"], "2", 30)
    landed = fingerprint(spark, [f"{work}/parts/part=1"])
    second = offline.build_training_tables(spark, sources, work)
    assert second.complete and second.encoded.count() == 50
    assert fingerprint(spark, [f"{work}/parts/part=1"]) == landed
    annotation_file(sources["1"], "1", 25)
    assert offline.build_training_tables(spark, sources, work).optimized.count() == 55


def test_other_faults_are_raised(spark, tmp_path):
    annotation_file(tmp_path / "chr1.gz", "1", 5)

    def broken(df):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        stitch_parts(spark, {"1": str(tmp_path / "chr1.gz")}, fresh_path(spark, "parts"), broken)
