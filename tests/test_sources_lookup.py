import gzip

import pytest
from pyspark.sql import functions as F

from variantloom.operators import ingest, lookup, scoring
from variantloom.session import fresh_path
from variantloom.sources import annotations, events, sinks, vcf

HEADER = "extra\t#chr\tpos(1-based)\tref\talt\tSIFT_score\tPolyphen2_HDIV_score\tCADD_phred\tgnomAD_exomes_AF\tclinvar_clnsig\tlast"


def write_gz(path, lines):
    with gzip.open(path, "wt") as handle:
        handle.write("\n".join(lines) + "\n")


def test_tsv_scan_keeps_text_and_prunes(spark, tmp_path):
    write_gz(tmp_path / "v.chr1.gz", [HEADER, "e\t01\t7\tA\tG\t.;0.2\t.\t12.5\t.\tPathogenic\tz", "e\t01\tbad\tA\tG\t.\t.\t.\t.\t.\tz"])
    df = annotations.scan_annotation_tsv(spark, str(tmp_path / "*.gz"))
    assert df.columns[0] == "#chr" and dict(df.dtypes)["pos(1-based)"] == "string"
    assert [r["#chr"] for r in df.collect()] == ["01", "01"]


def test_failing_file_is_left_out_and_reported(spark, tmp_path):
    write_gz(tmp_path / "one.gz", [HEADER, "e\t1\t7\tA\tG\t.\t.\t12.5\t.\tPathogenic\tz"])
    (tmp_path / "two.gz").write_bytes(b"not gzip")
    parts = {"one": str(tmp_path / "one.gz"), "two": str(tmp_path / "two.gz")}
    table, report = annotations.stitch_parts(spark, parts, fresh_path(spark, "stitch"), ingest.model_ready)
    assert table.count() == 1
    assert {r.part: r.status for r in report.collect()} == {"one": "landed", "two": "failed"}
    with pytest.raises(RuntimeError):
        annotations.stitch_parts(spark, {"two": parts["two"]}, fresh_path(spark, "stitch"), ingest.model_ready)


def test_point_read_prunes_partitions_and_pushes_position(spark):
    rows = [(c, p, "A", "G", 0.1) for c in ("1", "X") for p in range(1, 2000)]
    df = spark.createDataFrame(rows, "`#chr` string, `pos(1-based)` bigint, ref string, alt string, score double")
    out = fresh_path(spark, "store")
    annotations.write_partitioned_store(df, out)
    store = annotations.read_partitioned_store(spark, out)
    hit = annotations.partition_point_read(store, "X", 77, "A", "G")
    assert hit.count() == 1
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chr" in plan and "EqualTo(`pos(1-based)`,77)" in plan


VCF = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT", "", "1\t2\t.", "chr11\t209271\t.\tc\tA,T\t.", "1\t12345\t.\tA\tG", "X\t5\t.\tA\t, <DEL> ,*"]


def test_vcf_rows_one_per_allele_in_file_order(spark, tmp_path):
    write_gz(tmp_path / "a.vcf.gz", VCF)
    (tmp_path / "b.vcf").write_text("\n".join(VCF))
    rows = vcf.scan_vcf(spark, [str(tmp_path / "a.vcf.gz"), str(tmp_path / "b.vcf")])
    assert rows.count() == 10
    first = [(r.chrom, r.pos, r.ref, r.alt) for r in vcf.vcf_limit(rows, 3).collect()]
    assert first == [("11", "209271", "C", "A"), ("11", "209271", "C", "T"), ("1", "12345", "A", "G")]
    assert {r.allele_kind for r in rows.collect()} == {"bases", "symbolic", "spanning"}
    assert vcf.vcf_limit(rows, 6000).count() == 10
    for bad in (0, -1):
        with pytest.raises(ValueError):
            vcf.vcf_limit(rows, bad)


def test_event_log_skips_junk_and_non_finite(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(
        '{"timestamp":"2024-01-01T00:00:01","status":"success","sift":NaN,"polyphen":Infinity,"cadd":"12.5","prediction":1}\n'
        "\n{broken\n"
        '{"timestamp":"2024-01-01T00:00:02","status":"error","cadd":"high"}\n'
    )
    rows = events.recent_events(events.scan_event_log(spark, str(tmp_path)), 10).collect()
    assert [r.timestamp[-1] for r in rows] == ["2", "1"]
    assert (rows[1].sift, rows[1].polyphen, rows[1].cadd, rows[1].prediction) == (None, None, 12.5, 1)
    assert rows[0].cadd is None


def test_appended_events_get_a_timestamp_unless_given(spark):
    path = fresh_path(spark, "log")
    events.append_event_log(spark.createDataFrame([("success", None), ("error", "2024-05-06T00:00:00")], "status string, timestamp string"), path)
    got = {r.status: r.timestamp for r in events.scan_event_log(spark, path).collect()}
    assert got["error"] == "2024-05-06T00:00:00" and got["success"] > "2025"


def test_finished_stage_is_not_built_again(spark):
    path, calls = fresh_path(spark, "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.skip_if_materialized(spark, path, build).count() == 3
    assert sinks.skip_if_materialized(spark, path, build).count() == 3 and len(calls) == 1


def test_csv_report_quotes_every_cell(spark):
    path = fresh_path(spark, "csv")
    back = sinks.sink_csv_report(spark.createDataFrame([('say "hi"', "a,b")], "x string, y string"), path)
    assert back.first().x == 'say "hi"'
    assert '"say ""hi""","a,b"' in [r.value for r in spark.read.text(path).collect()]


STORE = "`#chr` string, `pos(1-based)` bigint, ref string, alt string, SIFT_score double, Polyphen2_HDIV_score double, CADD_phred double, gnomAD_exomes_AF double"


def test_batch_counts_labels_and_failures(spark):
    store = lookup.resolve_store({
        "local": spark.createDataFrame([("11", 209271, "C", "A", 0.1, 0.2, 23.0, 0.0001)], STORE),
        "lake": spark.createDataFrame([("11", 209271, "C", "A", 0.9, 0.9, 1.0, 0.5), ("2", 5, "A", "T", 0.1, 0.2, 99.0, 0.1)], STORE),
    })
    requests = spark.createDataFrame(
        [("chr11", " 209271 ", "c", "A"), ("1", "12345", "A", "G"), ("2", "5", "A", "T"), ("2", "5x", "A", "T")],
        "chrom string, pos string, ref string, alt string",
    )
    results = scoring.vcf_batch_score(requests, store, lambda f: f.withColumn("probability", F.lit(0.2)))
    by_status = {r.status: r for r in results.collect()}
    counters = scoring.batch_counters(results, total_input=10).first()
    assert (counters.total_input, counters.processed, counters.predicted, counters.not_found, counters.failed) == (10, 4, 1, 1, 2)
    hit = by_status["predicted"]
    assert (hit.label, hit.feature_source, hit.cadd, hit.polyphen, hit.confidence_score) == ("BENIGN", "local", 23.0, 0.2, 0.8)
    assert scoring.batch_events(results).count() == 3


def test_store_duplicates_keep_the_highest_cadd(spark):
    rows = spark.createDataFrame([("1", 1, "A", "C", None, None, c, 0.1) for c in (None, 3.0, 9.0)], STORE)
    assert lookup.store_dedupe_first(lookup.store_rows(rows)).first().cadd == 9.0


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    rows = spark.createDataFrame([("1", 1, "A", "C", None, None, 1.0, 0.1)], STORE)
    plan = lookup.store_dedupe_first(lookup.store_rows(rows))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_request_key_is_split_and_nothing_is_lost(spark):
    """A third of the requests share one key: the join keeps every row and splits the partition."""
    store = spark.range(2000).select(
        F.lit("1").alias("k_chrom"), F.col("id").alias("k_pos"), F.lit("A").alias("k_ref"), F.lit("C").alias("k_alt"),
        *[F.rand(1).alias(s) for s in lookup.SCORES],
    )
    path = fresh_path(spark, "skew-store")
    store.write.parquet(path)
    position = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000)
    requests = spark.range(60_000, numPartitions=8).select(
        F.lit("1").alias("chrom"), position.cast("string").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.sha2(F.col("id").cast("string"), 256).alias("pad")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup.lookup(requests, spark.read.parquet(path))
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_recent_events_honour_the_limit(spark):
    log = spark.range(3000).select(F.col("id").cast("string").alias("timestamp"))
    assert events.recent_events(log, 2500).count() == 2500


def test_event_log_keeps_its_day_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{d}T00:00:00+00:00", "success") for d in (1, 1, 2, 3)], "timestamp string, status string")
    path = str(tmp_path / "log")
    events.append_event_log(rows, path)
    log = events.scan_event_log(spark, path)
    assert sorted(r.day for r in log.collect()) == ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-03"]
    late = log.where("day >= '2024-01-02'")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert late.count() == 2 and "PartitionFilters: [isnotnull(day" in plan
