"""Source and sink queries: the views go out as files and come back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, real
from catalog.ingest import encoded
from variantloom.operators import ingest
from variantloom.session import fresh_path, hadoop_path, list_names, materialize
from variantloom.sources import annotations, blockgzip, events, sinks, vcf

RAW_NAMES = {"chrom": "#chr", "pos": "pos(1-based)"}
INGEST = ["chrom", "pos", "ref", "alt", *ingest.SCORE_COLUMNS, "clinvar_clnsig"]


def raw_files(t: Tables, codec: str = "gzip") -> str:
    """The raw variants as tab-separated files, one folder per contig."""
    path = fresh_path(t.spark, "raw-tsv")
    raw = t.variants_raw.select(*INGEST, F.col("chrom").alias("file_part")).withColumnsRenamed(RAW_NAMES)
    writer = raw.hint("rebalance", F.col("file_part")).write.partitionBy("file_part").option("sep", "\t").option("header", True)
    writer.option("compression", codec).csv(path)
    return path


def plain_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in RAW_NAMES.items()})


@query(
    "scan_annotation_tsv",
    """SELECT chrom, CAST(pos AS VARCHAR) AS pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF,
    nullif(clinvar_clnsig, '') AS clinvar_clnsig FROM variants_raw""",
)
def scan_annotation_tsv(t: Tables):
    return plain_names(annotations.scan_annotation_tsv(t.spark, f"{raw_files(t)}/*"))


def raw_lines(t: Tables, *extra) -> tuple[DataFrame, str]:
    """The raw variants as tab-separated lines with their columns, and the header line."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in INGEST]
    return t.variants_raw.select(F.concat_ws("\t", *cells).alias("value"), *extra), "\t".join(RAW_NAMES.get(c, c) for c in INGEST)


def range_bytes(t: Tables, files, least: int) -> int:
    return blockgzip.range_width([size for _, size in blockgzip.data_files(t.spark, files)], least)


@query(
    "scan_block_gzip",
    """SELECT chrom, CAST(pos AS VARCHAR) AS pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF,
    nullif(clinvar_clnsig, '') AS clinvar_clnsig, TRUE AS cut FROM variants_raw""",
)
def scan_block_gzip(t: Tables):
    """One block gzip file, read in ranges far smaller than it is; ``cut`` says that more than 8 tasks read it."""
    lines, header = raw_lines(t)
    path = fresh_path(t.spark, "raw-blocks")
    file = blockgzip.join_block_gzip(blockgzip.write_block_gzip(lines, f"{path}/parts", block=4096), f"{path}/whole.gz", header)
    rows = annotations.scan_annotation_tsv(t.spark, file, range_bytes=range_bytes(t, file, 8192))
    return plain_names(rows).withColumn("cut", F.lit(rows.rdd.getNumPartitions() > 8))


@query(
    "quarantine_rows",
    """SELECT chrom, CAST(count(*) AS BIGINT) AS lines, CAST(count(CASE WHEN pos % 11 > 1 THEN 1 END) AS BIGINT) AS accepted,
      CAST(count(CASE WHEN pos % 11 <= 1 THEN 1 END) AS BIGINT) AS rejected, CAST(count(CASE WHEN pos % 11 = 0 THEN 1 END) AS BIGINT) AS short_lines,
      CAST(count(CASE WHEN pos % 11 = 1 THEN 1 END) AS BIGINT) AS long_lines, TRUE AS placed FROM variants_raw GROUP BY chrom""",
)
def quarantine_rows(t: Tables):
    """Lines with a field too few or too many, kept apart with their place; ``placed`` says that each place holds that line."""
    key = F.pmod(F.col("pos").cast("bigint"), F.lit(11))
    lines, header = raw_lines(t, key.alias("k"))
    broken = F.when(F.col("k") == 0, F.substring_index("value", "\t", -5)).when(F.col("k") == 1, F.concat("value", F.lit("\tx"))).otherwise(F.col("value"))
    marked = F.when(F.col("k") == 0, F.concat_ws("\t", F.substring_index("value", "\t", 1), broken)).otherwise(broken)
    files = blockgzip.write_block_gzip(lines.select(marked.alias("value")), fresh_path(t.spark, "broken-blocks"), header, block=4096)
    records = materialize(annotations.annotation_records(t.spark, files, None, range_bytes=range_bytes(t, files, 16384)), "records")
    kept = records.where("kind = 'accepted'").select(F.col("#chr").alias("chrom"), F.lit("accepted").alias("kind"), F.lit(True).alias("placed"))
    bad = annotations.quarantined(records)
    texts = annotations.text_lines(t.spark, files)  # whole files again, with their line numbers
    numbered = annotations.numbered_lines(texts, texts).select("file", "line_no", F.col("value").alias("there"))
    bad = bad.join(numbered, ["file", "line_no"], "left")
    fields = F.substring_index("reason", " ", 1).cast("int")
    bad = bad.select(
        F.substring_index("value", "\t", 1).alias("chrom"), F.when(fields < len(INGEST), "short").otherwise("long").alias("kind"),
        F.coalesce(F.col("there") == F.col("value"), F.lit(False)).alias("placed"),
    )
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return kept.unionByName(bad).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("lines"), n("accepted").alias("accepted"), n("short", "long").alias("rejected"),
        n("short").alias("short_lines"), n("long").alias("long_lines"), F.bool_and("placed").alias("placed"),
    )


@query(
    "tsv_to_partitioned_parquet",
    """SELECT regexp_replace(upper(chrom), '^CHR', '') AS chr, chrom, pos, ref, alt, nullif(SIFT_score, '.') AS SIFT_score, Polyphen2_HDIV_score,
    nullif(CADD_phred, '.') AS CADD_phred, nullif(gnomAD_exomes_AF, '.') AS gnomAD_exomes_AF, clinvar_clnsig FROM variants_raw""",
)
def tsv_to_partitioned_parquet(t: Tables):
    out = fresh_path(t.spark, "partitioned-store")
    return plain_names(annotations.tsv_to_partitioned_parquet(t.spark, f"{raw_files(t)}/*", out))


def partitioned_store(t: Tables) -> DataFrame:
    path = t.stored_path("partitioned_store")
    if not annotations_ready(t, path):
        annotations.write_partitioned_store(t.variants_clean.withColumnsRenamed(RAW_NAMES), path)
    return annotations.read_partitioned_store(t.spark, path)


def annotations_ready(t: Tables, path: str) -> bool:
    fs, target = hadoop_path(t.spark, f"{path}/_SUCCESS")
    return fs.exists(target)


@query(
    "partition_point_read",
    """SELECT chrom AS chr, chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF, target
    FROM variants_clean ORDER BY chrom, pos, ref, alt LIMIT 1""",
)
def partition_point_read(t: Tables):
    store = partitioned_store(t)
    wanted = store.orderBy("chr", "pos(1-based)", "ref", "alt").select("chr", "pos(1-based)", "ref", "alt").first()
    return plain_names(annotations.partition_point_read(store, *wanted) if wanted else store.limit(0))


@query("scan_parquet", "SELECT * FROM variants_clean")
def scan_parquet(t: Tables):
    out = fresh_path(t.spark, "scan")
    t.variants_clean.write.parquet(out)
    return sinks.scan_parquet(t.spark, out)


@query("sink_parquet", "SELECT * FROM o_encoded")
def sink_parquet(t: Tables):
    return sinks.sink_parquet(encoded(t), fresh_path(t.spark, "sink"))


@query("union_chromosome_parts", "SELECT * FROM variants_clean")
def union_chromosome_parts(t: Tables):
    out = fresh_path(t.spark, "parts")
    t.variants_clean.withColumn("part", F.col("chrom")).write.partitionBy("part").parquet(out)
    return annotations.union_chromosome_parts(t.spark, [f"{out}/{name}" for name in list_names(t.spark, out)])


@query("skip_if_materialized", "SELECT chrom, target, CAST(count(*) AS BIGINT) AS variants FROM variants_clean GROUP BY chrom, target")
def skip_if_materialized(t: Tables):
    path = fresh_path(t.spark, "stage")
    build = lambda: t.variants_clean.groupBy("chrom", "target").agg(F.count(F.lit(1)).alias("variants"))

    def must_not_run():
        raise AssertionError("a finished stage was computed again")

    sinks.skip_if_materialized(t.spark, path, build)
    return sinks.skip_if_materialized(t.spark, path, must_not_run)


@query(
    "per_part_fault_isolation",
    """SELECT c.part, CASE WHEN v.chrom IS NULL THEN 'failed' ELSE 'landed' END AS status, CAST(count(v.chrom) AS BIGINT) AS variants,
      CAST(coalesce(sum(v.target), 0) AS BIGINT) AS pathogenic
    FROM (SELECT DISTINCT chrom AS part FROM variants_raw UNION ALL SELECT 'broken') c LEFT JOIN variants_clean v ON c.part = v.chrom
    GROUP BY c.part, v.chrom""",
)
def per_part_fault_isolation(t: Tables):
    path = raw_files(t)
    fs, broken = hadoop_path(t.spark, f"{path}/file_part=broken/part-0.csv.gz")
    stream = fs.create(broken)
    stream.write(bytearray(b"this is not a gzip stream"))
    stream.close()
    parts = {name.split("=", 1)[1]: f"{path}/{name}" for name in list_names(t.spark, path)}
    table, report = annotations.stitch_parts(t.spark, parts, fresh_path(t.spark, "stitched"), ingest.model_ready)
    per_part = table.groupBy(F.col("`#chr`").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positive"))
    return report.join(per_part, "part", "left").select(
        "part", "status", F.coalesce("n", F.lit(0)).alias("variants"), F.coalesce("positive", F.lit(0)).alias("pathogenic")
    )


VCF_ROWS = """SELECT regexp_replace(upper(trim(f[1])), '^CHR', '') AS chrom, f[2] AS pos, upper(f[4]) AS ref, upper(trim(a)) AS alt,
  CAST(i - 1 AS INT) AS alt_index, 'bases' AS allele_kind, section, s_chrom, s_pos, s_ref, s_alt
FROM (
  SELECT f, section, chrom AS s_chrom, pos AS s_pos, ref AS s_ref, alt AS s_alt, unnest(string_split(f[5], ',')) AS a,
    generate_subscripts(string_split(f[5], ','), 1) AS i
  FROM (SELECT *, string_split(line, chr(9)) AS f FROM vcf_lines WHERE line <> '' AND line NOT LIKE '#%') x WHERE len(f) >= 5
) y WHERE trim(a) <> ''"""
VCF_COLUMNS = "chrom, pos, ref, alt, alt_index, allele_kind"


def vcf_files(t: Tables) -> str:
    """The VCF lines as gzipped text files whose names follow the order of the lines."""
    path = fresh_path(t.spark, "vcf")
    order = ["section", "chrom", "pos", "ref", "alt"]
    lines = t.vcf_lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.option("compression", "gzip").text(path)
    return path


@query("scan_vcf", f"SELECT {VCF_COLUMNS} FROM ({VCF_ROWS}) z")
def scan_vcf(t: Tables):
    return vcf.scan_vcf(t.spark, vcf_files(t)).select(*VCF_COLUMNS.split(", "))


@query(
    "vcf_limit",
    f"SELECT {VCF_COLUMNS} FROM ({VCF_ROWS}) z ORDER BY section, s_chrom, s_pos, s_ref, s_alt, alt_index LIMIT 500",
)
def vcf_limit(t: Tables):
    return vcf.vcf_limit(vcf.scan_vcf(t.spark, vcf_files(t)), 500).select(*VCF_COLUMNS.split(", "))


EVENT_SQL = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, endpoint, source, status, chrom, CAST(prediction AS DOUBLE) AS prediction, probability,
  confidence_score, latency_ms, cadd, sift, polyphen, alt_freq FROM prediction_events"""
EVENT_COLUMNS = [
    "timestamp", "endpoint", "source", "status", "chrom", "prediction", "probability", "confidence_score", "latency_ms",
    "cadd", "sift", "polyphen", "alt_freq",
]


def logged_events(t: Tables) -> DataFrame:
    stamped = t.prediction_events.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return stamped.select(*EVENT_COLUMNS)


@query("append_event_log", EVENT_SQL)
def append_event_log(t: Tables):
    path = fresh_path(t.spark, "event-log")
    logged = logged_events(t)
    for part in (logged.where("status = 'success'"), logged.where("status = 'error'")):
        events.append_event_log(part, path)
    return real(events.scan_event_log(t.spark, path).select(*EVENT_COLUMNS), "prediction")


@query("scan_event_log", EVENT_SQL)
def scan_event_log(t: Tables):
    path = fresh_path(t.spark, "event-text")
    logged = logged_events(t)
    text = F.to_json(F.struct(*EVENT_COLUMNS))
    # a missing CADD is written as the bare word NaN, the way lenient writers do
    with_nan = F.when(F.col("cadd").isNull(), F.concat(F.lit('{"cadd":NaN,'), F.substring(text, 2, 1 << 20))).otherwise(text)
    junk = t.spark.createDataFrame([("",), ("   ",), ('{"status":"success",',), ("not json",)], "value string")
    logged.select(with_nan.alias("value")).unionByName(junk).write.text(path)
    return real(events.scan_event_log(t.spark, path).select(*EVENT_COLUMNS), "prediction")


@query(
    "recent_events",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, endpoint, status FROM prediction_events
    ORDER BY prediction_events.ts DESC, event_id LIMIT 100""",
)
def recent_events(t: Tables):
    newest = events.recent_events(t.prediction_events, 100, order=["ts"], ties=["event_id"])
    return newest.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "endpoint", "status")
