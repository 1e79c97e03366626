"""Raw annotation files and the partitioned variant store."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.contract import INGEST_COLUMNS
from variantloom.operators.ingest import prune_columns
from variantloom.session import hadoop_path, materialize, path_exists, scratch
from variantloom.sources.blockgzip import RANGE_BYTES, data_files, numbered_lines, text_lines
from variantloom.sources.sinks import sink_parquet, skip_if_materialized

LOGGER = logging.getLogger(__name__)
PLACE = ("file", "split", "line", "kind", "reason", "value")


def header_line(spark: SparkSession, file: str) -> str:
    """The first line of a file, decompressed where its name says so; empty for an empty file."""
    jvm = spark.sparkContext._jvm
    fs, target = hadoop_path(spark, file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(target)
    stream = fs.open(target)
    try:
        text = codec.createInputStream(stream) if codec is not None else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def annotation_records(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, null_value: str | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Every line of tab-separated files: ``file, split, line, kind, reason, value`` and its columns as text.

    ``kind`` is accepted, rejected, header or blank. A line with more or fewer fields than the header is rejected, with
    a reason and as ``value`` the line itself. Names come from the header line, so files with
    hundreds of columns stay aligned; each file's header must equal the first one's. Block gzip files are
    read by many tasks. No pass over the data infers types.
    """
    files = [f for f, _ in data_files(spark, paths)]
    headers = {f: header_line(spark, f) for f in files}
    header = next(iter(headers.values()), "")
    for file, other in headers.items():
        if other != header:
            raise ValueError(f"the header of {file} is not that of {files[0]}")
    names = [n.strip('"') for n in header.removeprefix("\ufeff").split("\t")]
    options = {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **({} if null_value is None else {"nullValue": null_value})}
    schema = ", ".join([*[f"`{n}` STRING" for n in names], "_corrupt STRING"])
    lines = text_lines(spark, files, range_bytes)
    # as a generator's output the fields are parsed once, whatever is filtered later
    parsed = lines.select("file", "split", "line", "value", F.inline(F.array(F.from_csv("value", schema, options))))
    fields = F.size(F.split("value", "\t")).cast("string")
    kind = (
        F.when(F.col("value") == F.lit(header), "header").when(~F.col("value").rlike(r"[^\x00-\x20]"), "blank")
        .when(F.col("_corrupt").isNotNull(), "rejected").otherwise("accepted")
    )
    reason = F.when(F.col("kind") == "rejected", F.concat(fields, F.lit(f" fields, the header has {len(names)}")))
    wanted = [n for n in names if columns is None or n in columns]
    rows = parsed.withColumn("kind", kind).withColumn("reason", reason)
    return rows.select("file", "split", "line", "kind", "reason", F.when(F.col("kind") == "rejected", F.col("value")).alias("value"), *[F.col(f"`{n}`") for n in wanted])


def scan_annotation_tsv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = INGEST_COLUMNS, null_value: str | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The accepted lines of tab-separated annotation files, every column as text, cut to ``columns``.

    ``quarantined`` gives the lines that are left out.
    """
    records = annotation_records(spark, paths, columns, null_value, range_bytes)
    df = records.where("kind = 'accepted'").drop(*PLACE)
    return prune_columns(df, columns) if columns is not None else df


def quarantined(records: DataFrame) -> DataFrame:
    """``file, line_no, reason, value`` of the rejected lines of ``annotation_records``, numbered from 1 within each file."""
    found = numbered_lines(records, records.where("kind = 'rejected'").select("file", "split", "line", "reason", "value"))
    return found.select("file", "line_no", "reason", "value")


def spread_after_gzip(df: DataFrame) -> DataFrame:
    """A gzip file is one task however long; even the surviving rows out before heavy work.

    The hint lets adaptive execution choose the sizes and split what is too large. It belongs
    after the label filter and the narrow cleaning, so that only the labelled rows are moved.
    """
    return df.hint("rebalance")


def write_partitioned_store(
    df: DataFrame, path: str, chrom: str = "#chr", pos: str = "pos(1-based)", rows_per_file: int = 5_000_000
) -> None:
    """Store folders ``chr=<contig>`` whose files each cover a tight position range.

    Range partitioning on (contig, position) cuts a large contig into many tasks and files,
    where hashing on the contig alone would leave it to one.
    """
    chrom_col, position = F.col(f"`{chrom}`"), F.col(f"`{pos}`").try_cast("bigint")
    rows = df.withColumn(pos, position).withColumn("chr", F.regexp_replace(F.upper(F.trim(chrom_col)), "^CHR", ""))
    # range bounds come from a sample of the input: stored rows are sampled, not unzipped a second time
    rows = materialize(spread_after_gzip(rows), "store-rows")
    # the row id as last key lets even one very frequent position be cut into several tasks
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("chr", F.col(f"`{pos}`"), "_row").sortWithinPartitions("chr", F.col(f"`{pos}`")).drop("_row")
    ranged.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("chr").parquet(path)


def tsv_to_partitioned_parquet(spark: SparkSession, paths: str | Sequence[str], out: str) -> DataFrame:
    """Annotation files to the partitioned store: text columns, ``.`` as NULL, numeric position."""
    write_partitioned_store(scan_annotation_tsv(spark, paths, columns=None, null_value="."), out)
    return read_partitioned_store(spark, out)


def read_partitioned_store(spark: SparkSession, path: str) -> DataFrame:
    """The store, with contig folder names kept as text (no guessing of ``01`` or ``X``)."""
    sample = spark.read.parquet(path)
    fields = [f"`{f.name}` {'string' if f.name == 'chr' else f.dataType.simpleString()}" for f in sample.schema]
    return spark.read.schema(", ".join(fields)).parquet(path)


def partition_point_read(store: DataFrame, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    """One variant from the store: one partition folder, position pushed down to the files."""
    return store.sparkSession.sql(
        "SELECT * FROM {store} WHERE chr = :chrom AND `pos(1-based)` = :pos AND ref = :ref AND alt = :alt LIMIT 1",
        args={"chrom": chrom, "pos": pos, "ref": ref, "alt": alt},
        store=store,
    )


def union_chromosome_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Cleaned per-chromosome tables as one table (no row order is promised)."""
    return spark.read.parquet(*sorted(paths))


UNREADABLE = re.compile(r"PATH_NOT_FOUND|FAILED_READ_FILE|FileNotFoundException|ZipException|EOFException|incorrect (header|data) check|not a gzip file|[Nn]ot in GZIP|unknown compression", re.DOTALL)


def stitch_parts(
    spark: SparkSession,
    sources: dict[str, str],
    out: str,
    clean: Callable[[DataFrame], DataFrame],
    workers: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Clean each source file into its own part; a file that cannot be read is reported and left out.

    Returns the union of the landed parts and a report (part, status, message, accepted, rejected), which is also kept as a
    table ``<out>.report``. Lines that the reader rejects lie with file, line number and reason in
    ``<out>.rejected/part=<name>``. A file is decompressed once: its columns of interest are stored, then
    counted, cleaned and numbered from there. A part that landed from the same file is not made again, so a further run
    retries only failed and changed files. Any other fault of the job is raised. Each part is one
    Spark job; a few run side by side. Raises when no part landed.
    """
    known: dict[str, tuple[int, int]] = {}
    if path_exists(spark, f"{out}.report/_SUCCESS"):
        known = {r["part"]: (r["accepted"], r["rejected"]) for r in spark.read.parquet(f"{out}.report").collect() if r["status"] == "landed"}

    def one(item: tuple[str, str]) -> tuple[str, str, str | None, int | None, int | None]:
        name, path = item
        counts: list[int] = []

        def build() -> DataFrame:
            records = materialize(annotation_records(spark, path, INGEST_COLUMNS), f"records-{name}")
            kinds = {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()}
            counts.extend(kinds.get(k, 0) for k in ("accepted", "rejected"))
            sink_parquet(quarantined(records), f"{out}.rejected/part={name}")
            return spread_after_gzip(clean(prune_columns(records.where("kind = 'accepted'"), INGEST_COLUMNS)))

        try:
            with scratch(spark):
                skip_if_materialized(spark, f"{out}/part={name}", build, [path])
            accepted, rejected = counts or known.get(name, (None, None))
            return name, "landed", None, accepted, rejected
        except (PySparkException, Py4JJavaError, FileNotFoundError) as error:
            if not UNREADABLE.search(str(error)):
                raise
            LOGGER.warning("part %s left out: %s", name, str(error).split("\n\tat ")[0])
            return name, "failed", type(error).__name__, None, None

    with ThreadPoolExecutor(max_workers=workers) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(one), sorted(sources.items())))
    landed = [f"{out}/part={name}" for name, status, *_ in outcomes if status == "landed"]
    if not landed:
        raise RuntimeError(f"none of the {len(outcomes)} source files could be read")
    report = spark.createDataFrame(outcomes, "part string, status string, message string, accepted bigint, rejected bigint")
    return union_chromosome_parts(spark, landed), sink_parquet(report, f"{out}.report")


def rejected_lines(spark: SparkSession, out: str) -> DataFrame:
    """The quarantine of ``stitch_parts``: ``part, file, line_no, reason, value``."""
    schema = "file string, line_no bigint, reason string, value string, part string"
    return spark.read.schema(schema).option("basePath", f"{out}.rejected").parquet(f"{out}.rejected").select("part", "file", "line_no", "reason", "value")
