"""Block gzip in ranges, and lines that the reader rejects."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from variantloom.operators import ingest
from variantloom.session import fresh_path, path_exists, scratch
from variantloom.sources import annotations, blockgzip, vcf


def block_gzip(data, block):
    return b"".join(blockgzip.members_of(data, block)) + blockgzip._member(b"")


def ranges(raw, width):
    found = []
    for start in range(0, len(raw), width):
        for lot in blockgzip.lines_of(io.BytesIO(raw), start, min(start + width, len(raw))):
            found += lot
    return found


@pytest.mark.parametrize("seed", range(12))
def test_every_line_is_read_once_whatever_the_ranges(seed):
    rng = random.Random(seed)
    lines = [bytes(rng.choices(b"abc\t\x1f\x8b\x08\x04", k=rng.choice([0, 1, 5, 40, 300, 3000]))) for _ in range(rng.choice([0, 1, 3, 300]))]
    data = b"".join(x + b"\n" for x in lines)
    if seed % 3 == 0:
        data, lines = data + b"no end", [*lines, b"no end"]
    raw = block_gzip(data, rng.choice([7, 64, 999, 65280]))
    assert gzip.decompress(raw) == data
    for width in (1, 13, 100, 777, len(raw)):
        assert ranges(raw, width) == lines


def test_a_long_line_across_many_ranges():
    lines = [b"first", b"x" * 500_000, b"", b"last"]
    raw = b"".join(blockgzip.members_of(b"\n".join(lines) + b"\n", 1000))
    assert ranges(raw, 200) == lines


def test_a_damaged_member_is_an_error():
    raw = bytearray(block_gzip(b"some line\n" * 5000, 1000))
    raw[len(raw) // 2] ^= 255
    with pytest.raises(ValueError):
        ranges(bytes(raw), len(raw))


HEADER = "#chr\tpos(1-based)\tref\talt\tSIFT_score\tPolyphen2_HDIV_score\tCADD_phred\tgnomAD_exomes_AF\tclinvar_clnsig"


def rows(n):
    return [f"{1 + i % 3}\t{i}\tA\tG\t0.1\t.\t{i % 40}\t.\tPathogenic" for i in range(n)]


def test_one_file_is_many_tasks_and_the_same_rows(spark, tmp_path):
    body = rows(20_000)
    (tmp_path / "a.gz").write_bytes(block_gzip(("\n".join([HEADER, *body]) + "\n").encode(), 12_000))
    with gzip.open(tmp_path / "b.gz", "wt") as handle:
        handle.write("\n".join([HEADER, *body]) + "\n")
    many = annotations.scan_annotation_tsv(spark, str(tmp_path / "a.gz"), range_bytes=8192)
    one = annotations.scan_annotation_tsv(spark, str(tmp_path / "b.gz"))
    assert many.rdd.getNumPartitions() > 8 and one.rdd.getNumPartitions() == 1
    assert many.exceptAll(one).count() == 0 and many.count() == one.count() == 20_000
    both = annotations.scan_annotation_tsv(spark, [str(tmp_path / "a.gz"), str(tmp_path / "b.gz")])
    assert both.count() == 40_000
    assert vcf.scan_vcf(spark, str(tmp_path / "a.gz"), range_bytes=8192).count() == vcf.scan_vcf(spark, str(tmp_path / "b.gz")).count()


@pytest.mark.parametrize("kind", ["block", "gzip", "plain"])
def test_rejected_lines_keep_place_and_reason(spark, tmp_path, kind):
    body = rows(3000)
    bad = {700: "1\t2\tshort", 1500: body[0] + "\tone\ttoo many", 2999: "alone"}
    body = [bad.get(i, x) for i, x in enumerate(body)]
    lines = [HEADER, *body[:1000], "", *body[1000:]]
    text = ("\n".join(lines) + "\n").encode()
    path = tmp_path / ("t.tsv" if kind == "plain" else "t.gz")
    path.write_bytes(block_gzip(text, 5000) if kind == "block" else gzip.compress(text) if kind == "gzip" else text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = annotations.annotation_records(spark, str(path), annotations.INGEST_COLUMNS, range_bytes=2000)
        kinds = {r["kind"]: r["count"] for r in records.groupBy("kind").count().collect()}
        found = {r["line_no"]: (r["reason"], r["value"]) for r in annotations.quarantined(records).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kinds == {"accepted": 2997, "rejected": 3, "header": 1, "blank": 1}
    want = {lines.index(x) + 1: (f"{x.count(chr(9)) + 1} fields, the header has 9", x) for x in bad.values()}
    assert found == want


def test_stitched_parts_report_what_they_reject(spark, tmp_path):
    with gzip.open(tmp_path / "one.gz", "wt") as handle:
        handle.write("\n".join([HEADER, *rows(50), "broken\tline"]) + "\n")
    (tmp_path / "two.gz").write_bytes(block_gzip(("\n".join([HEADER, *rows(10)]) + "\n").encode(), 100))
    (tmp_path / "three.gz").write_bytes(b"not gzip")
    out = fresh_path(spark, "stitched")
    parts = {n: str(tmp_path / f"{n}.gz") for n in ("one", "two", "three")} | {"four": str(tmp_path / "none.gz")}
    for _ in range(2):  # the second run makes nothing again and reports the same
        table, report = annotations.stitch_parts(spark, parts, out, ingest.model_ready)
        assert table.count() == 60
        want = {("one", "landed", 50, 1), ("two", "landed", 10, 0), ("three", "failed", None, None), ("four", "failed", None, None)}
        assert {(r["part"], r["status"], r["accepted"], r["rejected"]) for r in report.collect()} == want
        assert [(r["part"], r["line_no"], r["value"]) for r in annotations.rejected_lines(spark, out).collect()] == [("one", 52, "broken\tline")]


def test_other_headers_are_refused(spark, tmp_path):
    for name, header in (("a", HEADER), ("b", HEADER.replace("ref\talt", "alt\tref"))):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as handle:
            handle.write(f"{header}\n")
    with pytest.raises(ValueError):
        annotations.scan_annotation_tsv(spark, str(tmp_path))


def test_written_block_gzip_reads_back(spark, tmp_path):
    lines = spark.range(5000).select(F.concat_ws("\t", F.col("id").cast("string"), F.repeat(F.lit("x"), 30)).alias("value")).repartition(3)
    files = blockgzip.write_block_gzip(lines, f"file://{tmp_path}/out", "head", block=4000)
    assert len(files) == 3 and all(blockgzip.is_block_gzip(spark, f) for f in files)
    got = blockgzip.text_lines(spark, f"file://{tmp_path}/out", range_bytes=1000).where("value <> 'head'").select("value")
    assert got.exceptAll(lines).count() == 0 and got.count() == 5000


def test_joined_parts_are_one_file_with_one_header(spark, tmp_path):
    lines = spark.range(4000).select(F.concat("id", F.lit("\ty")).alias("value")).repartition(3)
    parts = blockgzip.write_block_gzip(lines, f"file://{tmp_path}/parts", block=500)
    file = blockgzip.join_block_gzip(parts, f"file://{tmp_path}/whole.gz", "a\tb")
    text = gzip.decompress((tmp_path / "whole.gz").read_bytes()).decode().splitlines()
    assert text[0] == "a\tb" and sorted(text[1:]) == sorted(f"{i}\ty" for i in range(4000))
    rows = annotations.scan_annotation_tsv(spark, file, columns=None, range_bytes=600)
    assert rows.rdd.getNumPartitions() > 8 and sorted(int(r["a"]) for r in rows.collect()) == list(range(4000))


class Counted(bytes):
    """Bytes that note how many are copied when a piece without an end is cut out."""

    copied = 0

    def __getitem__(self, key):
        if isinstance(key, slice) and key.stop is None:
            Counted.copied += len(self) - (key.start or 0)
        return Counted(bytes.__getitem__(self, key)) if isinstance(key, slice) else bytes.__getitem__(self, key)

    def __add__(self, other):
        return Counted(bytes(self) + bytes(other))

    __radd__ = __add__


def test_members_are_cut_out_without_copying_what_follows():
    raw = block_gzip(b"".join(b"%d some line\n" % i for i in range(40_000)), 1000)
    handle = io.BytesIO(raw)
    members = blockgzip.Members(handle, 0)
    members.held = Counted()
    Counted.copied = 0
    assert b"".join(text for _, text in members) == gzip.decompress(raw)
    assert Counted.copied < 10 * len(raw)


def test_ranges_follow_the_length_of_the_files():
    assert blockgzip.range_width([100_000], 8192) == 8192  # a small file is still cut
    for sizes in ([60 << 20], [30 << 20] * 8, [400 << 20]):
        width = blockgzip.range_width(sizes, 8192)
        assert 8192 < width <= blockgzip.RANGE_BYTES and sum(-(-x // width) for x in sizes) <= 64 + len(sizes)
    assert blockgzip.range_width([100 << 30], 8192) == blockgzip.RANGE_BYTES


def test_scratch_tables_go_when_their_work_is_done(spark):
    from variantloom.session import materialize

    kept = materialize(spark.range(3), "kept").inputFiles()[0].rsplit("/", 1)[0]
    with scratch(spark) as made:
        assert materialize(spark.range(5), "gone").count() == 5
    assert len(made) == 1 and not path_exists(spark, made[0]) and path_exists(spark, kept)
