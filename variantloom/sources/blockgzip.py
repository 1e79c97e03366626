"""Lines of text files with their place, where block-compressed gzip files are read by many tasks.

Block gzip (as bgzip writes it) is a series of small gzip members, each of which names its compressed size in its header.
Such a file is cut into ranges of bytes; a task starts at the first member that begins in its range, which it finds by
looking for a header whose member decompresses to the stated size and checksum. No index of the members is needed, and
no task reads more than its range and the rest of one line. A plain gzip file has no such places and stays one task.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from variantloom.session import hadoop_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

RANGE_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08\x04"
HEAD = 12  # bytes of a member before its extra field
LARGEST = 1 << 16  # bytes of a member
READ = 4 << 20
ROWS = 50_000  # lines of one batch
SCHEMA = "file string, split bigint, line bigint, value string"


def member_size(head: bytes) -> int | None:
    """Compressed size that the header of a member states; None if this is no such header, or one that is cut off."""
    if len(head) < HEAD or not head.startswith(MAGIC):
        return None
    extra = head[HEAD : HEAD + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        tag, length = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if tag == b"BC" and length == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + length
    return None


def member_text(member: bytes) -> bytes | None:
    """The decompressed text of a whole member, None if it is none."""
    start = HEAD + struct.unpack_from("<H", member, 10)[0]
    checksum, length = struct.unpack_from("<II", member, len(member) - 8)
    try:
        text = zlib.decompress(member[start:-8], -15)
    except zlib.error:
        return None
    return text if len(text) == length and zlib.crc32(text) == checksum else None


class Members:
    """The members of an open file from a place on, with the offset of each."""

    def __init__(self, handle, start: int):
        self.handle, self.offset = handle, start
        handle.seek(start)
        self.held, self.at = b"", 0  # bytes that were read, and how many of them are done: a member is cut out, the rest not copied

    def _fill(self, wanted: int) -> None:
        while len(self.held) - self.at < wanted:
            more = self.handle.read(READ)
            if not more:
                return
            self.held, self.at = self.held[self.at :] + more, 0

    def _move(self, n: int) -> None:
        self.offset += n
        self.at += n

    def find_first(self) -> bool:
        """Move to the first member at or after this place."""
        while True:
            self._fill(2 * LARGEST)
            at = self.held.find(MAGIC, self.at)
            while 0 <= at:
                size = member_size(self.held[at : at + LARGEST])
                if size and at + size <= len(self.held) and member_text(self.held[at : at + size]) is not None:
                    self._move(at - self.at)
                    return True
                if at + LARGEST > len(self.held):
                    break
                at = self.held.find(MAGIC, at + 1)
            if at < 0:
                at = max(self.at, len(self.held) - len(MAGIC) + 1)
            self._move(at - self.at)
            before = len(self.held) - self.at
            self._fill(before + 2 * LARGEST)
            if len(self.held) - self.at == before:
                return False

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while True:
            self._fill(LARGEST + HEAD)
            left = len(self.held) - self.at
            if not left:
                return
            size = member_size(self.held[self.at : self.at + LARGEST])
            text = member_text(self.held[self.at : self.at + size]) if size and size <= left else None
            if text is None:
                raise ValueError(f"no whole member of a block gzip file at byte {self.offset}")
            yield self.offset, text
            self._move(size)


def lines_of(handle, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines of one range of bytes, in lots.

    A range has the lines that begin after its first member's start (from its start, for the first range) up to the
    start of the next range's first member. So a line that ends where a range begins, or lies across several, is read once.
    """
    members = Members(handle, start)
    if start and not members.find_first():
        return
    skipping, rest = start > 0, b""
    for offset, text in members:
        last = offset >= end
        if last and skipping:
            return
        if skipping:
            at = text.find(b"\n")
            if at < 0:
                continue
            text, skipping = text[at + 1 :], False
        if last:
            at = text.find(b"\n")
            rest += text[: at + 1] if at >= 0 else text
            if at < 0:
                continue
            yield rest.split(b"\n")[:-1]
            return
        whole, found, tail = text.rpartition(b"\n")
        if found:
            yield (rest + whole).split(b"\n")
            rest = tail
        else:
            rest += text
    if rest:
        yield [rest]


class BlockGzipRange(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class BlockGzipReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], width: int):
        self.files, self.width = files, width

    def partitions(self) -> Sequence[InputPartition]:
        return [BlockGzipRange(f, a, min(a + self.width, size)) for f, size in self.files for a in range(0, size, self.width)]

    def read(self, partition: BlockGzipRange) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(partition.file)

        def batch(lines: list[bytes], first: int) -> pa.RecordBatch:
            texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            columns = [
                pa.array([partition.file] * len(lines), pa.string()),
                pa.array([partition.start] * len(lines), pa.int64()),
                pa.array(range(first, first + len(lines)), pa.int64()),
                pa.array(texts, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["file", "split", "line", "value"])

        with fs.open_input_file(path) as handle:
            held: list[bytes] = []
            done = 0
            for lot in lines_of(handle, partition.start, partition.end):
                held += lot
                while len(held) >= ROWS:
                    yield batch(held[:ROWS], done)
                    done, held = done + ROWS, held[ROWS:]
            if held:
                yield batch(held, done)


class BlockGzipSource(DataSource):
    """Options: ``files`` as JSON pairs of name and size, ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockGzipReader:
        return BlockGzipReader([tuple(f) for f in json.loads(self.options["files"])], int(self.options["range_bytes"]))


def data_files(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """Names and sizes of the files that the paths, patterns and folders stand for, hidden ones left out."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        fs, pattern = hadoop_path(spark, path)
        matches = [s for s in fs.globStatus(pattern) or [] if not s.getPath().getName().startswith(("_", "."))]
        if not matches:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
        while matches:
            status = matches.pop()
            if status.isDirectory():
                matches += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            else:
                found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def range_width(sizes: Sequence[int], least: int) -> int:
    """Bytes of a range that cuts files of these sizes into some 64 parts, but no smaller than ``least``; long files get the usual ranges."""
    return max(least, min(RANGE_BYTES, sum(sizes) // 64))


def is_block_gzip(spark: SparkSession, file: str) -> bool:
    """Whether the file starts with a member that states its size, and executors can open it by its name."""
    if not file.endswith((".gz", ".bgz")):
        return False
    try:
        pyarrow.fs.FileSystem.from_uri(file)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    fs, path = hadoop_path(spark, file)
    stream = fs.open(path)
    try:
        head = bytes(b & 255 for b in (stream.read() for _ in range(64)) if b >= 0)
    finally:
        stream.close()
    return member_size(head) is not None


def text_lines(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, split, line, value`` of every line. ``split`` and ``line`` grow with the place in a file.

    Files of block gzip are cut into ranges; all others are read by Spark's text source, which cuts uncompressed ones.
    """
    files = data_files(spark, paths)
    blocks = [f for f in files if is_block_gzip(spark, f[0])]
    others = [f for f, _ in files if f not in {b for b, _ in blocks}]
    parts = []
    if blocks:
        spark.dataSource.register(BlockGzipSource)
        parts.append(spark.read.format("block_gzip_lines").options(files=json.dumps(blocks), range_bytes=range_bytes).load())
    if others or not blocks:
        own = spark.read.text(others) if others else spark.createDataFrame([], "value string")
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if others else [F.lit(""), F.lit(0).cast("bigint")]
        # grows line by line within one block of one file, which one task reads from top to bottom
        parts.append(own.select(place[0].alias("file"), place[1].alias("split"), F.monotonically_increasing_id().alias("line"), "value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def numbered_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, some rows of ``lines``, with ``line_no``: the place of each line in its file, from 1.

    The lines of each split are counted; a split starts after all before it. A file has few splits, so the
    running sum over them is small however long the file is.
    """
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("line").alias("_first"))
    before = F.expr("coalesce(sum(_n) OVER (PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = splits.withColumn("_before", before).drop("_n")
    return wanted.join(starts, ["file", "split"]).withColumn("line_no", F.col("_before") + F.col("line") - F.col("_first") + 1).drop("_before", "_first")


def members_of(data: bytes, block: int = 65280) -> Iterator[bytes]:
    """``data`` as members of block gzip, without the empty one at the end of a file."""
    for start in range(0, len(data), block):
        yield _member(data[start : start + block])


def _member(text: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    head = MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def write_block_gzip(lines: DataFrame, path: str, header: str = "", block: int = 65280) -> list[str]:
    """The column ``value`` of ``lines`` as block gzip files below ``path``, one for each partition, each with the header first.

    A task writes one file named after its partition; a repeated task writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{number:05d}.gz"
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            held = f"{header}\n".encode() if header else b""
            for batch in batches:
                held += b"".join(f"{v}\n".encode() for v in batch.column("value").to_pylist() if v is not None)
                whole = len(held) // block * block
                for member in members_of(held[:whole], block):
                    out.write(member)
                held = held[whole:]
            for member in [*members_of(held, block), _member(b"")]:
                out.write(member)
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], ["file"])

    return sorted(r["file"] for r in lines.select("value").mapInArrow(run, "file string").collect())


def join_block_gzip(files: Sequence[str], path: str, header: str = "") -> str:
    """One block gzip file at ``path``: the header, then the members of ``files`` one after the other, as they are.

    Tasks compress the parts side by side; here only compressed bytes are copied, a few MB at a time.
    """
    fs, target = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_output_stream(target, compression=None) as out:
        out.write(_member(f"{header}\n".encode()) if header else b"")
        for file in files:
            parts, name = pyarrow.fs.FileSystem.from_uri(file)
            with parts.open_input_stream(name, compression=None) as part:
                while piece := part.read(READ):
                    out.write(piece)
    return path
