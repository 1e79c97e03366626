"""Helpers the operators share: reading tables, bounded slices of Arrow batches, word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18  # of texts whose words are hashed together: some 8-byte arrays of this length are held


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most ``most`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column).cast(pa.large_binary()))  # the batch is not copied for it
        sizes = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [v or b"" for v in batch.column(column).cast(pa.large_binary()).to_pylist()]


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A-Z and nothing else; UTF-8 continuation bytes are never in that range."""
    return data.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []  # powers of the base and of its inverse, kept by each worker


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (_BASE, inverse)]
    return _POWERS


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin and the last ones end.

    A word is a run without ASCII white space. Its hash is a polynomial in its bytes, taken from running
    sums over the joined texts, so that no loop runs over words. Texts are joined in blocks of BLOCK_BYTES, or one text.
    """
    ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
    hashes, at, start = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_BYTES, side="right")) - 1)
        own, own_at = _block_words(texts[start:end])
        hashes.append(own)
        at.append(own_at[1:] + at[-1][-1])
        start = end
    return np.concatenate(hashes), np.concatenate(at)


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edges = np.diff(np.concatenate([[0], (~_SPACE[data]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes, by position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15)) + words[i : i + n]
    return mix(out)


KEY_MASK = np.uint64((1 << 48) - 1)  # keys of recurring_keys


def recurring_keys(df: DataFrame, keys_of, chunk: int = 2_000_000) -> DataFrame:
    """``key``: the 48-bit keys that occur twice or more among all that ``keys_of(batch)`` gives (uint64 arrays).

    Each task sorts its keys in chunks and sends a key once for each chunk, or twice if it recurs there, packed
    as 32-bit rests in 65536 buckets: 4 bytes a key, and a key that a third of all rows have costs no more
    than any other. ``df`` needs a ``text`` column.
    """

    def packed(keys: np.ndarray) -> pa.RecordBatch:
        distinct, n = np.unique(keys, return_counts=True)
        sent = np.repeat(distinct, np.minimum(n, 2))
        buckets, starts = np.unique(sent >> np.uint64(32), return_index=True)
        rests = (sent & np.uint64(0xFFFFFFFF)).astype("<u4")
        offsets = np.append(starts, len(rests)).astype(np.int64) * 4
        if not len(buckets):
            offsets = np.zeros(1, np.int64)
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(buckets), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rests.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), blobs.cast(pa.binary())], ["bucket", "rests"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            held.append(keys_of(part) & KEY_MASK)
            size += len(held[-1])
            if size > chunk:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def twice(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rests = [np.frombuffer(b, "<u4") for _, b in held]
        tops = np.repeat(np.array([t for t, _ in held], np.uint64), [len(r) for r in rests])
        keys, n = np.unique((tops << np.uint64(32)) | np.concatenate(rests).astype(np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].astype(np.int64))], ["key"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0
        for batch in batches:
            for bucket, rests in zip(batch.column("bucket").to_pylist(), batch.column("rests").to_pylist(), strict=True):
                if size > 4 * chunk and held[-1][0] != bucket:
                    yield twice(held)
                    held, size = [], 0
                held.append((bucket, rests))
                size += len(rests)
        if held:
            yield twice(held)

    buckets = df.mapInArrow(pack, "bucket int, rests binary")
    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unpack, "key bigint")
