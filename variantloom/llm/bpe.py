"""Byte-level BPE by two-tier lookup: whole pre-tokens through a minimal perfect hash, the rest by merging.

Tier one is a minimal perfect hash over the vocabulary: a pre-token whose slot holds exactly its own
bytes is one token. Tier two merges the bytes of any other pre-token, kept as a linked list, lowest
rank first from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import mix, read_table, sha256_hex, slices

_STEP = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings: sum of mixed (byte, place) pairs, so that no loop runs per key."""
    if not keys:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(ends - lengths, lengths)
    parts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat * _STEP + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))])
    return mix(parts[ends] - parts[ends - lengths] + lengths.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash over distinct keys: hash and displace, one displacement for each small bucket.

    n keys take the slots 0..n-1; a stranger gets some slot too, so the slot's key must be compared.
    """

    def __init__(self, keys: list[bytes], load: int = 4, state: tuple | None = None):
        if state:
            self.n, self.buckets, self.shift, self.key_at = state
            return
        self.n = max(1, len(keys))
        self.buckets = max(1, len(keys) // load)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key_at = np.full(self.n, -1, np.int64)
        hashes = hash_keys(keys)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("keys are not distinct")
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        members = np.split(order, np.cumsum(np.bincount((hashes % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets))[:-1])
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not len(members[b]):
                break
            tried = 0
            while True:
                tries = np.arange(tried, tried + 256, dtype=np.uint64)
                slots = (mix(hashes[members[b]][None, :] + tries[:, None] * _STEP) % np.uint64(self.n)).astype(np.int64)
                free = (self.key_at[slots] < 0).all(axis=1)
                if len(members[b]) > 1:
                    free &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    first = int(np.argmax(free))
                    self.shift[b] = tries[first]
                    self.key_at[slots[first]] = members[b]
                    break
                tried += 256

    def state(self) -> tuple:
        return self.n, self.buckets, self.shift, self.key_at

    def slots(self, keys: list[bytes]) -> np.ndarray:
        hashes = hash_keys(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[(mix(hashes + shift * _STEP) % np.uint64(self.n)).astype(np.int64)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one pre-token: adjacent parts are joined lowest rank first, leftmost on a tie."""
    n = len(piece)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary; pre-tokens already met are kept up to ``memory`` entries."""

    def __init__(self, tokens: list[bytes], pattern: str, perfect: tuple | None = None, memory: int = 200_000):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.perfect = PerfectHash(tokens, state=perfect)
        self.digits = np.array([str(i) for i in range(len(tokens))], dtype=object)
        self.find = regex.compile(pattern).findall
        self.memory = memory
        self.known: dict[str, tuple[int, ...]] = {}
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        keys = [p.encode() for p in new]
        tokens, known = self.tokens, self.known
        for piece, key, slot in zip(new, keys, self.perfect.slots(keys).tolist(), strict=True):
            known[piece] = (slot,) if slot >= 0 and tokens[slot] == key else tuple(merge_bytes(key, self.ranks))

    def encode(self, text: str) -> np.ndarray:
        pieces = self.find(text)
        if len(self.known) > self.memory:
            self.known.clear()
        self.learn(set(pieces))
        known = self.known
        ids: list[int] = []
        for p in pieces:
            ids += known[p]
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Scatter every token's bytes into one buffer."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[source].tobytes()


def _by_row(df: DataFrame, tokens: list[bytes], pattern: str, key: str, text: str, fields: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """``row(codec, text)`` gives the values of ``fields`` for each text."""
    packed = df.sparkSession.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens).state()))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*packed.value)
        for part in slices(batches, "text"):
            rows = [row(codec, t or "") for t in part.column("text").to_pylist()]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", *fields])

    schema = ", ".join([f"key {df.schema[key].dataType.simpleString()}", *[f"{n} {k}" for n, (k, _) in fields.items()]])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode(df: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the token ids of ``text`` and the bytes that the ids give back.

    One row for each input row, in any order and with repeats kept. A null text counts as empty: no
    ids and no bytes. Null keys stay null; further columns are left out, whatever their names. A
    row's text is held whole in one task; a batch is worked off in slices of a few MB.
    """

    def row(codec: Codec, t: str) -> tuple:
        ids = codec.encode(t)
        return ids, codec.decode(ids)

    return _by_row(df, tokens, pattern, key, text, {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary())}, row)


def digests(df: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`encode`, but ids and bytes become counts and digests within the task that made them."""

    def row(codec: Codec, t: str) -> tuple:
        ids = codec.encode(t)
        return len(ids), sha256_hex(" ".join(codec.digits[ids].tolist()).encode()), sha256_hex(codec.decode(ids))

    fields = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _by_row(df, tokens, pattern, key, text, fields, row)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[list[bytes], str]:
    """Tokens by rank and the split pattern of an installed public tokenizer."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, pattern = public_vocabulary()
    return digests(read_table(spark, sf_dir, "documents"), tokens, pattern)
