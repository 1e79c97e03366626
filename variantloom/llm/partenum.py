"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles. Sets are joined in bands of about equal size: each band ends at 8/5 of the one
before, so partners lie in the same or in neighbouring bands, and a set takes part in its own band and, if a partner may
lie there, in the next. In a band of sets up to t elements, linked sets differ in at most k = 2t/7 elements. The domain of
shingles is cut into more than k/2 parts, so in one part at least linked sets differ in at most one element; each part is cut
into three cells, and every subset of two of them is one signature: what the set has in both. Sets that differ in one element of
a part share the signature without that element's cell. So linked sets share a signature.

A subset of empty cells, or of nothing but frequent shingles, says little, and very many sets would share it. A signature is as weak as
its rarest shingle is frequent. A set leaves out its weakest ones, from fewer of its parts than must agree with any partner: of
two linked sets, the one that leaves out more has an agreeing part without such a signature, and the other keeps that too. For
that there are a few more parts than needed.

Sets of a small group with one signature are all compared. In a large group each set is compared with one pivot at a time, which
joins copies of one text in a few rounds. Of sets that stay apart only those shingles count that another component has too: a set
with too few of them has no link left to find. The others are grouped again, by the shingles that they must share if they are
linked, the rarest first, so that a common template brings nobody together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from variantloom.llm.common import ascii_lower, byte_texts, gram_hashes, hashed_words, mix, read_table, slices
from variantloom.session import arrow_rows, materialize

SHINGLE = 5
FIRST_TOP = 8  # largest set of the first band
CELLS = 3  # of a part; a signature leaves out one
SPARE = 0.06  # parts beyond those needed, as a share
BATCH_ROWS = 1000  # that the JVM hands to Python at once
CHUNK = 1_000_000  # signatures that a task sorts together
CROWD = 256  # sets of one signature in a chunk from which they travel apart from the others
SMALL = 12  # sets of a group that are all compared
PIVOTS = 1  # rounds that compare with one member of each group
TILE = 256  # sets of a group that are compared with as many in one place
HOT_SHARE = 5e-7  # share of the shingles from which one's number is known to all: at most 2e6 of them
HOT_TIMES = 4  # and it occurs so often at least
NEVER = np.iinfo(np.int64).max  # how frequent no shingle is: of empty cells
CELL_WIDTH = math.log(1.08)  # of sizes, where shared shingles are asked for


def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words than a shingle's are one together."""
    hashes, at = hashed_words([ascii_lower(t) for t in byte_texts(batch)])
    grams = gram_hashes(hashes, SHINGLE)
    sets = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = end - start
        sets.append(np.unique(grams[start : end - SHINGLE + 1]) if n >= SHINGLE else gram_hashes(hashes[start:end], n) if n else hashes[:0])
    return sets


def class_of(elements: np.ndarray) -> int:
    """Equal sets, and only they, have one class."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(common, a, b):
    """The link rule: 100 * intersection >= 75 * union, in whole numbers."""
    return 100 * common >= 75 * (a + b - common)


# --- signatures


def band_of(n: int) -> tuple[int, int]:
    """Number and top of the band of sets with ``n`` elements."""
    band, top = 0, FIRST_TOP
    while n > top:
        band, top = band + 1, next_top(top)
    return band, top


def next_top(top: int) -> int:
    return 8 * top // 5 + 1


@cache
def parts_of(top: int) -> int:
    """Parts of a band: sets of at most ``top`` elements that are linked differ in at most 2 * top / 7."""
    needed = 2 * top // 7 // 2 + 1
    return needed + math.ceil(SPARE * needed)


def band_signatures(elements: np.ndarray, often: np.ndarray, band: int, top: int) -> np.ndarray:
    """The signatures of a set in one band; elements are sorted, and cells are ranges of them. ``often``: how frequent each is."""
    parts, n = parts_of(top), len(elements)
    cell = ((elements >> np.uint64(32)) * np.uint64(parts * CELLS)) >> np.uint64(32)
    edges = np.searchsorted(cell, np.arange(parts * CELLS + 1, dtype=np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(elements), out=sums[1:])
    held = (sums[edges[1:]] - sums[edges[:-1]]).reshape(parts, CELLS)
    found = held.sum(axis=1, keepdims=True, dtype=np.uint64) - held
    names = np.arange(parts * CELLS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(band) * np.uint64(0xE7037ED1A0B428DB)
    keys = mix(found.reshape(-1) + mix(names))
    rarest = np.minimum.reduceat(np.append(often, NEVER), edges[:-1])
    rarest[edges[1:] == edges[:-1]] = NEVER
    rarest = rarest.reshape(parts, CELLS)
    weak = np.stack([np.delete(rarest, i, axis=1).min(axis=1) for i in range(CELLS)], axis=1)
    # parts that agree with any partner of this band in all but one element; fewer parts lose signatures
    agree = parts - (n + min(4 * n // 3, top)) // 7 // 2
    most = np.partition(weak.max(axis=1), parts - agree)[parts - agree]
    return keys[weak.reshape(-1) <= most]


def frequency(elements: np.ndarray, hot: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each element occurs, by a sorted list of frequent ones; 0 for the others."""
    if not len(hot):
        return np.zeros(len(elements), np.int64)
    place = np.minimum(np.searchsorted(hot, elements), len(hot) - 1)
    return np.where(hot[place] == elements, times[place], 0).astype(np.int64)


NOTHING = np.zeros(0, np.uint64)


def signatures(elements: np.ndarray, hot: np.ndarray = NOTHING, times: np.ndarray = NOTHING) -> np.ndarray:
    """Signatures of a set in its own band, and in the next one if a partner may lie there; ``hot``, ``times``: frequent shingles."""
    n = len(elements)
    if not n:
        return elements
    band, top = band_of(n)
    often = frequency(elements, hot, times)
    found = band_signatures(elements, often, band, top)
    if 4 * n // 3 > top:
        found = np.concatenate([found, band_signatures(elements, often, band + 1, next_top(top))])
    return np.unique(found)


def parity(elements: np.ndarray) -> bytes:
    """Bits that tell of how many elements each has, odd or even; a power of two, about two bits an element.

    Bits that differ between two sets are no more than the elements that do. A longer one is folded to a shorter one's length.
    """
    bits = 1 << max(9, min(20, int(2 * len(elements) - 1).bit_length()))
    return np.packbits((np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ, from their parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    return int(_ONES[folded(a, width) ^ folded(b, width)].sum())


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The parity of a set in ``width`` bytes: bits that fall together are added."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


# --- groups of sets with one signature


def _map(docs: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(batch, sets)`` over slices of ``docs``, which has a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield from rows(part, sets_of(part))

    return docs.mapInArrow(run, schema)


def set_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, class, n, parity`` of each row, class null for an empty set; and ``shingle, times`` of frequent shingles.

    Shingles are counted where they occur HOT_TIMES times or more in a task's chunk, so times may be too small.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "class", "n", "parity", "times"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.sort(np.concatenate(held))
        found, times = np.unique(both[HOT_TIMES - 1 :][both[HOT_TIMES - 1 :] == both[: 1 - HOT_TIMES]], return_counts=True)
        times += HOT_TIMES - 1
        nulls = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(found), key), nulls[0], pa.array(found.view(np.int64)), nulls[1], nulls[2], pa.array(times)], names)

    key = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            sets = sets_of(part)
            classes = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            parities = pa.array([parity(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), classes, pa.array([len(s) for s in sets], pa.int64()), parities, pa.nulls(len(sets), pa.int64())], names)
            held.extend(sets)
            size += sum(map(len, sets))
            if size > CHUNK // 4:  # beside what the worker holds anyway
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    stored = materialize(own.mapInArrow(run, f"doc_id {kind}, text_hash bigint, class bigint, n bigint, parity binary, times bigint"), "set-classes")
    return stored.where("times IS NULL").drop("times"), stored.where("times IS NOT NULL").select(F.col("class").alias("shingle"), "times")


PACKED = "bucket int, salt int, keys binary, classes binary"
APART = (1 << 32) - 1  # in place of a class: this key's sets travel apart


def taken(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The pieces of each array together; ``held`` is emptied, so that they are not in memory twice while those are worked on."""
    whole = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()
    return whole


def packed(keys: np.ndarray, classes: np.ndarray, bits: int, salt: int) -> pa.RecordBatch:
    """Distinct pairs of key and class (by its low 32 bits) as one row for each bucket of keys.

    Sets of a crowded key go to a row of their own (bucket -1), salted, so that no task gets them all; a mark
    stays in the key's bucket.
    """
    classes = classes & APART
    classes[classes == APART] -= 1
    keys, classes = distinct_pairs(keys, classes)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    crowded = np.diff(np.append(starts, len(keys))) > CROWD
    away = np.repeat(crowded, np.diff(np.append(starts, len(keys))))
    rows = []
    if away.any():
        rows.append((-1, salt, keys[away].tobytes(), classes[away].astype("<u4").tobytes()))
        keys = np.append(keys[~away], keys[starts[crowded]])
        classes = np.append(classes[~away], np.full(int(crowded.sum()), APART))
        order = np.argsort(keys, kind="stable")
        keys, classes = keys[order], classes[order]
        del order, away
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int32)
    edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rest = (keys[a:b] >> np.uint64(32 - bits)).astype("<u4")
        rows.append((int(buckets[a]), 0, rest.tobytes(), classes[a:b].astype("<u4").tobytes()))
    del keys, classes, buckets
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "salt", "keys", "classes"])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of an entry of ``a`` and one of ``b``, by ``a``, then ``b``."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    del order
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


def pairs_within(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of ``classes`` within groups of up to SMALL, each pair once; repeated ones go before they pile up."""
    first, second = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size_held = [], 0
    for size in range(2, SMALL + 1):
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                held.append((classes[at + i], classes[at + j]))
                size_held += len(at)
                if size_held > CHUNK:
                    first, second = distinct_pairs(*taken([(first, second), *held]))
                    held, size_held = [], 0
    return distinct_pairs(*taken([(first, second), *held]))


def grouped(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From packed rows in bucket order: pairs ``a, b`` of small groups (key null), and ``key, a`` of large ones (b null)."""

    def pairs_and_members(keys: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        keys, classes = distinct_pairs(keys, classes)
        marked = np.unique(keys[classes == APART])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        large = (sizes > SMALL) | np.isin(keys[starts], marked)
        of = np.repeat(large, sizes) & (classes != APART)
        members, member_keys = classes[of], keys[of].astype(np.int64)
        del keys, of
        first, second = pairs_within(classes, starts[~large], sizes[~large])
        paired = np.arange(len(first) + len(members)) < len(first)
        key = pa.array(np.append(np.zeros(len(first), np.int64), member_keys), mask=paired)
        b = pa.array(np.append(second, np.zeros(len(members), np.int64)), mask=~paired)
        return pa.RecordBatch.from_arrays([key, pa.array(np.append(first, members)), b], ["key", "a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, last = 0, None
    for batch in batches:
        for bucket, keys, classes in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("classes"), strict=True):
            keys, own = keys.as_buffer(), np.frombuffer(classes.as_buffer(), "<u4").astype(np.int64)
            if bucket < 0:
                whole = np.frombuffer(keys, np.uint64) >> np.uint64(32 - bits)
                nothing = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(whole.astype(np.int64)), pa.array(own), nothing], ["key", "a", "b"])
                continue
            if size > CHUNK and bucket != last:
                yield pairs_and_members(*taken(held))
                size = 0
            held.append(((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(keys, "<u4").astype(np.uint64), own))
            size, last = size + len(own), bucket
    if held:
        yield pairs_and_members(*taken(held))


def candidates(source: DataFrame, keys_of, total: int, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` from small groups and ``key, class`` of large ones, among the ``classes`` that share one of the keys of ``keys_of(batch)``.

    ``keys_of`` gives keys and classes as arrays, piece by piece; ``total`` is about how many there are. A key and the low half of a
    class move once, packed. Different classes with one low half are all taken, so there may be more candidates, never fewer.
    """
    bits = min(24, max(6, math.ceil(math.log2(max(1, total) / 30_000 + 1))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = [], 0, TaskContext.get().partitionId() * 64  # the same when the task is run again
        for batch in batches:
            for piece in keys_of(batch):
                held.append(piece)
                size += len(piece[0])
                if size > CHUNK:
                    yield packed(*taken(held), bits, salt)
                    size, salt = 0, salt + 1
        if size:
            yield packed(*taken(held), bits, salt)

    moved = source.mapInArrow(pack, PACKED).repartition("bucket", "salt").sortWithinPartitions("bucket")
    found = materialize(moved.mapInArrow(lambda batches: grouped(batches, bits), "key bigint, a bigint, b bigint"), "signature-groups")
    halves = classes.select("class", low_half(F.col("class")).alias("half"))
    pairs, members = found.where("key IS NULL"), found.where("key IS NOT NULL").select("key", "a")
    for side in ("a", "b"):
        pairs = pairs.join(halves.withColumnsRenamed({"class": f"class_{side}", "half": side}), side)
    pairs = pairs.where("class_a <> class_b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    return pairs, members.join(halves, members["a"] == halves["half"]).select("key", "class")


def low_half(c: Column) -> Column:
    """The low 32 bits of a class; all ones stand for something else, so they become all ones but the last."""
    half = c.bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(half == APART, APART - 1).otherwise(half)


def signature_groups(docs: DataFrame, total: int, classes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and large groups by PartEnum signatures of the texts; ``counts`` has ``shingle, times`` of frequent ones."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(counts, total))

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices(iter([batch]), "text"):
            for name, s in {class_of(s): s for s in sets_of(part) if len(s)}.items():
                keys = signatures(s, *sent.value)
                yield keys, np.full(len(keys), name, np.int64)

    return candidates(docs.select("text"), keys_of, total, classes)


# --- comparing


def fetched_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, n, elements`` of the wanted classes, by reading their texts.

    One document of each class is read. The list of doc_ids is stored, so that its real size decides how
    it is joined. A class comes once.
    """
    first = classes.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("_id"))
    ids = materialize(first.select("_id").distinct(), "candidate-ids")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def rows(part: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = {class_of(s): s for s in sets if len(s)}
        columns = [pa.array(list(own), pa.int64()), pa.array([len(s) for s in own.values()], pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["class", "n", "elements"])

    found = _map(texts, rows, "class bigint, n bigint, elements binary").join(wanted, "class", "left_semi")  # not of other rows with these ids
    return materialize(found.dropDuplicates(["class"]), "candidate-sets")


def near(n: int, m: int, x, y) -> bool:
    """Whether sizes and parities let two sets be linked."""
    return 4 * n >= 3 * m and 4 * m >= 3 * n and 7 * apart_at_least(x, y) <= n + m


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"v_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "v_a", "v_b")


def _kept(pairs: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b")), batch.column("v_a"), batch.column("v_b"), strict=True)
            ok = pa.array([test(n, m, x.as_buffer(), y.as_buffer()) for n, m, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def near_pairs(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and parities let them be linked; ``shapes`` has ``class, n, parity``."""
    return _kept(_with_both(pairs.distinct(), shapes, "parity"), near)


def verified(close: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, of some that are near; only their texts are read."""
    close = materialize(close.distinct(), "close-pairs")
    sets = fetched_sets(docs, classes, close.select(F.explode(F.array("a", "b")).alias("class")).distinct())

    def equal(n: int, m: int, x, y) -> bool:
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort(kind="stable")
        return bool(linked(int((both[1:] == both[:-1]).sum()), n, m))

    return _kept(_with_both(close, sets, "elements"), equal)


def merged_groups(members: DataFrame) -> DataFrame:
    """``merged, key, class, root, minor`` from groups of ``key, class, root``: each pair of sets of one group, of different roots, meets in some group.

    The sets of all groups with one largest component become one group (``merged``; its key is that root) if minors times sets is no more there than in them together.
    """
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.mode("root", True).alias("main"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("mix"))
    once = sized.groupBy("size", "sum", "mix").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*", "size")
    rows = materialize(members.join(once, "key").withColumn("minor", F.col("root") != F.col("main")), "main-groups")
    apart = rows.where("minor").groupBy("main").agg(F.sum("size").alias("apart"))  # a minor meets all sets of its group
    sets = rows.select("main", "class", "minor").distinct().groupBy("main").agg(F.count(F.lit(1)).alias("sets"), F.count(F.when(F.col("minor"), 1)).alias("minors"))
    merge = materialize(sets.join(apart, "main").select("main", (F.col("sets") * F.col("minors") <= F.col("apart")).alias("merged")), "merged-mains")
    return rows.join(merge, "main").select("merged", F.when(F.col("merged"), F.col("main")).otherwise(F.col("key")).alias("key"), "class", "root", "minor").distinct()


def compared_in_tiles(members: DataFrame, shapes: DataFrame) -> DataFrame:
    """``a, b``: the near pairs of different components within each group of ``key, class, root``; ``shapes`` has ``most``, too.

    Two sets of different components are not both in the largest one of their group, so only the others (its minors) are compared, with all. Groups
    with the same sets are one, and so are those with the same largest component, where that makes fewer comparisons: shingles of one text
    group much the same sets over and over. A group is cut into tiles of TILE minors by TILE sets, which are compared in place: no task holds
    more, and only near pairs come out. ``most`` of a set's elements can be in a partner.
    """
    rows = materialize(merged_groups(members), "tile-groups")
    blocks = lambda n: F.ceil(F.count(n) / TILE).cast("int")
    of = materialize(rows.groupBy("merged", "key").agg(blocks(F.lit(1)).alias("blocks"), blocks(F.when(F.col("minor"), 1)).alias("minor_blocks")).where("minor_blocks > 0"), "tile-counts")
    rows = materialize(rows.join(of, ["merged", "key"]).join(shapes, "class"), "tile-rows")
    block = lambda blocks: F.pmod(F.xxhash64("class", "key"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    right = rows.select("merged", "key", each("minor_blocks").alias("low"), block("blocks").alias("high"), F.lit(1).alias("side"), "class", "root", "n", "most", "parity")
    left = rows.where("minor").select("merged", "key", block("minor_blocks").alias("low"), each("blocks").alias("high"), F.lit(0).alias("side"), "class", "root", "n", "most", "parity")

    def compare(held: list[tuple]) -> pa.RecordBatch:
        side, name, root, n, most = (np.array([r[i] for r in held], np.int64) for i in (4, 5, 6, 7, 8))
        width = min(len(r[9]) for r in held)
        bits = np.stack([folded(np.frombuffer(r[9], np.uint8), width) for r in held])
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        right = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            js = right[(root[i] != root[right]) & (7 * np.minimum(most[i], most[right]) >= 3 * (n[i] + n[right]))]
            js = js[7 * _ONES[bits[i] ^ bits[js]].sum(axis=1, dtype=np.int64) <= n[i] + n[js]]
            first.append(np.minimum(name[i], name[js]))
            second.append(np.maximum(name[i], name[js]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("merged", "key", "low", "high", "side", "class", "root", "n", "most", "parity")), strict=True):
                if held and row[:4] != held[0][:4]:
                    yield compare(held)
                    held = []
                held.append(row)
        if held:
            yield compare(held)

    tile = ["merged", "key", "low", "high"]
    sorted_tiles = left.unionByName(right).repartition(*tile).sortWithinPartitions(*tile)
    return sorted_tiles.mapInArrow(run, "a bigint, b bigint").distinct()


def with_partners(members: DataFrame, shapes: DataFrame) -> DataFrame:
    """``members`` (``key, class``) without the sets for which all sets of their group are too large; ``shapes`` has ``class, n, most``."""
    sized = members.join(shapes.select("class", "n", "most"), "class")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    return sized.join(least, "key").where(7 * F.col("most") >= 3 * (F.col("n") + F.col("least"))).select("key", "class")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``a, b`` reaches, by rounds of stored label tables.

    In a round every node takes the smallest label among its neighbours' and then that label's own, so a
    long chain needs few rounds and a star one.
    """
    both = materialize(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        new = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("further"))
        new = materialize(new.join(jump, "low").select("node", F.least("low", "further").alias("root"), (F.least("low", "further") < F.col("root")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def marked_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, class, root`` of the large groups whose sets are not yet all in one component, stored."""
    marked = members.join(roots.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_keys = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return materialize(marked.join(open_keys, "key", "left_semi").select("key", "class", "root"), "open-groups")


def pivot_pairs(groups: DataFrame, turn: int) -> DataFrame:
    """``a, b``: each set with one pivot of its groups that is in another component.

    The pivot of a group is the set that is in the most groups, later any by hash: the text that others were copied from shares most.
    """
    if turn == 0:
        order = groups.groupBy("class").agg((-F.count(F.lit(1))).cast("bigint").alias("order"))
        groups = groups.join(order, "class")
    else:
        groups = groups.withColumn("order", F.xxhash64("class", F.lit(turn)))
    pivots = groups.groupBy("key").agg(F.min(F.struct("order", "class", "root")).alias("p"))
    met = groups.join(pivots, "key").where(F.col("root") != F.col("p.root"))
    chosen = met.groupBy("class").agg(F.min(F.struct("p.order", "p.class")).alias("p"))
    return chosen.select(F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b"))


def frequent_shingles(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent ones of the shingles, sorted, and how often each occurs: at most 1 / HOT_SHARE of them."""
    rows = counts.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= max(HOT_TIMES, HOT_SHARE * total)).collect()
    found = np.array([(r["shingle"], r["times"]) for r in rows], np.int64).reshape(-1, 2)
    order = np.argsort(found[:, 0].view(np.uint64))
    return found[order, 0].view(np.uint64), found[order, 1]


def size_cell(n: int) -> int:
    return int(math.log(n) / CELL_WIDTH)


def shared_keys(elements: np.ndarray, hot: np.ndarray, times: np.ndarray, n: int | None = None) -> np.ndarray:
    """Keys of which linked sets have one in common: for each pair of size cells, the shingles of which partners must share one.

    ``elements`` are those of a set of ``n`` (by default all of them) that a partner can have. Sets of sizes a and b that are linked share
    o = 3 * (a + b) / 7 or more, so among the first ones of each, all but o - 1, in an order that is the same for all, there is one in common.
    Rare shingles are first, frequent ones by their number.
    """
    n = len(elements) if n is None else n
    ordered = elements[np.lexsort((elements, frequency(elements, hot, times)))]
    own, out = size_cell(n), [NOTHING]
    for cell in range(size_cell(max(1, math.ceil(3 * n / 4))), size_cell(4 * n // 3) + 1):
        least = max(math.ceil(3 * n / 4), math.ceil(math.exp(cell * CELL_WIDTH) - 1e-6))
        first = len(elements) - math.ceil(3 * (n + least) / 7) + 1
        if first > 0:
            name = np.array([min(own, cell) * 65536 + max(own, cell)], np.uint64)
            out.append(mix(ordered[:first] + mix(name * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))))
    return np.concatenate(out)


def shared_elements(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``class, n, shared``: of each set the elements that sets of other components have too, with the number of sets that have them.

    A link between components lies within these elements on both sides, so a set with fewer than three quarters of its own is left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "elements"):
            sizes = part.column("n").to_numpy()
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            elements = np.frombuffer(b"".join(part.column("elements").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(of) for c in ("class", "n", "root")], pa.array(elements)], ["class", "n", "root", "element"])

    rooted = sets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "n", F.coalesce("root", "class").alias("root"), "elements")
    each = materialize(rooted.mapInArrow(rows, "class bigint, n bigint, root bigint, element bigint"), "apart-elements")
    spread = each.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("times")).where("low < high")
    own = each.join(spread.select("element", "times"), "element").groupBy("class", "n").agg(F.collect_list(F.struct("element", "times")).alias("shared"))
    return materialize(own.where(4 * F.size("shared") >= 3 * F.col("n")), "shared-elements")


def shared_groups(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and large groups of sets that share a shingle which linked sets of their sizes must share."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for name, n, own in zip(batch.column("class").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), strict=True):
            elements, times = (own.values.field(f).to_numpy() for f in ("element", "times"))
            order = np.argsort(elements.view(np.uint64))
            elements, times = elements.view(np.uint64)[order], times[order]
            keys = shared_keys(elements, elements, times, n)
            yield keys, np.full(len(keys), name, np.int64)

    return candidates(shared, keys_of, shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], shared.select("class"))


def link_classes(docs: DataFrame, classes: DataFrame, counts: DataFrame) -> DataFrame:
    """``node, root`` of the linked classes, from what ``set_classes`` gives.

    Small groups are compared pair by pair. In large ones every set meets a pivot. Sets that this leaves apart are grouped by shingles that they
    must share and that other components have; what is still a large group then is compared in tiles. Sizes and parities come first everywhere, so that few sets move. No link is lost.
    """
    spark = docs.sparkSession
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shapes = materialize(classes.where("class IS NOT NULL").select("class", "n", "parity").dropDuplicates(["class"]), "shapes")
    pairs, members = signature_groups(docs, total, shapes, counts)
    links = spark.createDataFrame([], "a bigint, b bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")

    def add(found: DataFrame) -> None:
        nonlocal links, roots
        links = materialize(links.unionByName(verified(found, docs, classes)), "links")
        roots = components(links)

    for turn in range(PIVOTS):
        members = marked_groups(members.select("key", "class"), roots)
        found = pivot_pairs(members, turn)
        add(near_pairs(found.unionByName(pairs) if turn == 0 else found, shapes))
    members = marked_groups(members.select("key", "class"), roots)
    if not members.limit(1).count():
        return roots
    apart = fetched_sets(docs, classes, materialize(members.select("class").distinct(), "apart-classes"))
    shared = shared_elements(apart, roots)
    pairs, members = shared_groups(shared)
    rooted = roots.withColumnsRenamed({"node": "class"})
    for side in ("a", "b"):
        pairs = pairs.join(rooted.withColumnsRenamed({"class": side, "root": f"r_{side}"}), side, "left")
    found = near_pairs(pairs.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b"), shapes)
    shapes = materialize(shapes.join(shared.select("class", F.size("shared").alias("most")), "class"), "shared-shapes")
    members = marked_groups(with_partners(members, shapes), roots)
    add(found.unionByName(compared_in_tiles(members, shapes)))
    return roots


def join_similar(docs: DataFrame) -> DataFrame:
    """One row for each input row: ``doc_id, text_hash, n_shingles, component_id, first``.

    component_id is the smallest doc_id that links reach, the row's own included; rows with equal sets
    are linked. ``first`` marks the row that stands for its component: smallest doc_id, then smallest
    text_hash. Null and empty texts, and texts without words, have no set and stand alone. A null doc_id is
    never the smallest, unless a component has no other; then the smallest text_hash stands for it. Rows repeated in the input are repeated in the
    result. An empty table gives no rows; other columns are left out.
    """
    own = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        classes, counts = set_classes(own)
        roots = link_classes(own, classes, counts)
    own_place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")  # null ids after all others
    least = F.min(own_place)
    firsts = classes.where("class IS NOT NULL").groupBy("class").agg(least.alias("least"))
    rooted = firsts.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    out = classes.join(rooted.join(smallest, "root").select("class", "component"), "class", "left")
    own_id = F.col("component.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("component.text_hash") == F.col("text_hash"))
    first = F.col("component").isNull() | own_id
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component.doc_id", "doc_id").alias("component_id"), F.coalesce(first, F.lit(False)).alias("first"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that do not stand for their component; of equal rows one stays."""
    found = join_similar(docs)
    found = materialize(found.groupBy("doc_id", "text_hash").agg(F.max("first").alias("first"), F.count("*").alias("rows"), F.max("n_shingles").alias("n")), "similar")
    dropped = found.where("NOT first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    repeated = found.where("first AND rows > 1 AND n > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(dropped, same, "left_anti")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
