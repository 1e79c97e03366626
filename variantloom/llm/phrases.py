"""Substring deduplication with sharded automata of repeated passages.

A passage is a window of WINDOW words. Every window has an anchor: the smallest hash of the k-grams inside
it. Anchors that recur anywhere are found first; the stretches of text whose windows have such an anchor
are sent to the anchor's shard, equal stretches merged. A shard confirms the windows that several
documents have, compiles them into Aho-Corasick automata over words and streams its stretches
through them. The occurrences, with the first document of each passage, go back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from variantloom.llm.common import KEY_MASK, byte_texts, gram_hashes, hashed_words, read_table, recurring_keys, sha256_hex, slices
from variantloom.session import materialize, scratch

WINDOW = 13
GRAM = 5
SHARD_PIECES = 20_000  # stretches of one shard, about
AUTOMATON_PIECES = 8_000  # stretches of one automaton; a larger shard gets several
NO_ID = (1 << 63) - 1  # stands for a null doc_id: after all others


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: of every window, by its start, the anchor's place and 48-bit key."""
    hashes, at = hashed_words(texts)
    grams = gram_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    n = max(0, len(grams) - width + 1)
    least = grams[:n].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + n], out=least)
    places = np.zeros(n, np.int64)
    for i in reversed(range(width)):  # the leftmost of equal ones stays
        places[grams[i : i + n] == least] = i
    places += np.arange(n)
    out = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        last = max(start, end - WINDOW + 1)
        out.append((places[start:last] - start, least[start:last] & KEY_MASK))
    return out


def _distinct(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor places and their keys; places never go back from one window to the next."""
    first = np.append(True, places[1:] != places[:-1]) if len(places) else np.zeros(0, bool)
    return places[first], keys[first]


def recurring_places(docs: DataFrame) -> DataFrame:
    """``doc, places``: where each document has anchors that occur twice or more in the corpus.

    A doc_id that several rows have gets the places of all of them; places without an anchor do no harm.
    """

    def keys_of(part: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[np.unique(_distinct(*found)[1]) for found in anchors(byte_texts(part))]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [_distinct(*x) for x in anchors(byte_texts(part))]
            places = np.concatenate([p for p, _ in found]).astype(np.int32)
            keys = np.concatenate([k for _, k in found]).astype(np.int64)
            docs_of = np.repeat(part.column("doc").to_numpy(), [len(p) for p, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs_of), pa.array(places)], ["key", "doc", "place"])

    recurring = materialize(recurring_keys(docs.select("text"), keys_of), "recurring-anchors")
    found = docs.select("doc", "text").mapInArrow(rows, "key bigint, doc bigint, place int").join(recurring, "key", "left_semi")
    return found.groupBy("doc").agg(F.collect_set("place").alias("places"))


def stretches(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc, text_hash, key, start, piece``: for each recurring anchor the words of all windows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [])
            texts = byte_texts(part)
            for i, (text, (at, keys), chosen) in enumerate(zip(texts, anchors(texts), part.column("places").to_pylist(), strict=True)):
                words = text.split()
                begins = np.flatnonzero(np.append(True, np.diff(at) > 0)) if len(at) else np.zeros(0, np.int64)
                ends = np.append(begins[1:], len(at))
                wanted = np.isin(at[begins], np.array(chosen))
                for b, e in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
                    out[0].append(i)
                    out[1].append(int(keys[b]))
                    out[2].append(b)
                    out[3].append(b" ".join(words[b : e - 1 + WINDOW]))
            if out[0]:
                rows = pa.array(out[0])
                own = [part.column(c).take(rows) for c in ("doc", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc", "text_hash", "key", "start", "piece"])

    joined = docs.join(places, "doc").select("doc", "text_hash", "text", "places")
    return joined.mapInArrow(run, "doc bigint, text_hash bigint, key bigint, start int, piece string")


def coded(pieces: list[str]) -> tuple[list[str], int]:
    """Each piece as a string of word codes, and their width: every word has a code of ``width`` characters of its own."""
    lines = [p.split(" ") for p in pieces]
    known = {w for words in lines for w in words}
    width = max(1, (len(known).bit_length() + 7) // 8)
    codes = {w: n.to_bytes(width, "little").decode("latin-1") for n, w in enumerate(known, 1)}
    return ["".join(map(codes.__getitem__, words)) for words in lines], width


def passages(pieces: list[str], firsts: list[int], lasts: list[int], width: int) -> dict[str, int]:
    """What one shard confirms: passages that two documents or more have, with the first of them; pieces are word codes.

    A stretch that alone has its anchor is one passage, if several documents have it. Among several
    stretches every window is looked at.
    """
    if len(pieces) == 1:
        return {pieces[0]: firsts[0]} if lasts[0] != firsts[0] else {}
    first: dict[str, int] = {}
    shared: set[str] = set()
    for line, low, high in zip(pieces, firsts, lasts, strict=True):
        for i in range(0, len(line) - WINDOW * width + 1, width):
            window = line[i : i + WINDOW * width]
            before = first.setdefault(window, low)
            if before != low or high != low:
                shared.add(window)
                first[window] = min(before, low)
    return {window: first[window] for window in shared}


def occurrences(pieces: list[str], confirmed: dict[str, int], width: int) -> list[list[tuple[int, int]]]:
    """Per piece: (place, first document) of every window of a confirmed passage.

    The passages become one automaton, which reads each piece once. A word is a code of fixed width, so a
    match counts only where it ends with a word.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if not confirmed:
        return found
    automaton = ahocorasick.Automaton()
    for passage, first in confirmed.items():
        automaton.add_word(passage, (len(passage) // width, first))
    automaton.make_automaton()
    for line, out in zip(pieces, found, strict=True):
        for end, (length, first) in automaton.iter(line):
            if (end + 1) % width == 0:
                start = (end + 1) // width - length
                out.extend((start + i, first) for i in range(length - WINDOW + 1))
    return found


def locate(parts: DataFrame) -> DataFrame:
    """``piece_id, hits`` of pieces with confirmed passages, from ``shard, piece_id, offset, piece, low, high``.

    ``hits`` has the offset and the first document of each window. A piece comes once, so its hits are whole. The rows of a
    shard follow each other; an automaton takes whole anchors, some thousand pieces at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            pieces, width = coded([r[3] for r in held])
            confirmed: dict[str, int] = {}
            for _, group in groupby(range(len(held)), key=lambda i: held[i][0]):
                rows = list(group)
                for passage, first in passages([pieces[i] for i in rows], [held[i][4] for i in rows], [held[i][5] for i in rows], width).items():
                    confirmed[passage] = min(first, confirmed.get(passage, first))
            hits = occurrences(pieces, confirmed, width)
            some = [(row, own) for row, own in zip(held, hits, strict=True) if own]
            ends = np.cumsum([0, *[len(own) for _, own in some]]).astype(np.int32)
            windows = [pa.array([row[2] + place for row, own in some for place, _ in own], pa.int32()), pa.array([first for _, own in some for _, first in own], pa.int64())]
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(windows, ["offset", "first_doc"]))
            return pa.RecordBatch.from_arrays([pa.array([row[1] for row, _ in some], pa.int64()), lists], ["piece_id", "hits"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("shard", "piece_id", "offset", "piece", "low", "high")], strict=True):
                if len(held) >= AUTOMATON_PIECES and held[-1][0] != row[0]:
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    dealt = parts.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "piece_id bigint, hits array<struct<offset:int,first_doc:bigint>>")


def crowded_hits(merged: DataFrame) -> DataFrame:
    """``piece_id, hits`` as ``locate`` gives them, for anchors with very many different stretches.

    Stretches are split into windows, and the rows of a window are merged before they move, so no task holds the
    stretches that share one. The join back to them is left to adaptive execution, which splits a window that many have.
    """
    split = F.split("piece", " ")
    window = lambda i: F.array_join(F.slice(split, i + 1, WINDOW), " ")
    cut = F.transform(F.sequence(F.lit(0), F.size(split) - WINDOW), lambda i: F.struct(i.cast("int").alias("offset"), window(i).alias("part")))
    single = merged.select("piece_id", "low", "high", F.inline(cut))
    shared = single.groupBy("part").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc")).where("first_doc < last_doc")
    shared = materialize(shared.select("part", "first_doc"), "crowded-windows")
    hits = F.collect_set(F.struct("offset", "first_doc")).alias("hits")
    return single.join(shared, "part").groupBy("piece_id").agg(hits)


def removable(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, starts``: starts of windows that some document with a smaller doc_id has too.

    Tables are deleted as soon as what is made from them is stored; the result reads the stretches and the passages.
    """
    with scratch(docs.sparkSession) as made:
        pieces = materialize(stretches(docs, materialize(recurring_places(docs), "anchor-places")).withColumn("piece_id", F.xxhash64("key", "piece")), "stretches")
        made.pop()
    with scratch(docs.sparkSession) as made:
        found = materialize(_hits(pieces), "passages")
        made.pop()
    back = pieces.select("doc", "text_hash", "start", "piece_id").join(found, "piece_id")
    earlier = F.filter("hits", lambda h: h["first_doc"] < F.col("doc"))
    starts = F.transform(earlier, lambda h: F.col("start") + h["offset"])
    each = back.select("doc", "text_hash", starts.alias("starts")).where(F.size("starts") > 0)
    return each.groupBy("doc", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _hits(pieces: DataFrame) -> DataFrame:
    """``piece_id, hits`` of the distinct stretches with confirmed passages."""
    merged = pieces.groupBy("piece_id").agg(F.first("key").alias("key"), F.first("piece").alias("piece"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    merged = materialize(merged, "distinct-stretches")
    many = merged.groupBy("key").count().where(F.col("count") > SHARD_PIECES).select("key", F.lit(True).alias("crowded"))
    many = materialize(many, "crowded-anchors")  # few or none: its real size decides how it is joined
    marked = merged.join(many, "key", "left")
    whole = marked.where("crowded IS NULL").select(F.col("key").alias("shard"), "piece_id", F.lit(0).alias("offset"), "piece", "low", "high")
    return locate(whole).unionByName(crowded_hits(marked.where("crowded")))


def _identified(docs: DataFrame) -> tuple[DataFrame, DataType]:
    kind = docs.schema["doc_id"].dataType
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text"), kind


def _kept(words: list[bytes], starts: list[int]) -> list[bytes]:
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.array(starts, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return [w for w, covered in zip(words, np.cumsum(marks).tolist()) if not covered]


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_removed, kept`` (kept words joined by a space).

    A word goes when a window that covers it also starts in a document with a smaller doc_id. Null and
    empty texts have no words. Rows with a null doc_id come after all others and are no one's smaller
    document; rows with equal doc_id and text have equal results. An empty table gives no rows.
    Other columns are left out.
    """
    return _outputs(docs, lambda words: b" ".join(words).decode(), "kept string")


def _outputs(docs: DataFrame, value, column: str) -> DataFrame:
    own, kind = _identified(docs)
    with scratch(docs.sparkSession) as made:
        starts = materialize(removable(own.drop("doc_id")), "removable").withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
        made.pop()
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, removed, values = [], [], []
            for text, at in zip(byte_texts(part), part.column("starts").to_pylist(), strict=True):
                words = text.split()
                left = _kept(words, at) if at else words
                n.append(len(words))
                removed.append(len(words) - len(left))
                values.append(value(left))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(values, pa.string())], ["doc_id", "n_words", "n_removed", name])

    joined = own.join(starts, (F.col("doc") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words bigint, n_removed bigint, {column}")


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _outputs(docs, lambda words: sha256_hex(b" ".join(words)), "kept_sha256 string")
