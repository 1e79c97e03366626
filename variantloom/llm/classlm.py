"""Language-model scores from a class-based bigram model with exchange clustering.

p(word | previous) = p(class | previous class) * p(word | class). Words get their classes by exchange
clustering: rounds in which each unit moves to the class that raises the likelihood of the class
bigrams most. A unit is a word with at least CLUSTER_SHARE of the training tokens; all other words, and
words never seen, join the unit of their last bytes, so every word has a class. Units and listed words are
bounded by the shares (a share of 1e-6 leaves at most 1e6 words), whatever the corpus. Counts of all
other words stay in a table and are joined.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import ascii_lower, byte_texts, read_table, slices
from variantloom.session import materialize

CLUSTER_SHARE = 2e-5
LISTED_SHARE = 1e-6
SUFFIX_UNITS = 4096
CLASSES = 96
ROUNDS = 12
ADDED = 0.1  # added to every count, as in the base score
PRIOR = 50.0  # weight of the class unigrams in a class transition
FLUSH = 200_000  # entries of a task's local tables, which are passed on or forgotten beyond


def held_out(key: Column) -> Column:
    """Documents that are scored only. A null key is trained on."""
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))


def suffix_unit(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIX_UNITS


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts; each task merges its own counts before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, "text"):
            for t in byte_texts(part):
                counts.update(ascii_lower(t).split())
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """Unit numbers of words: listed words first, then suffix units, the text end last."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.size = len(words) + SUFFIX_UNITS + 1
        self.end = self.size - 1
        self.suffixes = len(words)

    def of(self, word: bytes) -> int:
        at = self.number.get(word)
        return self.suffixes + suffix_unit(word) if at is None else at


class WordTable:
    """Numbers of words, with values worked out once for each; forgotten when there are too many."""

    def __init__(self, values, kinds: str, most: int = FLUSH):
        self.values, self.kinds, self.most = values, kinds, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.columns = [array(k) for k in self.kinds]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of each word, and the columns of values by number."""
        if len(self.known) > self.most:
            self.forget()
        for w in set(words).difference(self.known):
            self.known[w] = len(self.known)
            for column, value in zip(self.columns, self.values(w), strict=True):
                column.append(value)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return numbers, [np.array(c) for c in self.columns]


def _joined_words(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """All words of a slice, and how many each text has."""
    lists = [ascii_lower(t).split() for t in byte_texts(part)]
    return [w for words in lists for w in words], np.fromiter(map(len, lists), np.int64, len(lists))


def _with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``end`` before the first text and after each."""
    return np.append(end, np.insert(values, np.cumsum(sizes), end))


def unit_bigrams(docs: DataFrame, words) -> DataFrame:
    """``code, n`` of adjacent units in all texts, code = left * units + right; texts start and end with the end unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(words.value)
        table = WordTable(lambda w: (units.of(w),), "q")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        for part in slices(batches, "text"):
            line, sizes = _joined_words(part)
            numbers, (unit,) = table(line)
            run_of = _with_ends(unit[numbers], sizes, units.end)
            held.append(np.unique(run_of[:-1] * units.size + run_of[1:], return_counts=True))
            if sum(len(c) for c, _ in held) > 6 * FLUSH:
                held[:] = [merged()]
                if len(held[0][0]) > 4 * FLUSH:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def neighbours(bigrams: DataFrame, units: int) -> DataFrame:
    """``unit, side, others, ns``: all neighbours of each unit on its left (0) and right (1); at most ``units`` each."""
    left, right = F.expr(f"code div {units}"), F.col("code") % units
    sides = F.array(F.struct(left.alias("unit"), F.lit(1).alias("side"), right.alias("other"), "n"), F.struct(right.alias("unit"), F.lit(0).alias("side"), left.alias("other"), "n"))
    rows = bigrams.select(F.inline(sides)).where(F.col("unit") != units - 1)
    packed = F.collect_list(F.struct(F.col("other").cast("int").alias("other"), "n"))
    return rows.groupBy("unit", "side").agg(packed.alias("others"))


def class_bigrams(counted: DataFrame, classes: np.ndarray, units: int) -> np.ndarray:
    """Counts of adjacent classes as a square table, from unit bigrams."""
    sent = counted.sparkSession.sparkContext.broadcast(classes.astype(np.int16))
    k = int(classes.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(np.int64)
        table = np.zeros(k * k)
        for batch in batches:
            codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            table += np.bincount(own[codes // units] * k + own[codes % units], n, k * k)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["pair", "n"])

    out = np.zeros(k * k)
    for row in counted.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most classes ** 2 rows
        out[row["pair"]] = row["n"]
    return out.reshape(k, k)


def transition_logs(table: np.ndarray) -> np.ndarray:
    """log10 p(class | previous class): counts with the class unigrams as prior, which have ADDED."""
    totals = table.sum(axis=0) + ADDED
    unigram = totals / totals.sum()
    return np.log10((table + PRIOR * unigram[None, :]) / (table.sum(axis=1, keepdims=True) + PRIOR))


def exchange(counted: DataFrame, around: DataFrame, units: int, frequency_order: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit. In a round, half of the units move at once, each to its best class.

    The gain of unit u in class c is the log-likelihood of u's class bigrams on both sides, given c,
    minus u's count times the log of c's size. Each round is a pass over the stored neighbour
    table; only the class numbers, as many as units, come back.
    """
    of = np.zeros(units, np.int64)
    of[frequency_order] = np.arange(len(frequency_order)) % classes
    of[units - 1] = classes
    session = around.sparkSession
    for turn in range(rounds):
        table = class_bigrams(counted, of, units) + 1e-3
        sizes = table.sum(axis=0)
        sent = session.sparkContext.broadcast((of.astype(np.int16), np.log(table / table.sum(axis=1, keepdims=True)), np.log(sizes[:classes])))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            own, step, size = sent.value
            own = own.astype(np.int64)
            for batch in batches:
                numbers, gains, totals = batch.column("unit").to_numpy(), [], []
                sides = batch.column("side").to_numpy()
                lists = batch.column("others")
                ends = lists.offsets.to_numpy()
                flat = lists.values
                others, n = flat.field("other").to_numpy(), flat.field("n").to_numpy()
                for i, side in enumerate(sides):
                    part = slice(ends[i], ends[i + 1])
                    profile = np.bincount(own[others[part]], n[part], classes + 1)
                    gains.append(profile @ (step[:, :classes] if side == 0 else step[:classes].T))
                    totals.append(profile.sum() if side == 0 else 0.0)
                gain = np.array(gains) - np.array(totals)[:, None] * size[None, :]
                lists_of = pa.ListArray.from_arrays((np.arange(len(gain) + 1) * classes).astype(np.int32), pa.array(gain.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), lists_of], ["unit", "gain"])

        gains = around.mapInArrow(run, "unit bigint, gain array<double>").groupBy("unit").agg(F.collect_list("gain").alias("gains"))
        both = F.zip_with(F.get("gains", F.lit(0)), F.coalesce(F.get("gains", F.lit(1)), F.array_repeat(F.lit(0.0), classes)), lambda a, b: a + b)
        best = gains.select("unit", (F.array_position(both, F.array_max(both)) - 1).alias("best")).collect()  # one row for each unit
        for row in best:
            if row["unit"] % 2 == turn % 2 or turn == rounds - 1:
                of[row["unit"]] = row["best"]
    return of


@dataclass
class Model:
    """What a task needs for scoring: bounded by the shares and the number of classes."""

    cluster: list[bytes]  # words with a unit of their own
    listed: dict[bytes, int]  # words whose counts travel with the model
    classes: np.ndarray  # by unit
    steps: np.ndarray  # log10 p(class | class)
    class_totals: np.ndarray  # tokens by class
    class_types: np.ndarray  # words by class
    tokens: int  # all training tokens, text ends too
    types: int  # distinct training tokens
    ends: int  # training documents


def class_sizes(vocabulary: DataFrame, cluster: list[bytes], classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each class, over the whole vocabulary."""
    sent = vocabulary.sparkSession.sparkContext.broadcast((cluster, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = sent.value
        units = Units(words)
        totals, types = np.zeros(k), np.zeros(k)
        for batch in batches:
            at = of[np.fromiter(map(units.of, batch.column("word").cast(pa.binary()).to_pylist()), np.int64, batch.num_rows)]
            totals += np.bincount(at, batch.column("n").to_numpy(), k)
            types += np.bincount(at, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(totals.astype(np.int64)), pa.array(types.astype(np.int64))], ["class", "tokens", "types"])

    totals, types = np.zeros(k), np.zeros(k)
    summed = vocabulary.mapInArrow(run, "class bigint, tokens bigint, types bigint").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    for row in summed.collect():  # one row for each class
        totals[row["class"]], types[row["class"]] = row["tokens"], row["types"]
    return totals, types


def train(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of ``text``, and the stored counts of all words."""
    vocabulary = materialize(word_counts(docs), "word-counts")
    ends = docs.count()
    row = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = int(row["n"] or 0) + ends, int(row["v"]) + bool(ends)
    listed_rows = vocabulary.where(F.col("n") >= max(1.0, LISTED_SHARE * tokens)).collect()  # at most 1 / LISTED_SHARE rows
    listed = {r["word"].encode(): r["n"] for r in listed_rows}
    cluster = [w for w, _ in sorted(((w, n) for w, n in listed.items() if n >= CLUSTER_SHARE * tokens), key=lambda x: (-x[1], x[0]))]
    units = Units(cluster)
    sent = docs.sparkSession.sparkContext.broadcast(cluster)
    counted = materialize(unit_bigrams(docs, sent), "unit-bigrams")
    around = materialize(neighbours(counted, units.size), "unit-neighbours")
    of = exchange(counted, around, units.size, np.arange(units.size - 1), classes, rounds)
    table = class_bigrams(counted, of, units.size)
    totals, sizes = class_sizes(vocabulary, cluster, of, classes + 1)
    totals[classes], sizes[classes] = ends, 1
    return Model(cluster, listed, of, transition_logs(table), totals, sizes, tokens, types, ends), vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: ``key, n_tokens, n_known, base_score, score, perplexity``.

    A null text is empty: its only token is the end. Rows with equal key and text get equal results;
    null keys stay; an empty table gives no rows. Scores are log10 probabilities of the whole text. Other
    columns are left out. Words outside the model's list are joined with the stored counts; they are
    rare, so no word is a hot key.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    base_all = float(-np.log10(model.tokens + ADDED * (model.types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        units, listed, of, steps = Units(v["cluster"]), v["listed"], v["classes"].tolist(), v["steps"]
        emit = -np.log10(v["class_totals"] + ADDED * (v["class_types"] + 1))
        end, end_log, end_known = of[units.end], float(np.log10(v["ends"] + ADDED)), int(v["ends"] > 0)

        def values(word: bytes) -> tuple[int, float, int]:
            n = listed.get(word)
            return of[units.of(word)], math.log10(n + ADDED) if n else 0.0, int(n is not None)

        table = WordTable(values, "qdq")
        for part in slices(batches, "text"):
            line, sizes = _joined_words(part)
            numbers, (classes, logs, known) = table(line)
            ends = np.cumsum(sizes)

            def total(x: np.ndarray, ends: np.ndarray = ends, sizes: np.ndarray = sizes) -> np.ndarray:
                sums = np.append(0, np.cumsum(x))
                return sums[ends] - sums[ends - sizes]

            at = _with_ends(classes[numbers], sizes, end)
            moves = np.append(0, np.cumsum(steps[at[:-1], at[1:]]))
            last = ends + np.arange(1, len(ends) + 1)
            word_logs = total(logs[numbers])
            model = moves[last] - moves[last - sizes - 1] + total(emit[classes[numbers]]) + word_logs
            n_tokens = sizes + 1
            base = word_logs + end_log + n_tokens * base_all
            columns = [pa.array(x) for x in (n_tokens, total(known[numbers]).astype(np.int64) + end_known, base, model)]
            yield _out(part.column("key"), part.column("text_hash"), None, None, *columns)
            rare = np.flatnonzero(known[numbers] == 0)
            if len(rare):
                known_words = list(table.known)
                width = len(known_words)
                pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * width + numbers[rare], return_counts=True)
                rows = pa.array(pairs // width)
                words = pa.array([known_words[i] for i in (pairs % width).tolist()], pa.binary()).cast(pa.string())
                yield _out(part.column("key").take(rows), part.column("text_hash").take(rows), words, pa.array(times), None, None, None, None)

    names = ["key", "text_hash", "word", "times", "n_tokens", "n_known", "base_score", "score"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def _out(*columns) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, types, strict=True)], names)

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = f"key {kind}, text_hash bigint, word string, times bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    parts = materialize(own.mapInArrow(run, schema), "scored-parts")  # read as whole texts and as rare words
    whole = parts.where("word IS NULL").select("key", "text_hash", F.lit(1).cast("bigint").alias("rows"), "n_tokens", "n_known", "base_score", "score")
    rare = parts.where("word IS NOT NULL").select("key", "text_hash", "word", "times")
    joined = rare.join(vocabulary.withColumnRenamed("n", "count"), "word", "left")
    seen = F.coalesce("count", F.lit(0))
    log = F.log10(seen + F.lit(ADDED)) * F.col("times")
    from_rare = joined.select("key", "text_hash", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("n_tokens"), F.when(seen > 0, F.col("times")).otherwise(0).cast("bigint").alias("n_known"), log.alias("base_score"), log.alias("score"))
    summed = whole.unionByName(from_rare).groupBy("key", "text_hash").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "score")])
    each = summed.select("key", *[(F.col(c) / F.col("rows")).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("n_tokens", "n_known")]
    return each.select(F.col("key").alias(key), *longs, "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    scored = score(docs, model, vocabulary)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "train_tokens": F.lit(model.tokens).cast("bigint")})
