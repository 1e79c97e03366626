"""Quality by weak supervision: rules vote or abstain, EM weighs the rules, the posterior decides.

Each rule votes good (1), bad (-1) or abstains (0). The corpus is reduced to counts of vote
patterns, at most 3 ** rules, and expectation-maximisation over these estimates how often each
rule votes good or bad for good and for bad documents. The posterior of a document follows from its
own pattern, so no document is rejected for one failed rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import byte_texts, read_table, slices
from variantloom.session import materialize

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PRIOR_GOOD = 0.85  # start of the share of good documents
PRIOR_WEIGHT = 0.1  # weight of the start, as a share of the documents
KEEP_FROM = 0.5  # smallest posterior that is kept
# starting p(vote | class) for votes bad, abstain, good; a rule that never votes one way learns so
START = [[0.4, 0.4, 0.2], [0.02, 0.28, 0.7]]  # bad, good


def repeat_words(words: list[bytes], width: int) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared exactly: ids of single words become ids of runs of two, four, ... words.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    run, span = ids, 1
    while span < width:
        step = min(span, width - span)
        pairs = run[: len(run) - step] * np.int64(len(words) + 1) + run[step:]
        run = np.unique(pairs, return_inverse=True)[1]
        span += step
        if len(np.bincount(run)) == len(run):
            return 0
    twice = np.bincount(run)[run] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    marks[:n] += twice
    marks[width : width + n] -= twice
    return int((np.cumsum(marks)[: len(words)] > 0).sum())


def text_stats(text: bytes, width: int = 8) -> tuple[int, ...]:
    """Values of STATS for one text in UTF-8. Words are runs without ASCII white space."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    count = lambda which: len(text) - len(text.translate(None, which))
    return len(words), len(joined) - chars, count(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words, width), count(UPPER)


def with_stats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the STATS of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            columns = zip(*[text_stats(t) for t in byte_texts(part)], strict=True)
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(c, pa.int64()) for c in columns]], ["key", *STATS])

    schema = ", ".join([f"key {df.schema[key].dataType.simpleString()}", *[f"{s} bigint" for s in STATS]])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict:
    """The rules over STATS: 1 good, -1 bad, 0 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    symbols, upper, repeats, lines = (100 * F.col(c) for c in ("n_symbols", "n_upper", "n_repeat_words", "n_dup_lines"))
    return {
        "clean": _vote((words > 0) & (symbols <= chars) & (upper <= 20 * chars), (symbols > 5 * chars) | (upper > 50 * chars)),
        "varied": _vote((words > 0) & (lines == 0) & (repeats <= 10 * words), (repeats > 25 * words) | (lines > 4 * words)),
        "length": _vote(words >= 40, words < 20),
        "word_size": _vote((words > 0) & chars.between(3 * words, 9 * words), (chars < 2 * words) | (chars > 15 * words)),
        "symbols": _vote(F.lit(False), symbols > 8 * chars),
        "shouting": _vote(F.lit(False), upper > 60 * chars),
        "repeats": _vote(F.lit(False), repeats > 30 * words),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good documents and p(vote | class) as [rule, class, vote + 1], by EM.

    The start counts as PRIOR_WEIGHT of the documents throughout. That keeps the classes from being
    swapped, and is the result for an empty table.
    """
    rules = patterns.shape[1]
    start = np.array(START)
    p = np.tile(start, (rules, 1, 1))
    good, total = PRIOR_GOOD, counts.sum()
    prior = PRIOR_WEIGHT * total * np.array([1 - PRIOR_GOOD, PRIOR_GOOD])
    one_hot = patterns[:, :, None] == np.array([-1, 0, 1])
    for _ in range(rounds if total else 0):
        post = posterior(patterns, good, p)
        weight = np.stack([(1 - post) * counts, post * counts], axis=1)
        p = np.einsum("nc,nrv->rcv", weight, one_hot) + (prior[:, None] * start)[None]
        p /= p.sum(axis=2, keepdims=True)
        good = float((weight[:, 1].sum() + prior[1]) / (total + prior.sum()))
    return good, p


def posterior(patterns: np.ndarray, good: float, p: np.ndarray) -> np.ndarray:
    """Probability of a good document for each row of votes."""
    at = np.arange(patterns.shape[1])
    logs = np.log(p[at[None, :], :, patterns + 1]).sum(axis=1) + np.log([1 - good, good])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", rules: dict | None = None) -> DataFrame:
    """One row for each input row: ``key``, STATS, ``base_failed``, ``p_good``, ``kept``.

    A null text is an empty one: no words, which fails. Null keys stay null, repeated rows stay, and
    an empty table gives an empty result. Further columns are left out, whatever their names.
    """
    stats = materialize(with_stats(df, key, text), "quality-stats")  # read twice, a few numbers a row
    return judged(stats, rules or rule_votes()).withColumnRenamed("key", key)


def judged(stats: DataFrame, rules: dict) -> DataFrame:
    """``key``, STATS and the verdict; the model is fitted on the vote patterns of all rows."""
    code = sum((vote + 1) * 3**i for i, vote in enumerate(rules.values()))
    coded = stats.withColumn("pattern", code.cast("int"))
    seen = coded.groupBy("pattern").count().collect()  # at most 3 ** rules rows
    codes = np.array([r["pattern"] for r in seen], np.int64).reshape(-1)
    counts = np.array([r["count"] for r in seen], float)
    digits = 3 ** np.arange(len(rules))
    good, p = fit_votes((codes[:, None] // digits) % 3 - 1, counts)
    every = np.array([v[::-1] for v in product(range(3), repeat=len(rules))]) - 1
    chance = F.get(F.lit(posterior(every, good, p).tolist()), F.col("pattern"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = coded.withColumns({"base_failed": failed, "p_good": chance})
    return out.select("key", *STATS, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)).alias("kept"))


def filter_kept(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns unchanged.

    The statistics travel inside the row as one struct, so that no join brings the verdict back to the text.
    """
    box = "_".join([*df.columns, "row"])  # longer than any column, so not one of them
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(box), F.col(f"`{text}`").alias("text"))
    stats = with_stats(held, box, "text")
    stored = materialize(stats.withColumnRenamed("key", box), "quality-rows")
    verdict = judged(stored.withColumnRenamed(box, "key"), rule_votes())
    return verdict.where("kept").select("key.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
