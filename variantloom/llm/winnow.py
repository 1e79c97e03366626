"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprint of a window of words is the smallest hash of the k-grams inside it, so equal windows
have equal fingerprints: every shared span as long as a window is found. Windows of documents whose
fingerprint may be one of the benchmark are then compared word by word with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table
from variantloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
BIT_WORDS = 1 << 14


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of letters a-z, digits and characters outside ASCII, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BREAKS, -1), "")


def fingerprints(words: Column, length: int, gram: int = GRAM) -> Column:
    """The smallest k-gram hash of every window of ``length`` words, by the window's start."""
    k = min(length, gram)

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(k)]))

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(g) - (length - k)), lambda i: F.array_min(F.slice(g, i, length - k + 1)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = let(hashes, lambda h: let(grams(h), least))
    return F.when(F.size(words) >= length, found).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, length, passage, fp`` of all benchmark windows; an item with fewer words is one window."""
    own = items.select("item_id", words_of(F.col("text")).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    own = own.withColumn("length", F.least(F.size("words"), F.lit(window)))
    parts = own.select("item_id", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    cut = parts.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("part"))
    fp = F.lit(None).cast("bigint")
    for n in range(1, window + 1):
        fp = F.when(F.col("length") == n, F.get(fingerprints(F.col("part"), n), F.lit(0))).otherwise(fp)
    return cut.select("item_id", "length", F.array_join("part", " ").alias("passage"), fp.alias("fp")).distinct()


def fingerprint_bits(windows: DataFrame) -> Column:
    """A table of BIT_WORDS * 64 bits, in which the fingerprints of all benchmark windows are set.

    Its size is fixed; a benchmark with very many windows only lets more candidates through. It becomes
    one constant of the plan.
    """
    set_bits = windows.select(_bit_word("fp").alias("id"), F.expr("shiftleft(1L, CAST(shiftright(fp, 14) & 63 AS INT))").alias("bit"))
    words = dict.fromkeys(range(BIT_WORDS), 0)
    words |= {r["id"]: r["bits"] for r in set_bits.groupBy("id").agg(F.bit_or("bit").alias("bits")).collect()}  # at most BIT_WORDS rows
    return F.split(F.lit(",".join(map(str, words.values()))), ",").cast("array<bigint>")


def _bit_word(fp: str | Column) -> Column:
    return (F.col(fp) if isinstance(fp, str) else fp).bitwiseAND(F.lit(BIT_WORDS - 1).cast("bigint")).cast("int")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, start, length, item_id`` of every benchmark window that occurs in a document.

    Candidates are windows whose fingerprint is set in the benchmark's bit table; only these leave
    their row, with their words, which a join with the benchmark's windows then compares. Texts are
    read once and never moved. The join carries no hint: the stored windows' real size decides it.
    """
    windows = materialize(item_windows(items, window), "benchmark-windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most ``window`` numbers
    bits = fingerprint_bits(windows)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    no = F.array().cast("array<struct<length: int, start: int, passage: string>>")

    def candidates(words: Column) -> Column:
        def of_length(n: int) -> Column:
            numbered = F.transform(fingerprints(words, n), lambda f, i: F.struct(i.alias("at"), f.alias("fp")))
            near = F.filter(numbered, lambda s: F.getbit(F.get(bits, _bit_word(s["fp"])), F.shiftright(s["fp"], 14).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1)
            return F.transform(near, lambda s: F.struct(F.lit(n).alias("length"), s["at"].alias("start"), F.array_join(F.slice(words, s["at"] + 1, n), " ").alias("passage")))

        return F.concat(no, *[of_length(n) for n in lengths])

    spans = own.select("doc_id", "text_hash", F.inline(let(words_of(F.col("text")), candidates)))
    found = spans.join(windows.select("item_id", "length", "passage"), ["length", "passage"])
    return found.select("doc_id", "text_hash", "start", "length", "item_id").distinct()


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document row: ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit when it lies in any occurrence of a benchmark window. A document is contaminated
    with 5 percent or more of its words hit. A null or empty text has no words and is clean; an empty
    benchmark hits nothing. Rows that agree in doc_id and text get the same result each; null doc_ids
    stay. Items without words or without an id count nowhere; other columns are left out.
    """
    found = materialize(hits(docs, items, window), "benchmark-hits")
    by_doc = ["doc_id", "text_hash"]
    spans = found.select(*by_doc, "start", "length").distinct().groupBy(*by_doc).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    ids = found.select(*by_doc, F.col("item_id").cast("string").alias("item_id")).distinct().groupBy(*by_doc).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    totals = _joined(spans.select(*by_doc, covered.cast("long").alias("n_hit")), ids)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = _joined(own, totals, "left")
    n_hit, items_list = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``judged`` without the hash of the text."""
    return judged(docs, items, window).drop("text_hash")


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id (nulls are equal) and text_hash, with the left side's keys."""
    other = right.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return left.join(other, same, how).drop("_doc_id", "_text_hash")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; a row is known by doc_id and text, so others with its id stay."""
    bad = judged(docs, items, window).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_hash")), "left_anti")


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same rows from all windows, without fingerprints.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT row_no, m, s, array_to_string(w[s:s + m - 1], ' ') AS p
  FROM (SELECT row_no, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d CROSS JOIN lengths WHERE len(w) >= m)),
h AS (SELECT DISTINCT row_no, dw.m AS m, s, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.p = iw.p),
c AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(s, s + m)) AS place FROM h) GROUP BY 1),
n AS (SELECT row_no, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (row_no) LEFT JOIN n USING (row_no)"""
