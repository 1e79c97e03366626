"""Exact ranked lexical search by two trees, one over items (the queries) and one over documents.

A score is an inner product: the item's term counts with the document's term impacts, all of them whole numbers and none
negative. A node of either tree keeps, for each term, the largest value below it, so the product of two nodes'
maxima bounds the score of every item below one with every document below the other. A pair of nodes is given up when
its bound is less than the weakest kth score among the node's items, and split otherwise; leaves are scored exactly. Equal
bounds are never given up, because ties go by doc_id.

Each task builds trees over its own documents, some hundreds at a time, and searches all items of a batch in them. A first
search through a thin slice of the documents gives every item a kth score that the final one cannot be below, from which
all tasks start. Texts are read once for a batch; what is stored of them is the counts of the batch's terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantloom.llm.common import byte_texts, read_table, slices
from variantloom.session import materialize

TOP = 20
BATCH_ITEMS = 768  # items that are broadcast together, about
BATCH_TERMS = 24_000  # their terms, with repeats, about
PIECE = 1 << 20  # bytes of a text that are cut into words at once
HELD_DOCS = 1024  # documents of one tree
HELD_PAIRS = 1_000_000  # (document, term) pairs of one tree
DOC_LEAF, DOC_NODE = 16, 8  # documents of a leaf, leaves of an inner node
ITEM_LEAF, ITEM_NODE = 8, 8
FIRST_SLICE = 16  # one in so many documents is searched first
EXACT = 2.0**53

# every byte that no term has becomes a blank; A-Z are lower-cased
_KEEP = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_counts(text: bytes, piece: int = PIECE) -> tuple[Counter, int]:
    """How often each term occurs, and how many there are; a long text is cut at blanks, so little of it is held as words."""
    if len(text) <= piece:
        found = terms_of(text)
        return Counter(found), len(found)
    counts, n, text, at = Counter(), 0, text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        found = text[at:end].split()
        counts.update(found)
        n, at = n + len(found), end
    return counts, n


# --- the trees


@dataclass(frozen=True)
class Items:
    """A batch of items: counts of terms as a (term, item) matrix, items in tree order, and the maxima of leaves and nodes."""

    ids: list
    counts: np.ndarray  # float32, whole numbers
    leaves: list[tuple[int, int]]
    leaf_max: np.ndarray  # (term, leaf)
    nodes: list[tuple[int, int]]  # ranges of leaves
    node_max: np.ndarray


def _ranges(n: int, width: int) -> list[tuple[int, int]]:
    return [(i, min(i + width, n)) for i in range(0, n, width)]


def item_tree(ids: list, counts: np.ndarray) -> Items:
    """Items are halved again and again by the term that parts them most evenly, so that items of one node share terms."""

    def ordered(members: np.ndarray) -> list[int]:
        if len(members) <= ITEM_LEAF:
            return members.tolist()
        share = (counts[:, members] > 0).sum(axis=1)
        split = counts[int(np.argmin(np.abs(2 * share - len(members)))), members] > 0
        if not split.any() or split.all():
            split = np.arange(len(members)) < len(members) // 2
        return ordered(members[split]) + ordered(members[~split])

    order = ordered(np.arange(len(ids)))
    counts = counts[:, order].astype(np.float32)
    leaves = _ranges(len(ids), ITEM_LEAF)
    leaf_max = np.stack([counts[:, a:b].max(axis=1) for a, b in leaves], axis=1)
    nodes = _ranges(len(leaves), ITEM_NODE)
    node_max = np.stack([leaf_max[:, a:b].max(axis=1) for a, b in nodes], axis=1)
    return Items([ids[i] for i in order], counts, leaves, leaf_max, nodes, node_max)


@dataclass
class Best:
    """The best documents of each item so far: falling score, then rising doc_id, null ids last."""

    top: int
    scores: list[np.ndarray]
    docs: list[np.ndarray]
    least: np.ndarray  # a document must reach this to count

    @classmethod
    def start(cls, least: np.ndarray, top: int) -> Best:
        return cls(top, [np.zeros(0, np.int64) for _ in least], [np.zeros(0, object) for _ in least], np.maximum(least, 1))

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.append(self.scores[item], scores), np.append(self.docs[item], docs)
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], docs[i] is None, docs[i] or 0))[: self.top]
        self.scores[item], self.docs[item] = scores[order], docs[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], scores[order[-1]])


@dataclass
class DocumentTree:
    """Documents of one task, short ones first: the impacts of their terms in leaves and inner nodes."""

    docs: np.ndarray
    leaves: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # from, to, terms, (document, term) impacts
    nodes: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # from leaf, to leaf, terms, their maxima

    @classmethod
    def build(cls, docs: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> DocumentTree:
        order = np.argsort(n, kind="stable")
        tree = cls(docs[order])
        for a, b in _ranges(len(order), DOC_LEAF):
            rows = [np.arange(starts[i], starts[i + 1]) for i in order[a:b]]
            lengths = [len(r) for r in rows]
            at = np.concatenate(rows)
            own, column = np.unique(terms[at], return_inverse=True)
            dense = np.zeros((b - a, len(own)))
            dense[np.repeat(np.arange(b - a), lengths), column] = impacts[at]
            tree.leaves.append((a, b, own, dense))
        for a, b in _ranges(len(tree.leaves), DOC_NODE):
            terms_below = np.concatenate([leaf[2] for leaf in tree.leaves[a:b]])
            most_below = np.concatenate([leaf[3].max(axis=0) for leaf in tree.leaves[a:b]])
            own, column = np.unique(terms_below, return_inverse=True)
            most = np.zeros(len(own))
            np.maximum.at(most, column, most_below)
            tree.nodes.append((a, b, own, most))
        return tree


def search(tree: DocumentTree, items: Items, best: Best) -> None:
    """Adds to ``best`` whatever documents of the tree belong there. Node pairs with high bounds go first."""
    weakest = lambda a, b: best.least[a:b].min()
    bounds = [most @ items.node_max[own] for _, _, own, most in tree.nodes]
    pairs = sorted(((-float(b[q]), d, q) for d, b in enumerate(bounds) for q in range(len(items.nodes))))
    for bound, d, q in pairs:
        first, last = items.nodes[q]
        if -bound < weakest(items.leaves[first][0], items.leaves[last - 1][1]):
            continue
        a, b, _, _ = tree.nodes[d]
        for low, high, own, impacts in tree.leaves[a:b]:
            upper = impacts.max(axis=0) @ items.leaf_max[own, first:last]
            for leaf in np.flatnonzero(upper >= [weakest(*items.leaves[i]) for i in range(first, last)]):
                x, y = items.leaves[first + leaf]
                exact = impacts @ items.counts[own, x:y]
                for i in np.flatnonzero(exact.max(axis=0) >= best.least[x:y]):
                    rows = np.flatnonzero(exact[:, i] >= best.least[x + i])
                    best.add(x + i, exact[rows, i].astype(np.int64), tree.docs[low:high][rows])


# --- the passes


def item_batches(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """The items with their term counts, in batches of bounded size that are dealt out by a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [term_counts(t) for t in byte_texts(part)]
            names = pa.array([list(c) for c, _ in found], pa.list_(pa.binary()))
            times = pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), names, times, pa.array([n for _, n in found], pa.int64())], ["item_id", "names", "times", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    counted = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, names array<binary>, times array<bigint>, n bigint")
    counted = materialize(counted.where("n > 0").withColumn("place", F.xxhash64("item_id", "names")), "item-terms")
    size = counted.agg(F.count("*").alias("items"), F.sum(F.size("names")).alias("terms")).first()
    if not size["items"]:
        return
    n_batches = max(math.ceil(size["items"] / BATCH_ITEMS), math.ceil(size["terms"] / BATCH_TERMS))
    for i in range(n_batches):
        rows = counted.where(F.pmod("place", F.lit(n_batches)) == i).collect()
        if rows:
            yield [(r["item_id"], Counter(dict(zip(map(bytes, r["names"]), r["times"], strict=True)))) for r in rows]


def matrix_of(batch: list[tuple[object, Counter]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the batch's terms, and its (term, item) counts."""
    numbers: dict[bytes, int] = {}
    for _, counts in batch:
        for term in counts:
            numbers.setdefault(term, len(numbers))
    matrix = np.zeros((len(numbers), len(batch)))
    for j, (_, counts) in enumerate(batch):
        matrix[[numbers[t] for t in counts], j] = list(counts.values())
    return numbers, matrix


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times``: each document's number of terms, and counts of the listed ones as packed whole numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part in slices(batches, "text"):
            sizes, terms, times = [], [], []
            for text in byte_texts(part):
                counts, n = term_counts(text)
                own = counts.keys() & known.keys()
                at = sorted((known[t], counts[t]) for t in own)
                sizes.append(n)
                terms.append(np.array([a for a, _ in at], "<i4").tobytes())
                times.append(np.array([c for _, c in at], "<i4").tobytes())
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms binary, times binary")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` listed terms occurs; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("terms").to_pylist():
                total[np.frombuffer(value, "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "docs"])

    out = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r["term"]] = r["docs"]
    return out


def held_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents with a listed term, in lots of bounded size: ids, lengths, where each one's terms start, terms, times."""
    ids, lengths, terms, times, size = [], [], [], [], 0

    def lot() -> tuple[np.ndarray, ...]:
        found = np.empty(len(ids), object)
        found[:] = ids
        starts = np.append(0, np.cumsum([len(t) // 4 for t in terms]))
        return found, np.array(lengths, np.int64), starts, np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(times), "<i4").astype(np.int64)

    for batch in batches:
        for doc, n, own, often in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "times")), strict=True):
            if not own:
                continue
            ids.append(doc), lengths.append(n), terms.append(own), times.append(often)
            size += len(own) // 4
            if len(ids) >= HELD_DOCS or size >= HELD_PAIRS:
                yield lot()
                ids, lengths, terms, times, size = [], [], [], [], 0
    if ids:
        yield lot()


def best_documents(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray, top: int) -> DataFrame:
    """``item, doc_id, score``: what each task finds best for each item, from kth scores of at least ``least`` on."""
    sent = counted.sparkSession.sparkContext.broadcast((items, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_items, w, floor = sent.value
        best = Best.start(floor, top)
        for docs, n, starts, terms, times in held_documents(batches):
            m = np.repeat(75 + (25 * n * n_docs) // n_terms, np.diff(starts))
            impacts = w[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m))
            search(DocumentTree.build(docs, n, starts, terms, impacts), own_items, best)
        item = np.repeat(np.arange(len(best.scores)), [len(s) for s in best.scores])
        if len(item):
            docs = [d for found in best.docs for d in found]
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(docs, pa.int64()), pa.array(np.concatenate(best.scores))], ["item", "doc_id", "score"])

    found = counted.mapInArrow(run, "item int, doc_id bigint, score bigint")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def rank_documents(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0, all if fewer.

    Equal scores go by rising doc_id, which is a whole number; null ids come last. Each row of ``items`` is an item of
    its own and each row of ``docs`` a document, so repeated rows give repeated results. Null and empty texts have no terms:
    such an item has no rows, such a document is neither counted nor found. Empty tables give no rows. Other columns are
    left out, whatever their names. Items are searched in batches of bounded size; each batch reads the texts once.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    parts = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")]
    for batch in item_batches(items):
        numbers, matrix = matrix_of(batch)
        counted = materialize(count_terms(docs, numbers), "term-counts")
        size = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size["docs"]:
            break
        df = document_frequencies(counted, len(numbers))
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        if (weights * 1_000_000 @ matrix).max() >= EXACT:
            raise OverflowError("an item is so long that its scores are not whole numbers in doubles")
        tree = item_tree([i for i, _ in batch], matrix)
        args = (tree, weights, size["docs"], size["terms"])
        least = np.zeros(len(batch), np.int64)
        first = counted.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(FIRST_SLICE)) == 0)
        for r in best_documents(first, *args, least.copy(), top).where(F.col("rank") == top).select("item", "score").collect():
            least[r["item"]] = r["score"]
        found = best_documents(counted, *args, least, top)
        names = spark.createDataFrame(list(enumerate(tree.ids)), f"item int, item_id {kind}")
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # BATCH_ITEMS rows, about
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item; nulls, ties, repeats and empty tables as in ``rank_documents``."""
    return rank_documents(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


#: The same rows by scoring every document that shares a term with an item.
ORACLE = r"""
WITH words AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT row_number() OVER () AS item_no, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
tf AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(w) AS term FROM words) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
q AS (SELECT item_no, term, count(*) AS q FROM (SELECT item_no, unnest(w) AS term FROM asked) GROUP BY 1, 2),
lengths AS (SELECT row_no, doc_id, 75 + (25 * len(words.w)::BIGINT * n_docs) // n_terms AS m FROM words, totals),
scores AS (SELECT item_no, doc_id, row_no, sum(q * weights.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (row_no) GROUP BY 1, 2, 3),
ranked AS (SELECT item_no, doc_id, score, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (item_no) WHERE rank <= 20"""
