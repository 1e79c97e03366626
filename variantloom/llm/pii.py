"""Personal data by a skip-chain conditional random field over the mentions of each document.

The base patterns give spans that always stay. Around them lie looser mentions: numbers with other separators or a part
left out, addresses spelled with "(at)" or without their last label. Base spans and loose mentions of a document
are the nodes of a field with the labels nothing, email, ip, card and phone. A node's own features (digits,
groups, separators, cue words) speak for its label; nodes next to each other share a transition potential; distant nodes
that repeat one another, or end in the same digits, or name the same mailbox, share an agreement potential. Loopy message
passing carries the label of a base span to what repeats it, however far away, and a mention whose
posterior for one kind reaches one half becomes a span.

The weights are trained by the same message passing: base spans are labelled with their kind, other mentions as nothing,
but those that repeat a base span are hidden, for the patterns say nothing about them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table, slices
from variantloom.session import materialize

KINDS = ["email", "ip", "card", "phone"]
TRAIN_DOCS = 4000  # documents with mentions that the weights are fitted on: those with the smallest hashes
TRAIN_NODES = 200  # most mentions of such a document
KEEP_FROM = 0.5  # smallest posterior of a span
NEAR = 40  # most characters between nodes that are next to each other
STEPS, RATE = 150, 0.1  # of the training
PASSES = 60  # most rounds of messages
LOT_NODES = 50_000  # nodes whose messages are passed together
HARD = 40.0  # log potential that holds a label

# --- the base patterns; possessive, so that no failing run is tried again

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern. The local part is read backwards from each @, so no run is scanned twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def small(part: str) -> bool:
    """A number of at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number from 1, start, end), by kind, then start."""
    spans = [(1, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [(2, *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((3, *m.span()))
        if "+" in text:
            spans += [(4, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15]
    return spans


# --- nodes

NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20().:/ ‐-―-]{0,3}[0-9])*+(?![A-Za-z0-9])")
AT = re.compile(r"\x20?[(\[](?:at)[)\]]\x20?")
AT_WORD = re.compile(r"\x20at\x20|@")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)*+")
# fixed values: words before a mention that speak for a kind
CUES = [
    {"email", "e-mail", "mail", "mailto", "contact"},
    {"ip", "host", "server", "addr", "address"},
    {"card", "visa", "mastercard", "credit", "debit", "amex"},
    {"phone", "tel", "telephone", "call", "mobile", "cell", "fax"},
]
# end of fixed values
FEATURES = [
    "always", "digits<7", "digits7", "digits8-9", "digits10-11", "digits12-15", "digits16", "digits17-19", "digits>19", "one group", "two groups", "three groups",
    "four groups", "more groups", "plus", "bracket", "dots", "dashes", "blanks", "other marks", "four small groups", "luhn", "at sign", "spelled at", "dotted host", *[f"cue {k}" for k in KINDS],
]
EXACT, TAIL, MAIL = range(3)  # kinds of likeness
NODE = "struct<start: int, end: int, kind: int, features: bigint, keys: array<string>>"


def features_of(shown: str, before: str) -> int:
    """The features of a mention as bits in the order of FEATURES; ``before`` is the text just before it."""
    bits = {"always"}
    if "@" in shown or AT_WORD.search(shown) or AT.search(shown):
        bits.add("at sign" if "@" in shown else "spelled at")
        if "." in re.split(r"@|at", shown)[-1] or "dot" in shown:
            bits.add("dotted host")
    else:
        groups = NOT_DIGITS.sub(" ", shown).split()
        n = sum(map(len, groups))
        for most, name in ((6, "<7"), (7, "7"), (9, "8-9"), (11, "10-11"), (15, "12-15"), (16, "16"), (19, "17-19")):
            if n <= most:
                bits.add(f"digits{name}")
                break
        else:
            bits.add("digits>19")
        bits.add({1: "one group", 2: "two groups", 3: "three groups", 4: "four groups"}.get(len(groups), "more groups"))
        if len(groups) == 4 and all(map(small, groups)):
            bits.add("four small groups")
        if 13 <= n <= 19 and luhn("".join(groups)):
            bits.add("luhn")
        for name, marks in (("plus", "+"), ("bracket", "()"), ("dots", "."), ("dashes", "-"), ("blanks", " ")):
            if any(c in marks for c in shown):
                bits.add(name)
        if any(not c.isdigit() and c not in "+(). -" for c in shown):
            bits.add("other marks")
    words = {w.strip(".,:;()\"'").lower() for w in before.split()[-3:]}
    bits |= {f"cue {k}" for k, cue in zip(KINDS, CUES, strict=True) if words & cue}
    return sum(1 << i for i, name in enumerate(FEATURES) if name in bits)


def keys_of(shown: str) -> list[str]:
    """What mentions must have in common to be alike: all digits, the last ten or seven, or a mailbox and its first host label."""
    parts = AT.split(shown) if AT.search(shown) else re.split(r"\x20at\x20|@", shown)
    if len(parts) == 2:
        return [f"{MAIL}:{parts[0].lower()}@{re.split(r'[^a-z0-9-]', parts[1].lower())[0]}"]
    digits = NOT_DIGITS.sub("", shown)
    return [f"{EXACT}:{digits}", *[f"{TAIL}:{digits[-n:]}" for n in (10, 7) if len(digits) >= n]]


def loose_mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Mentions outside the base spans: numbers of 7 digits or more or of four small groups, and spelled or short addresses.

    " at " counts only in a document with an @ of its own.
    """
    if spans:
        pieces, at = [], 0
        for a, b in sorted((a, b) for _, a, b in spans):
            if b > at:
                pieces += [text[at:a], "\n" * (b - max(a, at))]
                at = b
        masked = "".join([*pieces, text[at:]])
    else:
        masked = text
    found = []
    joins = [m.span() for m in AT.finditer(masked)] if "at" in masked else []
    joins += [m.span() for m in AT_WORD.finditer(masked)] if "@" in text else []
    done = 0
    for a, b in sorted(joins):
        if a < done:
            continue
        before = masked[done:a]
        local = len(before) - len(before.rstrip(LOCAL))
        host = HOST.match(masked, b) if local else None
        if host and (masked[a:b] != " at " or not host.group().isalpha()):
            found.append((a - local, host.end()))
            done = host.end()
        else:
            done = b
    if DIGIT.search(masked):
        taken = iter([*found, (len(text), len(text))])
        a, b = next(taken)
        for m in NUMBER.finditer(masked):
            while b <= m.start():
                if a == b:
                    break
                a, b = next(taken)
            if m.end() > a and m.start() < b:
                continue
            groups = NOT_DIGITS.sub(" ", m.group()).split()
            if sum(map(len, groups)) >= 7 or (len(groups) == 4 and all(map(small, groups))):
                found.append(m.span())
    return found


def nodes_of(text: str) -> list[dict]:
    """The nodes of a document by place: base spans with their kind number, loose mentions with kind 0."""
    if not DIGIT.search(text) and "@" not in text and not AT.search(text):
        return []
    spans = base_spans(text)
    places = [(a, b, k) for k, a, b in spans] + [(a, b, 0) for a, b in loose_mentions(text, spans)]
    return [
        {"start": a, "end": b, "kind": k, "features": features_of(text[a:b], text[max(0, a - 60) : a]), "keys": keys_of(text[a:b])} for a, b, k in sorted(places)
    ]


# --- the field


@dataclass(frozen=True)
class Graph:
    """Nodes of any number of documents and their edges, each in both directions; edge e comes back as e ^ 1."""

    features: np.ndarray  # (node, feature)
    kinds: np.ndarray  # kind number of base spans, 0 for loose mentions
    linked: np.ndarray  # loose mentions that are like a base span
    source: np.ndarray
    target: np.ndarray
    types: np.ndarray  # likeness of a skip edge, 3 along the chain, 4 back along it


def graph_of(documents: list[list[dict]]) -> Graph:
    """Next nodes are joined if near. A node is joined with the one before it of the same key, and a loose one with a base one too.

    So a document has a few edges for each node, however often something is repeated, and a base span is one
    step away from all that repeats it.
    """
    edges: list[tuple[int, int, int]] = []
    linked: set[int] = set()
    base = 0
    for nodes in documents:
        first_base: dict[str, int] = {}
        for i, n in enumerate(nodes):
            if n["kind"]:
                for key in n["keys"]:
                    first_base.setdefault(key, i)
        last: dict[str, int] = {}
        last_base: dict[str, int] = {}
        for i, n in enumerate(nodes):
            if i and n["start"] - nodes[i - 1]["end"] <= NEAR:
                edges.append((base + i - 1, base + i, 3))
            joined: set[int] = set()
            for key in n["keys"]:
                anchor = last_base.get(key, first_base.get(key)) if not n["kind"] else None
                if anchor is not None:
                    linked.add(base + i)
                for other in (last.get(key), anchor):
                    if other is not None and other not in joined:
                        joined.add(other)
                        edges.append((base + other, base + i, int(key[0])))
                last[key] = i
                if n["kind"]:
                    last_base[key] = i
        base += len(nodes)
    flat = [n for nodes in documents for n in nodes]
    bits = np.array([n["features"] for n in flat], np.int64)
    features = ((bits[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
    table = np.array(edges, np.int64).reshape(-1, 3)
    source, target = table[:, :2].reshape(-1), table[:, 1::-1].reshape(-1)
    types = np.repeat(table[:, 2], 2)
    types[1::2] += types[1::2] == 3
    mark = np.zeros(len(flat), bool)
    mark[list(linked)] = True
    return Graph(features, np.array([n["kind"] for n in flat], np.int64), mark, source, target, types)


@dataclass
class Field:
    """Weights: own[feature, label], chain[label, next label], agree[likeness, (nothing, a kind)]."""

    own: np.ndarray
    chain: np.ndarray
    agree: np.ndarray

    @classmethod
    def prior(cls) -> Field:
        """What holds without data: a mention alone is nothing, and like mentions have like labels."""
        own = np.zeros((len(FEATURES), len(KINDS) + 1))
        own[0, 0] = 2.0
        own[FEATURES.index("spelled at"), 0] = 3.0
        return cls(own, np.zeros((len(KINDS) + 1,) * 2), np.array([[0.5, 5.0], [0.5, 4.0], [0.5, 5.0]]))

    def potentials(self) -> np.ndarray:
        """(type, label of source, label of target) for the types of ``Graph``."""
        skip = np.stack([np.diag(np.append(nothing, np.full(len(KINDS), kind))) for nothing, kind in self.agree])
        return np.concatenate([skip, self.chain[None], self.chain.T[None]])

    def beliefs(self, g: Graph, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs (node, label) and messages (edge, label of target) after loopy message passing.

        ``held`` has the label that each node must have, or -1.
        """
        own = g.features @ self.own
        fixed = np.flatnonzero(held >= 0)
        own[fixed] = -HARD
        own[fixed, held[fixed]] = 0
        tables = np.exp(self.potentials())
        of_type = [np.flatnonzero(g.types == t) for t in range(len(tables))]
        back = np.arange(len(g.source)) ^ 1
        message = np.zeros((len(g.source), own.shape[1]))
        for _ in range(PASSES if len(g.source) else 0):
            heard = (own + self._gathered(message, g))[g.source] - message[back]
            heard = np.exp(heard - heard.max(axis=1, keepdims=True))
            sent = np.empty_like(message)
            for table, at in zip(tables, of_type, strict=True):
                sent[at] = np.log(heard[at] @ table)
            sent -= _logsum(sent, 1)[:, None]
            change = np.abs(sent - message).max()
            message += 0.7 * (sent - message)
            if change < 1e-4:
                break
        return own + self._gathered(message, g), message

    def posteriors(self, g: Graph, held: np.ndarray) -> np.ndarray:
        belief, _ = self.beliefs(g, held)
        return np.exp(belief - _logsum(belief, 1)[:, None])

    def marginals(self, g: Graph, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (node, label) and of edges (edge, label of source, label of target)."""
        belief, message = self.beliefs(g, held)
        back = np.arange(len(g.source)) ^ 1
        joint = (belief[g.source] - message[back])[:, :, None] + self.potentials()[g.types] + (belief[g.target] - message)[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if len(joint) else joint
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return np.exp(belief - _logsum(belief, 1)[:, None]), joint

    @staticmethod
    def _gathered(message: np.ndarray, g: Graph) -> np.ndarray:
        n, labels = len(g.features), message.shape[1]
        if not len(message):
            return np.zeros((n, labels))
        return np.stack([np.bincount(g.target, message[:, j], n) for j in range(labels)], axis=1)

    def expected(self, g: Graph, held: np.ndarray) -> np.ndarray:
        """Expected feature counts under the posteriors, in the order of ``flat``."""
        node, edge = self.marginals(g, held)
        own = g.features.T @ node
        chain = edge[g.types == 3].sum(axis=0)
        agree = []
        for t in range(3):
            same = np.einsum("eii->i", edge[(g.types == t) & (np.arange(len(g.types)) % 2 == 0)])
            agree.append([same[0], same[1:].sum()])
        return np.concatenate([own.ravel(), chain.ravel(), np.ravel(agree)])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.own.ravel(), self.chain.ravel(), self.agree.ravel()])

    @classmethod
    def shaped(cls, w: np.ndarray) -> Field:
        labels, k = len(KINDS) + 1, len(FEATURES)
        own, chain, agree = np.split(w, [k * labels, k * labels + labels**2])
        return cls(own.reshape(k, labels), chain.reshape(labels, labels), agree.reshape(3, 2))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True) if x.size else np.zeros_like(x.sum(axis=axis, keepdims=True))
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(documents: list[list[dict]], steps: int = STEPS) -> Field:
    """Weights by gradient steps on the likelihood of the labels, with a Gaussian around the prior.

    The gradient is what the labels make of the features less what the model alone expects; hidden nodes are summed out of both.
    """
    g = graph_of(documents)
    start = Field.prior().flat()
    if not len(g.kinds):
        return Field.prior()
    observed = np.where(g.kinds > 0, g.kinds, np.where(g.linked, -1, 0))
    w, mean, spread = start.copy(), np.zeros_like(start), np.zeros_like(start)
    free = np.full(len(g.kinds), -1)
    for step in range(1, steps + 1):
        model = Field.shaped(w)
        gradient = (model.expected(g, observed) - model.expected(g, free) - (w - start)) / len(g.kinds)
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        w = w + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field.shaped(w)


def labelled(documents: list[list[dict]], model: Field) -> list[list[tuple[int, float]]]:
    """(kind number, posterior) of each node; base spans keep their kind."""
    g = graph_of(documents)
    if not len(g.kinds):
        return [[] for _ in documents]
    posterior = model.posteriors(g, np.where(g.kinds > 0, g.kinds, -1))
    best = posterior.argmax(axis=1)
    sure = posterior[np.arange(len(best)), best]
    kind = np.where(g.kinds > 0, g.kinds, np.where(sure >= KEEP_FROM, best, 0)).tolist()
    rows, at = iter(zip(kind, sure.tolist(), strict=True)), [len(n) for n in documents]
    return [[next(rows) for _ in range(n)] for n in at]


def lots(documents: list[list[dict]], most: int = LOT_NODES) -> Iterator[list[list[dict]]]:
    """Runs of documents with at most ``most`` nodes together, or one document."""
    lot, size = [], 0
    for nodes in documents:
        if lot and size + len(nodes) > most:
            yield lot
            lot, size = [], 0
        lot.append(nodes)
        size += len(nodes)
    if lot:
        yield lot


# --- the passes

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, posterior: double>>"


def observe(docs: DataFrame) -> DataFrame:
    """``doc_id, nodes`` of each row; the texts are read once and not moved."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("features", pa.int64()), ("keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [nodes_of(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(node))], ["doc_id", "nodes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, nodes array<{NODE}>")


def fit(observed: DataFrame) -> Field:
    """Weights from at most TRAIN_DOCS documents with 1 to TRAIN_NODES mentions, by hash order."""
    own = observed.where(F.size("nodes").between(1, TRAIN_NODES))
    rows = own.orderBy(F.xxhash64("nodes"), "doc_id").limit(TRAIN_DOCS).select("nodes").collect()
    return train([[n.asDict() for n in r["nodes"]] for r in rows])


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``doc_id, spans`` for each row: base spans by kind and start with those the field adds, each with its posterior.

    Without a model one is fitted on these documents. A null or empty text has no spans; null and repeated ids and
    repeated rows stay as they are; an empty table gives no rows. Other columns are left out, whatever
    their names. A tie of two labels goes to nothing, then to the first kind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    observed = materialize(observe(docs), "pii-nodes")
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(observed))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("posterior", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = batch.column("nodes").to_pylist()
            out = []
            for nodes, kinds in zip(documents, (k for lot in lots(documents) for k in labelled(lot, sent.value)), strict=True):
                spans = [(k, n["start"], n["end"], n["kind"] > 0, p) for n, (k, p) in zip(nodes, kinds, strict=True) if k]
                out.append([(KINDS[k - 1], a, b, own, 1.0 if own else p) for k, a, b, own, p in sorted(spans)])
            rows = pa.array([[dict(zip(("kind", "start", "end", "base", "posterior"), s, strict=True)) for s in spans] for spans in out], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "spans"])

    return observed.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_skipchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of the whole documents table; nulls, ties, repeats and empty tables as in ``find``."""
    found = find(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
