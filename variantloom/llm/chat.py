"""Chat formatting by columnar byte assembly.

A turn becomes ``<|role|>\\n`` + text + ``<|end|>\\n``. In a text, every ``<`` that is followed by
backslashes and ``|`` gets one more backslash behind it, so that no text holds ``<|`` and the step can be
undone; roles are percent-coded. Lengths of all segments of a batch give offsets, and the bytes of the
role and text columns are scattered into one preallocated buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table, slices

OPEN, CLOSE, END = b"<|", b"|>\n", b"<|end|>\n"
TURN = re.compile(rb"<\|([^|<>\n]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
ROLE_CODES = [("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")]


def escape_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape_text(data: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", data)


def code_roles(roles: pa.Array) -> pa.Array:
    for plain, coded in ROLE_CODES:
        roles = pc.replace_substring(roles, plain, coded)
    return roles


def decode_role(data: bytes) -> bytes:
    for plain, coded in reversed(ROLE_CODES):
        data = data.replace(coded.encode(), plain.encode())
    return data


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a text column, nulls as empty."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; start of each turn (and the end), start and end of each text."""
    role_bytes, role_len = _column(code_roles(pc.fill_null(roles.cast(pa.large_string()), "")))
    text_bytes, text_len = _column(escape_texts(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(role_len)
    turn_len = len(OPEN) + role_len + len(CLOSE) + text_len + len(END)
    starts = np.concatenate([[0], np.cumsum(turn_len)]).astype(np.int64)
    out = np.empty(int(starts[-1]), np.uint8)

    def fixed(at: np.ndarray, what: bytes) -> None:
        for i, byte in enumerate(what):
            out[at + i] = byte

    def scattered(at: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
        before = np.cumsum(lengths) - lengths
        out[np.arange(len(data)) + np.repeat(at - before, lengths)] = data

    role_at = starts[:n] + len(OPEN)
    text_at = role_at + role_len + len(CLOSE)
    fixed(starts[:n], OPEN)
    scattered(role_at, role_bytes, role_len)
    fixed(role_at + role_len, CLOSE)
    scattered(text_at, text_bytes, text_len)
    fixed(text_at + text_len, END)
    return out, starts, text_at, text_at + text_len


def format_conversations(df: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss``: the formatted turns of each conversation in order.

    ``loss`` lists (start, end) byte spans of the texts of role ``learn_from`` in ``formatted``. Turns
    are ordered by turn (null first), then role, then text; repeated rows stay. A null role or text is
    empty; null conv_id is a conversation of its own. Only conv_id, turn, role and text are read,
    further columns are left out. A conversation longer than an Arrow batch comes in several
    consecutive parts, so that no task holds one whole; parts stay in order within their partition.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in slices(batches, "text"):
            out, starts, text_at, text_end = assemble(batch.column("role"), batch.column("text"))
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            rows = []
            for conv, group in groupby(range(len(ids)), key=ids.__getitem__):
                turns = list(group)
                first, end = turns[0], turns[-1] + 1
                part = part + 1 if conv == last else 0
                last = conv
                loss = [(int(text_at[i] - starts[first]), int(text_end[i] - starts[first])) for i in turns if roles[i] == learn_from]
                rows.append((conv, part, len(turns), out[starts[first] : starts[end]].tobytes().decode(), [{"start": a, "end": b} for a, b in loss]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), span]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "formatted", "loss"])

    kind = df.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    turns = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return turns.mapInArrow(run, f"conv_id {kind}, part bigint, n_turns bigint, formatted string, loss array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from the formatted bytes and the loss spans.

    Takes the result of :func:`format_conversations` as it comes: parts of a conversation follow each other.
    """

    def characters(data: bytes) -> int:
        return len(data.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_row: list | None = None

        def closed(row: list) -> tuple:
            return row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5]

        kind = pa.int64()
        for batch in batches:
            rows = []
            kind = batch.schema.field("conv_id").type
            for conv, part, formatted, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")], strict=True):
                if part == 0:
                    if open_row:
                        rows.append(closed(open_row))
                    open_row = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = formatted.encode()
                for role, text in TURN.findall(data):
                    open_row[1] += 1
                    open_row[2].update(decode_role(role) + b"\n" + unescape_text(text) + b"\n")
                for span in loss:
                    learned = unescape_text(data[span["start"] : span["end"]])
                    open_row[3] += characters(learned)
                    open_row[4].update(learned)
                open_row[5] += len(formatted)
            if rows:
                yield _rows(rows, names, kind)
        if open_row:
            yield _rows([closed(open_row)], names, kind)

    def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold foreign control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe)))
