"""Exact duplicates, digests first: whole rows move only where a digest recurs.

A row's digest is 16 bytes, so finding the digests that recur shuffles little, and copies are combined within each task before
that. Rows whose digest is their own are certainly distinct and stay where they are. The others are compared as
whole rows, so two rows that only share a digest both stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.values import ratio
from variantloom.session import materialize

Digest = Callable[[list[str]], tuple[Column, Column]]
BROADCAST_DIGESTS = 1_000_000  # 16 bytes each; with more of them the rows are grouped as they are


def row_digest(columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of all columns; -0.0 and 0.0, and all NaN, are alike, as they are in a group."""
    cells = [F.col(f"`{c}`") for c in columns]
    marks = [c.isNull() for c in cells]  # a NULL leaves a hash as it is
    return F.xxhash64(*cells, *marks), F.xxhash64(F.lit(1), *marks, *cells)


def _with_digest(df: DataFrame, digest: Digest) -> tuple[DataFrame, list[str]]:
    mark = "_".join([*df.columns, "digest"])  # longer than any column, so not one of them
    names = [f"{mark}_a", f"{mark}_b"]
    return df.withColumns(dict(zip(names, digest(df.columns), strict=True))), names


def recurring_digests(df: DataFrame, digest: Digest = row_digest) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` with its digest, the stored digests that occur twice or more, and their names."""
    marked, names = _with_digest(df, digest)
    seen = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    return marked, materialize(seen, "recurring-digests"), names


def distinct_rows(df: DataFrame, digest: Digest = row_digest, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """The rows of ``df``, each once.

    The digests that recur are sent to all tasks when there are at most ``most`` of them. With more, most rows would move
    anyway, and they are grouped in one shuffle.
    """
    marked, seen, names = recurring_digests(df, digest)
    if seen.count() > most:
        return df.dropDuplicates()
    known = F.broadcast(seen.select(*names))  # at most 16 * most bytes
    alone = marked.join(known, names, "left_anti")
    again = marked.join(known, names, "left_semi")
    return alone.drop(*names).unionByName(again.drop(*names).dropDuplicates())


def duplicate_count(df: DataFrame, digest: Digest = row_digest, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """Repeats of a full row beyond its first copy: ``rows, duplicates, percent``."""
    marked, seen, names = recurring_digests(df, digest)
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    some = marked if seen.count() > most else marked.join(F.broadcast(seen.select(*names)), names, "left_semi")
    copies = some.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    repeats = F.coalesce(copies.agg(F.sum(F.col("_copies") - 1)).scalar(), F.lit(0)).cast("bigint")
    counted = total.withColumn("duplicates", repeats)
    return counted.withColumn("percent", ratio(F.col("duplicates"), F.col("rows"), 0.0) * 100)
