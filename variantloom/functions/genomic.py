"""Column helpers for contigs, alleles and variant classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.contract import CONTIG_LENGTHS, IDENTITY_ALIASES

CHROM_DIALECTS = ("canonical", "training", "serving", "batch")


def normalize_chrom(c: Column, dialect: str = "canonical") -> Column:
    """Contig name without its ``chr`` prefix.

    ``canonical`` folds every spelling together. The others keep the quirks of one consumer:
    ``training`` drops a lower-case ``chr`` anywhere, ``serving`` folds case only when there is
    no prefix, ``batch`` drops a lower-case ``chr`` anywhere and then folds case.
    """
    if dialect == "canonical":
        return F.regexp_replace(F.upper(F.trim(c)), "^CHR", "")
    if dialect == "training":
        return F.replace(c, F.lit("chr"), F.lit(""))
    if dialect == "batch":
        return F.upper(F.replace(c, F.lit("chr"), F.lit("")))
    if dialect == "serving":
        trimmed = F.trim(c)
        return F.when(F.lower(trimmed).startswith("chr"), F.substring(trimmed, 4, 1 << 30)).otherwise(F.upper(trimmed))
    raise ValueError(f"unknown chromosome dialect {dialect!r}; expected one of {CHROM_DIALECTS}")


def first_base(c: Column, default: str = "N") -> Column:
    return F.coalesce(F.nullif(F.upper(F.substring(c, 1, 1)), F.lit("")), F.lit(default))


def contig_length(chrom: Column) -> Column:
    """Length of a known contig as a double, NULL for any other (a 25-entry literal map)."""
    entries = [F.lit(x) for name, length in CONTIG_LENGTHS.items() for x in (name, float(length))]
    return F.try_element_at(F.create_map(*entries), chrom)


def unit_interval(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def variant_label(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit(" "), ref, F.lit(">"), alt)


def allele_kind(alt: Column) -> Column:
    """Tells symbolic ALT texts from plain base strings."""
    return (
        F.when(alt.rlike("^[ACGTN]+$"), "bases")
        .when(alt == ".", "missing")
        .when(alt == "*", "spanning")
        .otherwise("symbolic")
    )


def resolve_identity_columns(df: DataFrame) -> dict[str, str]:
    """Which columns of ``df`` hold chrom, pos, ref and alt; an error names what is missing."""
    found = {role: next((n for n in names if n in df.columns), None) for role, names in IDENTITY_ALIASES.items()}
    missing = sorted(role for role, name in found.items() if name is None)
    if missing:
        raise ValueError(f"table lacks variant identity columns: {missing}")
    return found


def identity(df: DataFrame) -> dict[str, Column]:
    return {role: F.col(f"`{name}`") for role, name in resolve_identity_columns(df).items()}
