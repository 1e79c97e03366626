"""Feature encoding: training, serving and legacy definitions of the same 30 features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.contract import (
    CONTIG_LENGTHS,
    FEATURE_DEFAULTS,
    FEATURE_ORDER,
    FEATURE_TYPES,
    OPTIMIZED_ORDER,
    REDUNDANT_FEATURES,
    REQUEST_SCORE_ALIASES,
    TARGET,
    TRANSITION_PAIRS,
    TRANSVERSION_PAIRS,
)
from variantloom.functions.genomic import contig_length, first_base, identity, normalize_chrom, unit_interval
from variantloom.functions.values import first_number, flag, to_number, within_type
from variantloom.operators.ingest import drop_columns, impute_sentinels, require_columns
from variantloom.session import materialize


def _c(name: str) -> Column:
    return F.col(name)


def _allele_features(df: DataFrame) -> DataFrame:
    """Length and first-base features from the text columns ``_ref`` and ``_alt``."""
    df = df.withColumn("Delta_Length", F.length("_alt") - F.length("_ref"))
    df = df.withColumns(
        {"Is_InDel": flag(_c("Delta_Length") != 0), "indel_size": F.abs("Delta_Length"), "REF_Base": first_base(_c("_ref"))}
    )
    df = df.withColumns(
        {
            "Is_Frameshift": flag((_c("Is_InDel") == 1) & (_c("indel_size") % 3 != 0)),
            "is_large_indel": flag(_c("indel_size") > 5),
            "ALT_Base": F.when(_c("Is_InDel") == 1, "-").otherwise(first_base(_c("_alt"))),
        }
    )
    pair = F.concat_ws("_", "REF_Base", "ALT_Base")
    return df.withColumn("mutation_type", F.when(_c("Is_InDel") == 1, "INDEL").otherwise(pair))


def _score_features(df: DataFrame) -> DataFrame:
    """Flags and interactions from SIFT, PolyPhen, CADD and ALT_FREQ, compared as doubles."""
    df = df.withColumns(
        {
            "freq_log": F.log1p("ALT_FREQ"),
            "rare_variant": flag(_c("ALT_FREQ") < 0.005),
            "is_ultra_rare": flag(_c("ALT_FREQ") < 0.001),
            "CADD_high": flag(_c("CADD") > 20),
            "CADD_very_high": flag(_c("CADD") > 30),
            "SIFT_damaging": flag((_c("SIFT") >= 0) & (_c("SIFT") < 0.05)),
            "PolyPhen_damaging": flag(_c("PolyPhen") > 0.85),
            "is_transition": flag(_c("mutation_type").isin(TRANSITION_PAIRS)),
            "is_transversion": flag(_c("mutation_type").isin(TRANSVERSION_PAIRS)),
        }
    )
    df = df.withColumn("Impact_Score", impact_score())
    return df.withColumns(
        {"CADD_x_rare": _c("CADD") * _c("rare_variant"), "rare_impact": _c("rare_variant") * _c("Impact_Score")}
    )


def impact_score() -> Column:
    return (
        _c("Is_Frameshift") * 3.0
        + _c("is_large_indel") * 2.0
        + _c("indel_size") * 0.1
        + _c("is_ultra_rare") * 2.0
        + _c("CADD_high") * 2.0
    )


def _position_features(df: DataFrame, length: Column, single_precision: bool) -> DataFrame:
    """Relative position; in single precision the bin is taken from the rounded value."""
    relative = unit_interval(F.coalesce(_c("_pos") / length, F.lit(0.0)))
    df = df.withColumn("normalized_pos", relative.cast("float") if single_precision else relative)
    tenth = F.floor(_c("normalized_pos") * F.lit(10).cast("float" if single_precision else "double"))
    return df.withColumns(
        {
            "pos_bin": F.greatest(F.lit(0), F.least(F.lit(9), tenth)),
            "pos_freq_interaction": _c("normalized_pos") * _c("ALT_FREQ"),
        }
    )


def _typed(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select(*[within_type(_c(n), FEATURE_TYPES[n]).alias(n) for n in FEATURE_ORDER], *extra)


def training_rows(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Every row feature of the training encoding (no chromosome aggregates), in double precision."""
    key = identity(df)
    base = df.select(
        *carry,
        normalize_chrom(key["chrom"].cast("string"), "training").alias("CHROM"),
        to_number(_c("SIFT_score"), -1.0).alias("SIFT"),
        to_number(_c("Polyphen2_HDIV_score"), -1.0).alias("PolyPhen"),
        to_number(_c("CADD_phred"), -1.0).alias("CADD"),
        to_number(_c("gnomAD_exomes_AF"), 0.0).alias("ALT_FREQ"),
        F.coalesce(_c("target").try_cast("int"), F.lit(0)).alias(TARGET),
        to_number(key["pos"], 0.0).alias("_pos"),
        F.coalesce(key["ref"], F.lit("")).alias("_ref"),
        F.coalesce(key["alt"], F.lit("")).alias("_alt"),
    )
    return _position_features(_score_features(_allele_features(base)), contig_length(_c("CHROM")), single_precision=True)


def chrom_stats(encoded_rows: DataFrame) -> DataFrame:
    """Mean frequency and rare rate per chromosome: the table that serving joins."""
    return encoded_rows.groupBy("CHROM").agg(
        F.avg("ALT_FREQ").alias("chrom_freq_mean"), F.avg("rare_variant").alias("chrom_rare_rate")
    )


def attach_chrom_stats(rows: DataFrame, stats: DataFrame, on: str = "CHROM") -> DataFrame:
    """Broadcast a *stored* stats table back to the rows.

    Aggregating and joining keeps a chromosome with a third of all rows spread over all tasks,
    where a window would sort it in one. No hint is given: the stored table has a known size,
    so Catalyst broadcasts it when it fits and falls back to a skew-split join when not.
    """
    joined = rows.drop("chrom_freq_mean", "chrom_rare_rate").join(stats, on, "left")
    return joined.withColumns(
        {c: F.coalesce(_c(c), F.lit(0.0)) for c in ("chrom_freq_mean", "chrom_rare_rate")}
    )


TRAINING_INPUT = [
    "SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF", "target",
]


def encode_features(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Model-ready variants to the 30 contract features plus ``Target``."""
    require_columns(df, TRAINING_INPUT)
    rows = training_rows(df)
    if stats is None:
        stats = materialize(chrom_stats(rows), "chrom-stats")
    return _typed(attach_chrom_stats(rows, stats), _c(TARGET))


def _request_columns(df: DataFrame) -> list[str]:
    """Columns whose names differ, in any spelling, from every feature."""
    taken = {n.lower() for n in FEATURE_ORDER}
    return [c for c in df.columns if c.lower() not in taken]


def serving_rows(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Row features of the serving encoding: aliases resolved, unknown contigs take chr1's length."""
    key = identity(df)
    scores = {
        name: F.coalesce(first_number(df, REQUEST_SCORE_ALIASES[role]), F.lit(FEATURE_DEFAULTS[name]))
        for name, role in (("SIFT", "sift"), ("PolyPhen", "polyphen"), ("CADD", "cadd"), ("ALT_FREQ", "alt_freq"))
    }
    base = df.select(
        *[_c(f"`{c}`") for c in carry],
        normalize_chrom(F.coalesce(key["chrom"].cast("string"), F.lit("1")), "serving").alias("CHROM"),
        *[c.alias(n) for n, c in scores.items()],
        to_number(key["pos"], 0.0).alias("_pos"),
        *[F.upper(F.coalesce(F.nullif(key[a], F.lit("")), F.lit("N"))).alias(f"_{a}") for a in ("ref", "alt")],
    )
    length = F.coalesce(contig_length(_c("CHROM")), F.lit(float(CONTIG_LENGTHS["1"])))
    return _position_features(_score_features(_allele_features(base)), length, single_precision=False)


def build_serving_features(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Request rows with their contract features appended; columns named like a feature give way to it.

    Without ``stats`` the chromosome aggregates are the neutral 0.0.
    """
    carry = _request_columns(df)
    rows = serving_rows(df, carry)
    if stats is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in ("chrom_freq_mean", "chrom_rare_rate")})
    else:
        rows = attach_chrom_stats(rows, stats)
    return rows.select(*[_c(f"`{c}`") for c in carry], *[_c(n).try_cast(FEATURE_TYPES[n]).alias(n) for n in FEATURE_ORDER])


def optimize_dataset(encoded: DataFrame) -> DataFrame:
    """Distinct rows, imputed, without redundant features, with two interactions added."""
    df = drop_columns(impute_sentinels(encoded.dropDuplicates()), REDUNDANT_FEATURES)
    frequency = _c("ALT_FREQ").cast("double")
    df = df.withColumns(
        {
            "high_impact_rare": flag((_c("Impact_Score") > F.lit(0.7)) & (frequency < 0.01)).cast("tinyint"),
            "cadd_rare_interaction": (_c("CADD") * F.log1p(1.0 / (frequency + 1e-9))).cast("float"),
        }
    )
    tail = [TARGET] if TARGET in df.columns else []
    return df.select(*OPTIMIZED_ORDER, *tail)


def _legacy_score(df: DataFrame, names: list[str]) -> Column:
    source = next((n for n in names if n in df.columns), None)
    value = _c(source).try_cast("float") if source else F.lit(None).cast("float")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("float")), F.lit(0.0).cast("float"))


def legacy_rows(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Row features of the retired web form: single precision, zeros for missing, five position bins."""
    key = identity(df)
    single = lambda x: F.lit(x).cast("float")
    df = df.select(
        *carry,
        key["chrom"].cast("string").alias("CHROM"),
        key["ref"].alias("_ref"),
        key["alt"].alias("_alt"),
        F.coalesce(key["pos"].try_cast("float"), single(0.0)).alias("_pos"),
        _legacy_score(df, ["SIFT_score", "SIFT"]).alias("SIFT"),
        _legacy_score(df, ["Polyphen2_HVAR_score", "Polyphen2_HDIV_score", "PolyPhen"]).alias("PolyPhen"),
        _legacy_score(df, ["CADD_phred", "CADD"]).alias("CADD"),
        _legacy_score(df, ["gnomAD_exomes_AF", "ALT_FREQ"]).alias("ALT_FREQ"),
    )
    df = df.withColumn("Delta_Length", F.octet_length("_alt") - F.octet_length("_ref"))
    df = df.withColumns(
        {
            "Is_InDel": flag(_c("Delta_Length") != 0),
            "indel_size": F.abs("Delta_Length"),
            "REF_Base": F.coalesce(F.nullif(F.substring("_ref", 1, 1), F.lit("")), F.lit(FEATURE_DEFAULTS["REF_Base"])),
            "ALT_Base": F.coalesce(F.nullif(F.substring("_alt", 1, 1), F.lit("")), F.lit(FEATURE_DEFAULTS["ALT_Base"])),
        }
    )
    snp = (F.length("_ref") == 1) & (F.length("_alt") == 1)
    df = df.withColumn("mutation_type", F.concat_ws("_", "REF_Base", "ALT_Base"))
    relative = _c("_pos").cast("double") / F.coalesce(contig_length(_c("CHROM")), F.lit(2e8))
    df = df.withColumns(
        {
            "Is_Frameshift": flag((_c("Is_InDel") == 1) & (_c("indel_size") % 3 != 0)),
            "is_large_indel": flag(_c("indel_size") > 5),
            "freq_log": F.log1p(_c("ALT_FREQ").cast("double")),
            "rare_variant": flag(_c("ALT_FREQ") < single(0.005)),
            "is_ultra_rare": flag(_c("ALT_FREQ") < single(0.001)),
            "CADD_high": flag(_c("CADD") > single(20)),
            "CADD_very_high": flag(_c("CADD") > single(30)),
            "SIFT_damaging": flag(_c("SIFT") < single(0.05)),
            "PolyPhen_damaging": flag(_c("PolyPhen") > single(0.85)),
            "normalized_pos": relative,
            "is_transition": flag(snp & _c("mutation_type").isin(TRANSITION_PAIRS)),
            "is_transversion": flag(snp & ~_c("mutation_type").isin(TRANSITION_PAIRS)),
        }
    )
    common = single(1.0) - F.greatest(single(0.0), F.least(single(1.0), _c("ALT_FREQ")))
    floored = F.greatest(F.lit(0.0), _c("normalized_pos"))
    df = df.withColumns(
        {
            "Impact_Score": impact_score(),
            "CADD_x_rare": _c("CADD").cast("double") * common.cast("double"),
            "pos_bin": sum((flag(floored > edge) for edge in (0.25, 0.5, 0.75, 1.0)), F.lit(0)),
            "pos_freq_interaction": _c("normalized_pos") * _c("ALT_FREQ").cast("double"),
            "chrom_freq_mean": _c("ALT_FREQ").cast("double"),
            "chrom_rare_rate": _c("rare_variant").cast("double"),
        }
    )
    return df.withColumn("rare_impact", _c("rare_variant") * _c("Impact_Score"))


def legacy_ui_features(df: DataFrame) -> DataFrame:
    return _typed(legacy_rows(df))


def feature_skew_report(clean: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per feature, how many variants the serving and legacy encodings disagree on with training.

    The three encodings are row expressions over the same row, so they are nested into structs
    and compared in one scan without any join of the data with itself.
    """
    if stats is None:
        stats = materialize(chrom_stats(training_rows(clean)), "chrom-stats")
    row_features = [n for n in FEATURE_ORDER if n not in ("chrom_freq_mean", "chrom_rare_rate")]
    rows = clean.select(F.struct(*[_c(f"`{c}`") for c in clean.columns]).alias("_row"))
    sides: list[str] = []
    for side, encoder in (("train", training_rows), ("serve", serving_rows), ("legacy", legacy_rows)):
        flat = rows.select("_row.*", "_row", *sides)
        encoded = encoder(flat, ["_row", *sides])
        rows = encoded.select("_row", *sides, F.struct(*row_features).alias(side))
        sides.append(side)
    joined = rows.join(stats.withColumnRenamed("CHROM", "_chrom"), _c("train.CHROM") == _c("_chrom"), "left")

    def value(side: str, name: str) -> Column:
        if name in ("chrom_freq_mean", "chrom_rare_rate"):
            own = _c("legacy.ALT_FREQ" if name == "chrom_freq_mean" else "legacy.rare_variant")
            by_side = {"train": F.coalesce(_c(name), F.lit(0.0)), "serve": F.lit(0.0), "legacy": own}
            return within_type(by_side[side], FEATURE_TYPES[name])
        return within_type(F.col(f"{side}.{name}"), FEATURE_TYPES[name])

    # the numbers of the (feature, side) pairs that differ, most rows none: only those are exploded and counted
    sides = ("serve", "legacy")
    differs = [
        F.when(~value("train", name).eqNullSafe(value(side, name)), F.lit(2 * i + k))
        for i, name in enumerate(FEATURE_ORDER) for k, side in enumerate(sides)
    ]
    marked = joined.select(F.explode(F.array_append(F.array_compact(F.array(*differs)), F.lit(-1))).alias("pair"))
    counts = materialize(marked.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "feature-skew")
    variants = counts.agg(F.coalesce(F.max(F.when(_c("pair") == -1, _c("n"))), F.lit(0)).alias("variants"))
    total = lambda k: F.coalesce(F.max(F.when(_c("pair") == 2 * _c("place") + k, _c("n"))), F.lit(0))
    features = clean.sparkSession.createDataFrame(list(enumerate(FEATURE_ORDER)), "place int, feature string")
    by_feature = features.join(counts, F.expr("pair div 2 = place AND pair >= 0"), "left").groupBy("feature").agg(total(0).alias("serving_mismatches"), total(1).alias("legacy_mismatches"))
    return by_feature.select("feature", variants.select("variants").scalar().alias("variants"), "serving_mismatches", "legacy_mismatches")
