"""Feature encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query, rounded
from catalog.ingest import encoded
from catalog.oracle import ORACLE_VIEWS
from variantloom.operators import features


@query("encode_features", "SELECT * FROM o_encoded")
def encode_features(t: Tables):
    return features.encode_features(t.variants_clean)


@query(
    "chrom_aggregates",
    """SELECT CHROM, round(avg(ALT_FREQ), 6) AS chrom_freq_mean, round(avg(rare_variant), 6) AS chrom_rare_rate
    FROM o_rows GROUP BY CHROM""",
)
def chrom_aggregates(t: Tables):
    return rounded(features.chrom_stats(features.training_rows(t.variants_clean)))


@query(
    "chrom_length_dim",
    """SELECT CHROM, pos, ref, alt, CAST(rel AS FLOAT) AS normalized_pos FROM o_rows""",
)
def chrom_length_dim(t: Tables):
    rows = features.training_rows(t.variants_clean, ["pos"])
    return rows.select("CHROM", "pos", F.col("_ref").alias("ref"), F.col("_alt").alias("alt"), "normalized_pos")


ORACLE_VIEWS["o_serving"] = """
SELECT e.* REPLACE (CAST(rel2 AS FLOAT) AS normalized_pos,
    CAST(greatest(0, least(9, floor(rel2 * 10))) AS TINYINT) AS pos_bin,
    CAST(rel2 * freq AS FLOAT) AS pos_freq_interaction) FROM (
  SELECT r.CHROM AS CHROM, pos, ref, alt, CAST(SIFT AS FLOAT) AS SIFT, CAST(PolyPhen AS FLOAT) AS PolyPhen, CAST(CADD AS FLOAT) AS CADD,
    CAST(ALT_FREQ AS FLOAT) AS ALT_FREQ, CAST(Is_InDel AS TINYINT) AS Is_InDel, CAST(Delta_Length AS SMALLINT) AS Delta_Length,
    CAST(indel_size AS SMALLINT) AS indel_size, CAST(Is_Frameshift AS TINYINT) AS Is_Frameshift, REF_Base, ALT_Base,
    mutation_type, CAST(freq_log AS FLOAT) AS freq_log, CAST(rare_variant AS TINYINT) AS rare_variant,
    CAST(is_ultra_rare AS TINYINT) AS is_ultra_rare, CAST(is_large_indel AS TINYINT) AS is_large_indel,
    CAST(CADD_high AS TINYINT) AS CADD_high, CAST(CADD_very_high AS TINYINT) AS CADD_very_high,
    CAST(SIFT_damaging AS TINYINT) AS SIFT_damaging, CAST(PolyPhen_damaging AS TINYINT) AS PolyPhen_damaging,
    CAST(CADD * rare_variant AS FLOAT) AS CADD_x_rare, CAST(Impact_Score AS FLOAT) AS Impact_Score,
    CAST(rare_variant * Impact_Score AS FLOAT) AS rare_impact, CAST(0 AS FLOAT) AS normalized_pos, CAST(0 AS TINYINT) AS pos_bin,
    CAST(0 AS FLOAT) AS pos_freq_interaction,
    CAST(mutation_type IN ('A_G', 'G_A', 'C_T', 'T_C') AS TINYINT) AS is_transition,
    CAST(mutation_type IN ('A_C', 'C_A', 'A_T', 'T_A', 'C_G', 'G_C', 'G_T', 'T_G') AS TINYINT) AS is_transversion,
    CAST(m AS FLOAT) AS chrom_freq_mean, CAST(rr AS FLOAT) AS chrom_rare_rate, serving_rel AS rel2, ALT_FREQ AS freq
  FROM o_rows r JOIN (SELECT CHROM AS k, avg(ALT_FREQ) AS m, avg(rare_variant) AS rr FROM o_rows GROUP BY CHROM) s ON r.CHROM = s.k
) e
"""


@query("build_serving_features", "SELECT * EXCLUDE (rel2, freq) FROM o_serving")
def build_serving_features(t: Tables):
    clean = t.variants_clean
    stats = t.stored("chrom_stats", lambda: features.chrom_stats(features.training_rows(clean)))
    served = features.build_serving_features(clean, stats)
    return served.select("CHROM", "pos", "ref", "alt", *features.FEATURE_ORDER[1:])


@query(
    "optimize_dataset",
    """SELECT DISTINCT CHROM, SIFT, PolyPhen, CADD, ALT_FREQ, Is_InDel, Delta_Length, indel_size, Is_Frameshift, REF_Base,
      ALT_Base, mutation_type, rare_variant, is_ultra_rare, is_large_indel, CADD_high, CADD_very_high, SIFT_damaging,
      Impact_Score, normalized_pos, pos_freq_interaction, is_transition, chrom_freq_mean, chrom_rare_rate,
      CAST(Impact_Score > CAST(0.7 AS DOUBLE) AND CAST(ALT_FREQ AS DOUBLE) < CAST(0.01 AS DOUBLE) AS TINYINT) AS high_impact_rare,
      CAST(CAST(CADD AS DOUBLE) * ln(1 + 1 / (CAST(ALT_FREQ AS DOUBLE) + CAST(1e-9 AS DOUBLE))) AS FLOAT) AS cadd_rare_interaction, Target
    FROM (SELECT DISTINCT * FROM o_encoded) AS d""",
)
def optimize_dataset(t: Tables):
    return features.optimize_dataset(encoded(t))


ORACLE_VIEWS["o_legacy"] = """
SELECT CHROM, SIFT, PolyPhen, CADD, ALT_FREQ, Is_InDel, Delta_Length, indel_size, Is_Frameshift, REF_Base, ALT_Base, mutation_type,
  CAST(freq_log AS FLOAT) AS freq_log, rare_variant, is_ultra_rare, is_large_indel, CADD_high, CADD_very_high,
  CAST(SIFT < CAST(0.05 AS FLOAT) AS TINYINT) AS SIFT_damaging, CAST(PolyPhen > CAST(0.85 AS FLOAT) AS TINYINT) AS PolyPhen_damaging,
  CAST(CAST(CADD AS DOUBLE) * CAST(CAST(1 AS FLOAT) - ALT_FREQ AS DOUBLE) AS FLOAT) AS CADD_x_rare,
  CAST(impact AS FLOAT) AS Impact_Score, CAST(rare_variant * impact AS FLOAT) AS rare_impact, CAST(rel AS FLOAT) AS normalized_pos,
  CAST(CAST(rel > 0.25 AS INT) + CAST(rel > 0.5 AS INT) + CAST(rel > 0.75 AS INT) + CAST(rel > 1 AS INT) AS TINYINT) AS pos_bin,
  CAST(rel * CAST(ALT_FREQ AS DOUBLE) AS FLOAT) AS pos_freq_interaction,
  CAST(Is_InDel = 0 AND mutation_type IN ('A_G', 'G_A', 'C_T', 'T_C') AS TINYINT) AS is_transition,
  CAST(Is_InDel = 0 AND mutation_type NOT IN ('A_G', 'G_A', 'C_T', 'T_C') AS TINYINT) AS is_transversion,
  ALT_FREQ AS chrom_freq_mean, CAST(rare_variant AS FLOAT) AS chrom_rare_rate
FROM (
  SELECT v.chrom AS CHROM, CAST(coalesce(SIFT_score, 0) AS FLOAT) AS SIFT, CAST(coalesce(Polyphen2_HDIV_score, 0) AS FLOAT) AS PolyPhen,
    CAST(coalesce(CADD_phred, 0) AS FLOAT) AS CADD, CAST(gnomAD_exomes_AF AS FLOAT) AS ALT_FREQ,
    CAST(length(alt) <> length(ref) AS TINYINT) AS Is_InDel, CAST(length(alt) - length(ref) AS SMALLINT) AS Delta_Length,
    CAST(abs(length(alt) - length(ref)) AS SMALLINT) AS indel_size,
    CAST(abs(length(alt) - length(ref)) % 3 <> 0 AS TINYINT) AS Is_Frameshift,
    substr(ref, 1, 1) AS REF_Base, substr(alt, 1, 1) AS ALT_Base, substr(ref, 1, 1) || '_' || substr(alt, 1, 1) AS mutation_type,
    ln(1 + CAST(CAST(gnomAD_exomes_AF AS FLOAT) AS DOUBLE)) AS freq_log,
    CAST(CAST(gnomAD_exomes_AF AS FLOAT) < CAST(0.005 AS FLOAT) AS TINYINT) AS rare_variant,
    CAST(CAST(gnomAD_exomes_AF AS FLOAT) < CAST(0.001 AS FLOAT) AS TINYINT) AS is_ultra_rare,
    CAST(abs(length(alt) - length(ref)) > 5 AS TINYINT) AS is_large_indel,
    CAST(coalesce(CADD_phred, 0) > 20 AS TINYINT) AS CADD_high, CAST(coalesce(CADD_phred, 0) > 30 AS TINYINT) AS CADD_very_high,
    CAST(CASE WHEN abs(length(alt) - length(ref)) % 3 <> 0 THEN 3 ELSE 0 END AS DOUBLE)
      + CASE WHEN abs(length(alt) - length(ref)) > 5 THEN 2 ELSE 0 END + abs(length(alt) - length(ref)) * CAST(0.1 AS DOUBLE)
      + CASE WHEN CAST(gnomAD_exomes_AF AS FLOAT) < CAST(0.001 AS FLOAT) THEN 2 ELSE 0 END
      + CASE WHEN coalesce(CADD_phred, 0) > 20 THEN 2 ELSE 0 END AS impact,
    CAST(CAST(pos AS FLOAT) AS DOUBLE) / coalesce(CAST(chr_length AS DOUBLE), CAST(200000000 AS DOUBLE)) AS rel
  FROM variants_clean v LEFT JOIN contig_lengths c ON v.chrom = c.chrom
) AS base
"""


@query("legacy_ui_features", "SELECT * FROM o_legacy")
def legacy_ui_features(t: Tables):
    return features.legacy_ui_features(t.variants_clean)


def _skew_sql() -> str:
    """Compares the rows of the three definitions position by position, one UNION branch per feature."""
    legacy = ORACLE_VIEWS["o_legacy"].strip().replace(
        "SELECT v.chrom AS CHROM,", "SELECT pos, ref, alt, v.chrom AS CHROM,", 1
    ).replace("SELECT CHROM, SIFT,", "SELECT pos, ref, alt, CHROM, SIFT,", 1)
    train = ORACLE_VIEWS["o_encoded"].strip().replace("SELECT r.CHROM AS CHROM,", "SELECT pos, ref, alt, r.CHROM AS CHROM,", 1)
    parts = []
    for name in features.FEATURE_ORDER:
        serve = "0" if name in ("chrom_freq_mean", "chrom_rare_rate") else f's."{name}"'
        parts.append(
            f"""SELECT '{name}' AS feature, CAST(count(*) AS BIGINT) AS variants,
            CAST(count(*) FILTER (WHERE e."{name}" IS DISTINCT FROM {serve}) AS BIGINT) AS serving_mismatches,
            CAST(count(*) FILTER (WHERE e."{name}" IS DISTINCT FROM l."{name}") AS BIGINT) AS legacy_mismatches
            FROM e JOIN s ON e.i = s.i JOIN l ON e.i = l.i"""
        )
    serving = "SELECT * EXCLUDE (rel2, freq) FROM o_serving"
    # missing scores are -1 in two definitions and 0 in the third: order by what all of them share
    shared = "ORDER BY CHROM, pos, ref, alt, ALT_FREQ, greatest(SIFT, 0), greatest(PolyPhen, 0), greatest(CADD, 0)"
    return (
        f"WITH e AS (SELECT *, row_number() OVER ({shared}) AS i FROM ({train}) a),\n"
        f"s AS (SELECT *, row_number() OVER ({shared}) AS i FROM ({serving}) b),\n"
        f"l AS (SELECT *, row_number() OVER ({shared}) AS i FROM ({legacy}) c)\n" + "\nUNION ALL ".join(parts)
    )


@query("feature_skew_report", _skew_sql())
def feature_skew_report(t: Tables):
    return features.feature_skew_report(t.variants_clean)
