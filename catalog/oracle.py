"""DuckDB-side helper views, shared by the oracle texts."""

from __future__ import annotations

from variantloom.fixtures import VIEWS, with_clause

ORACLE_VIEWS: dict[str, str] = dict(VIEWS)

# row features of the training encoding, in double precision
ORACLE_VIEWS["o_rows"] = """
SELECT CHROM, SIFT, PolyPhen, CADD, ALT_FREQ, Target, ref, alt, pos,
  dl AS Delta_Length, abs(dl) AS indel_size, CAST(dl <> 0 AS INT) AS Is_InDel,
  CAST(dl <> 0 AND abs(dl) % 3 <> 0 AS INT) AS Is_Frameshift, CAST(abs(dl) > 5 AS INT) AS is_large_indel,
  rb AS REF_Base, CASE WHEN dl <> 0 THEN '-' ELSE ab END AS ALT_Base,
  CASE WHEN dl <> 0 THEN 'INDEL' ELSE rb || '_' || ab END AS mutation_type,
  ln(1 + ALT_FREQ) AS freq_log,
  CAST(ALT_FREQ < CAST(0.005 AS DOUBLE) AS INT) AS rare_variant,
  CAST(ALT_FREQ < CAST(0.001 AS DOUBLE) AS INT) AS is_ultra_rare,
  CAST(CADD > 20 AS INT) AS CADD_high, CAST(CADD > 30 AS INT) AS CADD_very_high,
  CAST(SIFT >= 0 AND SIFT < CAST(0.05 AS DOUBLE) AS INT) AS SIFT_damaging,
  CAST(PolyPhen > CAST(0.85 AS DOUBLE) AS INT) AS PolyPhen_damaging,
  CAST(CASE WHEN dl <> 0 AND abs(dl) % 3 <> 0 THEN 3 ELSE 0 END AS DOUBLE)
    + CASE WHEN abs(dl) > 5 THEN 2 ELSE 0 END + abs(dl) * CAST(0.1 AS DOUBLE)
    + CASE WHEN ALT_FREQ < CAST(0.001 AS DOUBLE) THEN 2 ELSE 0 END
    + CASE WHEN CADD > 20 THEN 2 ELSE 0 END AS Impact_Score,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(pos / CAST(chr_length AS DOUBLE), CAST(0 AS DOUBLE)))) AS rel,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), pos / CAST(coalesce(chr_length, 248956422) AS DOUBLE))) AS serving_rel,
  pos / coalesce(CAST(chr_length AS DOUBLE), CAST(200000000 AS DOUBLE)) AS exact_rel
FROM (
  SELECT replace(v.chrom, 'chr', '') AS CHROM, coalesce(SIFT_score, CAST(-1 AS DOUBLE)) AS SIFT,
    coalesce(Polyphen2_HDIV_score, CAST(-1 AS DOUBLE)) AS PolyPhen, coalesce(CADD_phred, CAST(-1 AS DOUBLE)) AS CADD,
    gnomAD_exomes_AF AS ALT_FREQ, target AS Target, ref, alt, pos, chr_length,
    length(alt) - length(ref) AS dl, upper(substr(ref, 1, 1)) AS rb, upper(substr(alt, 1, 1)) AS ab
  FROM variants_clean v LEFT JOIN contig_lengths c ON replace(v.chrom, 'chr', '') = c.chrom
) AS base
"""

ORACLE_VIEWS["o_encoded"] = """
SELECT r.CHROM AS CHROM, CAST(SIFT AS FLOAT) AS SIFT, CAST(PolyPhen AS FLOAT) AS PolyPhen, CAST(CADD AS FLOAT) AS CADD,
  CAST(ALT_FREQ AS FLOAT) AS ALT_FREQ, CAST(Is_InDel AS TINYINT) AS Is_InDel, CAST(Delta_Length AS SMALLINT) AS Delta_Length,
  CAST(indel_size AS SMALLINT) AS indel_size, CAST(Is_Frameshift AS TINYINT) AS Is_Frameshift, REF_Base, ALT_Base,
  mutation_type, CAST(freq_log AS FLOAT) AS freq_log, CAST(rare_variant AS TINYINT) AS rare_variant,
  CAST(is_ultra_rare AS TINYINT) AS is_ultra_rare, CAST(is_large_indel AS TINYINT) AS is_large_indel,
  CAST(CADD_high AS TINYINT) AS CADD_high, CAST(CADD_very_high AS TINYINT) AS CADD_very_high,
  CAST(SIFT_damaging AS TINYINT) AS SIFT_damaging, CAST(PolyPhen_damaging AS TINYINT) AS PolyPhen_damaging,
  CAST(CADD * rare_variant AS FLOAT) AS CADD_x_rare, CAST(Impact_Score AS FLOAT) AS Impact_Score,
  CAST(rare_variant * Impact_Score AS FLOAT) AS rare_impact, CAST(rel AS FLOAT) AS normalized_pos,
  CAST(greatest(0, least(9, floor(CAST(rel AS FLOAT) * CAST(10 AS FLOAT)))) AS TINYINT) AS pos_bin,
  CAST(CAST(CAST(rel AS FLOAT) AS DOUBLE) * ALT_FREQ AS FLOAT) AS pos_freq_interaction,
  CAST(mutation_type IN ('A_G', 'G_A', 'C_T', 'T_C') AS TINYINT) AS is_transition,
  CAST(mutation_type IN ('A_C', 'C_A', 'A_T', 'T_A', 'C_G', 'G_C', 'G_T', 'T_G') AS TINYINT) AS is_transversion,
  CAST(s.m AS FLOAT) AS chrom_freq_mean, CAST(s.r AS FLOAT) AS chrom_rare_rate, Target
FROM o_rows r JOIN (
  SELECT CHROM, avg(ALT_FREQ) AS m, avg(rare_variant) AS r FROM o_rows GROUP BY CHROM
) AS s ON r.CHROM = s.CHROM
"""


def oracle_text(sql: str) -> str:
    return with_clause(sql.strip(), ORACLE_VIEWS)
