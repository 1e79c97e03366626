"""Projection, filter and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query, rounded
from variantloom.functions.genomic import identity, normalize_chrom
from variantloom.operators import features, ingest

RAW = "variant_id, chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF, clinvar_clnsig"


@query(
    "prune_columns",
    "SELECT chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF, clinvar_clnsig FROM variants_raw",
)
def prune_columns(t: Tables):
    return ingest.prune_columns(t.variants_raw, [c.strip() for c in RAW.split(",")][1:])


@query("filter_labelled", f"SELECT {RAW} FROM variants_raw WHERE clinvar_clnsig IS NOT NULL AND clinvar_clnsig <> ''")
def filter_labelled(t: Tables):
    return ingest.filter_labelled(t.variants_raw)


@query(
    "label_target",
    """SELECT variant_id, clinvar_clnsig, CASE WHEN lower(clinvar_clnsig) LIKE '%pathogenic%' THEN 1 ELSE 0 END AS target
    FROM variants_raw WHERE lower(clinvar_clnsig) LIKE '%pathogenic%' OR lower(clinvar_clnsig) LIKE '%benign%'""",
)
def label_target(t: Tables):
    return ingest.label_target(t.variants_raw.select("variant_id", "clinvar_clnsig"))


@query(
    "clean_scores",
    """SELECT variant_id, try_cast(split_part(SIFT_score, ';', 1) AS FLOAT) AS SIFT_score,
      try_cast(split_part(Polyphen2_HDIV_score, ';', 1) AS FLOAT) AS Polyphen2_HDIV_score,
      try_cast(split_part(CADD_phred, ';', 1) AS FLOAT) AS CADD_phred,
      try_cast(split_part(gnomAD_exomes_AF, ';', 1) AS FLOAT) AS gnomAD_exomes_AF FROM variants_raw""",
)
def clean_scores(t: Tables):
    scores = ["SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF"]
    return ingest.clean_scores(t.variants_raw.select("variant_id", *scores))


@query(
    "fill_missing_af",
    """SELECT variant_id, coalesce(try_cast(split_part(gnomAD_exomes_AF, ';', 1) AS FLOAT), 0) AS gnomAD_exomes_AF
    FROM variants_raw""",
)
def fill_missing_af(t: Tables):
    return ingest.fill_missing_af(ingest.clean_scores(t.variants_raw.select("variant_id", "gnomAD_exomes_AF"), ["gnomAD_exomes_AF"]))


@query("model_ready", "SELECT * FROM variants_clean")
def model_ready(t: Tables):
    return ingest.model_ready(t.variants_raw, dtype="double").drop("variant_id")


@query(
    "drop_columns",
    """SELECT CHROM, SIFT, PolyPhen, CADD, ALT_FREQ, Is_InDel, Delta_Length, indel_size, Is_Frameshift, REF_Base, ALT_Base,
      mutation_type, rare_variant, is_ultra_rare, is_large_indel, CADD_high, CADD_very_high, SIFT_damaging, Impact_Score,
      normalized_pos, pos_freq_interaction, is_transition, chrom_freq_mean, chrom_rare_rate, Target FROM o_encoded""",
)
def drop_columns(t: Tables):
    return ingest.drop_columns(encoded(t), [*features.REDUNDANT_FEATURES, "not_there"])


@query(
    "coerce_numeric",
    """SELECT variant_id, coalesce(try_cast(SIFT_score AS DOUBLE), CAST(-1 AS DOUBLE)) AS SIFT_score,
      coalesce(try_cast(CADD_phred AS DOUBLE), CAST(-1 AS DOUBLE)) AS CADD_phred,
      coalesce(try_cast(gnomAD_exomes_AF AS DOUBLE), CAST(0 AS DOUBLE)) AS gnomAD_exomes_AF FROM variants_raw""",
)
def coerce_numeric(t: Tables):
    wanted = t.variants_raw.select("variant_id", "SIFT_score", "CADD_phred", "gnomAD_exomes_AF")
    return ingest.coerce_numeric(wanted, {"SIFT_score": -1.0, "CADD_phred": -1.0, "gnomAD_exomes_AF": 0.0})


@query(
    "require_columns",
    "SELECT chrom, target, CAST(count(*) AS BIGINT) AS variants FROM variants_clean GROUP BY chrom, target",
)
def require_columns(t: Tables):
    checked = ingest.require_columns(t.variants_clean, features.TRAINING_INPUT)
    return checked.groupBy("chrom", "target").agg(F.count(F.lit(1)).alias("variants"))


CONTRACT_SQL = """SELECT v.chrom AS CHROM, CAST(coalesce(SIFT_score, -1) AS FLOAT) AS SIFT,
  CAST(coalesce(Polyphen2_HDIV_score, -1) AS FLOAT) AS PolyPhen, CAST(coalesce(CADD_phred, -1) AS FLOAT) AS CADD,
  CAST(gnomAD_exomes_AF AS FLOAT) AS ALT_FREQ, CAST(0 AS TINYINT) AS Is_InDel, CAST(0 AS SMALLINT) AS Delta_Length,
  CAST(0 AS SMALLINT) AS indel_size, CAST(0 AS TINYINT) AS Is_Frameshift, ref AS REF_Base, 'N' AS ALT_Base,
  'N_N' AS mutation_type, CAST(0 AS FLOAT) AS freq_log, CAST(0 AS TINYINT) AS rare_variant,
  CAST(0 AS TINYINT) AS is_ultra_rare, CAST(0 AS TINYINT) AS is_large_indel, CAST(0 AS TINYINT) AS CADD_high,
  CAST(0 AS TINYINT) AS CADD_very_high, CAST(0 AS TINYINT) AS SIFT_damaging, CAST(0 AS TINYINT) AS PolyPhen_damaging,
  CAST(0 AS FLOAT) AS CADD_x_rare, CAST(0 AS FLOAT) AS Impact_Score, CAST(0 AS FLOAT) AS rare_impact,
  CAST(0 AS FLOAT) AS normalized_pos, CAST(0 AS TINYINT) AS pos_bin, CAST(0 AS FLOAT) AS pos_freq_interaction,
  CAST(0 AS TINYINT) AS is_transition, CAST(0 AS TINYINT) AS is_transversion, CAST(0 AS FLOAT) AS chrom_freq_mean,
  CAST(0 AS FLOAT) AS chrom_rare_rate FROM variants_clean v"""


@query("enforce_contract", CONTRACT_SQL)
def enforce_contract(t: Tables):
    partial = t.variants_clean.select(
        F.col("chrom").alias("CHROM"),
        F.col("SIFT_score").alias("SIFT"),
        F.col("Polyphen2_HDIV_score").alias("PolyPhen"),
        F.col("CADD_phred").cast("string").alias("CADD"),
        F.col("gnomAD_exomes_AF").alias("ALT_FREQ"),
        F.col("ref").alias("REF_Base"),
    )
    return ingest.enforce_contract(partial, fill_missing=True)


@query(
    "rename_monitoring_columns",
    """SELECT event_id, chrom AS CHROM, cadd AS CADD, sift AS SIFT, polyphen AS PolyPhen, alt_freq AS ALT_FREQ
    FROM prediction_events""",
)
def rename_monitoring_columns(t: Tables):
    return ingest.rename_monitoring_columns(t.prediction_events.select("event_id", "chrom", "cadd", "sift", "polyphen", "alt_freq"))


@query(
    "coalesce_aliases",
    """SELECT variant_id, coalesce(try_cast(nullif(CADD_phred, '') AS DOUBLE), try_cast(SIFT_score AS DOUBLE)) AS cadd,
      coalesce(try_cast(split_part(Polyphen2_HDIV_score, ';', 1) AS DOUBLE), try_cast(SIFT_score AS DOUBLE)) AS polyphen
    FROM variants_raw""",
)
def coalesce_aliases(t: Tables):
    raw = t.variants_raw.select(
        "variant_id", "CADD_phred", F.split_part("Polyphen2_HDIV_score", F.lit(";"), F.lit(1)).alias("HDIV"), "SIFT_score"
    )
    return ingest.coalesce_aliases(raw, {"cadd": ["CADD_phred", "SIFT_score"], "polyphen": ["HVAR", "HDIV", "SIFT_score"]})


@query(
    "resolve_identity_columns",
    """SELECT chrom, CAST(count(*) AS BIGINT) AS variants, CAST(min(pos) AS BIGINT) AS first_pos, max(alt) AS last_alt
    FROM variants_raw GROUP BY chrom""",
)
def resolve_identity_columns(t: Tables):
    raw = t.variants_raw.withColumnsRenamed({"chrom": "#chr", "pos": "pos(1-based)"})
    key = identity(raw)
    named = raw.select(*[c.alias(role) for role, c in key.items()])
    return named.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("variants"), F.min("pos").alias("first_pos"), F.max("alt").alias("last_alt")
    )


@query(
    "normalize_chrom",
    """SELECT request_id, regexp_replace(upper(trim(chrom)), '^CHR', '') AS canonical, replace(chrom, 'chr', '') AS training,
      CASE WHEN lower(trim(chrom)) LIKE 'chr%' THEN substr(trim(chrom), 4) ELSE upper(trim(chrom)) END AS serving,
      upper(replace(chrom, 'chr', '')) AS batch FROM variant_requests""",
)
def normalize_chrom_query(t: Tables):
    chrom = F.col("chrom")
    return t.variant_requests.select(
        "request_id", *[normalize_chrom(chrom, d).alias(d) for d in ("canonical", "training", "serving", "batch")]
    )


@query(
    "validate_ranges",
    """SELECT chrom, pos, ref, alt, coalesce(CADD_phred NOT BETWEEN 0 AND 60, false) = false AS accepted,
      CASE WHEN CADD_phred NOT BETWEEN 0 AND 60 THEN 'cadd' ELSE '' END AS violations FROM store_lake""",
)
def validate_ranges(t: Tables):
    scores = t.store_lake.withColumnsRenamed(
        {"SIFT_score": "sift", "Polyphen2_HDIV_score": "polyphen", "CADD_phred": "cadd", "gnomAD_exomes_AF": "alt_freq"}
    )
    checked = ingest.validate_ranges(scores)
    return checked.select("chrom", "pos", "ref", "alt", "accepted", F.concat_ws(",", "violations").alias("violations"))


@query(
    "drop_all_null_rows",
    """SELECT event_id, probability, confidence_score FROM prediction_events
    WHERE probability IS NOT NULL OR confidence_score IS NOT NULL""",
)
def drop_all_null_rows(t: Tables):
    wanted = t.prediction_events.select("event_id", "probability", "confidence_score")
    return ingest.drop_all_null_rows(wanted, ["probability", "confidence_score"])


@query(
    "select_common_columns",
    """SELECT 'reference' AS side, CHROM, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(CADD AS DOUBLE)), 6) AS mean_cadd FROM o_encoded GROUP BY CHROM
    UNION ALL SELECT 'current', chrom, CAST(count(*) AS BIGINT), round(avg(cadd), 6) FROM prediction_events GROUP BY chrom""",
)
def select_common_columns(t: Tables):
    current = ingest.rename_monitoring_columns(t.prediction_events)
    sides = ingest.select_common_columns(encoded(t), current)
    parts = [
        side.groupBy(F.lit(name).alias("side"), "CHROM").agg(F.count(F.lit(1)).alias("n"), F.avg("CADD").alias("mean_cadd"))
        for name, side in zip(("reference", "current"), sides)
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    "impute_sentinels",
    """SELECT chrom, pos, ref, alt, coalesce(SIFT_score, -1) AS SIFT, coalesce(Polyphen2_HDIV_score, -1) AS PolyPhen,
      coalesce(CADD_phred, -1) AS CADD FROM variants_clean""",
)
def impute_sentinels(t: Tables):
    return ingest.impute_sentinels(
        t.variants_clean.select(
            "chrom", "pos", "ref", "alt", F.col("SIFT_score").alias("SIFT"),
            F.col("Polyphen2_HDIV_score").alias("PolyPhen"), F.col("CADD_phred").alias("CADD"),
        )
    )


def encoded(t: Tables):
    """The encoded training table, written once like the stage output it is."""
    return t.stored("encoded", lambda: features.encode_features(t.variants_clean))
