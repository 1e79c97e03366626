"""Schemas, feature order and defaults of the variant tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------
INGEST_COLUMNS = [
    "#chr", "pos(1-based)", "ref", "alt",
    "SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF", "clinvar_clnsig",
]
SCORE_COLUMNS = ["SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF"]

# name, type, default: the model's input columns in their fixed order
FEATURE_CONTRACT = [
    ("CHROM", "string", "1"),
    ("SIFT", "float", -1.0),
    ("PolyPhen", "float", -1.0),
    ("CADD", "float", -1.0),
    ("ALT_FREQ", "float", 0.0),
    ("Is_InDel", "tinyint", 0),
    ("Delta_Length", "smallint", 0),
    ("indel_size", "smallint", 0),
    ("Is_Frameshift", "tinyint", 0),
    ("REF_Base", "string", "N"),
    ("ALT_Base", "string", "N"),
    ("mutation_type", "string", "N_N"),
    ("freq_log", "float", 0.0),
    ("rare_variant", "tinyint", 0),
    ("is_ultra_rare", "tinyint", 0),
    ("is_large_indel", "tinyint", 0),
    ("CADD_high", "tinyint", 0),
    ("CADD_very_high", "tinyint", 0),
    ("SIFT_damaging", "tinyint", 0),
    ("PolyPhen_damaging", "tinyint", 0),
    ("CADD_x_rare", "float", 0.0),
    ("Impact_Score", "float", 0.0),
    ("rare_impact", "float", 0.0),
    ("normalized_pos", "float", 0.0),
    ("pos_bin", "tinyint", 0),
    ("pos_freq_interaction", "float", 0.0),
    ("is_transition", "tinyint", 0),
    ("is_transversion", "tinyint", 0),
    ("chrom_freq_mean", "float", 0.0),
    ("chrom_rare_rate", "float", 0.0),
]
TARGET = "Target"

REDUNDANT_FEATURES = ["is_transversion", "freq_log", "rare_impact", "CADD_x_rare", "pos_bin", "PolyPhen_damaging"]
MONITORED_FEATURES = ["CADD", "SIFT", "PolyPhen", "ALT_FREQ"]
MONITORING_RENAMES = {"cadd": "CADD", "sift": "SIFT", "polyphen": "PolyPhen", "alt_freq": "ALT_FREQ", "chrom": "CHROM"}
REPORT_CANDIDATES = MONITORED_FEATURES + ["prediction", "CHROM", "mutation_type"]

# alias columns in order of preference
IDENTITY_ALIASES = {
    "chrom": ["#chr", "CHROM", "chrom"],
    "pos": ["pos(1-based)", "POS", "pos"],
    "ref": ["ref", "REF"],
    "alt": ["alt", "ALT"],
}
STORE_SCORE_ALIASES = {
    "sift": ["SIFT_score", "SIFT"],
    "polyphen": ["Polyphen2_HVAR_score", "Polyphen2_HDIV_score", "PolyPhen"],
    "cadd": ["CADD_phred", "CADD"],
    "alt_freq": ["gnomAD_exomes_AF", "ALT_FREQ"],
}
REQUEST_SCORE_ALIASES = {
    "sift": ["sift", "SIFT", "SIFT_score"],
    "polyphen": ["polyphen", "PolyPhen", "Polyphen2_HVAR_score", "Polyphen2_HDIV_score"],
    "cadd": ["cadd", "CADD", "CADD_phred"],
    "alt_freq": ["alt_freq", "ALT_FREQ", "gnomAD_exomes_AF"],
}

LEGAL_RANGES = {"sift": (0.0, 1.0), "polyphen": (0.0, 1.0), "cadd": (0.0, 60.0), "alt_freq": (0.0, 1.0)}

# GRCh38 contig lengths
CONTIG_LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259,
    "6": 170805979, "7": 159345973, "8": 145138636, "9": 138394717, "10": 133797422,
    "11": 135086622, "12": 133275309, "13": 114364328, "14": 107043718, "15": 101991189,
    "16": 90338345, "17": 83257441, "18": 80373285, "19": 58617616, "20": 64444167,
    "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415, "M": 16569,
}
TRANSITION_PAIRS = ["A_G", "G_A", "C_T", "T_C"]
TRANSVERSION_PAIRS = ["A_C", "C_A", "A_T", "T_A", "C_G", "G_C", "G_T", "T_G"]
REVIEW_STATUSES = ["Needs review", "Reviewed", "Flagged", "Exported"]
LATENCY_BUCKETS_SECONDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
LOW_CONFIDENCE = 0.6
# --- end of fixed values ----------------------------------------------------------------

FEATURE_ORDER = [name for name, _, _ in FEATURE_CONTRACT]
FEATURE_TYPES = {name: kind for name, kind, _ in FEATURE_CONTRACT}
FEATURE_DEFAULTS = {name: default for name, _, default in FEATURE_CONTRACT}
CATEGORICAL_FEATURES = [name for name, kind, _ in FEATURE_CONTRACT if kind == "string"]
NUMERIC_FEATURES = [name for name, kind, _ in FEATURE_CONTRACT if kind != "string"]
OPTIMIZED_ORDER = [n for n in FEATURE_ORDER if n not in REDUNDANT_FEATURES] + [
    "high_impact_rare",
    "cadd_rare_interaction",
]

EVENT_NUMERIC = ["latency_ms", "sift", "polyphen", "cadd", "alt_freq", "probability", "confidence_score"]
EVENT_TEXT = ["timestamp", "endpoint", "source", "status", "model_uri", "chrom", "pos", "ref", "alt", "error"]

# every field is read as text, so that one bad value never costs the whole event
EVENT_TEXT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in EVENT_TEXT + EVENT_NUMERIC + ["prediction", "_corrupt_record"]]
)
