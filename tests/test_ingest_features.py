import math

import pytest
from pyspark.sql import functions as F

from variantloom.contract import FEATURE_ORDER, OPTIMIZED_ORDER
from variantloom.functions.genomic import normalize_chrom
from variantloom.operators import features, ingest, models
from variantloom.session import materialize

CLEAN = (
    "chrom string, pos bigint, ref string, alt string, SIFT_score double, Polyphen2_HDIV_score double, "
    "CADD_phred double, gnomAD_exomes_AF double, target int"
)


def encode(spark, *rows):
    table = spark.createDataFrame([(*r, 1) for r in rows], CLEAN)
    return features.encode_features(table).orderBy("mutation_type").collect()


def test_pathogenic_wins_over_benign_and_conflicting_counts_unless_strict(spark):
    texts = ["Benign/Likely_benign", "Conflicting_interpretations_of_pathogenicity", "Uncertain_significance", "", None, "Pathogenic"]
    raw = spark.createDataFrame([(t,) for t in texts], "clinvar_clnsig string")
    labelled = ingest.label_target(ingest.filter_labelled(raw))
    assert {(r.clinvar_clnsig, r.target) for r in labelled.collect()} == {(texts[0], 0), (texts[1], 1), (texts[5], 1)}
    assert ingest.label_target(raw, strict_labels=True).count() == 2


def test_scores_take_the_first_item_and_bad_text_is_missing(spark):
    texts = [".", ".;0.3", "0.3;.", " 0.1 ", "abc", "1e-3;2", ""]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r.s for r in ingest.clean_scores(raw, ["s"], "double").orderBy("i").collect()]
    assert got == [None, None, 0.3, 0.1, None, 0.001, None]
    later = [r.s for r in ingest.clean_scores(raw, ["s"], "double", first_valid=True).orderBy("i").collect()]
    assert later[1] == 0.3


def test_chromosome_dialects(spark):
    rows = spark.createDataFrame([("chr1",), ("CHRX",), (" x ",), ("chrx",)], "c string")
    got = {d: [r[0] for r in rows.select(normalize_chrom(F.col("c"), d)).collect()] for d in ("canonical", "training", "serving", "batch")}
    assert got["canonical"] == ["1", "X", "X", "X"]
    assert got["training"] == ["1", "CHRX", " x ", "x"]
    assert got["serving"] == ["1", "X", "X", "x"]
    assert got["batch"] == ["1", "CHRX", " X ", "X"]


def test_contract_order_defaults_and_missing_columns(spark):
    df = spark.createDataFrame([("x", "7.5", None)], "CHROM string, CADD string, SIFT double")
    with pytest.raises(ValueError, match="ALT_Base"):
        ingest.enforce_contract(df)
    row = ingest.enforce_contract(df, fill_missing=True)
    assert row.columns == FEATURE_ORDER
    first = row.first()
    assert (first.CHROM, first.CADD, first.SIFT, first.PolyPhen, first.mutation_type) == ("x", 7.5, -1.0, -1.0, "N_N")


def test_ranges_and_aliases(spark):
    df = spark.createDataFrame([(1.5, 61.0), (0.5, 60.0), (None, None)], "sift double, cadd double")
    got = [(list(r.violations), r.accepted) for r in ingest.validate_ranges(df).collect()]
    assert got == [(["sift", "cadd"], False), ([], True), ([], True)]
    texts = spark.createDataFrame([("", "x", "0.5"), ("0.2", "1", "2")], "HVAR string, HDIV string, PolyPhen string")
    resolved = ingest.coalesce_aliases(texts, {"polyphen": ["HVAR", "HDIV", "PolyPhen"]})
    assert [r.polyphen for r in resolved.collect()] == [0.5, 0.2]


def test_encoded_edge_rows(spark):
    rows = {r.mutation_type: r for r in encode(
        spark,
        ("1", 0, "C", "T", 0.0, 0.85, 20.0, 0.001),
        ("X", 999_999_999, "AC", "GT", 0.05, 0.86, 30.1, 0.005),
        ("GL000", 5, "A", "ATTTTTT", None, None, None, 0.0),
        ("MT", -3, "", "", -1.0, None, 21.0, 0.004999),
    )}
    snv, mnv, indel, empty = rows["C_T"], rows["A_G"], rows["INDEL"], rows["N_N"]
    assert (snv.is_transition, snv.is_transversion, snv.CADD_high, snv.is_ultra_rare, snv.SIFT_damaging, snv.PolyPhen_damaging) == (1, 0, 0, 0, 1, 0)
    assert (mnv.is_transition, mnv.rare_variant, mnv.CADD_very_high, mnv.SIFT_damaging, mnv.normalized_pos, mnv.pos_bin) == (1, 0, 1, 0, 1.0, 9)
    assert (indel.Delta_Length, indel.indel_size, indel.Is_Frameshift, indel.is_large_indel, indel.ALT_Base) == (6, 6, 0, 1, "-")
    assert indel.SIFT == -1.0 and indel.normalized_pos == 0.0
    assert math.isclose(indel.Impact_Score, 2.0 + 0.6 + 2.0, rel_tol=1e-6)
    assert (empty.REF_Base, empty.Is_InDel, empty.normalized_pos, empty.rare_variant) == ("N", 0, 0.0, 1)


def test_serving_uses_chr1_length_and_neutral_aggregates(spark):
    request = spark.createDataFrame([("GL000", "248956422", "a", "", None)], "chrom string, pos string, ref string, alt string, cadd double")
    row = features.build_serving_features(request).first()
    assert (row.normalized_pos, row.pos_bin, row.CADD, row.mutation_type, row.chrom_freq_mean) == (1.0, 9, -1.0, "A_N", 0.0)


def test_encode_keeps_rows_and_flags_stay_binary(spark):
    table = spark.createDataFrame([("1", i, "A" * (1 + i % 3), "C", None, 0.1 * (i % 9), float(i), i / 1e4, i % 2) for i in range(200)], CLEAN)
    encoded = features.encode_features(table)
    assert encoded.columns == [*FEATURE_ORDER, "Target"] and encoded.count() == 200
    assert encoded.where("is_transition + is_transversion > 1 OR rare_variant NOT IN (0, 1) OR pos_bin NOT BETWEEN 0 AND 9").count() == 0
    again = features.optimize_dataset(encoded.unionByName(encoded))
    assert again.columns == [*OPTIMIZED_ORDER, "Target"] and again.count() == encoded.distinct().count()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="gnomAD_exomes_AF"):
        features.encode_features(spark.createDataFrame([("1",)], "chrom string"))


def test_long_alleles_stay_inside_their_type(spark):
    rows = encode(spark, ("1", 10, "A", "G" * 40001, 0.1, 0.2, 30.0, 0.0))
    assert rows[0].Delta_Length == 32767 and rows[0].indel_size == 32767
    wide = spark.createDataFrame([(1e9, None)], "Delta_Length double, indel_size double")
    kept = ingest.enforce_contract(wide, fill_missing=True).first()
    assert (kept.Delta_Length, kept.indel_size) == (32767, 0) and None not in kept


def test_training_and_importance_with_many_contigs(spark):
    rows = [(f"K{i % 90}", 1000 + i, "A", "G" if i % 2 else "T", 0.1 + i % 2, 0.2, float(i % 2 * 20 + i % 5), 0.0, i % 2) for i in range(400)]
    encoded = materialize(features.encode_features(spark.createDataFrame(rows, CLEAN)), "encoded")
    split = models.split_training_table(encoded)
    model = models.train_gbt(split, max_iter=1, max_depth=2)
    assert models.model_scorer(model)(encoded).where("probability IS NOT NULL").count() == 400
    importance = {r.feature: r.importance for r in models.permutation_importance(model, encoded).collect()}
    assert set(importance) == set(FEATURE_ORDER) and max(importance.values()) > 0
