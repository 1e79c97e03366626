import numpy as np
import pytest
from pyspark.sql import functions as F

from variantloom.operators import evaluate, profile, scoring
from variantloom.operators.ranks import bucket_count, exact_quantiles, prefix_sums

SCORED = "target int, probability double"


def scored(spark, pairs):
    return spark.createDataFrame(pairs, SCORED)


def brute_ranking(y, p):
    tp = fp = ap = area = 0.0
    positives, negatives = sum(y), len(y) - sum(y)
    for score in sorted(set(p), reverse=True):
        a = sum(1 for t, q in zip(y, p) if q == score and t == 1)
        b = sum(1 for t, q in zip(y, p) if q == score and t == 0)
        area += b * (tp + tp + a) / 2
        tp, fp = tp + a, fp + b
        ap += a / positives * tp / (tp + fp)
    return ap, area / positives / negatives


def test_separable_scores(spark):
    df = scored(spark, [(0, 0.05), (0, 0.2), (1, 0.7), (1, 0.9)])
    best = evaluate.best_threshold(evaluate.threshold_sweep(df, n=10)).first()
    assert 0.25 <= best.best_threshold < 0.75 and best.best_f1 == 1.0
    m = evaluate.classification_metrics(df, 0.5).first()
    assert (m.pr_auc, m.roc_auc, m.f1_score) == (1.0, 1.0, 1.0) and 0 <= m.brier_score <= 1 and m.log_loss > 0


def test_calibration_bins_are_right_closed(spark):
    df = scored(spark, [(0, 0.0), (0, 0.1), (1, 0.30000000000000004), (1, 0.3), (1, 1.0), (1, 1.5)])
    got = {r.bin: r["count"] for r in evaluate.calibration_table(df).collect()}
    assert got == {0: 2, 2: 2, 9: 1}
    two = evaluate.calibration_table(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]), 2)
    assert sum(r["count"] for r in two.collect()) == 4
    assert evaluate.expected_calibration_error(two).first()[0] == pytest.approx(0.15)


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 600).tolist(), (rng.integers(0, 90, 600) / 90).tolist()
    got = evaluate.ranking_metrics(evaluate.ranked_scores(evaluate.score_histogram(scored(spark, list(zip(y, p)))))).first()
    ap, auc = brute_ranking(y, p)
    assert got.pr_auc == pytest.approx(ap) and got.roc_auc == pytest.approx(auc)


def test_one_class_and_empty_thresholds(spark):
    df = scored(spark, [(0, 0.4), (0, 0.6)])
    best = evaluate.best_threshold(evaluate.threshold_sweep(df)).first()
    assert (best.best_threshold, best.best_f1) == (0.5, 0.0)
    m = evaluate.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1_score, m.pr_auc, m.roc_auc) == (0.0, 0.0, 0.0, 0.0, None)


def test_lowest_threshold_wins_ties(spark):
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, [(1, 0.9), (0, 0.01)]))).first()
    assert best.best_threshold == pytest.approx(0.05)


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0, 2.0], list(np.linspace(-3, 8, 501)), [0.0] * 700 + list(range(1, 400))])
def test_quantiles_match_numpy_even_with_a_hot_value(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "value double").groupBy("value").agg(F.count("*").alias("n"))
    row = exact_quantiles(df, [], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [row.a, row.b, row.c] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.9]).tolist())


def test_prefix_sums_per_group(spark):
    rows = [(g, float(v), v % 7 + 1) for g in "ab" for v in range(300)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, value double, n long"), ["g"], "value", ["n"]).orderBy("g", "value").collect()
    expected = np.cumsum([v % 7 + 1 for v in range(300)]).tolist() * 2
    assert [r.cum_n for r in got] == expected and {r.tot_n for r in got} == {expected[-1]}


def test_bucket_count_grows_with_the_histogram_and_any_power_of_two_works(spark):
    assert [bucket_count(n) for n in (10, 64_000_001, 10**12)] == [64, 128, 1048576]
    hist = spark.createDataFrame([(float(v), 1) for v in range(50)], "value double, n long")
    for buckets in (2, 256):
        got = prefix_sums(hist, [], "value", ["n"], buckets).orderBy("value").collect()
        assert [r.cum_n for r in got] == list(range(1, 51))


def test_a_null_group_is_kept(spark):
    rows = [(g, i % 2, i / 40) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, target int, probability double")
    got = {r.g: r for r in evaluate.metrics_by_group(df, ["g"]).collect()}
    assert set(got) == {"a", None} and got["a"].pr_auc == got[None].pr_auc is not None


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("target"))
    exact = evaluate.stratified_split_exact(df, "target", ["id"]).groupBy("target", "split").count().collect()
    counts = {(r.target, r.split): r["count"] for r in exact}
    assert counts[(1, "train")] == 700 and counts[(0, "train")] == 2100 and counts[(1, "validation")] == 150 and counts[(0, "test")] == 450
    hashed = evaluate.stratified_split(df, ["id"])
    assert hashed.count() == 4000 and evaluate.leakage(hashed, ["id"]).count() == 0
    folds = {r.fold: r["count"] for r in evaluate.stratified_kfold(df, ["id"]).groupBy("fold").count().collect()}
    assert sorted(folds) == [1, 2, 3, 4, 5] and min(folds.values()) > 650
    sample = evaluate.stratified_sample(df, 400, "target", ["id"])
    assert {r.target: r["count"] for r in sample.groupBy("target").count().collect()} == {0: 300, 1: 100}


def test_best_run_gate(spark):
    schema = "run_id string, status string, stage string, pr_auc double, start_time long"
    runs = [("latest", "FINISHED", "training", 0.86, 300), ("best", "FINISHED", "training", 0.93, 100), ("low", "FINISHED", "training", 0.79, 400)]
    assert evaluate.select_best_run(spark.createDataFrame(runs, schema)).first().run_id == "best"
    assert evaluate.select_best_run(spark.createDataFrame(runs[2:], schema)).count() == 0


def test_version_reuse(spark):
    versions = spark.createDataFrame([("2", 1, "a"), ("10", 1, "a"), ("3", 1, "b")], "version string, run_id int, source string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a")], "run_id int, source string")
    got = {r.run_id: (r.version, r.action) for r in evaluate.reuse_or_new_version(wanted, versions).collect()}
    assert got == {1: (10, "reuse"), 2: (None, "new")}


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert {r.c: r.c_code for r in evaluate.category_codes(df, ["c"]).collect()} == {"a": 0, "b": 1, None: -1}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), i % 2) for i in range(10)], "k double, x double, Target int")
    got = {r.feature: r.correlation for r in profile.target_correlation(df, top=None).collect()}
    assert got["k"] is None and got["x"] is not None


def test_audit_exact_and_approximate_agree_on_small_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], "s string, n int")
    for approximate in (False, True):
        rows = {r.column: r for r in profile.schema_audit(df, approximate=approximate).collect()}
        assert (rows["n"].non_null, rows["n"].null_count, rows["n"].unique_values) == (2, 1, 2)
        assert rows["s"].unique_values == 2


def test_sort_modes_order_rows_with_missing_last(spark):
    rows = [("1", "5", "A", "G", 0.2, 0.8), ("2", "1", "A", "G", 0.9, 0.9), ("X", "7", "C", "T", None, None), ("10", "3", "A", "G", 0.9, 0.6), ("2", "1", "A", "C", 0.2, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "request_id int, chrom string, pos string, ref string, alt string, probability double, confidence_score double")
    order = {mode: [r.request_id for r in scoring.sort_batch_results(df, mode, ties=["request_id"]).collect()] for mode in scoring.SORT_MODES}
    assert order["probability_desc"] == [1, 3, 0, 4, 2]
    assert order["probability_asc"] == [0, 4, 1, 3, 2]
    assert order["confidence_desc"] == [1, 0, 3, 2, 4]
    labels = [f"{c}:{p} {r}>{a}" for c, p, r, a, *_ in rows]
    assert order["variant_asc"] == sorted(range(5), key=lambda i: (labels[i], i))


def test_models_rank_by_ap_then_f1_then_name(spark):
    table = spark.createDataFrame([("b", 0.9, 0.5), ("a", 0.9, 0.5), ("c", 0.9, 0.7), ("d", 0.95, 0.1)], "model string, pr_auc double, f1_score double")
    assert [r.model for r in evaluate.rank_models(table).collect()] == ["d", "c", "a", "b"]
    assert evaluate.winner(table).first().model == "d"


def test_missing_probabilities_count_nowhere(spark):
    clean = scored(spark, [(0, 0.2), (1, 0.7), (1, 0.4)])
    dirty = scored(spark, [(0, 0.2), (1, 0.7), (1, 0.4), (1, float("nan")), (0, None)])
    for df in (clean, dirty):
        m = evaluate.classification_metrics(df, 0.4).first()
        assert (m.tp, m.fp, m.tn, m.fn) == (2, 0, 1, 0) and m.pr_auc == 1.0 and m.brier_score == pytest.approx((0.04 + 0.09 + 0.36) / 3)
    sweep = [evaluate.threshold_sweep(df, 10).select("threshold", "tp", "fp").collect() for df in (clean, dirty)]
    assert sorted(sweep[0]) == sorted(sweep[1])


def test_a_chosen_threshold_means_the_same_in_metrics_and_calls(spark):
    df = scored(spark, [(1, 0.4), (0, 0.39)])
    assert evaluate.confusion_at_threshold(df, 0.4).first().tp == 1
    assert [r.label for r in scoring.score_postprocess(df, 0.4).orderBy("probability").collect()] == ["BENIGN", "PATHOGENIC"]
    assert scoring.score_postprocess(scored(spark, [(1, 0.5)])).first().prediction == 0


def test_many_classes_and_categories(spark):
    df = spark.range(3000).select(F.format_string("c%05d", F.col("id") % 1500).alias("k"), F.col("id").alias("key"))
    split = evaluate.stratified_split_exact(df, "k", ["key"], (0.5, 0.0))
    assert {r["count"] for r in split.where("split = 'train'").groupBy("k").count().collect()} == {1}
    codes = {r.k: r.k_code for r in evaluate.category_codes(df, ["k"]).collect()}
    assert codes == {f"c{i:05d}": i for i in range(1500)}
    gaps = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert {r.k: r.k_code for r in evaluate.category_codes(gaps, ["k"]).collect()} == {"a": 0, "b": 1, None: -1}


def test_correlation_uses_every_row_that_has_both_values(spark):
    rows = [(float(i), 2.0 * i, None if i % 3 else float(-i), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, Target int")
    got = {(r.feature_a, r.feature_b): r.r for r in profile.high_correlation_pairs(df).collect()}
    assert got == {("a", "b"): pytest.approx(1.0), ("a", "c"): pytest.approx(-1.0), ("b", "c"): pytest.approx(-1.0)}
