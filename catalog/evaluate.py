"""Model-evaluation queries over the scored views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, real, rounded
from catalog.ingest import encoded
from catalog.oracle import ORACLE_VIEWS
from variantloom.operators import evaluate
from variantloom.session import fresh_path
from variantloom.sources import sinks

KEY = ["chrom", "pos", "ref", "alt"]
_HASH = "md5(concat_ws('|', '42', chrom, CAST(pos AS VARCHAR), ref, alt))"
ORACLE_VIEWS["o_split"] = f"""
SELECT chrom, pos, ref, alt, target, CASE WHEN h < 'b3333333' THEN 'train' WHEN h < 'd9999999' THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, substr({_HASH}, 1, 8) AS h FROM variants_clean) x
"""
ORACLE_VIEWS["o_folds"] = f"""
SELECT *, 1 + CAST(h >= '33333333' AS INT) + CAST(h >= '66666666' AS INT) + CAST(h >= '99999999' AS INT) + CAST(h >= 'cccccccc' AS INT) AS fold
FROM (SELECT *, substr({_HASH}, 1, 8) AS h FROM scored_variants) x
"""


@query("stratified_split", "SELECT * FROM o_split")
def stratified_split(t: Tables):
    return evaluate.stratified_split(t.variants_clean.select(*KEY, "target"), KEY)


@query(
    "stratified_split_exact",
    f"""SELECT chrom, pos, ref, alt, target, CASE WHEN last <= floor(n * 0.7 + 0.5) THEN 'train' WHEN last <= floor(n * 0.85 + 0.5) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n, count(*) OVER (PARTITION BY target ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
      FROM (SELECT chrom, pos, ref, alt, target, {_HASH} AS h FROM variants_clean) x) y""",
)
def stratified_split_exact(t: Tables):
    return evaluate.stratified_split_exact(t.variants_clean.select(*KEY, "target"), "target", KEY)


@query("stratified_kfold", "SELECT chrom, pos, ref, alt, target, fold FROM o_folds")
def stratified_kfold(t: Tables):
    return evaluate.stratified_kfold(t.scored_variants.select(*KEY, "target"), KEY)


@query(
    "holdout_by_chromosome",
    """SELECT chrom, CASE WHEN chrom IN ('8', '21', 'X') THEN 'holdout' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS variants,
      CAST(sum(target) AS BIGINT) AS pathogenic FROM variants_clean GROUP BY chrom""",
)
def holdout_by_chromosome(t: Tables):
    split = evaluate.holdout_by_chromosome(t.variants_clean, ["8", "21", "X"])
    return split.groupBy("chrom", "split").agg(F.count(F.lit(1)).alias("variants"), F.sum("target").alias("pathogenic"))


_LEAKY = "(SELECT chrom, pos, ref, alt, split FROM o_split UNION ALL SELECT chrom, pos, ref, alt, 'test' FROM o_split WHERE pos % 97 = 0)"


@query(
    "split_leakage",
    f"""SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS leaked, CAST((SELECT count(*) FROM (SELECT 1 FROM o_split
      GROUP BY chrom, pos, ref, alt HAVING count(DISTINCT split) > 1) c) AS BIGINT) AS leaked_unplanted
    FROM (SELECT count(DISTINCT split) AS n FROM {_LEAKY} u GROUP BY chrom, pos, ref, alt) k""",
)
def split_leakage(t: Tables):
    """Keys that lie in two splits, in the split table and in one with planted copies in the test split."""
    split = evaluate.stratified_split(t.variants_clean.select(*KEY, "target"), KEY).select(*KEY, "split")
    planted = split.unionByName(split.where("pos % 97 = 0").withColumn("split", F.lit("test")))
    n = F.count(F.lit(1))
    counts = [evaluate.leakage(df, KEY).agg(n).scalar() for df in (planted, split)]
    return planted.select(*KEY).distinct().agg(n.alias("keys")).withColumns({"leaked": counts[0], "leaked_unplanted": counts[1]})


@query(
    "random_sample",
    f"""SELECT chrom, pos, ref, alt, target FROM variants_clean ORDER BY {_HASH}, chrom, pos, ref, alt LIMIT 1000""",
)
def random_sample(t: Tables):
    return evaluate.random_sample(t.variants_clean.select(*KEY, "target"), 1000, KEY)


@query(
    "stratified_sample",
    f"""SELECT chrom, pos, ref, alt, target FROM (
      SELECT *, count(*) OVER (PARTITION BY target ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last,
        count(*) OVER (PARTITION BY target) AS n, count(*) OVER () AS total
      FROM (SELECT chrom, pos, ref, alt, target, {_HASH} AS h FROM variants_clean) x) y
    WHERE last <= floor(n * least(CAST(1 AS DOUBLE), CAST(2000 AS DOUBLE) / total) + 0.5)""",
)
def stratified_sample(t: Tables):
    return evaluate.stratified_sample(t.variants_clean.select(*KEY, "target"), 2000, "target", KEY)


_CUTS = ", ".join(f"({i}, CAST('{c!r}' AS DOUBLE))" for i, c in enumerate(evaluate.thresholds()))
ORACLE_VIEWS["o_sweep"] = f"""
SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
  SELECT c.slot, c.threshold, CAST(count(*) FILTER (WHERE probability >= c.threshold AND target = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE probability >= c.threshold AND target = 0) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE probability < c.threshold AND target = 1) AS BIGINT) AS fn
  FROM scored_variants, (VALUES {_CUTS}) c(slot, threshold) GROUP BY c.slot, c.threshold
) x
"""


@query("threshold_sweep", "SELECT CAST(slot AS INT) AS slot, round(threshold, 9) AS threshold, tp, fp, fn, round(f1, 9) AS f1 FROM o_sweep")
def threshold_sweep(t: Tables):
    return rounded(evaluate.threshold_sweep(t.scored_variants), 9)


@query("best_threshold", "SELECT round(threshold, 9) AS best_threshold, round(f1, 9) AS best_f1 FROM o_sweep ORDER BY f1 DESC, slot LIMIT 1")
def best_threshold(t: Tables):
    return rounded(evaluate.best_threshold(evaluate.threshold_sweep(t.scored_variants)), 9)


def confusion_sql(table: str, by: str = "", threshold: float = 0.5) -> str:
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy FROM (
      SELECT {lead}CAST(count(*) FILTER (WHERE probability >= {threshold} AND target = 1) AS BIGINT) AS tp,
        CAST(count(*) FILTER (WHERE probability >= {threshold} AND target = 0) AS BIGINT) AS fp,
        CAST(count(*) FILTER (WHERE probability < {threshold} AND target = 0) AS BIGINT) AS tn,
        CAST(count(*) FILTER (WHERE probability < {threshold} AND target = 1) AS BIGINT) AS fn FROM {table} {tail}) c"""


def ranking_sql(table: str, by: str = "") -> str:
    lead, part, tail = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""SELECT {lead}sum((tp / tot_p) * (ctp / (ctp + cfp))) AS pr_auc, sum((fp / tot_n) * ((ctp - tp) + ctp) / 2 / tot_p) AS roc_auc FROM (
      SELECT *, sum(tp) OVER ({part}ORDER BY p DESC) AS ctp, sum(fp) OVER ({part}ORDER BY p DESC) AS cfp, sum(tp) OVER ({part}) AS tot_p, sum(fp) OVER ({part}) AS tot_n
      FROM (SELECT {lead}probability AS p, CAST(sum(target) AS DOUBLE) AS tp, CAST(count(*) - sum(target) AS DOUBLE) AS fp FROM {table} GROUP BY {lead}probability) g) c {tail}"""


def losses_sql(table: str, by: str = "") -> str:
    lead, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    safe = "greatest(CAST(1e-7 AS DOUBLE), least(1 - CAST(1e-7 AS DOUBLE), probability))"
    return f"""SELECT {lead}avg((probability - target) * (probability - target)) AS brier_score,
      avg(-(target * ln({safe}) + (1 - target) * ln(1 - {safe}))) AS log_loss FROM {table} {tail}"""


_EDGES = ["0.1", "0.2", "0.30000000000000004", "0.4", "0.5", "0.6000000000000001", "0.7000000000000001", "0.8", "0.9"]
_BIN = " + ".join(f"CAST(probability > CAST('{e}' AS DOUBLE) AS INT)" for e in _EDGES)


def calibration_sql(table: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT *, abs(mean_predicted_probability - observed_pathogenic_rate) AS absolute_calibration_error FROM (
      SELECT {lead}{_BIN} AS bin, CAST(count(*) AS BIGINT) AS count, avg(probability) AS mean_predicted_probability, avg(target) AS observed_pathogenic_rate
      FROM {table} WHERE probability BETWEEN 0 AND 1 GROUP BY {lead}{_BIN}) b"""


def ece_sql(table: str, by: str = "") -> str:
    lead, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}sum(count * absolute_calibration_error) / sum(count) AS expected_calibration_error FROM ({calibration_sql(table, by)}) k {tail}"""


@query("confusion_at_threshold", f"SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(accuracy, 6) AS accuracy FROM ({confusion_sql('scored_variants')}) x")
def confusion_at_threshold(t: Tables):
    return rounded(evaluate.confusion_at_threshold(t.scored_variants))


@query("average_precision", f"SELECT round(pr_auc, 6) AS pr_auc FROM ({ranking_sql('scored')}) x")
def average_precision(t: Tables):
    return rounded(evaluate.average_precision(t.scored))


@query("roc_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({ranking_sql('scored')}) x")
def roc_auc(t: Tables):
    return rounded(evaluate.roc_auc(t.scored))


@query("ranking_metrics", f"SELECT round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM ({ranking_sql('scored_variants')}) x")
def ranking_metrics(t: Tables):
    return rounded(evaluate.ranking_metrics(evaluate.ranked_scores(evaluate.score_histogram(t.scored_variants))))


@query("brier_score", f"SELECT round(brier_score, 6) AS brier_score FROM ({losses_sql('scored_variants')}) x")
def brier_score(t: Tables):
    return rounded(evaluate.brier_score(t.scored_variants))


@query("log_loss", f"SELECT round(log_loss, 6) AS log_loss FROM ({losses_sql('scored_variants')}) x")
def log_loss(t: Tables):
    return rounded(evaluate.log_loss(t.scored_variants))


_CAL = "count, round(mean_predicted_probability, 6) AS mean_predicted_probability, round(observed_pathogenic_rate, 6) AS observed_pathogenic_rate, round(absolute_calibration_error, 6) AS absolute_calibration_error"


@query("calibration_table", f"SELECT bin, {_CAL} FROM ({calibration_sql('scored')}) x")
def calibration_table(t: Tables):
    return rounded(evaluate.calibration_table(t.scored))


@query("expected_calibration_error", f"SELECT round(expected_calibration_error, 6) AS expected_calibration_error FROM ({ece_sql('scored_variants')}) x")
def expected_calibration_error(t: Tables):
    return rounded(evaluate.expected_calibration_error(evaluate.calibration_table(t.scored_variants)))


@query("calibration_by_group", f"SELECT variant_type, bin, {_CAL} FROM ({calibration_sql('scored_variants', 'variant_type')}) x")
def calibration_by_group(t: Tables):
    return rounded(evaluate.calibration_by_group(t.scored_variants, ["variant_type"]))


def all_metrics_sql(table: str, by: str) -> str:
    return f"""SELECT c.*, pr_auc, roc_auc, brier_score, log_loss, expected_calibration_error FROM ({confusion_sql(table, by)}) c
      JOIN ({ranking_sql(table, by)}) r USING ({by}) JOIN ({losses_sql(table, by)}) l USING ({by}) JOIN ({ece_sql(table, by)}) e USING ({by})"""


_METRICS = ["precision", "recall", "f1_score", "accuracy", "pr_auc", "roc_auc", "brier_score", "log_loss", "expected_calibration_error"]
_SHOWN = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query(
    "metrics_by_group",
    f"SELECT variant_type, rarity, tp, fp, tn, fn, {_SHOWN}, CAST(0.5 AS DOUBLE) AS best_threshold FROM ({all_metrics_sql('scored_variants', 'variant_type, rarity')}) x",
)
def metrics_by_group(t: Tables):
    return rounded(evaluate.metrics_by_group(t.scored_variants, ["variant_type", "rarity"]))


@query("classification_metrics", f"SELECT tp, fp, tn, fn, {_SHOWN}, CAST(0.5 AS DOUBLE) AS best_threshold FROM ({all_metrics_sql('(SELECT *, 1 AS k FROM scored_variants) s', 'k')}) x")
def classification_metrics(t: Tables):
    return rounded(evaluate.classification_metrics(t.scored_variants))


@query(
    "operating_points",
    """SELECT rarity, round(max(CASE WHEN recall >= 0.9 THEN precision END), 6) AS precision_at_recall,
      round(coalesce(max(CASE WHEN precision >= 0.9 THEN recall END), 0), 6) AS recall_at_precision FROM (
      SELECT rarity, ctp / (ctp + cfp) AS precision, ctp / tot_p AS recall FROM (
        SELECT *, sum(tp) OVER (PARTITION BY rarity ORDER BY p DESC) AS ctp, sum(fp) OVER (PARTITION BY rarity ORDER BY p DESC) AS cfp, sum(tp) OVER (PARTITION BY rarity) AS tot_p
        FROM (SELECT rarity, probability AS p, CAST(sum(target) AS DOUBLE) AS tp, CAST(count(*) - sum(target) AS DOUBLE) AS fp FROM scored_variants GROUP BY rarity, probability) g) c) d
    GROUP BY rarity""",
)
def operating_points(t: Tables):
    return rounded(evaluate.operating_points(t.scored_variants, ["rarity"]))


_CV = ["roc_auc", "pr_auc", "accuracy", "brier_score", "precision", "recall", "f1_score"]
ORACLE_VIEWS["o_cv"] = f"SELECT fold, {', '.join(_CV)} FROM ({all_metrics_sql('o_folds', 'fold')}) x"


@query("cv_folds", f"SELECT CAST(fold AS INT) AS fold, {', '.join(f'round({m}, 6) AS {m}' for m in _CV)} FROM o_cv")
def cv_folds(t: Tables):
    return rounded(evaluate.cv_folds(evaluate.stratified_kfold(t.scored_variants, KEY)))


@query(
    "cv_summary",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, round(min({m}), 6) AS low, round(max({m}), 6) AS high FROM o_cv"
        for m in _CV
    ),
)
def cv_summary(t: Tables):
    return rounded(evaluate.cv_summary(evaluate.cv_folds(evaluate.stratified_kfold(t.scored_variants, KEY))))


@query(
    "category_codes",
    """SELECT e.chrom, pos, ref, alt, CAST(coalesce(c.code, -1) AS INT) AS chrom_code, CAST(s.code AS INT) AS clinvar_clnsig_code FROM
      (SELECT chrom, pos, ref, alt, clinvar_clnsig FROM variants_raw) e
      LEFT JOIN (SELECT chrom, dense_rank() OVER (ORDER BY chrom) - 1 AS code FROM (SELECT DISTINCT chrom FROM variants_raw) a) c ON e.chrom = c.chrom
      LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT clinvar_clnsig AS v FROM variants_raw WHERE clinvar_clnsig IS NOT NULL) b) s ON e.clinvar_clnsig = s.v""".replace(
        "CAST(s.code AS INT)", "CAST(coalesce(s.code, -1) AS INT)"
    ),
)
def category_codes(t: Tables):
    coded = evaluate.category_codes(t.variants_raw, ["chrom", "clinvar_clnsig"])
    return coded.select(*KEY, "chrom_code", "clinvar_clnsig_code")


def _baselines(t: Tables) -> DataFrame:
    """Three single-score classifiers over the same variants, as one long scored table."""
    clean = t.variants_clean
    scores = {"CADD": F.col("CADD_phred") / 60, "PolyPhen": F.col("Polyphen2_HDIV_score"), "SIFT": 1 - F.col("SIFT_score")}
    cells = F.array(*[F.struct(F.lit(name).alias("model"), p.alias("probability")) for name, p in scores.items()])
    return clean.select("target", F.inline(cells)).where(F.col("probability").isNotNull())


ORACLE_VIEWS["o_baselines"] = """
SELECT 'CADD' AS model, target, CADD_phred / 60 AS probability FROM variants_clean WHERE CADD_phred IS NOT NULL
UNION ALL SELECT 'PolyPhen', target, Polyphen2_HDIV_score FROM variants_clean WHERE Polyphen2_HDIV_score IS NOT NULL
UNION ALL SELECT 'SIFT', target, 1 - SIFT_score FROM variants_clean WHERE SIFT_score IS NOT NULL
"""
_BENCH = f"SELECT model, {_SHOWN} FROM ({all_metrics_sql('o_baselines', 'model')}) x"


def model_table(t: Tables) -> DataFrame:
    return rounded(evaluate.classification_metrics(_baselines(t), by=["model"]).select("model", *_METRICS))


@query("rank_models", _BENCH)
def rank_models(t: Tables):
    return evaluate.rank_models(model_table(t))


@query("best_model", f"SELECT * FROM ({_BENCH}) b ORDER BY pr_auc DESC, f1_score DESC, model LIMIT 1")
def best_model(t: Tables):
    return evaluate.winner(model_table(t))


@query("csv_benchmark_roundtrip", _BENCH)
def csv_benchmark_roundtrip(t: Tables):
    return sinks.csv_roundtrip(model_table(t), fresh_path(t.spark, "benchmark"))


@query(
    "select_best_run",
    """SELECT run_id, pr_auc, strftime(start_time, '%Y-%m-%d') AS started FROM model_runs
    WHERE stage = 'training' AND status = 'FINISHED' AND pr_auc >= 0.8 ORDER BY pr_auc DESC, start_time DESC, run_id LIMIT 1""",
)
def select_best_run(t: Tables):
    best = evaluate.select_best_run(t.model_runs)
    return best.select("run_id", "pr_auc", F.date_format("start_time", "yyyy-MM-dd").alias("started"))


@query(
    "reuse_or_new_version",
    """SELECT w.run_id, w.source, CAST(v.version AS DOUBLE) AS version, CASE WHEN v.version IS NULL THEN 'new' ELSE 'reuse' END AS action
    FROM (SELECT run_id, concat('runs:/', CAST(run_id AS VARCHAR), '/model') AS source FROM model_runs WHERE status = 'FINISHED') w
    LEFT JOIN (SELECT run_id, source, max(CAST(version AS BIGINT)) AS version FROM model_versions GROUP BY run_id, source) v
    ON w.run_id = v.run_id AND w.source = v.source""",
)
def reuse_or_new_version(t: Tables):
    finished = t.model_runs.where("status = 'FINISHED'")
    wanted = finished.select("run_id", F.concat(F.lit("runs:/"), F.col("run_id").cast("string"), F.lit("/model")).alias("source"))
    return real(evaluate.reuse_or_new_version(wanted, t.model_versions), "version")
