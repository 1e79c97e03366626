"""Data-quality and feature-profile queries over the encoded training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, rounded
from catalog.ingest import encoded
from catalog.oracle import ORACLE_VIEWS
from variantloom.contract import CATEGORICAL_FEATURES, FEATURE_ORDER, NUMERIC_FEATURES
from variantloom.operators import dedupe, profile, sketches
from variantloom.operators.ranks import value_histogram
from variantloom.session import list_names, materialize, path_exists

_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES)
ORACLE_VIEWS["o_wide"] = f"SELECT Target, {_DOUBLES} FROM o_encoded"
ORACLE_VIEWS["o_long"] = f"SELECT * FROM o_wide UNPIVOT (value FOR feature IN ({', '.join(NUMERIC_FEATURES)}))"


def histogram(t: Tables) -> DataFrame:
    """Value counts per class of every numeric feature, shared by the quantile profiles."""
    return t.stored("encoded_histogram", lambda: value_histogram(encoded(t), NUMERIC_FEATURES, ["Target"]))


@query(
    "category_lift",
    """SELECT feature, category, CAST(count AS BIGINT) AS count, round(rate, 6) AS pathogenic_rate, round(count / total, 6) AS dataset_share, CAST(place AS INT) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, category) AS place, sum(count) OVER (PARTITION BY feature) AS total
      FROM (SELECT feature, category, count(*) AS count, avg(Target) AS rate FROM (
        """
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS category, Target FROM o_encoded" for c in CATEGORICAL_FEATURES)
    + """) u GROUP BY feature, category) g) r WHERE place <= 15""",
)
def category_lift(t: Tables):
    return rounded(profile.category_lift(encoded(t)))


@query(
    "missing_report",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS percentage FROM variants_clean"""
        for c in ("chrom", "pos", "ref", "alt", "SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF", "target")
    )
    + ") m WHERE missing_count > 0",
)
def missing_report(t: Tables):
    return profile.missing_report(t.variants_clean)


@query(
    "duplicate_count",
    """SELECT n AS rows, n - d AS duplicates, round((n - d) * 100.0 / n, 6) AS percent
    FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM o_encoded) a, (SELECT CAST(count(*) AS BIGINT) AS d FROM (SELECT DISTINCT * FROM o_encoded) x) b""",
)
def duplicate_count(t: Tables):
    return rounded(dedupe.duplicate_count(encoded(t)))


@query("dedupe_rows", "SELECT DISTINCT * FROM o_encoded")
def dedupe_rows(t: Tables):
    return dedupe.distinct_rows(encoded(t))


_AUDITED = ["chrom", "pos", "ref", "alt", "SIFT_score", "Polyphen2_HDIV_score", "CADD_phred", "gnomAD_exomes_AF", "clinvar_clnsig"]


@query(
    "schema_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{'bigint' if c == 'pos' else 'string'}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null,
        CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        CAST(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS BIGINT) AS unique_values,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM variants_raw WHERE {c} IS NOT NULL ORDER BY v LIMIT 4) s) AS sample_values
        FROM variants_raw"""
        for c in _AUDITED
    ),
)
def schema_audit(t: Tables):
    return profile.schema_audit(t.variants_raw.select(*_AUDITED))


def _sentinel_entry(column: str, value) -> str:
    literal = f"'{value}'" if column in CATEGORICAL_FEATURES else str(value)
    return f"{{'f': '{column}', 'v': '{value}', 'c': CAST(count(*) FILTER (WHERE {column} = {literal}) AS BIGINT)}}"


_SENTINELS = ", ".join(
    _sentinel_entry(c, v) for c in [*FEATURE_ORDER, "Target"] for v in (("N", "-") if c in CATEGORICAL_FEATURES else (-1, 0))
)


@query(
    "sentinel_report",
    f"""SELECT p.f AS feature, p.v AS sentinel_value, p.c AS count, round(p.c * 100.0 / n, 6) AS percent
    FROM (SELECT unnest([{_SENTINELS}]) AS p, count(*) AS n FROM o_encoded) s
    WHERE p.c > 0 ORDER BY p.c * 100.0 / n DESC, p.f, p.v LIMIT 40""",
)
def sentinel_report(t: Tables):
    return rounded(profile.sentinel_report(encoded(t)))


@query(
    "feature_type_split",
    """SELECT 'categorical' AS kind, 'CHROM' AS feature, CAST(count(DISTINCT CHROM) AS BIGINT) AS distinct_values FROM o_encoded
    UNION ALL SELECT 'categorical', 'REF_Base', CAST(count(DISTINCT REF_Base) AS BIGINT) FROM o_encoded
    UNION ALL SELECT 'categorical', 'ALT_Base', CAST(count(DISTINCT ALT_Base) AS BIGINT) FROM o_encoded
    UNION ALL SELECT 'categorical', 'mutation_type', CAST(count(DISTINCT mutation_type) AS BIGINT) FROM o_encoded
    UNION ALL SELECT 'numeric', feature, CAST(count(DISTINCT value) AS BIGINT) FROM o_long GROUP BY feature""",
)
def feature_type_split(t: Tables):
    """Distinct values of every column, under the kind the schema gives it."""
    table = encoded(t)
    split = profile.feature_type_split(table)
    shown = lambda c, k: (F.col(c) if k == "categorical" else F.col(c).cast("double") + 0.0).cast("string")
    kind = {**{c: "numeric" for c in split["numeric"]}, **{c: "categorical" for c in split["categorical"]}}
    cells = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("feature"), shown(c, k).alias("value")) for c, k in kind.items()]
    )
    values = table.select(F.inline(cells)).distinct()
    return values.groupBy("kind", "feature").agg(F.count("value").alias("distinct_values"))


@query("infinite_count", "SELECT CAST(count(*) FILTER (WHERE gnomAD_exomes_AF = 0) AS BIGINT) AS infinite_cells FROM variants_clean")
def infinite_count(t: Tables):
    inverse = F.when(F.col("gnomAD_exomes_AF") == 0, float("inf")).otherwise(1 / F.nullif("gnomAD_exomes_AF", F.lit(0.0)))
    return profile.infinite_count(t.variants_clean.withColumn("inverse_af", inverse))


@query(
    "class_balance",
    """SELECT Target AS target, CAST(count(*) AS BIGINT) AS count, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share
    FROM o_encoded GROUP BY Target""",
)
def class_balance(t: Tables):
    return rounded(profile.class_balance(encoded(t)))


@query(
    "imbalance",
    """SELECT CAST(n0 AS BIGINT) AS negatives, CAST(n1 AS BIGINT) AS positives, round(n1 * 1.0 / n0, 6) AS imbalance_ratio,
      round(n0 * 1.0 / n1, 6) AS scale_pos_weight
    FROM (SELECT count(*) FILTER (WHERE Target = 0) AS n0, count(*) FILTER (WHERE Target = 1) AS n1 FROM o_encoded) c""",
)
def imbalance(t: Tables):
    return rounded(profile.imbalance(encoded(t)))


@query(
    "describe_numeric",
    """SELECT feature, CAST(count(*) AS BIGINT) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std,
      round(min(value), 3) AS min, round(quantile_cont(value, 0.25), 3) AS q1, round(quantile_cont(value, 0.5), 3) AS median,
      round(quantile_cont(value, 0.75), 3) AS q3, round(max(value), 3) AS max FROM o_long GROUP BY feature""",
)
def describe_numeric(t: Tables):
    return profile.describe_numeric(encoded(t), histogram(t))


_OUTLIERS = """SELECT l.feature, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
  FROM o_long l JOIN (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM o_long GROUP BY feature) q
  ON l.feature = q.feature GROUP BY l.feature"""


@query(
    "iqr_outliers",
    f"""SELECT feature, rows, outliers, round(outliers * 100.0 / rows, 6) AS percent, outliers * 100.0 / rows > 5 AS flagged
    FROM ({_OUTLIERS}) o ORDER BY outliers DESC, feature LIMIT 10""",
)
def iqr_outliers(t: Tables):
    return rounded(profile.iqr_outliers(histogram(t)))


_BOX = NUMERIC_FEATURES[:8]


@query(
    "boxplot_stats",
    f"""SELECT Target, feature, CAST(count(*) AS BIGINT) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
      round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high
    FROM o_long WHERE feature IN ({', '.join(f"'{c}'" for c in _BOX)}) GROUP BY Target, feature""",
)
def boxplot_stats(t: Tables):
    return rounded(profile.boxplot_stats(histogram(t), _BOX))


@query(
    "dataset_share",
    """SELECT mutation_type AS category, CAST(count(*) AS BIGINT) AS count, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS dataset_share
    FROM o_encoded GROUP BY mutation_type""",
)
def dataset_share(t: Tables):
    return rounded(profile.dataset_share(encoded(t), "mutation_type"))


@query("rate_by_chrom", "SELECT CHROM, round(avg(Target), 6) AS pathogenic_rate FROM o_encoded GROUP BY CHROM")
def rate_by_chrom(t: Tables):
    return rounded(profile.rate_by_chrom(encoded(t)))


@query(
    "top_mutation_types",
    """SELECT mutation_type, CAST(count(*) AS BIGINT) AS count, round(avg(Target), 6) AS pathogenic_rate FROM o_encoded
    GROUP BY mutation_type HAVING count(*) >= 100 ORDER BY round(avg(Target), 9) DESC, mutation_type LIMIT 15""",
)
def top_mutation_types(t: Tables):
    return rounded(profile.top_mutation_types(encoded(t)))


ORACLE_VIEWS["o_correlation"] = """
SELECT feature, CASE WHEN stddev_pop(value) > 0 THEN round(corr(value, Target), 6) END AS correlation FROM o_long GROUP BY feature
"""


@query("target_correlation", "SELECT * FROM o_correlation ORDER BY correlation DESC NULLS LAST, feature LIMIT 15")
def target_correlation(t: Tables):
    return rounded(profile.target_correlation(encoded(t)))


@query("annotation_correlation", "SELECT * FROM o_correlation WHERE feature IN ('SIFT', 'PolyPhen', 'CADD')")
def annotation_correlation(t: Tables):
    return rounded(profile.target_correlation(encoded(t), top=None, columns=profile.FEATURE_GROUPS["annotation"]))


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC_FEATURES) for b in NUMERIC_FEATURES[i + 1 :]]
ORACLE_VIEWS["o_pairs"] = (
    "SELECT p.a AS feature_a, p.b AS feature_b, p.r AS r FROM (SELECT unnest(["
    + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END}}" for a, b in _PAIRS)
    + "]) AS p FROM o_wide) u WHERE abs(p.r) > 0.9"
)


@query("high_correlation_pairs", "SELECT feature_a, feature_b, round(r, 6) AS r FROM o_pairs")
def high_correlation_pairs(t: Tables):
    return rounded(profile.high_correlation_pairs(encoded(t)))


@query(
    "class_separation",
    """SELECT feature, round(b, 6) AS benign_mean, round(p, 6) AS pathogenic_mean, round(bm, 6) AS benign_median, round(pm, 6) AS pathogenic_median,
      round(p - b, 6) AS mean_delta, round(coalesce((p - b) / nullif(s, 0), 0), 6) AS standardized_delta,
      round(abs(coalesce((p - b) / nullif(s, 0), 0)), 6) AS abs_standardized_delta
    FROM (SELECT feature, avg(value) FILTER (WHERE Target = 0) AS b, avg(value) FILTER (WHERE Target = 1) AS p, stddev_samp(value) AS s,
      quantile_cont(value, 0.5) FILTER (WHERE Target = 0) AS bm, quantile_cont(value, 0.5) FILTER (WHERE Target = 1) AS pm
      FROM o_long GROUP BY feature) x
    ORDER BY abs_standardized_delta DESC, feature LIMIT 20""",
)
def class_separation(t: Tables):
    return rounded(profile.class_separation(histogram(t)))


@query(
    "cumulative_importance",
    """SELECT *, 1 + count(*) FILTER (WHERE c <= 0.9) OVER () AS features_needed FROM (
      SELECT feature, abs(correlation) AS importance, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INT) AS place,
        sum(abs(correlation)) OVER (ORDER BY abs(correlation) DESC, feature ROWS UNBOUNDED PRECEDING) / sum(abs(correlation)) OVER () AS c
      FROM o_correlation WHERE correlation IS NOT NULL) r""".replace("SELECT *, 1 +", "SELECT feature, round(importance, 6) AS importance, place, round(c, 6) AS cumulative_share, 1 +"),
)
def cumulative_importance(t: Tables):
    """Importance of a feature taken as the strength of its correlation with the target."""
    importance = profile.target_correlation(encoded(t), top=None).where("correlation IS NOT NULL")
    table = importance.select("feature", F.abs("correlation").alias("importance"))
    return rounded(profile.cumulative_importance(table))


@query(
    "recommendations",
    f"""SELECT 'missing values' AS "check", 'ok' AS severity, 'no missing values' AS message
    UNION ALL SELECT 'duplicates', CASE WHEN n > d THEN 'warning' ELSE 'ok' END, CASE WHEN n > d THEN CAST(n - d AS VARCHAR) || ' duplicate rows to remove' ELSE 'no duplicate rows' END
      FROM (SELECT count(*) AS n FROM o_encoded) a, (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM o_encoded) x) b
    UNION ALL SELECT 'class imbalance', CASE WHEN r > 2 THEN 'severe' WHEN r > 1.5 THEN 'moderate' ELSE 'ok' END,
      CASE WHEN r > 1.5 THEN printf('%.2f', r) || ':1 positives to negatives; weight the classes' ELSE 'classes are balanced' END
      FROM (SELECT CAST(count(*) FILTER (WHERE Target = 1) AS DOUBLE) / count(*) FILTER (WHERE Target = 0) AS r FROM o_encoded) c
    UNION ALL SELECT 'multicollinearity', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END,
      CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' feature pairs with |r| > 0.9' ELSE 'no strongly correlated pairs' END FROM (SELECT count(*) AS n FROM o_pairs) p
    UNION ALL SELECT 'outliers', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END,
      CASE WHEN n > 0 THEN 'more than 5% outliers: ' || names ELSE 'outlier levels are reasonable' END
      FROM (SELECT count(*) AS n, string_agg(feature, ', ' ORDER BY feature) AS names FROM ({_OUTLIERS}) o WHERE outliers * 100.0 / rows > 5) q""",
)
def recommendations(t: Tables):
    return profile.recommendations(encoded(t), histogram(t))


@query("head_preview", "SELECT * FROM variants_clean ORDER BY chrom, pos, ref, alt, SIFT_score, CADD_phred, gnomAD_exomes_AF LIMIT 20")
def head_preview(t: Tables):
    return profile.head_preview(t.variants_clean, 20, ["chrom", "pos", "ref", "alt", "SIFT_score", "CADD_phred", "gnomAD_exomes_AF"])


def sketch_parts(t: Tables) -> DataFrame:
    """Stored sketches of the encoded table, one part for each chromosome."""
    path = t.stored_path("encoded_by_part")
    if not path_exists(t.spark, f"{path}/_SUCCESS"):
        encoded(t).withColumn("by_chrom", F.col("CHROM")).write.partitionBy("by_chrom").parquet(path)
    folders = [f"{path}/{name}" for name in list_names(t.spark, path)]
    parts = {f.rsplit("=", 1)[1]: ((lambda f=f: t.spark.read.parquet(f)), [f]) for f in folders}
    return sketches.update_sketches(t.spark, t.stored_path("sketches"), parts, profile.feature_columns(encoded(t)), ["Target"])


def rank_errors(t: Tables, described: DataFrame, by: list[str]) -> DataFrame:
    """For each row of quartiles: whether each has a rank within 0.03 of the one it stands for, among all values."""
    columns = profile.feature_columns(encoded(t))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]
    values = encoded(t).select(*by, F.inline(F.array(*cells))).where("v IS NOT NULL")
    shares = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        below, upto = F.avg((F.col("v") < F.col(name)).cast("double")), F.avg((F.col("v") <= F.col(name)).cast("double"))
        shares.append((below - 0.03 <= q) & (upto + 0.03 >= q))
    return values.join(described.select(*by, "feature", "q25", "q50", "q75"), [*by, "feature"]).groupBy(*by, "feature").agg((shares[0] & shares[1] & shares[2]).alias("close"))


@query(
    "describe_sketched",
    """SELECT feature, CAST(count(*) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low,
      round(max(value), 6) AS high, TRUE AS close FROM o_long GROUP BY feature""",
)
def describe_sketched(t: Tables):
    """Profiles merged from the stored sketches of the parts; ``close`` measures their quartiles against all values."""
    merged = materialize(sketches.merge_sketches(sketch_parts(t)), "merged-sketches")
    described = sketches.describe_sketched(merged)
    shown = described.select("feature", "count", "mean", "std", "low", "high").join(rank_errors(t, described, []), "feature")
    return rounded(shown)


@query(
    "separation_sketched",
    """SELECT feature, CAST(count(*) FILTER (WHERE Target = 0) AS BIGINT) AS n_0, CAST(count(*) FILTER (WHERE Target = 1) AS BIGINT) AS n_1,
      round(avg(value) FILTER (WHERE Target = 0), 6) AS mean_0, round(avg(value) FILTER (WHERE Target = 1), 6) AS mean_1, TRUE AS close FROM o_long GROUP BY feature""",
)
def separation_sketched(t: Tables):
    merged = materialize(sketches.merge_sketches(sketch_parts(t), ["Target"]), "merged-sketches")
    close = rank_errors(t, sketches.describe_sketched(merged, ["Target"]), ["Target"]).groupBy("feature").agg(F.bool_and("close").alias("close"))
    shown = sketches.separation_sketched(merged, "Target").select("feature", "n_0", "n_1", "mean_0", "mean_1")
    return rounded(shown.join(close, "feature"))
