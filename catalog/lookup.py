"""Feature-store lookup and batch scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, real, rounded
from catalog.oracle import ORACLE_VIEWS
from variantloom.functions.scoring import FORMULA_INTERCEPT, FORMULA_WEIGHTS
from variantloom.operators import lookup, scoring
from variantloom.session import fresh_path, path_exists
from variantloom.sources import sinks

ORACLE_VIEWS["o_requests"] = """
SELECT request_id, regexp_replace(upper(trim(chrom)), '^CHR', '') AS k_chrom, try_cast(trim(pos) AS BIGINT) AS k_pos,
  upper(ref) AS k_ref, upper(alt) AS k_alt, chrom, pos, ref, alt FROM variant_requests
"""

_TIE = "CADD_phred DESC NULLS LAST, SIFT_score NULLS LAST, Polyphen2_HDIV_score NULLS LAST, gnomAD_exomes_AF NULLS LAST"

ORACLE_VIEWS["o_store"] = f"""
SELECT * EXCLUDE (n, tier) FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY tier, {_TIE}) AS n
  FROM (SELECT *, 0 AS tier, 'local' AS feature_source FROM store_local UNION ALL SELECT *, 1, 'lake' FROM store_lake) u
) r WHERE n = 1
"""

ORACLE_VIEWS["o_store_local"] = f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY {_TIE}) AS n FROM store_local) r
WHERE n = 1
"""


def resolved_store(t: Tables) -> DataFrame:
    """Both tiers as one keyed store: written once, joined by every batch without moving it."""
    path = t.stored_path("store_keyed")
    if path_exists(t.spark, f"{path}.buckets/_SUCCESS"):
        return lookup.open_keyed_store(t.spark, path)
    return lookup.write_tiers({"local": t.store_local, "lake": t.store_lake}, path, t.spark.sparkContext.defaultParallelism)


def local_store(t: Tables) -> DataFrame:
    """The local tier as a keyed store of its own."""
    path = t.stored_path("store_local_keyed")
    if path_exists(t.spark, f"{path}.buckets/_SUCCESS"):
        return lookup.open_keyed_store(t.spark, path)
    return lookup.write_tiers({"local": t.store_local}, path, t.spark.sparkContext.defaultParallelism)


@query(
    "store_dedupe_first",
    """SELECT chrom, pos, ref, alt, SIFT_score AS sift, Polyphen2_HDIV_score AS polyphen, CADD_phred AS cadd,
    gnomAD_exomes_AF AS alt_freq FROM o_store_local""",
)
def store_dedupe_first(t: Tables):
    unique = lookup.store_dedupe_first(lookup.store_rows(t.store_local))
    return unique.withColumnsRenamed(dict(zip(lookup.KEY, ("chrom", "pos", "ref", "alt"))))


@query(
    "lookup_local_store",
    """SELECT request_id, q.chrom, q.pos, q.ref, q.alt, s.chrom IS NOT NULL AS found, SIFT_score AS sift, Polyphen2_HDIV_score AS polyphen,
      CADD_phred AS cadd, gnomAD_exomes_AF AS alt_freq
    FROM o_requests q LEFT JOIN o_store_local s ON k_chrom = s.chrom AND k_pos = s.pos AND k_ref = s.ref AND k_alt = s.alt""",
)
def lookup_local_store(t: Tables):
    found = lookup.lookup(t.variant_requests, local_store(t))
    return found.select("request_id", "chrom", "pos", "ref", "alt", "found", *lookup.SCORES)


@query(
    "lookup_two_tier",
    """SELECT request_id, q.chrom, q.pos, q.ref, q.alt, s.chrom IS NOT NULL AS found, feature_source, SIFT_score AS sift, Polyphen2_HDIV_score AS polyphen,
      CADD_phred AS cadd, gnomAD_exomes_AF AS alt_freq
    FROM o_requests q LEFT JOIN o_store s ON k_chrom = s.chrom AND k_pos = s.pos AND k_ref = s.ref AND k_alt = s.alt""",
)
def lookup_two_tier(t: Tables):
    found = lookup.lookup(t.variant_requests, resolved_store(t))
    return found.select("request_id", "chrom", "pos", "ref", "alt", "found", "feature_source", *lookup.SCORES)


_HOT = """(SELECT k_chrom, k_pos, k_ref, k_alt, request_id FROM o_requests UNION ALL
  SELECT h.k_chrom, h.k_pos, h.k_ref, h.k_alt, -1 - q.request_id FROM o_requests q CROSS JOIN (SELECT * FROM o_requests ORDER BY request_id LIMIT 2) h)"""


@query(
    "lookup_hot_requests",
    f"""SELECT q.k_chrom AS chrom, q.k_pos AS pos, CAST(count(*) AS BIGINT) AS requests, CAST(count(s.chrom) AS BIGINT) AS found, round(sum(CADD_phred), 3) AS cadd
    FROM {_HOT} q LEFT JOIN o_store s ON k_chrom = s.chrom AND k_pos = s.pos AND k_ref = s.ref AND k_alt = s.alt GROUP BY 1, 2""",
)
def lookup_hot_requests(t: Tables):
    """Two keys hold a third of the requests each; they are answered by broadcast, the others from the buckets."""
    own = t.variant_requests.select("request_id", "chrom", "pos", "ref", "alt")
    many = own
    for hot in own.orderBy("request_id").limit(2).collect():
        many = many.unionByName(own.select((-1 - F.col("request_id")).alias("request_id"), *[F.lit(hot[c]).alias(c) for c in ("chrom", "pos", "ref", "alt")]))
    found = lookup.lookup(many, resolved_store(t), split_hot=True)
    key = lookup.variant_key(found)
    return found.groupBy(key["k_chrom"].alias("chrom"), key["k_pos"].alias("pos")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("found").alias("found"), F.round(F.sum("cadd"), 3).alias("cadd")
    )


_EXISTS = "EXISTS (SELECT 1 FROM o_store s WHERE k_chrom = s.chrom AND k_pos = s.pos AND k_ref = s.ref AND k_alt = s.alt)"


@query("lookup_found", f"SELECT request_id, chrom, pos, ref, alt FROM o_requests WHERE {_EXISTS}")
def lookup_found(t: Tables):
    return lookup.lookup_found(t.variant_requests, resolved_store(t))


@query("lookup_not_found", f"SELECT request_id, chrom, pos, ref, alt FROM o_requests WHERE NOT {_EXISTS}")
def lookup_not_found(t: Tables):
    return lookup.lookup_not_found(t.variant_requests, resolved_store(t))


@query(
    "manual_fallback_gate",
    f"""SELECT request_id, CASE WHEN {_EXISTS} THEN 'found'
      WHEN k_pos % 2 = 0 AND length(k_ref) = 1 THEN 'manual_ready' ELSE 'needs_input' END AS status FROM o_requests""",
)
def manual_fallback_gate(t: Tables):
    """Hand-entered scores: some requests have none, some have unusable text in one field."""
    position = F.col("pos").try_cast("bigint")
    entered = t.variant_requests.withColumns(
        {
            "manual_sift": F.lit("0.1"),
            "manual_polyphen": F.when(F.length("ref") == 1, "0.9").otherwise(""),
            "manual_cadd": F.when(position % 2 == 0, "21.5").otherwise("unknown"),
            "manual_alt_freq": F.lit("0.0001"),
        }
    )
    return lookup.manual_fallback_gate(lookup.lookup(entered, resolved_store(t))).select("request_id", "status")


def _formula_sql() -> str:
    terms = "".join(f" + CAST({w} AS DOUBLE) * CAST(CAST({n} AS FLOAT) AS DOUBLE)" for n, w in FORMULA_WEIGHTS.items())
    return f"1 / (1 + exp(-(CAST({FORMULA_INTERCEPT} AS DOUBLE){terms})))"


ORACLE_VIEWS["o_features_of_batch"] = """
SELECT *, coalesce(sift, -1) AS SIFT_f, coalesce(polyphen, -1) AS PolyPhen_f, coalesce(cadd, -1) AS CADD_f, coalesce(alt_freq, 0) AS AF_f,
  length(alt) - length(ref) AS dl
FROM (
  SELECT request_id, upper(replace(q.chrom, 'chr', '')) AS chrom, trim(q.pos) AS pos, k_ref AS ref, k_alt AS alt,
    s.chrom IS NOT NULL AS found_in_store, feature_source, SIFT_score AS sift, Polyphen2_HDIV_score AS polyphen,
    CADD_phred AS cadd, gnomAD_exomes_AF AS alt_freq,
    CASE WHEN k_pos IS NULL THEN 'failed' WHEN s.chrom IS NULL THEN 'not_found' WHEN CADD_phred > 60 THEN 'failed' ELSE 'predicted' END AS status,
    CASE WHEN k_pos IS NULL THEN 'Position is not a whole number.' WHEN s.chrom IS NULL THEN 'Variant not found in feature store.'
      WHEN CADD_phred > 60 THEN 'Score out of range: cadd' END AS message
  FROM o_requests q LEFT JOIN o_store s ON k_chrom = s.chrom AND k_pos = s.pos AND k_ref = s.ref AND k_alt = s.alt
) j
"""

ORACLE_VIEWS["o_batch"] = f"""
SELECT request_id, chrom, pos, ref, alt, found_in_store, feature_source, status,
  CASE WHEN status = 'predicted' THEN CAST(p > 0.5 AS INT) END AS prediction,
  CASE WHEN status = 'predicted' THEN CASE WHEN p > 0.5 THEN 'PATHOGENIC' ELSE 'BENIGN' END END AS label,
  CASE WHEN status = 'predicted' THEN p END AS probability,
  CASE WHEN status = 'predicted' THEN greatest(p, 1 - p) END AS confidence_score,
  message, sift, polyphen, cadd, alt_freq
FROM (
  SELECT * EXCLUDE (SIFT_f, PolyPhen_f, CADD_f, AF_f), {_formula_sql()} AS p FROM (
    SELECT f.* EXCLUDE (SIFT_f, PolyPhen_f, CADD_f, AF_f), SIFT_f, PolyPhen_f, CADD_f, AF_f,
      CAST(AF_f < CAST(0.005 AS DOUBLE) AS INT) AS rare_variant, CAST(dl % 3 <> 0 AS INT) AS Is_Frameshift,
      CAST(CASE WHEN dl % 3 <> 0 THEN 3 ELSE 0 END AS DOUBLE) + CASE WHEN abs(dl) > 5 THEN 2 ELSE 0 END
        + abs(dl) * CAST(0.1 AS DOUBLE) + CASE WHEN AF_f < CAST(0.001 AS DOUBLE) THEN 2 ELSE 0 END
        + CASE WHEN CADD_f > 20 THEN 2 ELSE 0 END AS Impact_Score
    FROM o_features_of_batch f
  ) g
) h
"""
ORACLE_VIEWS["o_batch"] = (
    ORACLE_VIEWS["o_batch"]
    .replace("CAST(CADD AS FLOAT)", "CAST(CADD_f AS FLOAT)")
    .replace("CAST(PolyPhen AS FLOAT)", "CAST(PolyPhen_f AS FLOAT)")
    .replace("CAST(SIFT AS FLOAT)", "CAST(SIFT_f AS FLOAT)")
    .replace("CAST(ALT_FREQ AS FLOAT)", "CAST(AF_f AS FLOAT)")
)
_ROUND = "* REPLACE (CAST(prediction AS DOUBLE) AS prediction, round(probability, 6) AS probability, round(confidence_score, 6) AS confidence_score)"


def batch(t: Tables) -> DataFrame:
    """The scored batch, written once as the batch job would hand it on."""
    return t.stored("batch_results", lambda: scoring.vcf_batch_score(t.variant_requests, resolved_store(t)))


@query("vcf_batch_score", f"SELECT {_ROUND} FROM o_batch")
def vcf_batch_score(t: Tables):
    return real(rounded(scoring.vcf_batch_score(t.variant_requests, resolved_store(t))), "prediction")


@query(
    "score_postprocess",
    """SELECT request_id, round(p, 6) AS probability, CAST(CAST(p > 0.5 AS INT) AS DOUBLE) AS prediction,
      round(coalesce(greatest(p, 1 - p), CAST(0.5 AS DOUBLE)), 6) AS confidence_score,
      CASE WHEN p > 0.5 THEN 'PATHOGENIC' WHEN p IS NOT NULL THEN 'BENIGN' END AS label
    FROM (SELECT request_id, CASE WHEN cadd IS NOT NULL THEN least(1, greatest(0, cadd / 40)) END AS p FROM o_batch) x""",
)
def score_postprocess(t: Tables):
    raw = batch(t).select("request_id", (F.col("cadd") / 40).alias("probability"))
    return real(rounded(scoring.score_postprocess(raw)), "prediction")


@query(
    "batch_counters",
    """SELECT CAST(count(*) AS BIGINT) AS total_input, CAST(count(*) AS BIGINT) AS processed,
      CAST(count(*) FILTER (WHERE status = 'predicted') AS BIGINT) AS predicted,
      CAST(count(*) FILTER (WHERE status = 'not_found') AS BIGINT) AS not_found,
      CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed FROM o_batch""",
)
def batch_counters(t: Tables):
    return scoring.batch_counters(batch(t))


TRIAGE_SQL = """CASE WHEN label IS NULL THEN NULL WHEN coalesce({c}, 0) < 0.6 THEN 'Insufficient evidence'
  WHEN label = 'PATHOGENIC' AND coalesce(probability, 0) >= 0.75 THEN 'High priority'
  WHEN label = 'PATHOGENIC' THEN 'Review priority' ELSE 'Low priority' END"""


@query(
    "triage_label",
    f"""SELECT request_id, status, {TRIAGE_SQL.format(c='confidence_score')} AS triage,
      CASE WHEN confidence_score IS NULL THEN 'Unknown' WHEN confidence_score >= 0.85 THEN 'High'
        WHEN confidence_score >= 0.6 THEN 'Moderate' ELSE 'Low' END AS confidence_band FROM o_batch""",
)
def triage_label(t: Tables):
    return scoring.triage(batch(t)).select("request_id", "status", "triage", "confidence_band")


@query(
    "abstain_flag",
    """SELECT request_id, sift IS NULL OR polyphen IS NULL OR cadd IS NULL OR alt_freq IS NULL OR coalesce(confidence_score, 0) < 0.6 AS abstain,
      CASE WHEN sift IS NULL OR polyphen IS NULL OR cadd IS NULL OR alt_freq IS NULL THEN 'incomplete features'
        WHEN coalesce(confidence_score, 0) < 0.6 THEN 'low confidence' END AS abstain_reason FROM o_batch""",
)
def abstain_flag(t: Tables):
    return scoring.abstain_flag(batch(t)).select("request_id", "abstain", "abstain_reason")


@query(
    "evidence_drivers_topk",
    """SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id, rid ORDER BY strength DESC, o) AS INT) AS rank, name, direction, round(strength, 6) AS strength
    FROM (
      SELECT request_id, rid, o, name, direction, least(100, greatest(8, s)) AS strength FROM (
        SELECT request_id, rid, 0 AS o, 'CADD' AS name, CASE WHEN cadd >= 20 THEN 'Raises concern' WHEN cadd >= 10 THEN 'Moderate signal' ELSE 'Lower signal' END AS direction, cadd / 35 * 100 AS s FROM b WHERE cadd IS NOT NULL
        UNION ALL SELECT request_id, rid, 1, 'ALT frequency', CASE WHEN alt_freq < CAST(0.001 AS DOUBLE) THEN 'Rare variant' WHEN alt_freq < CAST(0.01 AS DOUBLE) THEN 'Uncommon' ELSE 'Commoner allele' END, (1 - least(alt_freq, CAST(0.02 AS DOUBLE)) / CAST(0.02 AS DOUBLE)) * 100 FROM b WHERE alt_freq IS NOT NULL
        UNION ALL SELECT request_id, rid, 2, 'SIFT', CASE WHEN sift <= CAST(0.05 AS DOUBLE) THEN 'Damaging signal' ELSE 'Tolerated signal' END, (1 - sift) * 100 FROM b WHERE sift IS NOT NULL
        UNION ALL SELECT request_id, rid, 3, 'PolyPhen', CASE WHEN polyphen >= CAST(0.85 AS DOUBLE) THEN 'Probably damaging' WHEN polyphen >= CAST(0.45 AS DOUBLE) THEN 'Possibly damaging' ELSE 'Benign leaning' END, polyphen * 100 FROM b WHERE polyphen IS NOT NULL
      ) d) e""".replace("SELECT request_id, CAST(row", "WITH b AS (SELECT *, row_number() OVER () AS rid FROM o_batch) SELECT request_id, CAST(row", 1),
)
def evidence_drivers_topk(t: Tables):
    return rounded(scoring.evidence_drivers_topk(batch(t).select("request_id", "sift", "polyphen", "cadd", "alt_freq")))


@query(
    "filter_batch_results",
    f"""SELECT {_ROUND} FROM o_batch WHERE label = 'PATHOGENIC' AND coalesce(confidence_score, 0) >= 0.7
    AND lower(concat(chrom, ':', pos, ' ', ref, '>', alt, ' ', status, ' ', coalesce(label, ''))) LIKE '%c>t predicted%'""",
)
def filter_batch_results(t: Tables):
    return real(rounded(scoring.filter_batch_results(batch(t), "pathogenic", 0.7, " C>T Predicted ")), "prediction")


def _sorted_query(mode: str) -> None:
    @query(f"sort_batch_results_{mode}", "SELECT request_id, chrom, pos, ref, alt, status, round(probability, 6) AS probability FROM o_batch")
    def run(t: Tables):
        ordered = scoring.sort_batch_results(batch(t), mode, ties=["request_id"])
        return rounded(ordered.select("request_id", "chrom", "pos", "ref", "alt", "status", "probability"))


for _mode in scoring.SORT_MODES:
    _sorted_query(_mode)


REPORT_SQL = f"""SELECT chrom, pos, ref, alt, status, coalesce(CAST(prediction AS VARCHAR), '') AS prediction, coalesce(label, '') AS label,
  coalesce({TRIAGE_SQL.format(c='confidence_score')}, '') AS triage,
  CASE WHEN probability IS NULL THEN '' ELSE printf('%.3f', probability * 100) END AS probability_percent,
  CASE WHEN confidence_score IS NULL THEN '' ELSE printf('%.3f', confidence_score * 100) END AS confidence_percent,
  coalesce(message, '') AS message, c.processed, c.predicted, c.not_found, c.failed
FROM o_batch, (SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE status = 'predicted') AS BIGINT) AS predicted,
  CAST(count(*) FILTER (WHERE status = 'not_found') AS BIGINT) AS not_found, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed FROM o_batch) c"""


@query("join_counters_to_rows", REPORT_SQL)
def join_counters_to_rows(t: Tables):
    results = batch(t)
    return sinks.batch_report(results, scoring.batch_counters(results))


@query(
    "sink_csv_report",
    REPORT_SQL.replace("c.processed, c.predicted, c.not_found, c.failed", ", ".join(
        f"CAST(c.{n} AS VARCHAR) AS {n}" for n in ("processed", "predicted", "not_found", "failed"))),
)
def sink_csv_report(t: Tables):
    results = batch(t)
    report = sinks.batch_report(results, scoring.batch_counters(results))
    return sinks.sink_csv_report(report, fresh_path(t.spark, "report")).na.fill("")


QUEUE_SQL = "id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, variant, source, label, probability, confidence, review_status"


def _queue(df: DataFrame) -> DataFrame:
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return df.select("id", shown, "variant", "source", "label", "probability", "confidence", "review_status")


@query(
    "filter_review_queue",
    f"""SELECT {QUEUE_SQL} FROM review_queue WHERE coalesce(review_status, 'Needs review') = 'Needs review'
    AND lower(concat(variant, ' ', source, ' ', label, ' ', coalesce(review_status, 'Needs review'))) LIKE '%manual pathogenic%'""",
)
def filter_review_queue(t: Tables):
    return _queue(scoring.filter_review_queue(t.review_queue, "Needs review", "Manual Pathogenic"))


@query("review_queue_latest", f"SELECT {QUEUE_SQL} FROM review_queue ORDER BY review_queue.ts DESC, id DESC LIMIT 200")
def review_queue_latest(t: Tables):
    return _queue(scoring.review_queue_latest(t.review_queue))


@query(
    "review_status_counts",
    """SELECT s.status, CAST(count(q.id) AS BIGINT) AS count
    FROM (VALUES ('Needs review'), ('Reviewed'), ('Flagged'), ('Exported')) s(status)
    LEFT JOIN review_queue q ON coalesce(q.review_status, 'Needs review') = s.status GROUP BY s.status""",
)
def review_status_counts(t: Tables):
    return scoring.review_status_counts(t.review_queue)


@query(
    "review_dashboard",
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE label = 'PATHOGENIC') AS BIGINT) AS pathogenic,
      round(100 * avg(CASE WHEN label = 'PATHOGENIC' THEN 1.0 ELSE 0.0 END), 6) AS pathogenic_rate,
      round(100 * avg(probability), 6) AS avg_probability FROM review_queue""",
)
def review_dashboard(t: Tables):
    return rounded(scoring.review_dashboard(t.review_queue))


@query(
    "review_report_csv",
    f"""SELECT CAST(ts AS VARCHAR) AS timestamp, variant, source, coalesce(review_status, 'Needs review') AS review_status, label AS prediction,
      {TRIAGE_SQL.format(c='confidence')} AS triage, printf('%.3f', probability * 100) AS probability_percent,
      printf('%.3f', confidence * 100) AS confidence_percent FROM review_queue""",
)
def review_report_csv(t: Tables):
    return sinks.sink_csv_report(sinks.review_report(t.review_queue), fresh_path(t.spark, "review"))
