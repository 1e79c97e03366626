"""Variant-shaped views over the plain test tables.

Every text is valid in Spark SQL and in DuckDB, so the engine and its oracle read the same
input. Later views use earlier ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from variantloom.contract import CONTIG_LENGTHS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["variants_raw"] = """
SELECT l_orderkey * 8 + l_linenumber AS variant_id,
  CASE WHEN l_suppkey % 26 < 22 THEN CAST(l_suppkey % 26 + 1 AS STRING)
       WHEN l_suppkey % 26 = 22 THEN 'X' WHEN l_suppkey % 26 = 23 THEN 'Y'
       WHEN l_suppkey % 26 = 24 THEN 'M' ELSE 'GL000' END AS chrom,
  (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % 160000000 + 1 AS pos,
  substr('ACGTACGTACGT', CAST(1 + l_partkey % 4 AS INT),
         CASE WHEN CAST(l_quantity AS INT) % 10 = 0 THEN 1 + l_linenumber ELSE 1 END) AS ref,
  substr('ACGTACGTACGT', CAST(1 + (l_partkey + 1 + l_suppkey % 3) % 4 AS INT),
         CASE WHEN CAST(l_quantity AS INT) % 10 = 1 THEN 1 + l_linenumber ELSE 1 END) AS alt,
  CASE WHEN l_partkey % 11 = 0 THEN '.'
       WHEN l_linenumber % 3 = 0 THEN concat('0.', lpad(CAST(l_partkey % 100 AS STRING), 2, '0'), ';0.99')
       ELSE concat('0.', lpad(CAST(l_partkey % 100 AS STRING), 2, '0')) END AS SIFT_score,
  CASE WHEN l_partkey % 13 = 0 THEN '.;.'
       ELSE concat('0.', lpad(CAST(l_orderkey % 1000 AS STRING), 3, '0'), ';0.1') END AS Polyphen2_HDIV_score,
  CASE WHEN l_partkey % 17 = 0 THEN '.'
       ELSE concat(CAST((l_orderkey * l_linenumber) % 45 AS STRING), '.', CAST(l_partkey % 10 AS STRING)) END AS CADD_phred,
  CASE WHEN l_suppkey % 5 = 0 THEN '.'
       WHEN l_suppkey % 5 = 1 THEN concat('0.', lpad(CAST(l_orderkey % 50 AS STRING), 2, '0'))
       ELSE concat('0.00', lpad(CAST(l_orderkey % 100 AS STRING), 2, '0')) END AS gnomAD_exomes_AF,
  CASE l_orderkey % 8 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Benign'
       WHEN 3 THEN 'Likely_benign' WHEN 4 THEN 'Uncertain_significance'
       WHEN 5 THEN 'Conflicting_interpretations_of_pathogenicity' WHEN 6 THEN '' ELSE NULL END AS clinvar_clnsig
FROM lineitem
"""

VIEWS["variants_clean"] = """
SELECT chrom, pos, ref, alt,
  try_cast(split_part(SIFT_score, ';', 1) AS DOUBLE) AS SIFT_score,
  try_cast(split_part(Polyphen2_HDIV_score, ';', 1) AS DOUBLE) AS Polyphen2_HDIV_score,
  try_cast(split_part(CADD_phred, ';', 1) AS DOUBLE) AS CADD_phred,
  coalesce(try_cast(split_part(gnomAD_exomes_AF, ';', 1) AS DOUBLE), CAST(0.0 AS DOUBLE)) AS gnomAD_exomes_AF,
  CASE WHEN lower(clinvar_clnsig) LIKE '%pathogenic%' THEN 1
       WHEN lower(clinvar_clnsig) LIKE '%benign%' THEN 0 END AS target
FROM variants_raw
WHERE clinvar_clnsig IS NOT NULL AND clinvar_clnsig <> ''
  AND (lower(clinvar_clnsig) LIKE '%pathogenic%' OR lower(clinvar_clnsig) LIKE '%benign%')
"""

VIEWS["contig_lengths"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', {length})" for name, length in CONTIG_LENGTHS.items())
    + ") AS t(chrom, chr_length)"
)

# rare variants; re-annotated indels are stored a second time with another CADD
VIEWS["store_local"] = """
SELECT chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred, gnomAD_exomes_AF
FROM variants_clean WHERE gnomAD_exomes_AF < CAST(0.005 AS DOUBLE)
UNION ALL
SELECT chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score, CADD_phred + 1, gnomAD_exomes_AF
FROM variants_clean WHERE gnomAD_exomes_AF < CAST(0.005 AS DOUBLE) AND length(ref) <> length(alt)
"""

# deleterious variants; the unplaced contig carries scores outside the legal range
VIEWS["store_lake"] = """
SELECT chrom, pos, ref, alt, SIFT_score, Polyphen2_HDIV_score,
  CASE WHEN chrom = 'GL000' THEN CADD_phred + 60 ELSE CADD_phred END AS CADD_phred, gnomAD_exomes_AF
FROM variants_clean WHERE CADD_phred >= 20
"""

VIEWS["variant_requests"] = """
SELECT variant_id AS request_id,
  CASE WHEN pos % 7 = 0 THEN concat('chr', chrom) WHEN pos % 7 = 1 THEN concat('CHR', chrom) ELSE chrom END AS chrom,
  CASE WHEN pos % 11 = 0 THEN concat(' ', CAST(pos AS STRING), ' ')
       WHEN pos % 13 = 0 THEN CAST(pos + 200000000 AS STRING) ELSE CAST(pos AS STRING) END AS pos,
  CASE WHEN pos % 5 = 0 THEN lower(ref) ELSE ref END AS ref,
  alt
FROM variants_raw
"""

# one row per physical line, ordered by (section, chrom, pos, ref, alt)
VIEWS["vcf_lines"] = """
SELECT 0 AS section, '' AS chrom, CAST(0 AS BIGINT) AS pos, '' AS ref, '' AS alt, '##fileformat=VCFv4.2' AS line
UNION ALL SELECT 1, '', CAST(0 AS BIGINT), '', '',
  concat('#CHROM', chr(9), 'POS', chr(9), 'ID', chr(9), 'REF', chr(9), 'ALT', chr(9), 'QUAL', chr(9), 'FILTER', chr(9), 'INFO')
UNION ALL SELECT 2, '', CAST(0 AS BIGINT), '', '', ''
UNION ALL SELECT 3, '', CAST(0 AS BIGINT), '', '', concat('1', chr(9), '100', chr(9), '.')
UNION ALL
SELECT 4 AS section, chrom, pos, ref, alt,
  concat(CASE WHEN pos % 4 = 0 THEN 'chr' ELSE '' END, chrom, chr(9), CAST(pos AS STRING), chr(9), '.', chr(9),
         CASE WHEN pos % 5 = 0 THEN lower(ref) ELSE ref END, chr(9),
         CASE WHEN pos % 6 = 0 THEN concat(alt, ', t') WHEN pos % 6 = 1 THEN concat(alt, ',,G') ELSE alt END,
         chr(9), '.', chr(9), 'PASS', chr(9), '.') AS line
FROM variants_raw
"""

VIEWS["prediction_events"] = """
SELECT event_id, ts,
  CASE WHEN event_id % 3 = 0 THEN '/api/vcf-batch-predict' ELSE '/api/predict' END AS endpoint,
  CASE WHEN event_id % 3 = 0 THEN 'vcf_batch' WHEN event_id % 3 = 1 THEN 'api' ELSE NULL END AS source,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN user_id % 26 < 22 THEN CAST(user_id % 26 + 1 AS STRING) WHEN user_id % 26 = 22 THEN 'X' ELSE NULL END AS chrom,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 2 AS INT) END AS prediction,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS probability,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE greatest(CAST(event_id % 101 AS DOUBLE) / 100, 1 - CAST(event_id % 101 AS DOUBLE) / 100) END AS confidence_score,
  value AS latency_ms,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 45 AS DOUBLE) END AS cadd,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS sift,
  CAST(event_id % 10 AS DOUBLE) / 10 AS polyphen,
  CAST(event_id % 50 AS DOUBLE) / 1000 AS alt_freq
FROM events
"""

VIEWS["scored"] = """
SELECT d.doc_id AS id, l.quality AS target,
  CAST((d.doc_id * 37 + d.n_chars * 11 + l.quality * 45) % 101 AS DOUBLE) / 100 AS probability,
  d.lang AS grp
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["scored_variants"] = """
SELECT chrom, pos, ref, alt, target, CADD_phred / 45 AS probability,
  CASE WHEN length(ref) <> length(alt) THEN 'INDEL' ELSE 'SNV' END AS variant_type,
  CASE WHEN gnomAD_exomes_AF < CAST(0.001 AS DOUBLE) THEN 'ultra_rare'
       WHEN gnomAD_exomes_AF < CAST(0.005 AS DOUBLE) THEN 'rare' ELSE 'common' END AS rarity
FROM variants_clean WHERE CADD_phred IS NOT NULL
"""

VIEWS["model_runs"] = """
SELECT o_orderkey AS run_id,
  CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
  CASE WHEN o_custkey % 3 = 0 THEN 'evaluation' ELSE 'training' END AS stage,
  CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE) / 1000 END AS pr_auc,
  o_orderdate AS start_time
FROM orders
"""

# registered versions: a run may be registered several times, from two kinds of source
VIEWS["model_versions"] = """
SELECT CAST(l_linenumber AS STRING) AS version, l_orderkey AS run_id,
  CASE WHEN l_returnflag = 'R' THEN concat('file:/runs/', CAST(l_orderkey AS STRING))
       ELSE concat('runs:/', CAST(l_orderkey AS STRING), '/model') END AS source
FROM lineitem
"""

VIEWS["review_queue"] = """
SELECT event_id AS id, ts, concat(coalesce(chrom, '?'), ':', CAST(event_id AS STRING), ' A>G') AS variant,
  CASE WHEN event_id % 3 = 0 THEN 'VCF Batch' WHEN event_id % 3 = 1 THEN 'Feature Store' ELSE 'Manual' END AS source,
  CASE WHEN prediction = 1 THEN 'PATHOGENIC' ELSE 'BENIGN' END AS label,
  probability, confidence_score AS confidence,
  CASE event_id % 5 WHEN 0 THEN 'Reviewed' WHEN 1 THEN 'Flagged' WHEN 2 THEN 'Exported' WHEN 3 THEN 'Needs review' ELSE NULL END AS review_status,
  sift, polyphen, cadd, alt_freq
FROM prediction_events WHERE status = 'success'
"""


def with_clause(body: str, views: dict[str, str] = VIEWS) -> str:
    """Prefix ``body`` with the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({views[name].strip()})" for name in needed)
    lead = body.strip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{lead[5:]}"
    return f"WITH {ctes}\n{lead}"


def view(spark: SparkSession, name: str, resolve: Callable[[str], DataFrame]) -> DataFrame:
    """One view as a DataFrame; ``resolve`` gives the tables and views it reads directly."""
    text = VIEWS[name]
    used = [n for n in [*TABLES, *VIEWS] if re.search(rf"(FROM|JOIN) {n}\b", text)]
    for source in used:
        text = re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
    return spark.sql(text, **{source: resolve(source) for source in used})
