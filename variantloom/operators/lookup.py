"""Feature-store lookups of variant batches as joins on the normalised variant key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantloom.contract import STORE_SCORE_ALIASES
from variantloom.functions.genomic import identity, normalize_chrom
from variantloom.functions.values import first_number

KEY = ["k_chrom", "k_pos", "k_ref", "k_alt"]
SCORES = ["sift", "polyphen", "cadd", "alt_freq"]
HOT_SHARE = 0.01  # share of a batch from which a requested key is hot


def variant_key(df: DataFrame) -> dict[str, Column]:
    """Normalised identity: contig without prefix, numeric position, upper-case alleles."""
    key = identity(df)
    return {
        "k_chrom": normalize_chrom(key["chrom"].cast("string")),
        "k_pos": F.trim(key["pos"].cast("string")).try_cast("bigint"),
        "k_ref": F.upper(F.trim(key["ref"].cast("string"))),
        "k_alt": F.upper(F.trim(key["alt"].cast("string"))),
    }


def store_rows(store: DataFrame) -> DataFrame:
    """Key and the four scores of a store table, whatever its columns are called."""
    return store.select(
        *[c.alias(n) for n, c in variant_key(store).items()],
        *[first_number(store, names).alias(role) for role, names in STORE_SCORE_ALIASES.items()],
    )


def store_dedupe_first(rows: DataFrame, rank: str | None = None) -> DataFrame:
    """One row per key: best tier, then highest CADD, then the other scores in order.

    ``row_number() = 1`` is planned as a per-task group limit before the shuffle, so a key with
    very many copies sends at most one row per task.
    """
    order = [F.col(rank)] if rank else []
    order += [F.desc_nulls_last("cadd"), *[F.asc_nulls_last(c) for c in ("sift", "polyphen", "alt_freq")]]
    picked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    return picked.where(F.col("_n") == 1).drop("_n")


def resolve_store(tiers: Mapping[str, DataFrame]) -> DataFrame:
    """Several store tiers, in order of preference, as one table with unique keys.

    One union and one shuffle replace a lookup, an anti-join of the misses and a second lookup.
    """
    parts = [
        store_rows(store).withColumns({"feature_source": F.lit(name), "_tier": F.lit(i)})
        for i, (name, store) in enumerate(tiers.items())
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return store_dedupe_first(union, rank="_tier").drop("_tier")


# --- the keyed store --------------------------------------------------------------------


def _table_name(path: str) -> str:
    return f"variantloom_store_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_keyed_store(store: DataFrame, path: str, buckets: int) -> DataFrame:
    """``store`` (unique keys) as ``buckets`` files, each with its hash bucket of keys in order.

    Lookups join it bucket by bucket: the store is never shuffled again, however often it is asked. Within a file the
    keys are sorted, so the row groups of a contig and a range of positions are skipped or read as a whole. Rows
    whose key has a NULL can match no request and are left out.
    """
    spark = store.sparkSession
    rows = store.dropna(subset=KEY).repartition(buckets, *KEY).sortWithinPartitions(*KEY)
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    rows.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(_table_name(path))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}.buckets")
    return open_keyed_store(spark, path)


def open_keyed_store(spark: SparkSession, path: str) -> DataFrame:
    """A store written by ``write_keyed_store``, in this or another application."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.json(f"{path}.buckets").first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        keys = ", ".join(KEY)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def hot_keys(keyed: DataFrame, share: float = HOT_SHARE) -> list[tuple]:
    """The keys that hold ``share`` of the requests or more: at most 1 / ``share`` of them, from one pass with a fixed-size sketch."""
    most = math.ceil(1 / share)
    item = F.concat_ws("\t", *[F.col(k).cast("string") for k in KEY])
    whole = keyed.dropna(subset=KEY).select(item.alias("item"))
    row = whole.agg(F.expr(f"approx_top_k(item, {most}, {32 * most})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return []
    hot = [r["item"].split("\t") for r in row["top"] if r["count"] >= max(2, share * row["n"])]
    return [(chrom, int(pos), ref, alt) for chrom, pos, ref, alt in hot]


def _answer_hot(keyed: DataFrame, store: DataFrame, hot: list[tuple]) -> DataFrame:
    """Hot requests answered from a broadcast of their few store rows, and their keys scattered over values no store row has."""
    spark = keyed.sparkSession
    wanted = spark.createDataFrame(hot, ", ".join(f"{k} {'bigint' if k == 'k_pos' else 'string'}" for k in KEY))
    near = store.where(F.col("k_pos").isin([pos for _, pos, _, _ in hot]))  # skips row groups
    rows = wanted.join(F.broadcast(near.join(F.broadcast(wanted), KEY, "left_semi")), KEY, "left")  # as many rows as hot keys
    answers = rows.select(*KEY, F.lit(True).alias("_hot"), F.struct(*[c for c in store.columns if c not in KEY]).alias("_answer"), F.col("found").alias("_known"))
    out = keyed.join(F.broadcast(answers), KEY, "left")
    scattered = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    return out.withColumn("k_pos", F.when(F.col("_hot"), scattered).otherwise(F.col("k_pos")))


def lookup(requests: DataFrame, store: DataFrame, split_hot: bool = False) -> DataFrame:
    """Requests with ``found`` and the scores of their variant (NULL when it is not in the store).

    ``store`` holds unique keys (``resolve_store``), best as a keyed store: then only the requests are
    shuffled. A plain stored table is shuffled too, and adaptive execution splits a request key that holds a large
    share of the batch. It cannot do that beside a bucketed table; ``split_hot`` does: keys with a hundredth of the requests or
    more are answered by broadcast, at the price of one pass over the keys of the requests.
    """
    keyed = requests.withColumns(variant_key(requests))
    clash = [c for c in requests.columns if c in [*SCORES, "feature_source"]]
    keyed = keyed.drop(*clash)
    known = store.withColumn("found", F.lit(True))
    hot = hot_keys(keyed) if split_hot else []
    if not hot:
        joined = keyed.join(known, KEY, "left")
        return joined.withColumn("found", F.coalesce("found", F.lit(False))).drop(*KEY)
    joined = _answer_hot(keyed, known, hot).join(known, KEY, "left")
    values = {c: F.when(F.col("_hot"), F.col(f"_answer.{c}")).otherwise(F.col(c)).alias(c) for c in store.columns if c not in KEY}
    found = F.coalesce(F.when(F.col("_hot"), F.col("_known")).otherwise(F.col("found")), F.lit(False))
    return joined.withColumns({**values, "found": found}).drop(*KEY, "_hot", "_answer", "_known")


def lookup_local_store(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Lookup in one tier that may hold several rows per key."""
    return lookup(requests, store_dedupe_first(store_rows(store)))


def lookup_two_tier(requests: DataFrame, local: DataFrame, lake: DataFrame) -> DataFrame:
    """Lookup in the local tier, then the lake; ``feature_source`` tells which one answered."""
    return lookup(requests, resolve_store({"local": local, "lake": lake}))


def lookup_found(requests: DataFrame, store: DataFrame) -> DataFrame:
    keyed = requests.withColumns(variant_key(requests))
    return keyed.join(store.select(*KEY), KEY, "left_semi").drop(*KEY)


def lookup_not_found(requests: DataFrame, store: DataFrame) -> DataFrame:
    keyed = requests.withColumns(variant_key(requests))
    return keyed.join(store.select(*KEY), KEY, "left_anti").drop(*KEY)


def write_tiers(tiers: Mapping[str, DataFrame], path: str, buckets: int) -> DataFrame:
    """The keyed store of several tiers."""
    return write_keyed_store(resolve_store(tiers), path, buckets)


def manual_fallback_gate(looked_up: DataFrame, manual: Mapping[str, str] | None = None) -> DataFrame:
    """Status of each request: found, or scorable by hand because all four scores were entered.

    ``manual`` names the columns with hand-entered scores.
    """
    names = manual or {s: f"manual_{s}" for s in SCORES}
    complete = F.lit(True)
    for column in names.values():
        complete = complete & F.coalesce(F.abs(F.col(column).try_cast("double")) < float("inf"), F.lit(False))
    status = F.when(F.col("found"), "found").when(complete, "manual_ready").otherwise("needs_input")
    return looked_up.withColumn("status", status)
