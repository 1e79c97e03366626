"""The keyed store: no shuffle of the store, pruning, hot requests."""

from pyspark.sql import functions as F

from variantloom.operators import lookup
from variantloom.session import fresh_path

STORE = "chrom string, pos bigint, ref string, alt string, SIFT_score double, Polyphen2_HDIV_score double, CADD_phred double, gnomAD_exomes_AF double"


def keyed(spark, rows, buckets=8):
    store = spark.createDataFrame(rows, STORE)
    return lookup.write_tiers({"local": store}, fresh_path(spark, "keyed"), buckets)


def rows(n):
    return [(str(1 + i % 4), i, "A", "G", 0.1, 0.2, float(i % 40), 0.3) for i in range(n)] + [(None, 5, "A", "G", 0.1, 0.2, 1.0, 0.3)]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_store_side_is_not_shuffled(spark):
    store = keyed(spark, rows(2000))
    requests = spark.createDataFrame([(f"chr{1 + i % 4}", str(i), "a", "g") for i in range(0, 4000, 3)], "chrom string, pos string, ref string, alt string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (lookup.lookup(requests, store), lookup.lookup_found(requests, store), lookup.lookup_not_found(requests, store)):
            plan = plan_of(query).split("Initial Plan")[0]
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert lookup.lookup(requests, store).where("found").count() == len(range(0, 2000, 3))
        assert lookup.lookup_found(requests, store).count() + lookup.lookup_not_found(requests, store).count() == requests.count()
        one = store.where("k_chrom = '2' AND k_pos = 5 AND k_ref = 'A' AND k_alt = 'G'")
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
        assert one.count() == 1 and "EqualTo(k_pos,5)" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_store_opens_again(spark):
    path = fresh_path(spark, "keyed")
    lookup.write_tiers({"local": spark.createDataFrame(rows(100), STORE)}, path, 4)
    spark.sql(f"DROP TABLE {lookup._table_name(path)}")
    again = lookup.open_keyed_store(spark, path)
    assert again.count() == 100
    assert lookup.lookup(spark.createDataFrame([("1", "4", "A", "G")], "chrom string, pos string, ref string, alt string"), again).where("found").count() == 1
    lookup.write_tiers({"local": spark.createDataFrame(rows(50), STORE)}, path, 8)
    assert lookup.open_keyed_store(spark, path).count() == 50


def test_hot_requests_are_spread_and_answered(spark):
    store = keyed(spark, rows(500))
    cold = [(i, f"chr{1 + i % 4}", str(i), "a", "g") for i in range(600)]
    hot = [(1000 + i, "2", "101", "A", "G") for i in range(900)] + [(3000 + i, "9", "7", "A", "G") for i in range(700)] + [(5000, None, None, None, None), (5001, "1", "x", "A", "G")]
    requests = spark.createDataFrame(cold + hot, "id bigint, chrom string, pos string, ref string, alt string")
    assert sorted(lookup.hot_keys(requests.withColumns(lookup.variant_key(requests)))) == [("2", 101, "A", "G"), ("9", 7, "A", "G")]
    plain = lookup.lookup(requests, store)
    split = lookup.lookup(requests, store, split_hot=True)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0
    spread = lookup._answer_hot(requests.withColumns(lookup.variant_key(requests)), store.withColumn("found", F.lit(True)), [("2", 101, "A", "G"), ("9", 7, "A", "G")])
    assert spread.groupBy("k_chrom", "k_pos").count().agg(F.max("count")).first()[0] <= 4
    assert lookup.lookup(requests.limit(0), store, split_hot=True).count() == 0
