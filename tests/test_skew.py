"""Hot keys: results, and that their rows stay out of the shuffle."""
import re

from pyspark.sql import functions as F

from textloom.operators.skew import join_per_key


def tables(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") < 1800, 0).otherwise(F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("v"))
    return rows, rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))


def test_same_rows_as_a_plain_join(spark):
    rows, per_key = tables(spark)
    want = sorted(map(tuple, rows.join(per_key, ["k"]).collect()))
    assert sorted(map(tuple, join_per_key(rows, per_key, ["k"], "n", hot_rows=100).collect())) == want
    assert sorted(map(tuple, join_per_key(rows, per_key, ["k"], "n", 2000, 10_000).collect())) == want
    assert sorted(map(tuple, join_per_key(rows, per_key, ["k"], "n").collect())) == want


def test_rows_of_hot_keys_are_not_shuffled(spark):
    rows, per_key = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_per_key(rows, per_key, ["k"], "n", hot_rows=100)
        # Rows per task of the shuffled side: a task with the 1,800 rows of key 0 would show.
        cold = joined.where("n <= 100").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert cold < 200
    # The marking broadcast join and its filter lie below the exchange of the rows.
    exchange = plan[plan.index("SortMergeJoin"):]
    assert re.search(r"Exchange hashpartitioning\(k[\s\S]*?Filter isnull\(_hot[\s\S]*?BroadcastHashJoin", exchange)
