"""Retrieval quality, workload and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, f1) at k of ranked lists (query_id, rank, doc_id): precision divides by k, recall by the relevant up to k. Queries in either list appear."""
    got = retrieved.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    want = relevant.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    both = got.withColumn("g", F.lit(1)).join(want.withColumn("w", F.lit(1)), ["query_id", "doc_id"], "full")
    sums = both.groupBy("query_id").agg(F.count("g").alias("n_got"), F.count("w").alias("n_want"), F.sum(F.when(F.col("g").isNotNull() & F.col("w").isNotNull(), 1).otherwise(0)).alias("tp"))
    rows = sums.withColumn("precision", F.col("tp") / F.lit(k)).withColumn("recall", F.when(F.col("n_want") > 0, F.col("tp") / F.col("n_want")).otherwise(0.0))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def macro_average(rows: DataFrame) -> DataFrame:
    """One row of means over queries with something on either side, rounded to 4 digits, and counts of those and of the others."""
    ok = (F.col("n_got") > 0) & (F.col("n_want") > 0)
    means = [F.round(F.avg(F.when(ok, F.col(c))), 4).alias(c) for c in ("precision", "recall", "f1")]
    return rows.agg(*means, F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


def top_sets_agree(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, same): whether two ranked lists have the same set of first k."""
    sets = lambda x, name: x.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias(name))
    both = sets(a, "x").join(sets(b, "y"), "query_id", "full")
    return both.select("query_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, population deviation, extremes, 95th and 99th percentile (interpolated), count and throughput a second of milliseconds."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.expr(f"percentile({value}, 0.5)").alias("median"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.expr(f"percentile({value}, 0.95)").alias("p95"),
        F.expr(f"percentile({value}, 0.99)").alias("p99"),
        F.count("*").alias("n"),
        (F.count("*") / F.sum(value) * 1000).alias("throughput"),
    )


def workload_stats(queries: DataFrame, column: str = "query_text") -> DataFrame:
    """One row of counts over query texts: operators, phrases, parentheses, single terms, mean and distinct terms."""
    q = F.col(column)
    plain = F.regexp_replace(q, r'[()"]', "")
    for op in ("AND", "OR", "NOT"):
        plain = F.replace(plain, F.lit(f" {op} "), F.lit(" "))
    rows = queries.select(q.alias("q"), F.filter(F.split(plain, r"\s+"), lambda t: t != "").alias("terms"))
    counted = rows.agg(
        F.count("*").alias("total_queries"),
        F.count_if(~F.contains(F.expr("trim(BOTH '\"' FROM q)"), F.lit(" "))).alias("single_term"),
        *[F.count_if(F.contains("q", F.lit(f" {op} "))).alias(f"with_{op.lower()}") for op in ("AND", "OR", "NOT")],
        F.count_if(F.contains("q", F.lit('"'))).alias("phrase_queries"),
        F.count_if(F.contains("q", F.lit("("))).alias("complex_queries"),
        F.avg(F.size("terms")).alias("avg_terms_per_query"),
        F.size(F.array_distinct(F.flatten(F.collect_set("terms")))).cast("long").alias("unique_terms"),
    )
    return counted
