"""Corpus reports and benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_counts(rows: DataFrame, column: str, n: int = 15) -> DataFrame:
    """(column, n) of the most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def length_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row of mean, upper median, least and greatest length of texts. The median is found by counting lengths, not by gathering them."""
    sizes = rows.select(F.length(text).alias("len")).where("len IS NOT NULL").groupBy("len").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("total"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.array_sort(F.collect_list(F.struct("len", "n"))).alias("all"))
    walk = "aggregate(all, named_struct('seen', 0L, 'len', CAST(NULL AS INT)), (s, x) -> named_struct('seen', s.seen + x.n, 'len', IF(s.len IS NULL AND s.seen + x.n > total div 2, x.len, s.len)), s -> s.len)"
    return whole.select("avg_len", F.expr(walk).alias("median_len"), "min_len", "max_len")


def exploded_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of the values of an array column; share is of rows."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def json_fields(rows: DataFrame, column: str) -> DataFrame:
    """(field, n): names of the fields of JSON objects and in how many they stand."""
    return rows.select(F.explode(F.expr(f"json_object_keys({column})")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def dataset_stats(rows: DataFrame, column: str, cap: int = 100_000) -> DataFrame:
    """One row: number of JSON objects (at most `cap` is told) and the sorted names of all fields met in any of them."""
    fields = json_fields(rows, column).agg(F.array_sort(F.collect_list("field")).alias("fields"))  # a row a name
    count = rows.where(F.col(column).isNotNull()).agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    return count.crossJoin(F.broadcast(fields))  # one row each


def sample_rows(rows: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first n rows by a column."""
    return rows.orderBy(order).limit(n)


def first_match_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left outer join with one row of right for each key: the smallest by its other columns."""
    rest = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.min(F.struct(*rest)).alias("r")).select(*on, "r.*")
    return left.join(one, list(on), "left")


def pivoted(rows: DataFrame, by: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """A row for each value of `by`, a column for each of `values`: the least measure there, 0 for none."""
    return rows.groupBy(by).pivot(column, list(values)).agg(F.min(measure)).na.fill(0, list(values))


def word_frequency_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: tokens and terms of two frequency tables (term, freq) and by how many percent tokens and terms fell."""
    one = before.agg(F.sum("freq").alias("tokens_before"), F.count("*").alias("terms_before"))
    two = after.agg(F.sum("freq").alias("tokens_after"), F.count("*").alias("terms_after"))
    both = one.crossJoin(F.broadcast(two))  # one row each
    fell = lambda a, b: F.round(100.0 * (F.col(a) - F.col(b)) / F.col(a), 4)
    return both.withColumn("token_reduction", fell("tokens_before", "tokens_after")).withColumn("term_reduction", fell("terms_before", "terms_after"))
