"""Set algebra, phrases and proximity over postings. Every operator gives documents by semi-joins, anti-joins or one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def any_of(posted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents with at least one of the terms."""
    return posted.where(F.col("term").isin(list(terms))).select("doc_id").distinct()


def all_of(posted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents with each of the terms, in one aggregation whatever their number; none for no terms."""
    terms = sorted(set(terms))
    hits = posted.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(terms)).select("doc_id")


def none_of(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents of docs that aren't matched."""
    return docs.select("doc_id").join(matched.select("doc_id"), "doc_id", "left_anti")


def and_not(posted: DataFrame, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Documents with all positive terms and none of the negative."""
    return none_of(all_of(posted, positive), any_of(posted, negative))


def intersect_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merge of two lists (doc_id, positions): common documents with the positions of both, and as tf their number."""
    both = left.select("doc_id", F.col("positions").alias("a")).join(right.select("doc_id", F.col("positions").alias("b")), "doc_id")
    return both.select("doc_id", F.array_sort(F.concat("a", "b")).alias("positions")).withColumn("tf", F.size("positions"))


def union_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two lists (doc_id, tf, positions): common documents add up."""
    every = left.select("doc_id", "tf", "positions").unionByName(right.select("doc_id", "tf", "positions"))
    return every.groupBy("doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def phrase_starts(tokens: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, start) where the terms stand in a row, from a token table: every token votes for the start its place in the phrase implies."""
    places = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("idx")) for i, t in enumerate(terms)])
    hits = tokens.where(F.col("term").isin(list(set(terms)))).withColumn("at", F.explode(F.filter(places, lambda x: x["term"] == F.col("term"))))
    starts = hits.groupBy("doc_id", (F.col("pos") - F.col("at.idx")).alias("start")).agg(F.count_distinct("at.idx").alias("n"))
    return starts.where(F.col("n") == len(terms)).select("doc_id", "start")


def phrase(tokens: DataFrame, terms: Sequence[str]) -> DataFrame:
    return phrase_starts(tokens, terms).select("doc_id").distinct()


def proximity_span(tokens: DataFrame, terms: Sequence[str], distance: int) -> DataFrame:
    """(doc_id, span): documents with all terms whose occurrences, all taken together, lie within distance."""
    terms = sorted(set(terms))
    seen = tokens.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"), (F.max("pos") - F.min("pos")).alias("span"))
    return seen.where((F.col("n") == len(terms)) & (F.col("span") <= distance)).select("doc_id", "span")


def proximity_min_window(tokens: DataFrame, terms: Sequence[str], distance: int) -> DataFrame:
    """(doc_id, span): documents where some window with all terms spans at most distance, and the smallest such span.

    Per document the places are sorted once and, walking along, the last place of each term is kept: no join of places with places.
    """
    terms = sorted(set(terms))
    place = F.struct("pos", F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")).alias("k"))
    seen = tokens.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("places"), F.count_distinct("term").alias("n")).where(F.col("n") == len(terms))
    big = 1 << 30
    step = f"""aggregate(places, named_struct('last', array_repeat({-big}L, {len(terms)}), 'best', {big}L),
      (s, p) -> named_struct(
        'last', transform(s.last, (x, i) -> IF(i = p.k - 1, CAST(p.pos AS BIGINT), x)),
        'best', least(s.best, p.pos - array_min(transform(s.last, (x, i) -> IF(i = p.k - 1, CAST(p.pos AS BIGINT), x))))),
      s -> s.best)"""
    return seen.select("doc_id", F.expr(step).alias("span")).where(F.col("span") <= distance)
