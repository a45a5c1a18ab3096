"""Ranked retrieval: scorers by name, batches of queries, thresholds, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodetext.operators.index import lookup
from lodetext.operators.index import stats as collection_stats


def idf(n_docs: Column, df: Column) -> Column:
    """ln(N / df), 0 where either is 0."""
    return F.when((df > 0) & (n_docs > 0), F.log(n_docs / df)).otherwise(F.lit(0.0))


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    norm = F.when(avgdl > 0, 1 - b + b * dl / avgdl).otherwise(F.lit(1.0))
    return F.when(tf > 0, idf(n_docs, df) * tf * (k1 + 1) / (tf + k1 * norm)).otherwise(F.lit(0.0))


def server_bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """The search servers' form: smoothed idf, no k1 + 1."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl))


C = F.col
#: Scorers: a term's part of a document's score, and its largest value in any document.
SCORERS: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {
    "boolean": (lambda: F.lit(1.0), lambda: F.lit(1.0)),
    "tf": (lambda: C("tf").cast("double"), lambda: C("max_tf").cast("double")),
    "bm25": (lambda: bm25(C("tf"), C("df"), C("dl"), C("n_docs"), C("avgdl")), lambda: bm25(C("max_tf"), C("df"), F.lit(1), C("n_docs"), C("avgdl"))),
}


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, terms array): a repeated term counts as often as it stands."""
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def restricted(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the workload's terms. They are named in a filter, which reaches the tokens or the files; a semi-join would come after the shuffle of every posting."""
    return lookup(posted, sorted({r["term"] for r in wanted.select("term").collect()} - {None}))  # the workload's terms


def term_parts(posted: DataFrame, wanted: DataFrame, scorer: str = "bm25", stats: DataFrame | dict | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, weight, part, bound): the part of each query term in each document that has it. Terms unknown to the index give no rows.

    The workload restricts the postings before anything is counted. terms: a table (term, df, max_tf) of the workload's terms; without it they are counted from
    the postings that are left. stats is the collection's n_docs and avgdl, as one row or as numbers; without it, one aggregation over documents gives it, and
    posted must hold the whole collection.
    """
    part, bound = SCORERS[scorer]
    if terms is None:
        needed = restricted(posted, wanted)
        counted = needed.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
        rows = needed.join(F.broadcast(counted), "term").join(F.broadcast(wanted), "term")  # rows of the workload
    else:
        rows = posted.join(F.broadcast(terms.select("term", "df", "max_tf").join(F.broadcast(wanted), "term")), "term")  # rows of the workload
    if isinstance(stats, dict):
        rows = rows.withColumns({c: F.lit(float(stats[c])) for c in ("n_docs", "avgdl")})
    elif scorer == "bm25":
        rows = rows.crossJoin(F.broadcast(collection_stats(posted) if stats is None else stats))  # one row
    return rows.select("query_id", "doc_id", "term", "weight", part().alias("part"), bound().alias("bound"))


def scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.sum(C("part") * C("weight")).alias("score"))


def top_k(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): by score, then doc_id. Rows beyond k go before the shuffle (WindowGroupLimit)."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(C("rank") <= k).select("query_id", "rank", "doc_id", "score")


def ranked(posted: DataFrame, queries: DataFrame, k: int = 10, scorer: str = "bm25", digits: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The whole workload in one plan."""
    return top_k(scores(term_parts(posted, query_terms(queries), scorer, stats)), k, digits)


def bounds(parts: DataFrame) -> DataFrame:
    """(query_id, bound_sum, n_terms): sum of the largest parts of a query's known terms, and their number with repeats."""
    each = parts.groupBy("query_id", "term").agg(F.max("bound").alias("bound"), F.max("weight").alias("weight"))
    return each.groupBy("query_id").agg(F.sum("bound").alias("bound_sum"), F.sum("weight").alias("n_terms"))


def term_threshold(parts: DataFrame, threshold: float) -> DataFrame:
    """Parts above threshold * bound_sum / n_terms."""
    return parts.join(bounds(parts), "query_id").where(C("part") > threshold * C("bound_sum") / C("n_terms"))


def ranked_term_threshold(posted: DataFrame, queries: DataFrame, threshold: float, k: int = 10, scorer: str = "bm25", digits: int | None = None, stats: DataFrame | dict | None = None) -> DataFrame:
    """A term's part counts only where above threshold * bound_sum / n_terms."""
    return top_k(scores(term_threshold(term_parts(posted, query_terms(queries), scorer, stats), threshold)), k, digits)


def ranked_doc_threshold(posted: DataFrame, queries: DataFrame, threshold: float, k: int = 10, scorer: str = "bm25", digits: int | None = None, stats: DataFrame | dict | None = None) -> DataFrame:
    """A document stays only with a score of at least threshold * bound_sum."""
    parts = term_parts(posted, query_terms(queries), scorer, stats)
    kept = scores(parts).join(bounds(parts), "query_id").where(C("score") >= threshold * C("bound_sum"))
    return top_k(kept.select("query_id", "doc_id", "score"), k, digits)


def ranked_early_stop(posted: DataFrame, terms: list[str], k: int = 10, window: int = 3, scorer: str = "bm25", digits: int = 6, stats: DataFrame | None = None) -> DataFrame:
    """Term-at-a-time with the stop rule: once the set of the best k has been the same after `window` terms in a row, later terms don't count.

    Approximate by definition. Every prefix of the query is scored at once: parts are repeated for the prefixes they belong to, the
    best k of each prefix are compared with those before, and the first stable prefix (else the last) is returned as query 0.
    """
    spark = posted.sparkSession
    known = {r["term"] for r in posted.where(C("term").isin(terms)).select("term").distinct().collect()}
    order = [t for t in terms if t in known]
    rows = [(p, order[:p]) for p in range(1, len(order) + 1)]
    prefixes = spark.createDataFrame(rows or [(1, [])], "query_id int, terms array<string>")
    best = ranked(posted, prefixes, k, scorer, digits, stats)
    sets = best.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    along = Window.orderBy("query_id").rowsBetween(-(window - 1), 0)  # as many rows as the query has terms
    sets = sets.withColumn("n", F.count("*").over(along)).withColumn("seen", F.size(F.collect_set("docs").over(along)))
    stop = sets.agg(F.coalesce(F.min(F.when((C("n") == window) & (C("seen") == 1), C("query_id"))), F.max("query_id")).alias("stop"))
    return best.join(F.broadcast(stop), C("query_id") == C("stop")).select(F.lit(0).alias("query_id"), "rank", "doc_id", "score")


def total_hits(scored: DataFrame) -> DataFrame:
    """(query_id, total_hits, max_score)."""
    return scored.groupBy("query_id").agg(F.count("*").alias("total_hits"), F.max("score").alias("max_score"))


def field_scores(fields: dict[str, tuple], queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): per document the largest of its fields' boosted scores. fields: name to (postings, boost), or (postings, boost, the field's statistics as one row), whose postings may be those of the workload's terms only."""
    wanted = query_terms(queries)
    every = None
    for posted, boost, *stats in fields.values():
        needed = restricted(posted, wanted)
        df = needed.groupBy("term").agg(F.count("*").alias("df"))
        rows = needed.join(F.broadcast(df), "term").join(F.broadcast(wanted), "term")  # rows of the workload
        rows = rows.crossJoin(F.broadcast(stats[0] if stats else collection_stats(posted)))  # one row
        part = server_bm25(C("tf"), C("df"), C("dl"), C("n_docs"), C("avgdl"))
        one = rows.groupBy("query_id", "doc_id").agg((boost * F.sum(part * C("weight"))).alias("score"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def best_fields(fields: dict[str, tuple], queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """Multi-field search: the k best by field_scores."""
    return top_k(field_scores(fields, queries), k, digits)


def enriched(scored: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The k best with the columns of meta (doc_id, ...); documents without metadata are out before ranks are given."""
    return top_k(scored.join(meta.select("doc_id"), "doc_id", "left_semi"), k).join(meta, "doc_id")
