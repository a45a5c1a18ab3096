"""The positional inverted index as DataFrames: postings, docs, terms, stats."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodetext.functions.encoding import gap_decode, gap_encode, vbyte_decode, vbyte_encode
from lodetext.functions.text import PLAIN, AnalyzerConfig, token_table, tokens


def named(column: str, name: str) -> Column:
    """A column under a name. Never an alias to the name it has: Spark removes those on one side of a join only, and then the two sides don't share their shuffle."""
    return F.col(column) if column == name else F.col(column).alias(name)


#: Bytes of stored documents a task parts into postings, which take some thirty times as much in memory.
PART_BYTES = 8 << 20


def texts_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, texts): a row per document, in parts small enough for what is made of them. Rows that share an id are one document, in an order of their own."""
    rows = docs.select(named(doc_id, "doc_id"), named(text, "text"))
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # of the files read; no job
    if size < 1 << 60:  # else it isn't known
        least = docs.sparkSession.sparkContext.defaultParallelism if size > 1 << 20 else 1
        rows = rows.repartition(min(max(-(-size // PART_BYTES), least), 20_000), "doc_id")
    held = F.sort_array(F.collect_list(F.struct(F.xxhash64("text").alias("h"), "text")))
    return rows.groupBy("doc_id").agg(F.transform(held, lambda x: x["text"]).alias("texts"))


def runs(rows: DataFrame, entry: Callable[[Column, Column], Column], *keep: str) -> DataFrame:
    """Exploded rows (keep, e): an entry for each run of equal terms in `at`, an array of structs (term, ...) that is sorted."""
    new = lambda k: (k == 0) | (F.get("at", k)["term"] != F.get("at", k - 1)["term"])
    starts = F.filter(F.when(F.size("at") > 0, F.sequence(F.lit(0), F.size("at") - 1)), new)
    rows = rows.select(*keep, "at", starts.alias("starts"))
    part = lambda s, j: entry(F.get("at", s)["term"], F.slice("at", s + 1, F.coalesce(F.get("starts", j + 1), F.size("at")) - s))
    return rows.select(*keep, F.transform("starts", part).alias("entries"))


def by_document(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, dl, entries (term, positions)): postings before they are exploded. Texts are dealt by doc_id once; a document's tokens are sorted and parted within its row."""
    one_text = lambda t: tokens(t, config)
    toks = F.when(F.size("texts") == 1, one_text(F.get("texts", F.lit(0)))).otherwise(F.flatten(F.transform("texts", one_text)))
    rows = texts_of(docs, text, doc_id).select("doc_id", toks.alias("toks"))
    placed = F.transform("toks", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    rows = rows.select("doc_id", F.size("toks").alias("dl"), F.sort_array(placed).alias("at"))
    return runs(rows, lambda term, run: F.struct(term.alias("term"), F.transform(run, lambda x: x["pos"]).alias("positions")), "doc_id", "dl")


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, term, tf, positions) of rows with entries (term, positions).

    What is exploded is an expression, not a column: of a column Spark would infer that it isn't empty, and make all of it once more for that filter.
    """
    entry = lambda e: F.struct(e["term"].alias("term"), F.size(e["positions"]).cast("long").alias("tf"), e["positions"].alias("positions"))
    return rows.select(*keep, F.explode(F.transform("entries", entry)).alias("e")).select(*keep, "e.*")


def postings(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, dl, term, tf, positions): only texts are shuffled, by doc_id. Stems need the vocabulary, so with stemming it is a shuffle on (doc_id, term), combined before it."""
    if not config.stemming:
        return exploded(by_document(docs, config, text, doc_id), "doc_id", "dl")
    rows = token_table(docs, config, text, doc_id)
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def of_terms(docs: DataFrame, wanted: Sequence[str], config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """postings() of the wanted terms, and (doc_id, dl) of all documents with tokens. Both lie in one shuffle, of a row per document with the wanted tokens only.

    Texts are analyzed once for both, however often they are used in a plan: everything after that shuffle reads the whole of its rows, so that it is the same one.
    """
    if config.stemming:  # stems are known by the vocabulary only
        return lookup(postings(docs, config, text, doc_id), sorted(wanted)), doc_lengths(docs, config, text, doc_id)
    rows = docs.select(named(doc_id, "doc_id"), F.xxhash64(text).alias("h"), tokens(F.col(text), config).alias("toks"))
    placed = F.transform("toks", lambda t, i: F.when(t.isin(sorted(wanted)), F.struct(t.alias("term"), i.alias("pos"))))
    part = F.struct("h", F.size("toks").alias("n"), F.filter(placed, lambda x: x.isNotNull()).alias("found"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + x["n"])
    moved = lambda x, k: F.transform(x["found"], lambda y: F.struct(y["term"].alias("term"), (y["pos"] + total(F.slice("parts", 1, k))).alias("pos")))
    found = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))["found"]).otherwise(F.flatten(F.transform("parts", moved)))
    entries = runs(
        rows.select("doc_id", total("parts").alias("dl"), F.sort_array(found).alias("at")),
        lambda term, run: F.struct(term.alias("term"), F.transform(run, lambda x: x["pos"]).alias("positions")), "doc_id", "dl",
    )
    return exploded(entries, "doc_id", "dl"), rows.select("doc_id", total("parts").alias("dl")).where("dl > 0")


def frequencies(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, dl, term, tf): postings without positions."""
    return token_table(docs, config, text, doc_id).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def doc_table(posted: DataFrame) -> DataFrame:
    """(doc_id, dl) of documents with tokens."""
    return posted.groupBy("doc_id").agg(F.max("dl").alias("dl"))


def doc_lengths(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_table() from the documents themselves: a row each is shuffled, not their postings."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text), config)).alias("dl")).where("dl > 0")
    return rows.groupBy("doc_id").agg(F.max("dl").alias("dl"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """stats() of a table (doc_id, dl)."""
    return lengths.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_terms"), F.avg("dl").alias("avgdl"))


def terms(posted: DataFrame) -> DataFrame:
    """(term, df, cf, max_tf)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def stats(posted: DataFrame) -> DataFrame:
    """One row: n_docs, total_terms, avgdl. Every document has a posting of its first token, so documents need no shuffle of their own."""
    return length_stats(doc_table(posted))


def index_stats(posted: DataFrame) -> DataFrame:
    """One row: documents, terms, tokens, average document and postings length."""
    of_terms = terms(posted).agg(F.count("*").alias("n_terms"), F.sum("cf").alias("n_tokens"), F.avg("df").alias("avg_postings_length"))
    return stats(posted).select("n_docs", F.col("avgdl").alias("avg_doc_length")).crossJoin(F.broadcast(of_terms))  # one row each


def merged(*parts: DataFrame) -> DataFrame:
    """Postings of several lists: frequencies add up, positions are joined and sorted; entries without positions are left out."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(F.size("positions") > 0)
    return every.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def merged_documents(rows: DataFrame) -> DataFrame:
    """merged() of lists that already lie in their document's row: (doc_id, lists), each list as the entries of by_document(). Nothing is shuffled."""
    held = F.transform("lists", lambda entries: F.filter(entries, lambda e: F.size(e["positions"]) > 0))
    rows = rows.select("doc_id", F.sort_array(F.flatten(held)).alias("at"))
    joined = lambda run: F.sort_array(F.flatten(F.transform(run, lambda e: e["positions"])))
    return exploded(runs(rows, lambda term, run: F.struct(term.alias("term"), joined(run).alias("positions")), "doc_id"), "doc_id")


def updated(posted: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, config: AnalyzerConfig = PLAIN) -> DataFrame:
    """Postings without the documents in remove (doc_id) and with those in add (doc_id, text), which replace ones of the same id."""
    gone = [x.select("doc_id") for x in (remove, add) if x is not None]
    for ids in gone:
        posted = posted.join(ids.distinct(), "doc_id", "left_anti")
    return posted if add is None else posted.unionByName(postings(add, config))


def bucket_of(df: DataFrame) -> tuple[str, int] | None:
    """The partition column of a saved table and its number of buckets, which is in its name: no reader can take another one."""
    found = [(c, int(m[1])) for c in df.columns if (m := re.fullmatch(r"tb_of_(\d+)", c))]
    return found[0] if found else None


def unbucketed(df: DataFrame) -> DataFrame:
    found = bucket_of(df)
    return df.drop(found[0]) if found else df


def save(rows: DataFrame, path: str, buckets: int = 64, codec: str | None = None, coded: bool = False, order: str = "doc_id") -> None:
    """Writes postings, or any table with a term, by hash bucket of the term, sorted, so that lookups prune folders and row groups.

    Tasks follow the size of the data, not the number of buckets: small buckets share one, and a bucket with a hot term is split. codec: of Parquet; coded:
    positions as variable bytes of their gaps.
    """
    rows = unbucketed(rows)
    name = f"tb_of_{buckets}"
    if coded:
        rows = rows.withColumn("positions", vbyte_encode(gap_encode(F.col("positions")))).withColumnRenamed("positions", "coded")
    rows = rows.withColumn(name, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).hint("rebalance", name)
    writer = rows.sortWithinPartitions(name, "term", *[order] * (order in rows.columns)).write.mode("overwrite").partitionBy(name)
    (writer.option("compression", codec) if codec else writer).parquet(path)


def load(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if "coded" in rows.columns:
        rows = rows.withColumn("positions", gap_decode(vbyte_decode(F.col("coded"))).cast("array<int>")).drop("coded")
    return rows


def lookup(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted terms; in a saved table only their buckets are read. Buckets are found on the driver, without a job."""
    found, bucket = rows.where(F.col("term").isin(wanted)), bucket_of(rows)
    if bucket:
        name, n = bucket
        hashes = {xxhash.xxh64_intdigest(w.encode(), 42) for w in wanted}  # as Spark's xxhash64
        found = found.where(F.col(name).isin(sorted({(h - (1 << 64) if h >> 63 else h) % n for h in hashes})))
    return found


def dense_ids(docs: DataFrame, order: str, name: str = "doc_no", part_rows: int = 500_000) -> DataFrame:
    """Numbers 0, 1, 2, … in order of a column, nulls last: rows are dealt by bounds, numbered within their part, and each part starts after those before it.

    The bounds are values of the column, told by hash, and stand in the plan: a second run parts the rows as the first did, which counted them. Ranges that Spark
    samples differ from run to run. No window over all rows.
    """
    if not (n := docs.count()):
        return docs.withColumn(name, F.lit(0).cast("long"))
    parts = min(-(-n // part_rows), 256)
    bounds = []
    if parts > 1:
        seen = docs.select(F.col(order).alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(parts * 64)
        values = sorted(r["v"] for r in seen.collect())  # 64 a part
        bounds = sorted({values[len(values) * i // parts] for i in range(1, parts)} if values else ())

    def part(low: int, high: int) -> Column:
        """The number of bounds up to a value, from low to high, by bisection."""
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(F.col(order) >= F.lit(bounds[at]), part(at + 1, high)).otherwise(part(low, at))

    rows = docs.withColumn("lodetext_part", F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(part(0, len(bounds))))
    total, start = 0, []
    for r in rows.groupBy("lodetext_part").count().orderBy("lodetext_part").collect():  # a row a part
        start.append((r["lodetext_part"], total))
        total += r["count"]
    shift = docs.sparkSession.createDataFrame(start, "lodetext_part int, lodetext_shift long")
    at = F.row_number().over(Window.partitionBy("lodetext_part").orderBy(order)) - 1
    return rows.withColumn("lodetext_at", at.cast("long")).join(F.broadcast(shift), "lodetext_part").withColumn(name, F.col("lodetext_at") + F.col("lodetext_shift")).drop("lodetext_part", "lodetext_at", "lodetext_shift")
