"""Variants of an index, matrices of builds and benchmarks, timed queries, and evaluation against a reference ranking."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.functions.text import ENGLISH, AnalyzerConfig
from lodetext.operators import evaluation
from lodetext.plans import ast
from lodetext.plans.catalog import Catalog
from lodetext.plans.engine import EngineConfig, SearchEngine

#: Numbers and letters of a variant's parts.
INFO = {"boolean": 1, "tf": 2, "bm25": 3}
CODES = {"none": 1, "gaps": 2, "gzip": 3}
PROCESSING = {"term": "T", "document": "D"}
SHORTCUTS = {"none": "0", "skipping": "sp", "threshold": "th", "early_stop": "es"}
RECORD = "query_id int, query_text string, kind string, latency_ms double, n_results long, memory_mb double, error string"
BUILD = "index_name string, dataset string, size int, variant string, documents long, processed long, skipped long, vocabulary long, tokens long, seconds double, docs_per_second double, bytes long, memory_mb double, status string"


@dataclass(frozen=True)
class Variant:
    """What an index and its queries are made with."""

    info: str = "bm25"
    store: int = 1
    code: str = "none"
    processing: str = "term"
    shortcut: str = "none"
    threshold: float = 0.3

    def __post_init__(self):
        for value, known in ((self.info, INFO), (self.code, CODES), (self.processing, PROCESSING), (self.shortcut, SHORTCUTS)):
            if value not in known:
                raise ValueError(f"unknown {value}; one of {', '.join(known)}")

    @property
    def short(self) -> str:
        return f"lodetext_i{INFO[self.info]}d{self.store}c{CODES[self.code]}q{PROCESSING[self.processing]}o{SHORTCUTS[self.shortcut]}"

    @property
    def long(self) -> str:
        return f"core=lodetext|index={self.info}|datastore={self.store}|compressor={self.code}|qproc={self.processing}|optim={self.shortcut}"

    @property
    def dotted(self) -> str:
        """x.y.z.i.q"""
        return f"{INFO[self.info]}.{self.store}.{CODES[self.code] - 1}.{SHORTCUTS[self.shortcut]}.{PROCESSING[self.processing]}"

    def config(self, analyzer: AnalyzerConfig = ENGLISH) -> EngineConfig:
        return EngineConfig(analyzer=analyzer, scorer=self.info)

    def storage(self) -> dict:
        """Options of SearchEngine.save."""
        return {"codec": "gzip" if self.code == "gzip" else None, "coded": self.code == "gaps"}

    def search(self, engine: SearchEngine, queries: list[str], k: int) -> DataFrame:
        return engine.search(queries, k, self.threshold if self.shortcut == "threshold" else None)


#: The usual matrix. Skipping and early stopping are left to the plan: block statistics of the files, and the limited window.
VARIANTS = {
    "boolean": Variant("boolean"),
    "wordcount": Variant("tf"),
    "tfidf": Variant("bm25"),
    "tfidf_document": Variant("bm25", processing="document"),
    "tfidf_skip": Variant("bm25", shortcut="skipping"),
    "tfidf_gap": Variant("bm25", code="gaps"),
    "tfidf_gzip": Variant("bm25", code="gzip"),
    "tfidf_threshold": Variant("bm25", shortcut="threshold"),
    "tfidf_earlystop": Variant("bm25", shortcut="early_stop"),
}
Sizes = Iterable[int | None]


def index_name(dataset: str, size: int | None, variant: str) -> str:
    return f"{dataset}_{size or 'all'}_{variant}"


def memory_mb() -> float:
    """Largest memory of the driver's process so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def first_documents(docs: DataFrame, n: int | None, by: str = "doc_id") -> DataFrame:
    """A benchmark's corpus of n documents: the first by id. All for None."""
    return docs if n is None else docs.orderBy(by).limit(n)


def build_matrix(catalog: Catalog, corpora: Mapping[str, DataFrame], sizes: Sizes = (None,), variants: Mapping[str, Variant] = VARIANTS, analyzer: AnalyzerConfig = ENGLISH, skip_existing: bool = True, **columns) -> DataFrame:
    """Builds an index for each corpus, size and variant; a row of metrics each. One that exists is skipped, one that fails is told of and the rest go on."""
    rows = []
    for dataset, docs in corpora.items():
        for size in sizes:
            some = first_documents(docs, size, columns.get("doc_id", "doc_id"))
            for name, variant in variants.items():
                of = index_name(dataset, size, name)
                if skip_existing and catalog.exists(of):
                    rows.append((of, dataset, size, variant.short, *[None] * 9, "skipped"))
                    continue
                try:
                    told = catalog.create(of, some, variant.config(analyzer), **variant.storage(), **columns)
                except Exception as e:  # noqa: BLE001  a matrix goes on
                    rows.append((of, dataset, size, variant.short, *[None] * 9, f"failed: {type(e).__name__}"))
                    continue
                rows.append((of, dataset, size, variant.short, told["document_count"], told["processed"], told["skipped"], told["vocabulary_size"], told["total_tokens"], told["seconds"], told["docs_per_second"], told["size_bytes"], memory_mb(), "built"))
    return catalog.spark.createDataFrame(rows, BUILD)


def kind_of(query: str) -> str:
    return ast.parse_or_term(query).kind.lower()


def timed(engine: SearchEngine, queries: list[str], k: int = 10, warm_up: int = 3, run: Callable[[SearchEngine, str, int], DataFrame] | None = None) -> DataFrame:
    """A record of each query, run one after the other after the first `warm_up` have been run once. One that fails has its error and no latency."""
    run = run or (lambda e, q, k: e.search([q], k))
    for q in queries[: min(warm_up, len(queries))]:
        try:
            run(engine, q, k).collect()  # at most k rows
        except Exception:  # noqa: BLE001, S112  told of below
            continue
    rows = []
    for i, q in enumerate(queries):
        began = time.perf_counter()
        try:
            n = len(run(engine, q, k).collect())  # at most k rows
            rows.append((i, q, kind_of(q), (time.perf_counter() - began) * 1000, n, memory_mb(), None))
        except Exception as e:  # noqa: BLE001  a benchmark goes on
            rows.append((i, q, kind_of(q), None, None, memory_mb(), type(e).__name__))
    return engine.spark.createDataFrame(rows, RECORD)


def summary(records: DataFrame, *by: str) -> DataFrame:
    """Latency statistics of records, with counts of successful and failed queries; throughput is queries a second, one after the other."""
    rows = records if by else records.withColumn("all", F.lit("all"))
    keys = by or ("all",)
    whole = rows.groupBy(*keys).agg(F.count("latency_ms").alias("successful"), (F.count("*") - F.count("latency_ms")).alias("failed"), F.max("memory_mb").alias("memory_mb"), F.avg("n_results").alias("mean_results"))
    return whole.join(evaluation.latency_stats(rows, "latency_ms", *keys), list(keys), "left")


def save_benchmark(records: DataFrame, path: str, *by: str) -> None:
    """Details and statistics as JSON, each in a folder under path."""
    records.coalesce(1).write.mode("overwrite").json(f"{path}/details")
    summary(records, *by).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")


def benchmark_matrix(catalog: Catalog, workloads: Mapping[str, list[str]], sizes: Sizes = (None,), variants: Mapping[str, Variant] = VARIANTS, k: int = 10, warm_up: int = 3) -> DataFrame:
    """Records of each dataset's workload on each of its indices that exist, with index_name, dataset, size and variant."""
    every = None
    for dataset, queries in workloads.items():
        for size in sizes:
            for name, variant in variants.items():
                of = index_name(dataset, size, name)
                if not catalog.exists(of):
                    continue
                rows = timed(catalog.load(of), queries, k, warm_up, lambda e, q, k, v=variant: v.search(e, [q], k))
                told = {"index_name": F.lit(of), "dataset": F.lit(dataset), "size": F.lit(size).cast("int"), "variant": F.lit(variant.short)}
                rows = rows.withColumns(told)
                every = rows if every is None else every.unionByName(rows)
    return every if every is not None else catalog.spark.createDataFrame([], f"{RECORD}, index_name string, dataset string, size int, variant string")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table read from path, or made, written there and read: results of a reference are asked for once."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


ENTRY = "struct<doc_id: string, id: string, _id: string, document_id: string, uuid: string, score: double, _score: double>"


def normalised(answers: DataFrame, k: int = 20, value: str = "value") -> DataFrame:
    """(query_id, rank, doc_id, score) from JSON answers (query_id, value): a list of entries, or one under results, documents or hits.hits, at most k of each.

    An entry names its document by doc_id, id, _id, document_id or uuid; those without a name, and answers that can't be read, give no rows.
    """
    inside = f"struct<results: array<{ENTRY}>, documents: array<{ENTRY}>, hits: struct<hits: array<{ENTRY}>>>"
    rows = answers.select("query_id", F.from_json(value, inside).alias("a"), F.from_json(value, f"array<{ENTRY}>").alias("b"))
    entries = F.when(F.col("a.results").isNotNull() | F.col("a.documents").isNotNull() | F.col("a.hits.hits").isNotNull(), F.coalesce("a.results", "a.documents", "a.hits.hits")).otherwise(F.col("b"))
    rows = rows.select("query_id", F.posexplode(entries).alias("at", "e")).select("query_id", "at", F.coalesce("e.doc_id", "e.id", "e._id", "e.document_id", "e.uuid").alias("doc_id"), F.coalesce("e.score", "e._score").alias("score")).where("doc_id IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy("at")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def evaluate(catalog: Catalog, references: Mapping[str, DataFrame], workloads: Mapping[str, list[str]], sizes: Sizes = (None,), variants: Mapping[str, Variant] = VARIANTS, k: int = 20) -> DataFrame:
    """Macro precision, recall and F1 at k of each existing index against the reference ranking (query_id, rank, doc_id) of its dataset: a row each."""
    every = None
    for dataset, queries in workloads.items():
        want = references[dataset].withColumn("doc_id", F.col("doc_id").cast("string"))
        for size in sizes:
            for name, variant in variants.items():
                of = index_name(dataset, size, name)
                if not catalog.exists(of):
                    continue
                got = variant.search(catalog.load(of), queries, k).withColumn("doc_id", F.col("doc_id").cast("string"))
                rows = evaluation.macro_average(evaluation.precision_recall(got, want, k)).withColumns({"index_name": F.lit(of), "dataset": F.lit(dataset), "size": F.lit(size).cast("int"), "variant": F.lit(variant.short)})
                every = rows if every is None else every.unionByName(rows)
    return every if every is not None else catalog.spark.createDataFrame([], "precision double, recall double, f1 double, successful long, failed long, index_name string, dataset string, size int, variant string")


def write_evaluation(rows: DataFrame, path: str) -> str:
    """All rows as JSON and as a table by variant; returns the path of the JSON."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/evaluation")
    rows.groupBy("variant").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return f"{path}/evaluation"


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of a number in equal bins between its extremes, empty ones included: what a histogram shows."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("z"))
    step = (F.col("z") - F.col("a")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("a")) / step), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row
    every = ends.where("a IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", step.alias("step"))
    return every.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("step")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def series(records: DataFrame, by: str, along: str, measure: str = "latency_ms") -> DataFrame:
    """(by, along, mean, p95, n): a line for each `by`, such as latency by size for each variant."""
    return records.where(F.col(measure).isNotNull()).groupBy(by, along).agg(F.avg(measure).alias("mean"), F.expr(f"percentile({measure}, 0.95)").alias("p95"), F.count("*").alias("n"))


def frequency_pair(before: DataFrame, after: DataFrame, n: int = 50) -> DataFrame:
    """(rank, term_before, freq_before, term_after, freq_after): the n most frequent words of two tables (term, freq) side by side, ties by term."""
    def best(rows: DataFrame, name: str) -> DataFrame:
        some = rows.orderBy(F.desc("freq"), "term").limit(n)
        return some.select(F.row_number().over(Window.orderBy(F.desc("freq"), "term")).alias("rank"), F.col("term").alias(f"term_{name}"), F.col("freq").alias(f"freq_{name}"))  # n rows

    return best(before, "before").join(best(after, "after"), "rank", "full")


def experiment(catalog: Catalog, corpora: Mapping[str, DataFrame], workloads: Mapping[str, list[str]], path: str, variants: Mapping[str, Variant] = VARIANTS, sizes: Sizes = (None,), k: int = 10, **columns) -> dict:
    """Builds, benchmarks and writes what the charts show: build metrics, details, statistics by variant, a latency histogram."""
    sizes = list(sizes)
    built = build_matrix(catalog, corpora, sizes, variants, **columns)
    built.coalesce(1).write.mode("overwrite").json(f"{path}/builds")
    records = benchmark_matrix(catalog, workloads, sizes, variants, k)
    save_benchmark(records, path, "dataset", "variant")
    done = catalog.spark.read.schema(records.schema).json(f"{path}/details")
    histogram(done, "latency_ms").coalesce(1).write.mode("overwrite").json(f"{path}/latency_histogram")
    return {"built": built.where("status = 'built'").count(), "records": done.count(), "failed": done.where("error IS NOT NULL").count(), "path": path}


def told(rows: DataFrame) -> str:
    """Rows of a report as JSON lines."""
    return "\n".join(json.dumps(r.asDict()) for r in rows.collect())
