"""The search engine: build, save, load, update, and whole workloads of queries as single plans."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.functions.stemmer import stem
from lodetext.functions.text import ENGLISH, AnalyzerConfig, analyzed_here, tokens
from lodetext.operators import index as ix
from lodetext.operators import ranking
from lodetext.plans import ast
from lodetext.plans.ast import Node


@dataclass(frozen=True)
class EngineConfig:
    analyzer: AnalyzerConfig = field(default_factory=lambda: ENGLISH)
    scorer: str = "bm25"
    max_results: int = 10
    first_term_only: bool = False

    def __post_init__(self):
        if self.scorer not in ranking.SCORERS:
            raise ValueError(f"unknown scorer {self.scorer}")


def local(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A small table that lies in the plan; no job makes it."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(list(c), kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[name for name, _ in schema]))


class SearchEngine:
    """Postings with positions, the documents' lengths and a configuration; of a saved index also its term table and its statistics."""

    def __init__(self, posted: DataFrame, config: EngineConfig = EngineConfig(), docs: DataFrame | None = None, terms: DataFrame | None = None, told: dict | None = None, source: tuple[DataFrame, str, str] | None = None):
        self.source = source  # of an index that isn't saved: the documents, and their columns of text and id
        self.posted, self.config, self.spark = posted, config, posted.sparkSession
        self.docs = ix.doc_table(posted) if docs is None else docs
        self.terms, self.told = terms, told

    @classmethod
    def build(cls, docs: DataFrame, config: EngineConfig = EngineConfig(), text: str = "text", doc_id: str = "doc_id") -> SearchEngine:
        """From documents; those without tokens aren't part of the collection."""
        return cls(ix.postings(docs, config.analyzer, text, doc_id), config, ix.doc_lengths(docs, config.analyzer, text, doc_id), source=(docs, text, doc_id))

    def save(self, path: str, buckets: int = 64, codec: str | None = None, coded: bool = False) -> dict:
        """Postings and terms by term bucket, documents, configuration and statistics, each beside the other; returns the statistics."""
        ix.save(self.posted, path, buckets, codec, coded)
        self.docs.write.mode("overwrite").parquet(f"{path}_docs")
        saved = self.spark.read.parquet(path).drop("positions", "coded")
        ix.save(ix.terms(saved), f"{path}_terms", buckets, codec)
        of_docs, of_terms = (self.spark.read.parquet(f"{path}_{x}") for x in ("docs", "terms"))
        a = ix.length_stats(of_docs).first()
        b = of_terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.avg("df").alias("avg_postings_length")).first()
        told = {"n_docs": a["n_docs"], "avgdl": a["avgdl"] or 0.0, "avg_doc_length": a["avgdl"], **b.asDict()}
        self.spark.createDataFrame([(json.dumps({**asdict(self.config), "stats": told}),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}_config")
        return told

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchEngine:
        told = json.loads(spark.read.text(f"{path}_config").first()[0])
        analyzer, stats = told.pop("analyzer"), told.pop("stats")
        analyzer["stop_words"] = tuple(analyzer["stop_words"])
        read = spark.read.parquet
        return cls(ix.load(spark, path), EngineConfig(analyzer=AnalyzerConfig(**analyzer), **told), read(f"{path}_docs"), read(f"{path}_terms"), stats)

    def update(self, add: DataFrame | None = None, remove: DataFrame | None = None) -> SearchEngine:
        return SearchEngine(ix.updated(ix.unbucketed(self.posted), add, remove, self.config.analyzer), self.config)

    def files(self) -> DataFrame:
        return self.docs

    def length(self, doc_id) -> int | None:
        """Tokens of a document; None for one that isn't in the collection."""
        row = self.docs.where(F.col("doc_id") == F.lit(doc_id)).first()
        return row["dl"] if row else None

    def count(self) -> int:
        return self.told["n_docs"] if self.told else self.docs.count()

    def asked(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """Postings of the terms, and (doc_id, dl) of all documents; where the index isn't saved, both by one pass over its documents."""
        if self.source is None:
            return ix.lookup(self.posted, terms), self.docs
        docs, text, doc_id = self.source
        return ix.of_terms(docs, terms, self.config.analyzer, text, doc_id)

    def postings_of(self, term: str) -> DataFrame:
        """(doc_id, tf, positions) of a term, with its df and total_tf."""
        rows, _ = self.asked([term])
        return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf")))).select("doc_id", "tf", "positions", "df", "total_tf")  # one row

    def stats(self) -> DataFrame:
        if self.told:
            names = ("n_docs", "avg_doc_length", "n_terms", "n_tokens", "avg_postings_length")
            return local(self.spark, [tuple(self.told[c] for c in names)], [(c, pa.float64() if c.startswith("avg") else pa.int64()) for c in names])
        return ix.index_stats(self.posted)

    def analyzed(self, texts: list[str]) -> list[list[str]]:
        """Texts of a workload through the index's own analyzer: ASCII ones on the driver, others by a job."""
        found = {t: analyzed_here(t, self.config.analyzer) for t in set(texts) if t.isascii()}
        rest = [t for t in dict.fromkeys(texts) if t not in found]
        if rest:
            rows = self.spark.createDataFrame(list(enumerate(rest)), "i int, t string").select("i", tokens(F.col("t"), self.config.analyzer).alias("toks"))
            stems = stem if self.config.analyzer.stemming else str
            found |= {rest[r["i"]]: [stems(x) for x in r["toks"]] for r in rows.collect()}  # as many rows as the workload has leaves
        return [found[t] for t in texts]

    def leaf_hits(self, named: list[list[str]], posted: DataFrame) -> DataFrame:
        """(leaf, doc_id) of leaves given as their terms, one or a phrase of several, from postings of those terms at least."""
        rows = [(i, k, t, len(ts)) for i, ts in enumerate(named) for k, t in enumerate(ts)]
        wanted = local(self.spark, rows, [("leaf", pa.int32()), ("idx", pa.int32()), ("term", pa.string()), ("n", pa.int32())])
        met = ix.lookup(posted, sorted({r[2] for r in rows})).join(F.broadcast(wanted), "term")  # the workload's terms
        single = met.where("n = 1").select("leaf", "doc_id")
        starts = met.where("n > 1").select("leaf", "doc_id", "idx", "n", F.explode("positions").alias("pos")).groupBy("leaf", "doc_id", "n", (F.col("pos") - F.col("idx")).alias("start"))
        phrases = starts.agg(F.count_distinct("idx").alias("found")).where("found = n").select("leaf", "doc_id").distinct()
        return single.unionByName(phrases)

    def boolean(self, queries: list[str | Node], asked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """(query_id, doc_id) of all documents that match each query, by its position in the list.

        Leaves of all queries are matched once; a document's leaves are gathered per query and the query's condition is tested on them. Only
        queries that hold for a document without any leaf, such as NOT alone, visit all documents. Leaves that the analyzer empties are neutral: they
        go, and a query of nothing else matches nothing. asked: postings and documents as asked() gives them, of these queries' terms at least.
        """
        trees = [q if isinstance(q, Node) else ast.parse_or_term(q, first_term_only=self.config.first_term_only) for q in queries]
        every = list(dict.fromkeys(x for t in trees for x in ast.leaves(t)))
        named = dict(zip(every, self.analyzed([x.value for x in every]), strict=True))
        number = {x: i for i, x in enumerate(x for x in every if named[x])}

        def known(node: Node) -> Node | None:
            if node.kind in ("TERM", "PHRASE"):
                return node if named[node] else None
            parts = tuple(p for p in map(known, node.parts) if p is not None)
            return Node(node.kind, node.value, parts) if parts else None

        pairs = [(i, ast.flat(t)) for i, t in ((i, known(t)) for i, t in enumerate(trees)) if t is not None]
        if not pairs:
            return self.posted.select(F.lit(0).alias("query_id"), "doc_id").limit(0)
        posted, docs = asked or self.asked(sorted({t for x in number for t in named[x]}))
        hits = self.leaf_hits([named[x] for x in number], posted)
        uses = local(self.spark, [(i, number[x]) for i, t in pairs for x in ast.leaves(t)], [("query_id", pa.int32()), ("leaf", pa.int32())])
        held = hits.join(F.broadcast(uses), "leaf").groupBy("query_id", "doc_id").agg(F.collect_set("leaf").alias("h"))
        empty = [i for i, t in pairs if ast.holds(t, set())]
        if empty:
            all_docs = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i in empty])).alias("query_id"))
            none = F.array().cast("array<int>")
            held = held.join(all_docs, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.coalesce("h", none).alias("h"))
        tests = " ".join(f"WHEN {i} THEN {ast.condition(t, lambda x: f'array_contains(h, {number[x]})')}" for i, t in pairs)
        return held.where(F.expr(f"CASE query_id {tests} END")).select("query_id", "doc_id")

    def scored(self, queries: list[str], threshold: float | None = None) -> DataFrame:
        """(query_id, doc_id, score) of all documents that match: terms and bags by the scorer, boolean and phrase queries with score 1."""
        trees = [ast.parse_or_term(q, first_term_only=self.config.first_term_only) for q in queries]
        bags = [(i, t) for i, t in enumerate(trees) if t.kind in ("TERM", "BAG")]
        rest = [i for i, t in enumerate(trees) if t.kind not in ("TERM", "BAG")]
        words = self.analyzed([" ".join(x.value for x in ast.leaves(t)) if t.kind == "BAG" else t.value for _, t in bags])
        rows = [(i, t, n) for (i, _), w in zip(bags, words, strict=True) for t, n in Counter(w).items()]
        leaves = self.analyzed([x.value for i in rest for x in ast.leaves(trees[i])])
        asked = self.asked(sorted({t for _, t, _ in rows} | {t for ts in leaves for t in ts}))  # one pass for the whole workload
        found = None
        if rest:
            ids = F.element_at(F.array(*[F.lit(i) for i in rest]), F.col("query_id") + 1)
            found = self.boolean([trees[i] for i in rest], asked).select(ids.alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
        if bags:
            wanted = local(self.spark, rows, [("query_id", pa.int32()), ("term", pa.string()), ("weight", pa.int64())])
            every = sorted({t for _, t, _ in rows})
            whole = self.told or ix.length_stats(asked[1])
            parts = ranking.term_parts(ix.lookup(asked[0], every), wanted, self.config.scorer, whole, None if self.terms is None else ix.lookup(self.terms, every))
            one = ranking.scores(ranking.term_threshold(parts, threshold) if threshold else parts)
            found = one if found is None else found.unionByName(one)
        return found

    def search(self, queries: list[str], k: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score) of the k best by score, then doc_id."""
        return ranking.top_k(self.scored(queries, threshold), self.config.max_results if k is None else k)

    def hits(self, queries: list[str]) -> DataFrame:
        """(query_id, total_hits, max_score) of the queries that match something."""
        return ranking.total_hits(self.scored(queries))

    def search_documents(self, queries: list[str], meta: DataFrame, k: int | None = None) -> DataFrame:
        """search() with the columns of meta (doc_id, ...); documents without metadata are out before ranks are given."""
        return ranking.enriched(self.scored(queries), meta, self.config.max_results if k is None else k)

    def result_json(self, query: str, k: int | None = None) -> str:
        """The k best, and how many match."""
        rows = self.search([query], k).orderBy("rank").collect()  # at most k rows
        whole = self.hits([query]).first() if rows else None
        return json.dumps({"results": [{"rank": r["rank"], "doc_id": str(r["doc_id"]), "score": r["score"]} for r in rows], "total_results": whole["total_hits"] if whole else 0, "max_score": whole["max_score"] if whole else None})
