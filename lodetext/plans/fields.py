"""Search over several fields of a document, each with its own analyzer, boost and postings."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.functions.text import ENGLISH, PLAIN, SERVER, AnalyzerConfig, analyzed_here
from lodetext.operators import index as ix
from lodetext.operators import ranking


@dataclass(frozen=True)
class Field:
    column: str
    boost: float = 1.0
    analyzer: AnalyzerConfig = SERVER


#: Title and text, as they are and preprocessed; a title counts twice.
FIELDS = {
    "title": Field("title", 2.0),
    "text": Field("text"),
    "preprocessed_title": Field("title", 2.0, ENGLISH),
    "preprocessed_text": Field("text", 1.0, ENGLISH),
}


class FieldedEngine:
    """Postings (field, doc_id, dl, term, tf, positions) of several fields."""

    def __init__(self, posted: DataFrame, fields: Mapping[str, Field] = FIELDS, source: tuple[DataFrame, str] | None = None):
        self.source = source  # of an index that isn't saved: the documents, and their column of ids
        self.posted, self.fields, self.spark = posted, dict(fields), posted.sparkSession

    @classmethod
    def build(cls, docs: DataFrame, fields: Mapping[str, Field] = FIELDS, doc_id: str = "doc_id") -> FieldedEngine:
        every = None
        for name, field in fields.items():
            rows = ix.postings(docs, field.analyzer, field.column, doc_id).select(F.lit(name).alias("field"), "doc_id", "dl", "term", "tf", "positions")
            every = rows if every is None else every.unionByName(rows)
        return cls(every, fields, (docs, doc_id))

    def save(self, path: str, codec: str | None = None) -> None:
        """A folder for each field, sorted by term, beside the configuration."""
        writer = self.posted.hint("rebalance", "field").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").partitionBy("field")
        (writer.option("compression", codec) if codec else writer).parquet(path)
        told = json.dumps({name: asdict(f) for name, f in self.fields.items()})
        self.spark.createDataFrame([(told,)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}_config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FieldedEngine:
        fields = {}
        for name, f in json.loads(spark.read.text(f"{path}_config").first()[0]).items():
            analyzer = f.pop("analyzer")
            fields[name] = Field(**f, analyzer=AnalyzerConfig(**{**analyzer, "stop_words": tuple(analyzer["stop_words"])}))
        return cls(spark.read.parquet(path), fields)

    def scored(self, queries: list[str]) -> DataFrame:
        """(query_id, doc_id, score): the largest of the fields' boosted scores. Each field analyzes the queries its own way."""
        every = None
        for name, field in self.fields.items():
            rows = [(i, analyzed_here(q, field.analyzer) if q.isascii() else q.lower().split()) for i, q in enumerate(queries)]
            asked = self.spark.createDataFrame(rows, "query_id int, terms array<string>")
            if self.source is None:
                held = (self.posted.where(F.col("field") == name), field.boost)
            else:  # the asked terms and all lengths by one pass
                posted, lengths = ix.of_terms(self.source[0], sorted({t for _, ts in rows for t in ts}), field.analyzer, field.column, self.source[1])
                held = (posted, field.boost, ix.length_stats(lengths))
            one = ranking.field_scores({name: held}, asked)
            every = one if every is None else every.unionByName(one)
        return every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))

    def search(self, queries: list[str], k: int = 10, digits: int | None = None) -> DataFrame:
        return ranking.top_k(self.scored(queries), k, digits)

    def hits(self, queries: list[str]) -> DataFrame:
        return ranking.total_hits(self.scored(queries))


#: The same four fields without stemming, which SQL can express.
PLAIN_FIELDS = {
    "title": Field("title", 2.0, PLAIN),
    "text": Field("text", 1.0, PLAIN),
    "preprocessed_title": Field("title", 2.0, AnalyzerConfig()),
    "preprocessed_text": Field("text", 1.0, AnalyzerConfig()),
}
