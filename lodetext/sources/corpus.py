"""Corpus readers and writers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIKI = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "title", "text")])
NEWS = T.StructType([*WIKI.fields, *[T.StructField(n, T.StringType()) for n in ("author", "published", "site")], T.StructField("categories", T.ArrayType(T.StringType()))])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the physical lines of text files with their numbers from 0, files in order of their names.

    Lines are counted by split of a file, and each split starts after those before it: a row a split comes to the driver, and no line is sorted.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    total, shift = 0, []
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        shift.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    starts = spark.createDataFrame(shift, "file string, block long, shift long")
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("at"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = WIKI, first_lines: int | None = None) -> DataFrame:
    """Rows of a JSON-lines corpus; lines that aren't JSON objects are left out. first_lines: only so many physical lines, bad ones counted.
    A row without id is named doc_<line number>."""
    lines = numbered_lines(spark, path)
    if first_lines is not None:
        lines = lines.where(F.col("at") < first_lines)
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select("at", F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r IS NOT NULL AND r._bad IS NULL")
    rows = rows.select("at", *[F.col("r")[f.name].alias(f.name) for f in schema.fields])
    if "id" in schema.fieldNames():
        rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("doc_"), F.col("at").cast("string"))))
    return rows.select(*schema.fieldNames())


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def sample_texts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    return docs.select(text).where(F.col(text) != "").limit(n)


def read_zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, value) of every *.json member of the zip files at path; what can't be read is left out."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for member in sorted(z.namelist()):
                            if member.endswith(".json"):
                                try:
                                    value = z.read(member).decode()
                                    json.loads(value)
                                except (ValueError, RuntimeError, zipfile.BadZipFile):
                                    continue
                                yield pd.DataFrame([(name, member, value)], columns=["file", "member", "value"])
                except zipfile.BadZipFile:
                    continue

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(unzip, "file string, member string, value string")


def news_articles(raw: DataFrame, value: str = "value", least: int = 100) -> DataFrame:
    """Articles from the JSON of a news crawl: fields with '' for what is missing, the site of the thread; texts of over `least` characters."""
    schema = "uuid string, url string, title string, text string, author string, published string, thread struct<site: string>, categories array<string>"
    rows = raw.select(F.from_json(value, schema).alias("r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c.split(".")[-1])
    rows = rows.select(text("uuid").alias("id"), *[text(c) for c in ("url", "title", "text", "author", "published", "thread.site")], F.coalesce("r.categories", F.array().cast("array<string>")).alias("categories"))
    return rows.where(F.length(F.trim("text")) > least)


def combined(**corpora: DataFrame) -> DataFrame:
    """Union of corpora by column name with a `source` column; columns one lacks are null."""
    every = None
    for name, docs in corpora.items():
        docs = docs.withColumn("source", F.lit(name))
        every = docs if every is None else every.unionByName(docs, allowMissingColumns=True)
    return every


def read_queries(spark: SparkSession, path: str, wanted: int | None = None) -> DataFrame | None:
    """(query_id, query_text) of a saved workload; None where it hasn't as many queries as wanted."""
    told = spark.read.schema("seed int, dataset string, num_queries int, queries array<string>").option("multiLine", True).json(path)
    rows = told.select(F.posexplode("queries").alias("query_id", "query_text"))
    return rows if wanted is None or rows.count() == wanted else None


def latest(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """JSON of the file, or folder, of the greatest name that matches; no other is read. lines: a row a line, else a document a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    if not len(found):
        raise FileNotFoundError(pattern)
    return spark.read.option("multiLine", not lines).json(max(x.getPath().toString() for x in found))


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown; for reports of at most `limit` rows."""
    some = rows.limit(limit).collect()
    out = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(out + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in some])
