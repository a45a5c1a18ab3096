"""Index maintenance by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodetext.functions.text import PLAIN, AnalyzerConfig
from lodetext.operators.index import postings


def maintain(stream: DataFrame, path: str, checkpoint: str, config: AnalyzerConfig = PLAIN, available_now: bool = True) -> StreamingQuery:
    """Appends the postings of every micro-batch of documents (doc_id, text) under path, and beside it the ids that came. A batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, config).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}_ids/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_batches(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, batch): the batch in which each document came last, from the ids alone."""
    return spark.read.option("basePath", f"{path}_ids").parquet(f"{path}_ids/batch=*").groupBy("doc_id").agg(F.max("batch").alias("batch"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """Postings as of now: of a document that came several times, those of the latest batch; one that came empty at last has none."""
    every = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return every.join(last_batches(spark, path), ["doc_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, path: str) -> int:
    """Replaces all batches by one, under the number of the latest, while nothing writes or reads; returns that number. Later reads visit a document once.

    Old folders go only after the new ones have been written whole.
    """
    latest = last_batches(spark, path).agg(F.max("batch")).first()[0]
    posted, ids = current(spark, path), last_batches(spark, path).select("doc_id")
    posted.write.mode("overwrite").parquet(f"{path}_new")
    ids.write.mode("overwrite").parquet(f"{path}_new_ids")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for new, folder in ((f"{path}_new", path), (f"{path}_new_ids", f"{path}_ids")):
        fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        old = [x.getPath() for x in fs.globStatus(hadoop(f"{folder}/batch=*"))]
        fs.rename(hadoop(new), hadoop(f"{folder}/batch={latest + 1}"))
        for x in old:
            fs.delete(x, True)
        fs.rename(hadoop(f"{folder}/batch={latest + 1}"), hadoop(f"{folder}/batch={latest}"))
    return latest
