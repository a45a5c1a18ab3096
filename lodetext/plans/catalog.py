"""Indices by name under one folder."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lodetext.plans.engine import EngineConfig, SearchEngine


class Catalog:
    """Folder with an index and its metadata per name; any file system that Spark opens."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create(self, name: str, docs: DataFrame, config: EngineConfig = EngineConfig(), buckets: int = 64, codec: str | None = None, coded: bool = False, text: str = "text", doc_id: str = "doc_id") -> dict:
        """Builds, saves and describes an index; one of the same name is replaced. Documents without tokens are processed but not part of it: they are counted as skipped."""
        began = time.perf_counter()
        told = SearchEngine.build(docs, config, text, doc_id).save(self.path(name), buckets, codec, coded)
        seconds = time.perf_counter() - began
        processed, bytes_ = docs.count(), self.size(name)
        meta = {
            "index_name": name, "index_type": config.scorer, "document_count": told["n_docs"], "vocabulary_size": told["n_terms"], "total_tokens": told["n_tokens"], "avg_doc_length": told["avg_doc_length"],
            "processed": processed, "skipped": processed - told["n_docs"], "size_bytes": bytes_, "seconds": round(seconds, 3), "docs_per_second": round(processed / seconds, 3),
            "created_at": datetime.now(timezone.utc).isoformat(), "version": 1,
        }
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path(name)}_meta")
        return meta

    def exists(self, name: str) -> bool:
        fs, path = self.fs(f"{self.path(name)}_meta/_SUCCESS")
        return fs.exists(path)

    def load(self, name: str) -> SearchEngine:
        if not self.exists(name):
            raise KeyError(f"no index {name}; there are {', '.join(x['index_name'] for x in self.list()) or 'none'}")
        return SearchEngine.load(self.spark, self.path(name))

    def list(self) -> list[dict]:
        fs, root = self.fs(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [json.loads(self.spark.read.text(f"{self.root}/{n}").first()[0]) for n in sorted(names) if n.endswith("_meta")]

    def delete(self, name: str) -> bool:
        found = False
        for p in (self.path(name), f"{self.path(name)}_docs", f"{self.path(name)}_terms", f"{self.path(name)}_config", f"{self.path(name)}_meta"):
            fs, path = self.fs(p)
            found |= fs.delete(path, True)
        return found

    def size(self, name: str) -> int:
        """Bytes on disk."""
        fs, path = self.fs(self.path(name))
        return fs.getContentSummary(path).getLength()
