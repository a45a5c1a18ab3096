"""Command line: python -m lodetext.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from lodetext.functions.shipping import ship
from lodetext.functions.text import ENGLISH, PLAIN, word_frequencies
from lodetext.operators import evaluation, workload
from lodetext.operators import index as ix
from lodetext.plans import ast, experiments
from lodetext.plans.catalog import Catalog
from lodetext.plans.engine import EngineConfig, SearchEngine


def overridden(config: EngineConfig, settings: list[str]) -> EngineConfig:
    """A configuration with settings such as scorer=tf, max_results=20 or analyzer.stemming=false; values are JSON, or text."""
    for setting in settings:
        key, _, text = setting.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        if key.startswith("analyzer."):
            inner = key.removeprefix("analyzer.")
            if inner not in config.analyzer.__dataclass_fields__:
                raise ValueError(f"unknown setting {key}")
            config = replace(config, analyzer=replace(config.analyzer, **{inner: tuple(value) if isinstance(value, list) else value}))
        elif key in config.__dataclass_fields__:
            config = replace(config, **{key: value})
        else:
            raise ValueError(f"unknown setting {key}")
    return config


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodetext")
    p.add_argument("--root", default="indices", help="folder of the indices")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", dest="settings", help="a setting of the configuration")
    c = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        sub = c.add_parser(name)
        for x in positional:
            sub.add_argument(x, **({"nargs": "+"} if x == "query" and name == "query" else {}))
        for x, default in options.items():
            flag = f"-{x}" if len(x) == 1 else f"--{x}"
            sub.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return sub

    command("setup", "corpus")
    command("build", "name", "corpus", text="text", id="doc_id", variant="tfidf")
    command("query", "name", "query", k=10)
    command("workload", "name", "output", n=100, seed=42)
    command("bench", "name", n=100, output=None)
    command("experiment", "corpus", "output", n=20, variants="boolean,tfidf", text="text", id="doc_id", size=0)
    command("list")
    command("config")
    command("delete", "name")
    command("explain", "query")
    command("wordfreq", "corpus", n=50)
    return p


def checked(spark: SparkSession, catalog: Catalog, corpus: str) -> dict:
    """Whether Spark runs, what indices there are and whether the corpus can be read."""
    fs, path = catalog.fs(corpus)
    found = fs.exists(path)
    return {"spark": spark.version, "root": catalog.root, "indices": [x["index_name"] for x in catalog.list()], "corpus": corpus, "corpus_exists": found, "corpus_bytes": fs.getContentSummary(path).getLength() if found else 0}


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    config = overridden(EngineConfig(), a.settings)
    if a.command == "explain":
        print(json.dumps(ast.explain(a.query), indent=2))
        return
    if a.command == "config":
        print(json.dumps(asdict(config), indent=2))
        return
    spark = SparkSession.builder.appName("lodetext").getOrCreate()
    ship(spark)
    catalog = Catalog(spark, a.root)
    read = lambda path: spark.read.json(path) if path.endswith(".jsonl") else spark.read.parquet(path)

    def queries_of(engine: SearchEngine, n: int, seed: int = 42) -> list[str]:
        return workload.generate(workload.pools_from_vocabulary(ix.terms(engine.posted) if engine.terms is None else engine.terms), n, seed)

    if a.command == "setup":
        print(json.dumps(checked(spark, catalog, a.corpus), indent=2))
    elif a.command == "build":
        variant = experiments.VARIANTS[a.variant]
        config = config if any(x.startswith("scorer=") for x in a.settings) else replace(config, scorer=variant.info)
        print(json.dumps(catalog.create(a.name, read(a.corpus), config, **variant.storage(), text=a.text, doc_id=a.id)))
    elif a.command == "query":
        for q in a.query:
            print(catalog.load(a.name).result_json(q, a.k))
    elif a.command == "list":
        print(json.dumps(catalog.list(), indent=2))
    elif a.command == "delete":
        print(catalog.delete(a.name))
    elif a.command == "wordfreq":
        before, after = (word_frequencies(read(a.corpus), c) for c in (PLAIN, ENGLISH))
        experiments.frequency_pair(before, after, a.n).orderBy("rank").show(a.n, False)
    elif a.command == "experiment":
        docs, chosen = read(a.corpus), {x: experiments.VARIANTS[x] for x in a.variants.split(",")}
        engine = SearchEngine.build(docs, config, a.text, a.id)
        asked = {"corpus": queries_of(engine, a.n)}
        print(json.dumps(experiments.experiment(catalog, {"corpus": docs}, asked, a.output, chosen, [a.size or None], text=a.text, doc_id=a.id)))
    elif a.command == "workload":
        queries = queries_of(catalog.load(a.name), a.n, a.seed)
        workload.save(spark, queries, a.output, a.name, a.seed)
        evaluation.workload_stats(spark.createDataFrame([(x,) for x in queries], "query_text string")).show(vertical=True)
    else:
        engine = catalog.load(a.name)
        queries = queries_of(engine, a.n)
        records = experiments.timed(engine, queries)
        if a.output:
            experiments.save_benchmark(records, a.output, "kind")
        began = time.perf_counter()
        n = engine.search(queries).count()
        took = time.perf_counter() - began
        print(experiments.told(experiments.summary(records, "kind")))
        print(json.dumps({"queries": len(queries), "rows": n, "seconds_as_one_plan": round(took, 3), "queries_per_second": round(len(queries) / took, 2)}))


if __name__ == "__main__":
    main()
