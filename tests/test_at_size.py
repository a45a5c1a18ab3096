"""Tests of what only larger tables show: parts that differ between runs, bytes shuffled, texts analyzed again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from lodetext.functions import encoding
from lodetext.functions.text import ENGLISH, analyzed_here, word_frequencies
from lodetext.operators import index as ix
from lodetext.operators import ranking as rk
from lodetext.plans import registry


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("options", [{}, {"part_rows": 1000}])
def test_dense_ids_when_ranges_are_sampled(uncoalesced, tmp_path, options):
    uncoalesced.range(60_000).orderBy(F.xxhash64("id")).write.parquet(str(tmp_path / "ids"))
    rows = ix.dense_ids(uncoalesced.read.parquet(str(tmp_path / "ids")), "id", **options)
    assert rows.agg(F.count("*"), F.count_if(F.col("id") != F.col("doc_no"))).first() == (60_000, 0)


def test_dense_ids_of_nulls_and_repeats(spark):
    rows = ix.dense_ids(spark.createDataFrame([(None,), ("b",), ("a",), ("b",), (None,)], "k string"), "k", part_rows=2)
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[1]) == [("a", 0), ("b", 1), ("b", 2), (None, 3), (None, 4)]
    assert ix.dense_ids(spark.createDataFrame([], "k string"), "k").count() == 0


def measured(spark, make) -> tuple[int, int]:
    """Bytes that a run writes to shuffles or spills, and rows it reads from tables."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        every = [stages.apply(i) for i in range(stages.length())]
        return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() for x in every), sum(x.inputRecords() for x in every)

    before = so_far()
    make().write.format("noop").mode("overwrite").save()
    return tuple(b - a for a, b in zip(before, so_far(), strict=True))


def shuffled(spark, rows) -> int:
    return measured(spark, lambda: rows)[0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder whose documents have many words each, most of them their own."""
    path = tmp_path_factory.mktemp("tables")
    words = F.expr("transform(sequence(1, 2000), i -> CASE WHEN i % 20 = 0 THEN element_at(array('that', 'with', 'anea', 'ther', 'tion'), CAST(i / 20 % 5 AS INT) + 1) ELSE conv(xxhash64(id, i) % 1000000, 10, 26) END)")
    docs = spark.range(0, 200, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    docs.write.parquet(str(path / "documents.parquet"))
    html = F.concat(F.lit("<html><title>that</title><p>"), F.substring("text", 1, 3000), F.lit("</p></html>"))
    docs.select(F.col("doc_id").alias("page_id"), html.alias("html")).write.parquet(str(path / "pages.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stored(folder):
    """Bytes of its documents."""
    import glob
    import os

    return sum(map(os.path.getsize, glob.glob(f"{folder}/documents.parquet/*.parquet")))


def test_positions_of_rows_that_share_an_id(spark):
    rows = [(1, "cat dog cat"), (1, "dog bird"), (None, "cat"), (None, "cat cat"), (2, None), (2, ""), (3, "a !"), (4, None), (4, "fish")]
    found = {(r["doc_id"], r["term"]): r for r in ix.postings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (r["dl"], r["tf"]) for k, r in found.items()} == {(1, "cat"): (5, 2), (1, "dog"): (5, 2), (1, "bird"): (5, 1), (None, "cat"): (3, 3), (4, "fish"): (1, 1)}
    assert sorted(p for k, r in found.items() if k[0] == 1 for p in r["positions"]) == [0, 1, 2, 3, 4]


def run(spark, name, folder):
    return registry.queries()[name](spark, folder)


@pytest.mark.parametrize("name", ["merge_postings", "build_postings", "gap_decode", "gap_encode", "vbyte_sizes", "compression_ratio"])
def test_only_texts_are_shuffled_for_postings(spark, folder, stored, name):
    assert shuffled(spark, run(spark, name, folder)) < (3 if name == "vbyte_sizes" else 2) * stored  # sizes by term are shuffled too


RANKED = ["rank_bm25", "rank_threshold_doc", "total_hits", "top3_consistency", "rank_early_stop", "rank_tf", "precision_recall_f1", "macro_avg", "rank_batch_topk", "rank_threshold_term"]


@pytest.mark.parametrize("name", RANKED)
def test_only_asked_postings_are_shuffled(spark, folder, stored, name):
    written, read = measured(spark, lambda: run(spark, name, folder))
    assert written < stored // 10 and read == 200 * (1 + (name == "rank_early_stop"))  # whose known terms come first


@pytest.mark.parametrize("name", ["engine_multifield", "multifield_best_fields"])
def test_a_field_is_one_pass(spark, folder, stored, name):
    written, read = measured(spark, lambda: run(spark, name, folder))
    assert written < stored // 10 and read == 200 * (4 if name == "engine_multifield" else 2)


@pytest.mark.parametrize("name", ["search_total_hits", "engine_search", "bool_workload"])
def test_a_workload_is_one_pass(spark, folder, name):
    assert measured(spark, lambda: run(spark, name, folder))[1] == 200


def test_postings_of_some_terms_are_those_of_all(spark):
    rows = [(1, "cat dog cat"), (1, "dog bird cat"), (None, "cat"), (2, None), (2, ""), (3, "a !"), (4, "fish cat"), (5, "bird")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every, (posted, lengths) = ix.postings(docs), ix.of_terms(docs, ["cat", "bird", "none"])
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(posted) == order(every.where("term IN ('cat', 'bird')"))
    assert order(lengths) == [(1, 6), (4, 2), (5, 1), (None, 1)]


def test_a_workload_restricts_any_postings_before_their_shuffle(spark, folder, stored):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    asked = spark.createDataFrame([(0, ["that", "with"])], "query_id int, terms array<string>")
    assert shuffled(spark, rk.ranked(ix.frequencies(docs), asked, scorer="tf")) < stored // 10


def test_stems_are_of_counted_words(spark):
    texts = ["Running dogs cannot run", "the dog's RUN gonna end; cannots", "", "gimme the dog: it ran", "cannot"]
    rows = word_frequencies(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), ENGLISH)
    assert dict(map(tuple, rows.collect())) == Counter(t for x in texts for t in analyzed_here(x, ENGLISH))
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_variable_bytes_go_as_whole_batches(spark):
    rows = [([1, 5, 300],), (None,), ([],), ([0, 2**40, 2**62],), (None,), ([127, 128],)] * 700
    lists = spark.createDataFrame(rows, "x array<bigint>").coalesce(1)
    coded = lists.select("x", encoding.vbyte_encode(F.col("x")).alias("b"))
    found = coded.select("x", "b", encoding.vbyte_decode(F.col("b")).alias("y")).collect()
    assert [r["x"] for r in found] == [r["y"] for r in found] == [x for x, in rows]
    assert all(r["b"] == (None if r["x"] is None else encoding.vbyte(r["x"])) for r in found)
    assert "SQL_SCALAR_ARROW_UDF" in udf_kinds(coded)
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([([-1],)], "x array<bigint>").select(encoding.vbyte_encode(F.col("x"))).collect()


def udf_kinds(rows) -> str:
    kinds = {PythonEvalType.SQL_SCALAR_ARROW_UDF: "SQL_SCALAR_ARROW_UDF", PythonEvalType.SQL_SCALAR_PANDAS_UDF: "SQL_SCALAR_PANDAS_UDF"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return " ".join(name for number, name in kinds.items() if f"], {number}" in plan)
