"""Golden tests of the retrieval engine."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodetext.functions import encoding
from lodetext.functions.stemmer import stem
from lodetext.functions.text import ENGLISH, PLAIN, SERVER, AnalyzerConfig, analyzed_here, token_table, tokens
from lodetext.operators import boolean as bo
from lodetext.operators import evaluation as ev
from lodetext.operators import index as ix
from lodetext.operators import ranking as rk
from lodetext.operators import reporting as rp
from lodetext.operators import workload as wl
from lodetext import cli
from lodetext.plans import ast, experiments
from lodetext.plans.ast import Node
from lodetext.plans.catalog import Catalog
from lodetext.plans.engine import EngineConfig, SearchEngine
from lodetext.plans.fields import FIELDS, Field, FieldedEngine
from lodetext.sources import corpus
from lodetext.streaming import maintenance

BOOLEAN = [(0, "machine learning python"), (1, "deep learning neural"), (2, "machine learning neural"), (3, "python programming")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(BOOLEAN, "doc_id long, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_analyzer(spark):
    assert one(spark, lambda c: tokens(c), "Hello, WORLD! a-b don't") == ["hello", "world", "ab", "dont"]
    assert one(spark, lambda c: tokens(c, AnalyzerConfig(contractions=True, stop_words=())), "I cannot; gonna go") == ["can", "not", "gon", "na", "go"]
    assert one(spark, lambda c: tokens(c, AnalyzerConfig()), "this is the state of the art") == ["state", "art"]
    for nothing in (None, "", " ", "!?"):
        assert one(spark, lambda c: tokens(c), nothing) == []


@pytest.mark.parametrize(
    "pair",
    "caresses-caress ponies-poni cats-cat feed-feed agreed-agre plastered-plaster motoring-motor conflated-conflat hopping-hop falling-fall filing-file happy-happi "
    "relational-relat conditional-condit formalize-formal electrical-electr hopefulness-hope adjustment-adjust adoption-adopt probate-probat rate-rate controll-control "
    "roll-roll news-news dying-die ties-tie flies-fli sky-sky".split(),
)
def test_stemmer(pair):
    word, expected = pair.split("-")
    assert stem(word) == expected


def test_index(spark):
    found = ix.postings(spark.createDataFrame([(1, "cat dog cat"), (2, "dog bird"), (3, "cat bird fish"), (4, None), (5, "")], "doc_id long, text string"))
    assert {r["term"]: (r["df"], r["cf"]) for r in ix.terms(found).collect()} == {"cat": (2, 3), "dog": (2, 2), "bird": (2, 2), "fish": (1, 1)}
    assert found.where("doc_id = 1 AND term = 'cat'").first()["positions"] == [0, 2]
    s = ix.index_stats(found).first()
    assert (s["n_docs"], s["n_terms"], s["n_tokens"]) == (3, 4, 8)


def test_merge_lists(spark):
    schema = "doc_id long, term string, tf long, positions array<int>"
    a = spark.createDataFrame([(1, "t", 2, [5, 10]), (3, "t", 1, [15])], schema)
    b = spark.createDataFrame([(2, "t", 1, [20]), (3, "t", 2, [25, 30]), (9, "t", 1, [])], schema)
    assert sorted((r["doc_id"], r["tf"], r["positions"]) for r in ix.merged(a, b).collect()) == [(1, 2, [5, 10]), (2, 1, [20]), (3, 3, [15, 25, 30])]


def test_set_algebra(spark):
    schema = "doc_id long, positions array<int>, tf int"
    one_, two = (spark.createDataFrame(x, schema) for x in ([(1, [1, 2], 2), (3, [5], 1), (5, [10], 1)], [(2, [3], 1), (3, [6], 1), (4, [8], 1)]))
    assert [(r["doc_id"], r["positions"], r["tf"]) for r in bo.intersect_positions(one_, two).collect()] == [(3, [5, 6], 2)]
    assert ids(bo.union_positions(one_, two)) == [1, 2, 3, 4, 5]
    assert ids(bo.none_of(spark.range(1, 8).withColumnRenamed("id", "doc_id"), one_)) == [2, 4, 6, 7]
    assert ids(bo.none_of(one_, two)) == [1, 5]


def test_boolean(docs):
    posted = ix.frequencies(docs)
    assert ids(bo.all_of(posted, ["machine", "learning"])) == [0, 2]
    assert ids(bo.all_of(posted, ["machine", "deep"])) == []
    assert ids(bo.all_of(posted, ["machine", "unknown"])) == []
    assert ids(bo.any_of(posted, ["python", "neural", "unknown"])) == [0, 1, 2, 3]
    assert ids(bo.and_not(posted, ["learning"], ["python"])) == [1, 2]


def test_workload_of_booleans(docs):
    engine = SearchEngine.build(docs, EngineConfig(analyzer=PLAIN))
    queries = ["machine AND learning", "NOT python", "(machine OR deep) AND learning", "deep OR python", '"machine learning"', "NOT unknown", "learning AND NOT python", 'NOT "machine learning"', "(((", "a AND machine"]
    got = {}
    for r in engine.boolean(queries).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 2], 1: [1, 2], 2: [0, 1, 2], 3: [0, 1, 3], 4: [0, 2], 5: [0, 1, 2, 3], 6: [1, 2], 7: [1, 3], 9: [0, 2]}


def test_phrases(spark):
    rows = [(1, 0, "natural"), (1, 1, "language"), (1, 2, "processing"), (1, 10, "natural"), (1, 11, "language"), (1, 12, "processing"), (2, 5, "natural"), (2, 8, "language"), (3, 3, "processing")]
    toks = spark.createDataFrame([(d, 20, p, t) for d, p, t in rows], "doc_id long, dl int, pos int, term string")
    assert sorted(r["start"] for r in bo.phrase_starts(toks, ["natural", "language"]).collect()) == [0, 10]
    assert sorted((r["doc_id"], r["start"]) for r in bo.phrase_starts(toks, ["natural", "language", "processing"]).collect()) == [(1, 0), (1, 10)]
    again = token_table(spark.createDataFrame([(1, "so so so la")], "doc_id long, text string"))
    assert sorted(r["start"] for r in bo.phrase_starts(again, ["so", "so"]).collect()) == [0, 1]
    assert [(r["doc_id"], r["span"]) for r in bo.proximity_span(toks, ["natural", "language"], 5).collect()] == [(2, 3)]
    assert sorted((r["doc_id"], r["span"]) for r in bo.proximity_min_window(toks, ["natural", "language"], 5).collect()) == [(1, 1), (2, 3)]


def test_ranking(spark):
    posted = ix.frequencies(spark.createDataFrame([(0, "cat dog pet"), (1, "dog pet animal"), (2, "cat pet animal")], "doc_id long, text string"))
    asks = spark.createDataFrame([(0, ["cat"]), (1, ["cat", "dog"]), (2, ["pet"]), (3, ["unknown"])], "query_id int, terms array<string>")
    got = rk.ranked(posted, asks, 2, "boolean").collect()
    assert [(r["doc_id"], r["score"]) for r in got if r["query_id"] == 1] == [(0, 2.0), (1, 1.0)]
    assert [r["doc_id"] for r in got if r["query_id"] == 2] == [0, 1]
    assert not [r for r in got if r["query_id"] == 3]
    assert sorted(r["doc_id"] for r in rk.ranked(posted, asks, 10, "bm25").collect() if r["query_id"] == 0) == [0, 2]
    assert rk.ranked(posted, asks, 0).count() == 0
    assert rk.ranked_early_stop(posted, ["pet", "dog", "cat", "animal", "unknown"], 3, 3).count() == 3


def test_bm25_values(spark):
    row = spark.createDataFrame([(3, 2, 100, 10, 100.0)], "tf int, df int, dl int, n int, a double")
    c = F.col
    s = row.select(rk.idf(c("n"), c("df")).alias("i"), rk.bm25(c("tf"), c("df"), c("dl"), c("n"), c("a")).alias("b"), rk.bm25(F.lit(0), c("df"), c("dl"), c("n"), c("a")).alias("z")).first()
    assert s["i"] == pytest.approx(1.6094379124341003)
    assert s["b"] == pytest.approx(1.6094379124341003 * 3 * 2.5 / 4.5)
    assert s["z"] == 0


def test_parser():
    t = lambda x: Node("TERM", x)
    assert ast.parse("python") == t("python")
    assert ast.parse('"machine learning"') == Node("PHRASE", "machine learning")
    assert ast.parse("python AND NOT beginner") == Node("AND", parts=(t("python"), Node("NOT", parts=(t("beginner"),))))
    assert ast.parse("((A OR B) AND C) OR D") == Node("OR", parts=(Node("AND", parts=(Node("OR", parts=(t("A"), t("B"))), t("C"))), t("D")))
    assert ast.parse("a OR b AND c") == Node("OR", parts=(t("a"), Node("AND", parts=(t("b"), t("c")))))
    assert ast.parse("machine learning") == Node("BAG", parts=(t("machine"), t("learning")))
    assert ast.parse("machine learning", first_term_only=True) == t("machine")
    for bad in ("", "NOT NOT x", "(a", "malformed (((query AND", "AND x"):
        with pytest.raises(ast.QuerySyntaxError):
            ast.parse(bad)
        assert ast.parse_or_term(bad).kind == "TERM"
    assert ast.flat(ast.parse("a AND b AND a AND (b AND c)")) == Node("AND", parts=(t("a"), t("b"), t("c")))


def test_dsl():
    f = ["title^2", "text"]
    match = lambda q: {"multi_match": {"query": q, "fields": f, "type": "best_fields"}}
    assert ast.to_dsl("machine learning") == match("machine learning")
    assert ast.to_dsl("a AND NOT b") == {"bool": {"must": [match("a"), {"bool": {"must_not": [match("b")]}}]}}
    assert ast.to_dsl('"a b"') == {"bool": {"should": [{"match_phrase": {"title": "a b"}}, {"match_phrase": {"text": "a b"}}], "minimum_should_match": 1}}
    assert ast.to_dsl("a OR b")["bool"]["minimum_should_match"] == 1
    assert ast.to_dsl("(a") == match("(a")


def test_engine(spark, tmp_path):
    rows = [("d1", "Python is a programming language"), ("d2", "Java programming"), ("d3", "Machine learning with Python"), ("d4", None), ("d5", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    catalog = Catalog(spark, str(tmp_path / "indices"))
    told = catalog.create("first", docs)
    assert told["document_count"] == 3 and [x["index_name"] for x in catalog.list()] == ["first"]
    engine = catalog.load("first")
    assert engine.config == EngineConfig()
    result = json.loads(engine.result_json("programs"))
    assert sorted(r["doc_id"] for r in result["results"]) == ["d1", "d2"]
    assert json.loads(engine.result_json("unknown"))["total_results"] == 0
    assert engine.search(["python", "java AND programming", "python"], k=1).count() == 3
    newer = engine.update(add=spark.createDataFrame([("d2", "Rust"), ("d6", "python python")], "doc_id string, text string"), remove=spark.createDataFrame([("d3",)], "doc_id string"))
    rebuilt = SearchEngine.build(spark.createDataFrame([("d1", rows[0][1]), ("d2", "Rust"), ("d6", "python python")], "doc_id string, text string"))
    plain = lambda e: sorted((r["doc_id"], r["term"], r["tf"], r["dl"], r["positions"]) for r in e.posted.collect())
    assert plain(newer) == plain(rebuilt)
    saved = ix.load(spark, catalog.path("first"))
    assert ix.lookup(saved, ["python"]).count() == 2 and ix.bucket_of(saved) == ("tb_of_64", 64)
    assert catalog.delete("first") and catalog.list() == []


def test_gaps(spark):
    assert one(spark, encoding.gap_encode, [1, 5, 10, 15, 20], "array<int>") == [1, 4, 5, 5, 5]
    assert one(spark, encoding.gap_decode, [1, 4, 5, 5, 5], "array<int>") == [1, 5, 10, 15, 20]
    assert one(spark, encoding.gap_decode, [], "array<int>") == []
    with pytest.raises(Exception, match="ascend"):
        one(spark, encoding.gap_encode, [5, 1], "array<int>")
    assert one(spark, encoding.vbyte_size, [0, 127, 128, 16383, 16384], "array<int>") == 1 + 1 + 2 + 2 + 3


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2**40)))
def test_vbyte(numbers):
    assert encoding.unvbyte(encoding.vbyte(numbers)) == numbers


def test_evaluation(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, doc_id long")
    a, b = lists([(0, 1, 1), (0, 2, 2), (1, 1, 9)]), lists([(0, 1, 2), (0, 2, 3), (2, 1, 5)])
    rows = {r["query_id"]: (r["precision"], r["recall"]) for r in ev.precision_recall(a, b, 5).collect()}
    assert rows == {0: (0.2, 0.5), 1: (0.0, 0.0), 2: (0.0, 0.0)}
    m = ev.macro_average(ev.precision_recall(a, b, 5)).first()
    assert (m["precision"], m["successful"], m["failed"]) == (0.2, 1, 2)


def test_reports(spark):
    rows = spark.createDataFrame([("aa",), ("b",), (None,), ("cccc",), ("ddd",)], "text string")
    s = rp.length_stats(rows).first()
    assert (s["avg_len"], s["median_len"], s["min_len"], s["max_len"]) == (2.5, 3, 1, 4)
    table = spark.createDataFrame([(1000, "x", 0.5), (1000, "y", 0.25), (5000, "x", 0.75)], "size int, variant string, f double")
    assert sorted(map(tuple, rp.pivoted(table, "size", "variant", ["x", "y"], "f").collect())) == [(1000, 0.5, 0.25), (5000, 0.75, 0.0)]


def test_workload():
    pools = {"a": list("bcdefghijk"), "b": list("lmnopqrstu")}
    queries = wl.generate(pools, 100)
    assert queries == wl.generate(pools, 100) and len(queries) == 100 and queries != wl.generate(pools, 100, seed=1)
    assert all(ast.parse(q) for q in queries)


def test_sources(spark, tmp_path):
    import zipfile

    path = tmp_path / "corpus.jsonl"
    path.write_text('{"id": "a", "text": "one"}\nnot json\n{"text": "two"}\n{"id": "c", "text": ""}\n')
    rows = corpus.read_jsonl(spark, str(path)).collect()
    assert [(r["id"], r["text"]) for r in rows] == [("a", "one"), ("doc_2", "two"), ("c", "")]
    assert corpus.read_jsonl(spark, str(path), first_lines=2).count() == 1
    assert corpus.line_count(spark, str(path)) == 4 and corpus.sample_texts(corpus.read_jsonl(spark, str(path)), 5).count() == 2
    with zipfile.ZipFile(tmp_path / "news.zip", "w") as z:
        z.writestr("a.json", json.dumps({"uuid": "u", "text": "x" * 101, "thread": {"site": "s"}}))
        z.writestr("b.json", "broken")
        z.writestr("c.json", json.dumps({"text": "short"}))
    news = corpus.news_articles(corpus.read_zipped_json(spark, str(tmp_path))).collect()
    assert [(r["id"], r["site"], r["title"], r["categories"]) for r in news] == [("u", "s", "", [])]
    wl.save(spark, ["a", "b AND c"], str(tmp_path / "queries"), "news")
    assert corpus.read_queries(spark, str(tmp_path / "queries"), 2).count() == 2 and corpus.read_queries(spark, str(tmp_path / "queries"), 3) is None


def test_streamed_index_equals_batch(spark, docs, tmp_path):
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintenance.maintain(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()
    plain = lambda df: sorted((r["doc_id"], r["term"], r["tf"], r["positions"]) for r in df.collect())
    assert plain(maintenance.current(spark, str(tmp_path / "index"))) == plain(ix.postings(docs))
    newer = [(0, "new text"), (1, ""), (9, "python python")]
    spark.createDataFrame(newer, docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    maintenance.maintain(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()
    now = plain(ix.postings(spark.createDataFrame(newer + BOOLEAN[2:], docs.schema)))
    assert plain(maintenance.current(spark, str(tmp_path / "index"))) == now
    maintenance.compact(spark, str(tmp_path / "index"))
    assert len(list((tmp_path / "index").glob("batch=*"))) == 1 and plain(maintenance.current(spark, str(tmp_path / "index"))) == now


def test_dense_ids(spark):
    rows = ix.dense_ids(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k long"), "k").collect()
    assert sorted((r["k"], r["doc_no"]) for r in rows) == [(i, i) for i in range(50)]


def test_stemmed_engine_matches_inflections(spark):
    engine = SearchEngine.build(spark.createDataFrame([(1, "running dogs"), (2, "a dog ran")], "doc_id long, text string"), EngineConfig(analyzer=ENGLISH))
    assert sorted(r["doc_id"] for r in engine.boolean(["dog"]).collect()) == [1, 2]


def test_analysis_on_the_driver_is_that_of_spark(spark):
    texts = ["Hello, WORLD! a-b don't", "I cannot; gonna go", "this is the state of the art", "running\tdogs\x0bran", "", "...", "x" * 60 + " yy"]
    for config in (PLAIN, SERVER, AnalyzerConfig(), AnalyzerConfig(contractions=True, lowercase=False)):
        assert [one(spark, lambda c: tokens(c, config), t) for t in texts] == [analyzed_here(t, config) for t in texts]
    assert analyzed_here("running dogs", ENGLISH) == ["run", "dog"]
    engine = SearchEngine.build(spark.createDataFrame([(1, "Running dogs \u00fcber"), (2, "cats")], "doc_id long, text string"))
    assert engine.analyzed(["dogs running", "\u00dcber dogs", "dogs running"]) == [["dog", "run"], ["\u00fcber", "dog"], ["dog", "run"]]


def test_hits_and_metadata(spark):
    rows = [(i, "cat dog" if i % 2 else "cat") for i in range(30)]
    engine = SearchEngine.build(spark.createDataFrame(rows, "doc_id long, text string"), EngineConfig(analyzer=PLAIN))
    hits = {r["query_id"]: (r["total_hits"], r["max_score"]) for r in engine.hits(["dog", "cat AND dog", "unknown"]).collect()}
    assert hits[0][0] == 15 and hits[0][1] > 0 and hits[1] == (15, 1.0) and 2 not in hits
    told = json.loads(engine.result_json("dog", 4))
    assert told["total_results"] == 15 and [r["rank"] for r in told["results"]] == [1, 2, 3, 4]
    meta = spark.createDataFrame([(3, "three"), (7, "seven"), (4, "four")], "doc_id long, title string")
    assert sorted((r["rank"], r["title"]) for r in engine.search_documents(["dog"], meta).collect()) == [(1, "three"), (2, "seven")]
    assert engine.length(1) == 2 and engine.length(99) is None and engine.count() == 30
    assert {(r["df"], r["total_tf"]) for r in engine.postings_of("dog").collect()} == {(15, 15)}


@pytest.mark.parametrize("options", [{"buckets": 7}, {"coded": True}, {"codec": "gzip", "buckets": 1}])
def test_saved_index(spark, tmp_path, options):
    rows = [(i, f"common word{i % 5} word{i} common") for i in range(40)]
    built = SearchEngine.build(spark.createDataFrame(rows, "doc_id long, text string"), EngineConfig(analyzer=PLAIN))
    built.save(str(tmp_path / "x"), **options)
    loaded = SearchEngine.load(spark, str(tmp_path / "x"))
    asks = ["common word3", '"word3 word33"', "word7 OR word8", "common AND NOT word1", "nothing"]
    plain = lambda e: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in e.search(asks, 50).collect())
    assert plain(loaded) == plain(built) and plain(loaded)
    assert sorted((r["term"], r["positions"]) for r in ix.lookup(loaded.posted, ["common", "word9"]).collect()) == sorted((r["term"], r["positions"]) for r in ix.lookup(built.posted, ["common", "word9"]).collect())
    assert ix.bucket_of(loaded.posted)[1] == options.get("buckets", 64) and loaded.stats().first().asDict() == pytest.approx(built.stats().first().asDict())
    assert loaded.told["n_docs"] == 40 and ix.lookup(loaded.posted, []).count() == 0
    assert sorted(r["doc_id"] for r in loaded.update(remove=spark.createDataFrame([(0,)], "doc_id long")).boolean(["word0"]).collect()) == [5, 10, 15, 20, 25, 30, 35]


def test_fields(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running", "about dogs"), (2, "Cats", "they run and run"), (3, None, "")], "doc_id long, title string, text string")
    engine = FieldedEngine.build(docs)
    engine.save(str(tmp_path / "f"))
    loaded = FieldedEngine.load(spark, str(tmp_path / "f"))
    assert loaded.fields == FIELDS
    got = loaded.search(["running", "cats", "none"]).collect()
    assert [(r["query_id"], r["doc_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, 1), (0, 2), (1, 2)]
    assert {r["query_id"]: r["total_hits"] for r in loaded.hits(["running", "cats"]).collect()} == {0: 2, 1: 1}
    one_ = FieldedEngine.build(docs, {"title": Field("title", 3.0, PLAIN)})
    assert [r["doc_id"] for r in one_.search(["running"]).collect()] == [1]


def test_variants():
    v = experiments.VARIANTS["tfidf_threshold"]
    assert v.short == "lodetext_i3d1c1qToth" and v.dotted == "3.1.0.th.T" and "optim=threshold" in v.long
    assert experiments.VARIANTS["tfidf_gap"].storage() == {"codec": None, "coded": True}
    with pytest.raises(ValueError):
        experiments.Variant("bm26")


def test_matrix(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"apple pear{i % 3} plum{i % 2}") for i in range(12)] + [(99, "")], "doc_id long, text string")
    catalog, chosen = Catalog(spark, str(tmp_path / "indices")), {k: experiments.VARIANTS[k] for k in ("boolean", "tfidf_gap")}
    built = experiments.build_matrix(catalog, {"fruit": docs}, [6, None], chosen).collect()
    assert [r["status"] for r in built] == ["built"] * 4 and [r["documents"] for r in built] == [6, 6, 12, 12] and built[2]["skipped"] == 1
    assert {r["status"] for r in experiments.build_matrix(catalog, {"fruit": docs}, [6], chosen).collect()} == {"skipped"}
    assert experiments.build_matrix(catalog, {"bad": spark.range(3)}, [None], {"x": chosen["boolean"]}).first()["status"].startswith("failed")
    with pytest.raises(KeyError):
        catalog.load("nothing")
    asks = ["apple", "pear1 AND plum1", '"apple pear2"']
    records = experiments.benchmark_matrix(catalog, {"fruit": asks}, [None], chosen, warm_up=1)
    experiments.save_benchmark(records, str(tmp_path / "bench"), "variant")
    done = spark.read.json(str(tmp_path / "bench" / "details"))
    assert done.count() == 6 and sorted({r["kind"] for r in done.collect()}) == ["and", "phrase", "term"]
    assert {(r["successful"], r["failed"]) for r in spark.read.json(str(tmp_path / "bench" / "statistics")).collect()} == {(3, 0)}

    def broken(e, q, k):
        if q == "bad":
            raise RuntimeError
        return e.search([q], k)

    whole = experiments.summary(experiments.timed(catalog.load("fruit_all_boolean"), ["bad", "apple"], run=broken)).first()
    assert (whole["successful"], whole["failed"], whole["n"]) == (1, 1, 1) and whole["p95"] > 0
    reference = experiments.cached(spark, str(tmp_path / "reference"), lambda: catalog.load("fruit_all_boolean").search(asks, 20))
    assert experiments.cached(spark, str(tmp_path / "reference"), lambda: 1 / 0).count() == reference.count()
    found = {r["variant"]: r for r in experiments.evaluate(catalog, {"fruit": reference}, {"fruit": asks}, [None], chosen).collect()}
    assert found[chosen["boolean"].short]["recall"] == 1.0 and len(found) == 2
    path = experiments.write_evaluation(experiments.evaluate(catalog, {"fruit": reference}, {"fruit": asks}, [None], chosen), str(tmp_path / "eval"))
    assert spark.read.json(path).count() == 2 and corpus.latest(spark, str(tmp_path / "eval" / "eval*"), lines=True).count() == 2
    (tmp_path / "m1.json").write_text('{"a":\n1}')
    (tmp_path / "m2.json").write_text('{"a":\n2}')
    assert corpus.latest(spark, str(tmp_path / "m*.json")).first()["a"] == 2
    bins = experiments.histogram(done, "latency_ms", 4).collect()
    assert len(bins) == 4 and sum(r["n"] for r in bins) == 6
    assert experiments.series(done, "variant", "kind").count() == 6


def test_normalised_answers(spark):
    answers = [(0, '{"results": [{"doc_id": 7, "score": 2.5}, {"id": "b"}]}'), (1, '{"hits": {"hits": [{"_id": "x", "_score": 1.0}]}}'), (2, '[{"id": "q"}, {"score": 1}, {"uuid": "r"}]'), (3, "broken"), (4, None), (5, '{"documents": []}')]
    rows = experiments.normalised(spark.createDataFrame(answers, "query_id int, value string"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in rows) == [(0, 1, "7", 2.5), (0, 2, "b", None), (1, 1, "x", 1.0), (2, 1, "q", None), (2, 2, "r", None)]


def test_queries_are_explained():
    assert ast.explain('a AND NOT "b c"')["tree"] == '(and a (not "b c"))' and ast.explain('a AND NOT "b c"')["leaves"] == ["a", "b c"]
    assert "not_parsed" in ast.explain("(a") and ast.rewritten("(x OR y z) AND w") == "(x OR y) AND w" and ast.rewritten("(((") == "(((" and ast.rewritten("") == ""
    assert ast.is_boolean("a OR b") and not ast.is_boolean("a b") and ast.terms_of("a AND NOT b") == ["a", "b"]
    assert ast.to_dsl("a b", operator="and")["multi_match"]["operator"] == "and"


def test_first_lines_over_several_files(spark, tmp_path):
    for name, ids_ in (("a", range(5)), ("b", range(5, 9)), ("c", range(9, 12))):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"text": "t{i}"}}\n' if i != 6 else "bad\n" for i in ids_))
    rows = corpus.read_jsonl(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["text"]) for r in rows) == sorted((f"doc_{i}", f"t{i}") for i in range(12) if i != 6)
    assert sorted(r["text"] for r in corpus.read_jsonl(spark, str(tmp_path), first_lines=8).collect()) == sorted(f"t{i}" for i in range(8) if i != 6)


def test_dataset_stats(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"c": 1}',), (None,)], "value string")
    assert tuple(rp.dataset_stats(rows, "value").first()) == (2, ["a", "b", "c"]) and rp.dataset_stats(rows, "value", cap=1).first()["n"] == 1
    assert rp.sample_rows(rows.where("value IS NOT NULL"), "value", 1).first()["value"] == '{"a": 1, "b": 2}'


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(i, f"apple pear{i % 30} plum{i % 40} fig{i % 50} kiwi{i % 60}") for i in range(120)], "doc_id long, text string").write.parquet(str(tmp_path / "docs.parquet"))
    root, docs = ["--root", str(tmp_path / "indices")], str(tmp_path / "docs.parquet")

    def run(*args):
        capsys.readouterr()
        cli.main([*root, *args])
        return capsys.readouterr().out

    assert json.loads(run("setup", docs))["corpus_exists"] and not json.loads(run("setup", docs + "x"))["corpus_exists"]
    assert json.loads(run("--set", "analyzer.stemming=false", "build", "first", docs, "--variant", "wordcount"))["document_count"] == 120
    assert json.loads(run("list"))[0]["index_type"] == "tf"
    assert json.loads(run("query", "first", "pear3", "-k", "2"))["total_results"] == 4
    assert json.loads(run("--set", "scorer=tf", "--set", "max_results=3", "config"))["max_results"] == 3
    assert json.loads(run("explain", "a AND b"))["tree"] == "(and a b)"
    assert "apple" in run("wordfreq", docs, "-n", "3")
    assert "total_queries" in run("workload", "first", str(tmp_path / "queries"), "-n", "20")
    assert "queries_per_second" in run("bench", "first", "-n", "10", "--output", str(tmp_path / "bench"))
    assert json.loads(run("experiment", docs, str(tmp_path / "out"), "-n", "10", "--variants", "boolean"))["built"] == 1
    assert run("delete", "first").strip() == "True"
    with pytest.raises(ValueError):
        cli.overridden(EngineConfig(), ["nothing=1"])
