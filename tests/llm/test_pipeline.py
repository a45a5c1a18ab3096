"""The pipeline's stages, one after the other, on a small corpus."""

import corpus_pipeline
from lodetext.llm.shared import stored

from .test_operators import DOCS, corpus, frame, save


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    rows = docs + [(10_000, docs[2][1], *docs[2][2:]), (10_001, docs[3][1] + " one more word", *docs[3][2:])] + [(20_000 + r[0] if r[0] is not None else None, *r[1:]) for r in DOCS]
    rows += [(30_000 + i, docs[4][1] if i else None, *docs[4][2:]) for i in (0, 1, 1, 1)] + [(30_002, " ".join(f"z{k} and then" for k in range(20_000)), "en", None, None)]
    path = save(spark, tmp_path, documents=frame(spark, rows), labels=spark.createDataFrame(labels + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int"))
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, path), name)
        ids[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert name == "packing" or now.columns == columns
    bad, toxic = {d for d, q, _ in labels if not q}, {d for d, _, t in labels if t}
    clean = set(range(len(docs))) - bad - toxic
    assert len(ids["quality_classifier"] & bad) <= 0.02 * len(bad) and len(clean - ids["quality_classifier"]) <= 0.02 * len(clean)
    assert len(ids["toxicity"] & toxic) <= 0.02 * len(toxic) and len(clean - ids["toxicity"]) <= 0.02 * len(clean)
    assert not ids["simhash_near_dedup"] & {10_000, 10_001, 30_001} and clean & ids["toxicity"] <= ids["simhash_near_dedup"]
    assert ids["packing"] == ids["source_mixture"] <= ids["simhash_near_dedup"]


def test_empty_corpus(spark, tmp_path):
    path = save(spark, tmp_path, documents=frame(spark, [], extra=False), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, path).count() == 0
