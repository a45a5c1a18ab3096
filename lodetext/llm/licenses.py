"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Phrases whose places are counted, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License"
GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation"
#: The operative sentences of public license notices, with their labels.
TEMPLATES = [
    ("agpl", GNU.format("program", "Affero ")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by", CREATIVE.format("Attribution")),
    ("cc-by-nc", CREATIVE.format("Attribution-NonCommercial")),
    ("cc-by-nc-nd", CREATIVE.format("Attribution-NonCommercial-NoDerivatives")),
    ("cc-by-nc-sa", CREATIVE.format("Attribution-NonCommercial-ShareAlike")),
    ("cc-by-nd", CREATIVE.format("Attribution-NoDerivatives")),
    ("cc-by-sa", CREATIVE.format("Attribution-ShareAlike")),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl", GNU.format("program", "")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", GNU.format("library", "Lesser ")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    """Distinct words of an ASCII template."""
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def rivals(templates, threshold: float) -> dict[str, list[str]]:
    """For each label those of other templates that a notice of the one may meet as well, as they hold nearly the same words."""
    sets = [(label, set(template_words(t))) for label, t in templates]
    return {a: sorted({b for b, y in sets if b != a and len(x & y) >= threshold * min(len(x), len(y)) - 1e-9}) for a, x in sets}


def words_of(text: str):
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def strings(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def numbers(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def scan(docs: DataFrame, threshold: float = 0.8, block: int = 128, templates=None, phrases=None) -> DataFrame:
    """Per row of docs (doc_id, text): the columns of op9_licenses and blocks, array<struct<label, start, containment, chosen>>.

    A text block is `block` consecutive words from every multiple of block / 2. Each pair of a block and a template of m distinct words
    that holds at least need = ceil(threshold * m) of them is found: words are ordered by document frequency over all of docs, rare first, and the
    k template words of a block and those of a template are compared in that order. A pair can only qualify if k >= need (length filter), if the first
    m - need + 1 of the template and the first k - need + 1 of the block meet (prefix filter), and if these matches and what both have left after
    the last of them come to need (positional filter); what passes is counted in full. Templates are few, so they lie in the plan as literals: after one small
    aggregation for the frequencies there is neither shuffle nor Python, and a frequent word or passage costs no more than another.

    All pairs are in blocks. Of templates that are nearly contained in one another, a block's label is only the one of highest containment, and of
    those the longest (chosen): a notice of the lesser license isn't one of the general. Null and empty texts have no words: counts 0,
    places null, labels '', score 0. Repeated rows are kept; other columns are ignored.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    sets = [(label, template_words(t)) for label, t in templates]
    vocabulary = sorted({w for _, words in sets for w in words} | {w for p, _ in phrases for w in p.split()})
    texts = docs.select("doc_id", words_of("text").alias("w"))
    held = texts.select(F.expr(f"explode(array_intersect(w, {strings(vocabulary)}))").alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    ranked = f"transform(array_intersect({{}}, {strings(order)}), x -> array_position({strings(order)}, x) - 1)"
    rows = texts.select("doc_id", "w", F.expr(f"array_sort({ranked.format('w')})").alias("has"))
    places = []
    for k, (phrase, _) in enumerate(phrases):
        parts = phrase.split()
        whole = " AND ".join(f"array_contains(has, {rank[x]}L)" for x in parts)
        here = " AND ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(parts))
        places.append(F.expr(f"CASE WHEN {whole} THEN filter(sequence(0, size(w) - 1), i -> {here}) ELSE CAST(array() AS array<int>) END").alias(f"p{k}"))

    def maybe(of: str, words: list[str]) -> str:
        r, need = sorted(rank[x] for x in words), math.ceil(threshold * len(words) - 1e-9)
        whole = numbers(f"{x}L" for x in r)
        prefix = numbers(f"{x}L" for x in r[: len(r) - need + 1])
        met = f"array_intersect({prefix}, slice({of}, 1, greatest(0, size({of}) - {need} + 1)))"
        left = f"least({len(r)} - array_position({whole}, element_at(c, -1)), size({of}) - array_position({of}, element_at(c, -1)))"
        return f"(size({of}) >= {need} AND exists(array({met}), c -> CASE WHEN size(c) > 0 THEN size(c) + {left} >= {need} ELSE false END))"

    any_template = " OR ".join(maybe("has", words) for _, words in sets)
    half = block // 2
    starts = f"transform(sequence(0, size(w) - 1, {half}), i -> named_struct('start', i, 'has', array_sort({ranked.format(f'slice(w, i + 1, {block})')})))"
    rows = rows.select("doc_id", "w", *places, F.expr(f"CASE WHEN {any_template} THEN {starts} END").alias("windows"))
    hits = []
    for label, words in sets:
        need = math.ceil(threshold * len(words) - 1e-9)
        common = f"size(array_intersect(b.has, {numbers(f'{rank[x]}L' for x in sorted(words, key=rank.get))}))"
        hits.append(f"CASE WHEN {maybe('b.has', words)} AND {common} >= {need} THEN named_struct('label', '{label}', 'start', CAST(b.start AS BIGINT), 'containment', {common} / {len(words)}D, 'words', {len(words)}) END")
    of_rivals = rivals(templates, threshold)
    rival = "element_at(map(" + ", ".join(f"'{label}', {strings(of_rivals[label])}" if of_rivals[label] else f"'{label}', CAST(array() AS array<string>)" for label in of_rivals) + "), x.label)"
    better = f"exists(h, y -> array_contains({rival}, y.label) AND (y.containment > x.containment OR y.containment = x.containment AND y.words > x.words))"
    chosen = f"transform(h, x -> named_struct('label', x.label, 'start', x.start, 'containment', x.containment, 'chosen', NOT {better}))"
    here = f"element_at(transform(array(array_compact(array({', '.join(hits)}))), h -> {chosen}), 1)"
    kind = "array<struct<label:string,start:bigint,containment:double,chosen:boolean>>"
    found = F.expr(f"CASE WHEN windows IS NOT NULL THEN flatten(transform(windows, b -> {here})) ELSE CAST(array() AS {kind}) END")
    named = [f"CASE WHEN size(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases)]
    every = "concat(" + ", ".join(f"p{k}" for k in range(len(phrases))) + ")"
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(every).alias("places"), F.expr(f"array_sort(array_distinct(array_compact(array({', '.join(named)}))))").alias("base"), found.alias("blocks"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base, transform(filter(blocks, b -> b.chosen), b -> b.label))), ',')").alias("labels"),
        F.expr("CASE WHEN size(places) > 0 THEN 1D ELSE coalesce(array_max(transform(blocks, b -> b.containment)), 0D) END").alias("score"),
        "blocks",
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def op9_sql(threshold: float = 0.8, block: int = 128) -> str:
    """The same result in DuckDB: every block against every template, counted in full."""
    rows = ",\n".join(f"('{label}', {template_words(t)!r}, {math.ceil(threshold * len(template_words(t)) - 1e-9)})" for label, t in TEMPLATES)
    at = []
    for phrase, _ in PHRASES:
        here = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
        at.append(f"list_filter(range(len(w)), lambda i: {here})")
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    near = ", ".join(f"('{a}', '{b}')" for a, found in rivals(TEMPLATES, threshold).items() for b in found)
    return f"""
WITH templates(label, words, need) AS (VALUES {rows}),
texts AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w
  FROM documents),
blocks AS (SELECT row_id, unnest(range(0, len(w), {block // 2})) AS start, unnest(list_transform(range(0, len(w), {block // 2}), lambda i: w[i + 1 : i + {block}])) AS b FROM texts WHERE len(w) > 0),
hits AS (
  SELECT row_id, start, label, len(list_intersect(words, b)) / len(words) AS c, len(words) AS m
  FROM blocks, templates WHERE len(list_intersect(words, b)) >= need),
rivals(label, other) AS (VALUES {near}),
beaten AS (
  SELECT DISTINCT x.row_id, x.start, x.label
  FROM hits x JOIN rivals r ON r.label = x.label JOIN hits y ON y.row_id = x.row_id AND y.start = x.start AND y.label = r.other
  WHERE y.c > x.c OR y.c = x.c AND y.m > x.m),
method AS (
  SELECT row_id, list(DISTINCT h.label) FILTER (b.label IS NULL) AS found, max(c) AS best
  FROM hits h LEFT JOIN beaten b USING (row_id, start, label) GROUP BY row_id),
placed AS (SELECT row_id, doc_id, w, {', '.join(f'{x} AS p{k}' for k, x in enumerate(at))} FROM texts),
based AS (SELECT *, list_filter([{named}], lambda x: x IS NOT NULL) AS base, {' || '.join(f'p{k}' for k in range(len(PHRASES)))} AS places FROM placed)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM based LEFT JOIN method USING (row_id)"""
