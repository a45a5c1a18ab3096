"""Training-data operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodetext.llm import audio, html_text, licenses, mixing, packing, quality, queries, simhash, topk, toxicity, warc
from lodetext.llm.shared import components, new_path

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
DOCS = [
    (0, "the mit license and Apache License, CC-BY text", "en", "b", 10),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "de", "b", len(LONG)),
    (4, "Same words here again and again for all of you to read", "en", "a", 5),
    (5, "Same words here again and again for all of you to read", "en", "a", 5),
    (5, "Same words here again and again for all of you to read", "en", "a", 5),
    (None, "no id but some text with words", "fr", "c", 3),
    (7, " \n\t ", "en", "c", 4),
    (50, "gnu general public license gnu general public license", "en", "\U0001f600", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "fp", "key", "root", "size", "row", "mix_taken", "term", "digest", "query", "start", "labels", "w"]


def frame(spark, rows=DOCS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype({c: "Int64" for c, t in df.dtypes if t == "bigint"}))
    return sorted(con.sql(text).fetchall(), key=str)


def plain(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = components(spark.createDataFrame([(9, 1), (8, 1), (1, 7)], "u long, v long"))  # nothing to do, and what looks like it
    assert {tuple(r) for r in star.collect()} == {(9, 1), (8, 1), (7, 1), (1, 1)}
    assert {r["root"] for r in components(spark.createDataFrame([(9, 1), (9, 2), (8, 2)], "u long, v long")).collect()} == {1}


# --- near-duplicates


def test_fingerprint_by_definition():
    import xxhash

    text = "A b\tC d\x0bÀ A b"
    w = ["a", "b", "c", "d", "À", "a", "b"]
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), 42).intdigest() for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 5)
    assert simhash.fingerprint(text) % 2**64 == want
    assert simhash.fingerprint("one TWO") % 2**64 == xxhash.xxh64(b"one two", 42).intdigest()
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


@pytest.mark.parametrize("bits, bucket", [(0, 256), (1, 0), (2, 0), (2, 3), (2, 256), (3, 0)])
def test_near_links(spark, bits, bucket):
    rng = np.random.default_rng(bits)
    values = set()
    for x in rng.integers(-(2**62), 2**62, 12).tolist():
        values.add(x)
        for _ in range(8):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= (1 << int(b)) if b < 63 else -(1 << 63)
            values.add(y)
    values = sorted(values)

    def parts(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(v) for v in values]

    got = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), bits, bucket).collect()
    assert parts(got) == parts((a, b) for a in values for b in values if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits)


def test_op8(spark, tmp_path):
    path = save(spark, tmp_path, documents=frame(spark))
    rows = plain(simhash.op8_simhash(spark, path), ["doc_id", "fingerprint", "component_id"])
    by = {r[0]: r for r in rows}
    assert len(rows) == len(DOCS)
    assert by[1][1:] == by[2][1:] == by[7][1:] == ("0" * 16, 1)
    assert by[4][1:] == by[5][1:] and by[4][2] == 4 and sum(r[0] == 5 for r in rows) == 2
    assert by[None][2] is None and by[0][2] == 0
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_go(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for base in range(20):
        words = [f"t{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((n, " ".join(words), "en", "a", 1))
        for _ in range(3):
            n += 1
            copy = list(words)
            for i in rng.integers(0, 300, 3):
                copy[i] = f"u{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(copy), "en", "a", 1))
        n += 1
    rows += [(1000, "", "en", "a", 0), (1001, None, None, None, None), (None, "", "en", "a", 0), (1002, "few words", "en", "a", 0), (1002, "few words", "en", "a", 0), (1003, "Few  Words", "en", "a", 0)]
    assert all(jaccard(rows[4 * b][1], rows[4 * b + k][1]) >= 0.8 for b in range(20) for k in (1, 2, 3))
    docs = frame(spark, rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4 * b for b in range(20)] + [1000, 1002]
    assert simhash.deduplicated(frame(spark, [])).count() == 0


def test_separate_edits_of_one_text(spark):
    rng = np.random.default_rng(3)

    def edited(words, n):
        copy = list(words)
        for i in rng.choice(len(copy), n, replace=False):
            copy[i] = f"u{rng.integers(0, 10**9)}"
        return copy

    texts = []
    for size, copies in ((400, 250), (200, 60)):  # far apart from each other, all near to the first
        base = [f"t{x}" for x in rng.integers(0, 10**6, size)]
        texts += [base] + [edited(base, rng.integers(6, 9) * size // 400) for _ in range(copies)]
    walk = [[f"t{x}" for x in rng.integers(0, 10**6, 300)]]
    for _ in range(40):  # each near to its neighbours only
        walk.append(edited(walk[-1], 4))
    texts += walk
    sets = [frozenset(zip(*(t[i:] for i in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if c >= 0.8 * (len(a) + len(sets[j]) - c) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    order = rng.permutation(len(texts))  # the first of a group isn't the one that all are near to
    least = defaultdict(lambda: 10**9)
    for i in range(len(texts)):
        least[find(i)] = min(least[find(i)], int(order[i]))
    docs = frame(spark, [(int(order[i]), " ".join(t), "en", "a", 1) for i, t in enumerate(texts)])
    assert len(least) < 10
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == sorted(least.values())


def test_block_pairs(spark):
    rng = np.random.default_rng(4)
    sets = [set(rng.choice(200, rng.integers(20, 41), replace=False).tolist()) for _ in range(40)]
    sets += [set(x) ^ {1000 + i, min(x)} for i, x in enumerate(sets)]
    marks = [[sum(1 << b for b in range(64) if 64 * w + b in x) - (1 << 64) * (64 * w + 63 in x) for w in range(simhash.MARKS)] for x in sets]
    rows = [(int(k), int(v), f"x{i}", f"r{i % 30}", len(x), marks[i]) for i, x in enumerate(sets) for k, v in ((0, i % 2), (1, 7))]
    members = spark.createDataFrame(rows, "k int, value long, key string, root string, size long, marks array<long>")
    want = {(max(a[2], b[2]), min(a[2], b[2])) for a in rows for b in rows if a[:2] == b[:2] and a[3] != b[3] and a[2] != b[2]}
    near = {(u, v) for u, v in want for a, b in [(sets[int(u[1:])], sets[int(v[1:])])] if len(a & b) >= 0.8 * len(a | b)}
    assert len(near) > 20
    for block in (1, 8, 1000):
        assert {(r["u"], r["v"]) for r in simhash.block_pairs(members, 0.0, block).collect()} == want
        assert near <= {(r["u"], r["v"]) for r in simhash.block_pairs(members, 0.8, block).collect()} < want


# --- licenses


def test_op9(spark, tmp_path):
    more = [(60 + i, t, "en", "a", 1) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    more += [(180, "x " * 90 + dict(licenses.TEMPLATES)["mit"] + " y" * 90, "en", "a", 1), (181, "MIT\nLicense mit-license", "en", "a", 1), (182, "cc by by cc by", "en", "a", 1)]
    more += [(190, " z" * 200 + (t := dict(licenses.TEMPLATES))["gpl"] + " y" * 200 + t["lgpl"], "en", "a", 1), (191, t["cc-by-nc"].replace("International ", ""), "en", "a", 1)]
    docs = frame(spark, DOCS + more)
    path = save(spark, tmp_path, documents=docs)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = plain(licenses.op9_licenses(spark, path), names)
    assert got == sql(licenses.op9_sql(), documents=docs.select("doc_id", "text"))
    by = {r[0]: r for r in got}
    assert by[0][5] == "apache,cc-by,mit" and by[50][1:5] == (8, 2, 0, 4) and by[1][1:] == (0, 0, None, None, "", "", 0.0)
    assert by[180][6] == "mit" and by[180][7] == 1.0 and by[180][2] == 0 and by[181][2] == 2 and by[182][2:5] == (2, 0, 3)
    assert [by[60 + i][6] for i in range(len(licenses.TEMPLATES))] == [",".join(sorted({label, *by[60 + i][5].split(",")} - {""})) for i, (label, _) in enumerate(licenses.TEMPLATES)]
    assert by[190][6] == "gpl,lgpl" and by[191][6] == "cc-by-nc"
    pairs = {(r["doc_id"], b["label"], b["start"]) for r in licenses.scan(docs).collect() for b in r["blocks"]}
    want = set()
    for d, t, *_ in DOCS + more:
        w = [x for x in re.split(licenses.GAP, (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
        for at in range(0, len(w), 64):
            for label, text in licenses.TEMPLATES:
                words = set(licenses.template_words(text))
                if len(words & set(w[at : at + 128])) >= 0.8 * len(words) - 1e-9:
                    want.add((d, label, at))
    assert pairs == want
    assert licenses.scan(frame(spark, [])).count() == 0


# --- mixing


def test_op3(spark, tmp_path):
    rows = [(i, "w " * (i * 37 % 90), "en", None if i % 10 == 0 else f"s{i % 3 if i % 7 else 5}", 1) for i in range(400)] + DOCS
    docs = frame(spark, rows)
    path = save(spark, tmp_path, documents=docs)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = plain(mixing.op3_mixing(spark, path), names)
    want = sql(mixing.OP3_SQL, documents=docs.select("doc_id", "text", "source"))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert got == plain(mixing.op3_mixing(spark, path), names)
    assert all(r[4] <= 2 * r[1] for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[r[2], r[3]] += r[4]
    assert all(abs(t - n) <= 1 for (_, t), n in sums.items())


def test_flow_of_overlapping_sources():
    patterns, quotas = {("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 12}
    given = mixing.flow(patterns, quotas, 2)
    assert sum(f.get("a", 0) for f in given.values()) == 12 and sum(f.get("b", 0) for f in given.values()) == 12
    assert sum(given["a", "b"].values()) == 10 and given[("b",)]["b"] == 2 and given[("a",)]["a"] == 10 or sum(max(0, sum(f.values()) - patterns[p]) for p, f in given.items()) == 2
    assert mixing.flow({}, {}, 2) == {}


def test_targets_by_water_filling():
    got = mixing.targets({"a": 10, "b": 1000, None: 50}, {"a": 3, "b": 1, None: 2}, 1.5, 2)
    assert got["a"] == 20 and got[None] == 100 and got["b"] == pytest.approx(1.5 * 1060 - 120)


def test_materialised_mix(spark):
    docs = frame(spark)
    out = mixing.materialised(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r["doc_id"], r["source"]] += len((r["text"] or "").split())
    sized = docs.select("doc_id", "source", F.array("source").alias("sources"), mixing.n_words("text").alias("size"), mixing.row_key(F.col("doc_id"), F.col("text")).alias("key"))
    want = defaultdict(int)
    for r in mixing.mix(sized, key="key").collect():
        want[r["doc_id"], r["source"]] += r["mix_taken"]
    assert {k: n for k, n in taken.items() if n} == {k: n for k, n in want.items() if n}
    assert mixing.materialised(frame(spark, [])).count() == 0


# --- packing


def test_op10(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = DOCS + [(100 + i, t, "en", "a", 1) for i, t in enumerate(["  two  spaces ", "tab\tand\nline \n x", "<|endoftext|>", "don't we'll 3,000 naïve", "é" * 70, "a" * 5000, " lead", "trail ", "1 2  3"])]
    path = save(spark, tmp_path, documents=frame(spark, rows))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for d, t, *_ in rows:
        ids[d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces = packing.op10_packing(spark, path).collect()
    whole = packing.pack(spark.read.parquet(f"{path}/documents.parquet")).collect()
    assert sorted(zlib.crc32(r["ids"]) for r in whole) == sorted(r["ids_crc32"] for r in pieces)
    texts, by, sequences = Counter(), defaultdict(list), defaultdict(list)
    for r in whole:
        by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for (d, n), parts in by.items():
        copies = sum(s == 0 for s, _ in parts)
        data = b"".join(x for _, x in sorted(set(parts)))
        assert len(data) == 4 * n
        texts[d, data] += copies
    assert texts == ids
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(frame(spark, [])).count() == 0


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z ", " <|startoftext|> \n\n q", "don't WE'LL it's 12 345", "\u200b é\u0301 漢字 🙂 \r\n\t x", LONG[:5000]]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        for literal in (False, True):
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = literal
            encode = packing.Encoder(path, literal, keep=3).ids
            for text in texts:
                assert encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), (name, literal, text)
    assert packing.ranked(public_tokenizers.path("byte_bpe_50k.json")) and not packing.ranked(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_balances_cost():
    lengths = np.array([700] * 30 + [100] * 120 + [3000] * 3 + [1])
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    seen = defaultdict(int)
    for k, _, n, *_ in pieces:
        seen[k] += n
    assert [seen[k] for k in range(len(lengths))] == lengths.tolist()
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
    full = [c for s, c in cost.items() if s > 3][:10]
    assert max(full) / min(full) < 1.6


# --- archives


def test_op5(spark, tmp_path):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example.org/p/{i % 11}?q=é {i % 2}", ("x" * 999 if i % 5 == 0 else "ü" * 700) + ("" if i % 2 else str(i % 6))) for i in range(120)]
    rows += [(500, None, None), (501, "not a url [", ""), (None, "http://a.b/", "ü" * 700), (502, "http://a.b/", "z" * 300_000), (502, "http://a.b/", "z" * 300_000), (-4, "http://a.b:8080", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "page": F.lit(2), "file": F.lit(3), "line": F.lit("4")})
    path = save(spark, tmp_path, pages=pages)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = plain(warc.op5_warc(spark, path), names)
    want = sql(warc.OP5_SQL, pages=pages.select("page_id", "url", "html"))
    assert got == want
    base = new_path(spark, "warc")
    captures = warc.write_archives(pages.select("page_id", "url", "html"), base)
    directory = warc.build_index(captures, base, lines=4)
    assert directory.count() > 1
    found = warc.read_records(warc.look_up(pages.where("page_id = 502 OR page_id = 7"), directory, base), base, stretch=1000, payloads=True).collect()
    assert sorted((r["page_id"], len(r["payload"])) for r in found if r["record_type"] == "response" and r["page_id"] == 502) == [(502, 300_000)] * 2
    assert warc.look_up(spark.createDataFrame([(9999, "http://nowhere/")], "page_id long, url string"), directory, base).count() == 0
    none, base = pages.limit(0), new_path(spark, "warc")
    captures = warc.write_archives(none, base)
    assert warc.read_records(warc.look_up(none, warc.build_index(captures, base), base), base).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/a/b?c=d#e") == "com,example)/a/b?c=d"
    assert warc.url_key("http://m.example.com:8080") == "com,example,m):8080/"
    assert warc.url_key(None) == ")" and " " not in warc.url_key("http://a b/c d")


# --- main text


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First paragraph with   some text in it, long enough &eacute;.<br><p>Second &lt;one&gt; here with text,
and a line break.</p><p>Hi.</p><form><input><p>Your mail</p></form><aside>Side</aside><ul><li>item one<li>item two</ul><!-- gone --><svg><text>no</text></svg>
<section id="comments"><p>Great read, thanks a lot for writing all of this down for us.</p></section></article>
<div id="sidebar"><p>Other stories that people like to read these days, in a list.</p></div><footer>&copy; all</footer></body></html>"""


def test_op7(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain words only"), (5, "u", "<p>" + LONG), (6, "u", "<<<>>> &#0; &bogus; <p"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(9)})
    got = plain(html_text.op7_html_text(spark, save(spark, tmp_path, pages=pages)), ["page_id", "url", "text", "n_chars"])
    by = {r[0]: r for r in got}
    assert by[1][2] == "Title & more\nFirst paragraph with some text in it, long enough é.\nSecond <one> here with text, and a line break.\nHi.\nitem one\nitem two"
    assert by[2][2:] == by[3][2:] == ("", 0) and by[4][2] == "plain words only" and by[5][2] == LONG and len(got) == 7
    assert all(r[3] == len(r[2]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_without_article():
    page = '<body><div id="menu"><a>x</a></div><div id="wrap"><h2>Head</h2><p>A first long paragraph of running text that says something.</p><p>Short.</p><p>Another long paragraph of running text that says more.</p></div><div class="footer">f</div></body>'
    assert html_text.main_text(page).split("\n")[0] == "Head" and "Short." in html_text.main_text(page) and "f" not in html_text.main_text(page).split("\n")


def test_several_articles_and_class_words():
    long = "A long paragraph of running text that says something about one thing or another, in some detail."
    page = f'<body><nav><a>m</a></nav><article><h2>One</h2><p>{long}</p><p class="search-results-study">Study.</p></article><div class="ad">Buy</div><article><h2>Two</h2><p class="notice-board">{long}</p><div class="related-posts"><p>{long}</p></div></article><article class="card"><p>Teaser</p></article></body>'
    assert html_text.main_text(page) == f"One\n{long}\nStudy.\nTwo\n{long}"


def test_pages_of_any_depth():
    import time
    import tracemalloc

    for tag, end in (("div", ""), ("article", ""), ("b", ""), ("button", "x"), ("li", "y"), ("p", "z")):
        page = f"<body><article><p>Some text of the article.</p></article>{f'<{tag}>{end}' * 40_000}" + "</section>" * 20_000
        began = time.process_time()
        tracemalloc.start()
        assert "Some text of the article." in html_text.main_text(page)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.process_time() - began < 20 and most < 150e6, tag


#: What stands on a page, and whether it is of the article; the pages are dealt from these.
PIECES = [
    ("<header><h1>Site name</h1></header>", None), ("<nav><ul><li><a>Home</a><li><a>News</a></ul></nav>", None), ('<div class="cookie-notice"><p>We use cookies here.</p></div>', None),
    ('<div class="ad">Buy this thing now, it is cheap.</div>', None), ('<form action="/s"><label>Search</label><input><button>Go</button></form>', None), ("<script>var a = '<p>no</p>';</script>", None),
    ("<aside><h3>Read next</h3><p>Other stories that people like to read these days.</p></aside>", None), ("<footer><p>&copy; 2020 All rights reserved by the owner of this site.</p></footer>", None),
    ('<section id="comments"><h3>Comments</h3><p>Great read, thanks a lot for writing all of this down.</p></section>', None), ("<style>p { margin: 0 }</style>", None),
    ("<h1>Title &amp; sub</h1>", "Title & sub"), ("<p>First paragraph of the\n article, with <b>bold</b> and <a href='x'>linked</a> words in it.</p>", "First paragraph of the article, with bold and linked words in it."),
    ("<p>Short.</p>", "Short."), ("<ul><li>one item<li>another item</ul>", "one item\nanother item"), ("<blockquote>Quoted text of some length stands here, as said.</blockquote>", "Quoted text of some length stands here, as said."),
    ("<p>Last paragraph that ends the article with a few more words &eacute;.", "Last paragraph that ends the article with a few more words é."), ("<pre>code  line\n two</pre>", "code line two"),
]


def test_precision_and_recall_on_labelled_pages():
    rng = np.random.default_rng(9)
    right, got_all, want_all = 0, 0, 0
    noise, text = [p for p in PIECES if p[1] is None], [p for p in PIECES if p[1] is not None]
    for k in range(120):
        body = [text[i] for i in sorted(rng.choice(len(text), rng.integers(3, len(text)), replace=False))] * int(rng.integers(1, 4))
        inside = [p[0] for p in body]
        for i in rng.choice(len(noise), 2, replace=False):
            if "header" not in noise[i][0]:
                inside.insert(int(rng.integers(0, len(inside) + 1)), noise[i][0])
        wrap = [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>")][k % 3]
        outside = [noise[i][0] for i in rng.permutation(len(noise))]
        page = "<html><body>" + "".join(outside[:5]) + wrap[0] + "".join(inside) + wrap[1] + "".join(outside[5:]) + "</body></html>"
        want, got = Counter("\n".join(p[1] for p in body).split("\n")), Counter(html_text.main_text(page).split("\n"))
        right, got_all, want_all = right + sum((want & got).values()), got_all + sum(got.values()), want_all + sum(want.values())
    assert right >= 0.99 * got_all and right >= 0.99 * want_all, (right, got_all, want_all)


def test_marks_of_other_elements():
    page = '<body class="has-sidebar"><div class="no-sidebar"><article class="post has-comments"><div class="entry-header"><h1>Name</h1></div><p>Some long text of the article that runs on.</p></article></div><aside>s</aside><div class="siteNav"><p>x</p></div></body>'
    assert html_text.main_text(page) == "Name\nSome long text of the article that runs on."


# --- classifiers


def corpus(n=600):
    rng = np.random.default_rng(3)
    base = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "th", "st", "lo")]
    docs, labels = [], []
    for i in range(n):
        words = [base[k] for k in rng.integers(0, len(base), 60)]
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            words[10] = ["zogwuf", "zogwux", "qimpek"][i % 3]
            words[30] = ["z0gwuf", "z.o.g.w.u.f", "zzzogwuf", "q1mpek"][i % 4]
        text = " ".join(w + "###" for w in words) if bad else " ".join(words).capitalize() + "."
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return docs, labels


def test_viterbi_restores_disguised_words():
    counts = Counter(g for w in ["idiot"] * 5 + ["stupid"] * 5 + ["the", "that", "station", "nation"] * 50 for g in toxicity.grams(w))
    model = toxicity.CharModel(dict(counts))
    for token, want in {"1diot": "idiot", "id!ot": "idiot", "$tupid": "stupid", "stuuuupid": "stupid", "st.u.p.id": None, "idiot!!!": "idiot", "the": "the", "2024": None}.items():
        got = toxicity.readings(token, model)
        assert (want in got) if want else True, (token, got)
    assert "idiot" in toxicity.tokens("you i d i o t !") and "idiot" in toxicity.tokens("I.D.I.O.T")
    assert toxicity.tokens(None) == toxicity.tokens("") == set()

    def best(token):  # all paths of the lattice
        paths = [("", 0.0)]
        for step in toxicity.lattice(token):
            paths = [(s + t, w + v) for s, w in paths for t, v in step]
        return max(w + sum(model(g[0], g[1], g[2]) for g in toxicity.grams(s)) for s, w in paths)

    for token in ("1d10t", "$$tup1d", "7h3", "nnna+ion"):
        read = toxicity.decode(token, model)
        assert any(abs(best(token) - (w + sum(model(*g) for g in toxicity.grams(read)))) < 1e-9 for w in {round(v, 9) for v in _weights(token, read)})


def test_doubled_and_split_words_are_decoded():
    counts = Counter()
    for word in ["idiot", "loser", "clown", "scum", "stupid", "well", "known", "is", "it", "hello", "the"] * 20:
        counts.update(toxicity.grams(word))
    model = toxicity.CharModel(dict(counts))
    for token, word in {"iddiot": "idiot", "lloser": "loser", "cclown": "clown", "scuum": "scum", "stu-pid": "stupid", "id.iot": "idiot", "the/stu-pid": "stupid"}.items():
        assert word in toxicity.readings(token, model), token
    for text, word in {"you sc um there": "scum", "one i d ! o t here": "idiot", "one i d i o t here": "idiot"}.items():
        assert word in {w for t in toxicity.tokens(text) for w in toxicity.readings(t, model)}, text
    assert toxicity.readings("hello", model) == ["hello"] and set(toxicity.readings("well-known", model)) == {"well", "known"}
    assert toxicity.readings("is it", model) == []


def test_gated_evidence_is_that_of_all_readings():
    words = ["idiot", "scum", "stupid", "ass", "goodbye", "there", "hello", "loser"]
    model = toxicity.CharModel(dict(Counter(g for w in words * 9 for g in toxicity.grams(w))))
    odds = {"=idiot": 3.0, "^idio": 2.0, "=scum": 2.0, "^stup": 3.0, "^stupi": 3.1, "=ass": 2.0, "=as": 1.7, "^good": 1.8, "^lose": 1.6}
    evidence = toxicity.Evidence(odds, model)
    rng = np.random.default_rng(0)
    for k in range(4000):
        token = ""
        for c in words[k % len(words)]:
            signs = [x for x, y in toxicity.STANDS_FOR.items() if c in y]
            ways = [c, c, c * 2, c * 3, *signs, "." + c, "-" + c, " " + c, c + "!"]
            token += ways[rng.integers(len(ways))]
        want = max((odds.get(t, 0.0) for w in toxicity.readings(token, model) for t in toxicity.traits(w)), default=0.0)
        assert evidence.token(token) == want, token
    assert evidence.of("you i d ! o t") == toxicity.Evidence(odds, model, keep=0).of("you i d ! o t") and evidence.of(None) == (0.0, 0.0, 0.0)


def test_trigrams_are_counted():
    texts = ["the cat, über 3rd x", "", "a b1b  naïve\n漢字 end.", "(who) is?"]
    want = Counter(g for t in texts for x in t.split() if (w := x.strip(toxicity.TRIMMED)).isalpha() for g in toxicity.grams(w))
    n, found = len(toxicity.SYMBOLS), toxicity.trigram_counts(texts, toxicity.code_classes())
    name = lambda i: "".join(toxicity.SYMBOLS[x] for x in (i // n // n, i // n % n, i % n))
    assert {name(i): int(found[i]) for i in np.flatnonzero(found[1:]) + 1} == want


def _weights(token, read):
    paths = [("", 0.0)]
    for step in toxicity.lattice(token):
        paths = [(s + t, w + v) for s, w in paths for t, v in step]
    return [w for s, w in paths if s == read]


def test_op2(spark, tmp_path):
    docs, labels = corpus()
    rows = docs + [(10_000 + r[0] if r[0] is not None else None, *r[1:]) for r in DOCS]
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    path = save(spark, tmp_path, documents=frame(spark, rows), labels=marks)
    got = toxicity.op2_toxicity(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert not any(r["predicted"] for r in got if r["doc_id"] is None or r["doc_id"] >= 10_000)
    none = toxicity.fit(frame(spark, []), marks.limit(0))
    assert [r[0] for r in frame(spark).select(none.score(spark, "text")).collect()] == [0.0] * len(DOCS)


def test_op6(spark, tmp_path):
    docs, labels = corpus()
    rows = docs + [(10_000 + r[0] if r[0] is not None else None, *r[1:]) for r in DOCS]
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    path = save(spark, tmp_path, documents=frame(spark, rows), labels=marks)
    got = quality.op6_quality(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["keep"] == bool(truth[r["doc_id"]]) for r in held) >= 0.98 * len(held)
    none = quality.fit(quality.features(frame(spark, [])), marks.limit(0))
    assert [r[0] for r in quality.described(frame(spark)).select(none.score()).collect()] == [1.0] * len(DOCS)
    made = quality.features(frame(spark, rows))
    model = quality.fit(made, marks)
    both = [quality.described(frame(spark, rows)).select(model.score().alias("s")), made.select(model.score_of("x").alias("s"))]
    one, two = (sorted(r["s"] for r in x.collect()) for x in both)
    assert one == pytest.approx(two)


def two_views(n, seed):
    """Features in which either view tells the class roughly and neither depends on the other's noise."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, quality.TEXT_FEATURES + 3))
    x[:, 0] = y + rng.normal(0, 0.35, n)
    x[:, quality.TEXT_FEATURES] = np.where(y == 1, rng.integers(0, 30, n), rng.integers(22, 52, n))
    x[:, quality.TEXT_FEATURES + 1] = rng.integers(0, 3, n)
    return x, y


def test_cotraining_uses_pseudo_labels(spark):
    x, y = two_views(3000, 0)
    made = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(0, 3000, 25)], "doc_id long, quality int")
    right, told = {}, {}
    for rounds in (0, 5):
        model = quality.fit(made, labels, rounds=rounds)
        right[rounds] = ((model.of(x[:, : quality.TEXT_FEATURES], x[:, quality.TEXT_FEATURES :]) >= 0.5) == (y == 1)).mean()
        told[rounds] = len(model.meta.edges[0])  # values of the first feature that the metadata view has met
    assert right[5] > right[0] > 0.8 and told[5] > told[0]


def test_surest_rows_are_those_of_a_full_sort(spark):
    x, y = two_views(800, 1)
    x[700:] = x[0]  # copies count once
    fits = [quality.fit_view(x[:200, : quality.TEXT_FEATURES], y[:200], []), quality.fit_view(x[:200, quality.TEXT_FEATURES :], y[:200], [0, 1])]
    made = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * len(x[0]))], "doc_id long, x array<double>").repartition(5)
    surest = quality.pool_of(made, set(range(200)))
    out = {0: set(range(200)), 1: set(range(200))}
    for _ in range(2):
        got = surest(fits, {1: 30, 0: 20}, 0.8)
        gone = {0: set(), 1: set()}
        for (k, label), q in quality.certain(fits, x).items():
            order = sorted((i for i in range(800) if q[i] >= 0.8 and i not in out[1 - k]), key=lambda i: -q[i])
            rows = got.get((k, label), np.zeros((0, 1)))
            seen = {tuple(r) for r in rows}
            assert len(seen) == len(rows) <= {1: 30, 0: 20}[label]
            if len(rows) == {1: 30, 0: 20}[label]:
                least = min(q[[tuple(r) for r in x.tolist()].index(s)] for s in seen)
                assert all(tuple(x[i]) in seen for i in order if q[i] > least + 1e-12)
            gone[1 - k] |= {i for i in range(800) if tuple(x[i]) in seen and i < 700 or i in out[1 - k]}
        out = {k: out[k] | gone[k] for k in out}


# --- search


def test_op4_against_exhaustive_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=weights / weights.sum())), "en", "a", 1) for i in range(500)]
    rows += [(1000 + i, rows[50][1], "en", "a", 1) for i in range(20)] + [(r[0] + 2000 if r[0] is not None else None, *r[1:]) for r in DOCS]
    docs = frame(spark, rows)
    got = defaultdict(list)
    for r in topk.op4_topk(spark, save(spark, tmp_path, documents=docs), n_terms=8, least_df=2).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    named = [(d, topk.words(t)) for d, t, *_ in rows if d is not None]
    tf, n = [(d, Counter(w), len(w)) for d, w in named], len(named)
    mean, df = sum(len(w) for _, w in named) / n, Counter(x for _, w in named for x in set(w))
    idf = {w: np.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    asked = [(d, w) for d, w in named if d % 50 == 0]
    for d, w in asked:
        count = Counter(w)
        best = sorted(sorted((t for t in count if df[t] > 1), key=lambda t: (-idf[t] * topk.part(count[t], len(w), mean), t))[:8])
        scored = [(-round(sum(idf[t] * topk.part(c[t], size, mean) for t in best if t in c), 6), e) for e, c, size in tf if any(t in c for t in best)]
        want = sorted(scored)[:10]
        if not want:
            assert d not in got
            continue
        assert [x[2] for x in sorted(got[d])] == pytest.approx([-s for s, _ in want], abs=2e-6), d
        assert {x[1] for x in got[d] if x[2] > -want[-1][0] + 1e-5} == {e for s, e in want if -s > -want[-1][0] + 1e-5}
    index = topk.build_index(docs, shard_docs=64)
    assert index.select("shard").distinct().count() > 4
    asks = spark.createDataFrame([("q", "v0 v1 v5 v399"), ("none", "unknown")], "query string, text string")
    few = topk.search(index, asks, 15).collect()
    many = topk.search(topk.build_index(docs), asks, 15, queries_at_once=1).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in few) == sorted((r["rank"], r["doc_id"]) for r in many) and len(few) == 15
    assert topk.search(topk.build_index(frame(spark, [])), asks, 5).count() == 0


def test_registered_op4_asks_by_the_whole_text(spark, tmp_path):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 90), p=weights / weights.sum())), "en", "a", 1) for i in range(500)]
    rows += [(1000 + i, rows[50][1], "en", "a", 1) for i in range(20)] + [(2000, " ".join(f"alone{i}" for i in range(30)), "en", "a", 1), (2050, "once twice", "en", "a", 1)]
    rows += [(r[0] + 3000 if r[0] is not None else None, *r[1:]) for r in DOCS]
    got = defaultdict(list)
    for r in queries.queries()["op4_topk"](spark, save(spark, tmp_path, documents=frame(spark, rows).repartition(3))).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    named = [(d, topk.words(t)) for d, t, *_ in rows if d is not None]
    tf, n = [(d, Counter(w), len(w)) for d, w in named], len(named)
    mean, df = sum(len(w) for _, w in named) / n, Counter(x for _, w in named for x in set(w))
    idf = {w: np.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    asked = {d: set(w) for d, w in named if d % 50 == 0 and w}
    assert set(got) == set(asked) and [x[:2] for x in got[2000]] == [(1, 2000)] and [x[:2] for x in got[2050]] == [(1, 2050)]
    for d, w in asked.items():
        want = sorted((-sum(idf[t] * topk.part(c[t], size, mean) for t in w if t in c), e) for e, c, size in tf if w & set(c))[:10]
        assert [x[2] for x in sorted(got[d])] == pytest.approx([-s for s, _ in want], abs=2e-6), d
        assert {x[1] for x in got[d] if x[2] > -want[-1][0] + 1e-5} == {e for s, e in want if -s > -want[-1][0] + 1e-5}
    assert [x[1] for x in sorted(got[50])] == [50, *range(1000, 1009)]  # equal scores: the smaller doc_id


def test_op4_searches_all_queries_in_one_pass_and_by_kinds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    weights = 1 / np.arange(1, 601)
    texts = [" ".join(f"{'xy'[i % 2]}{w}" for w in rng.choice(600, rng.integers(10, 120), p=weights / weights.sum())) for i in range(1500)]
    texts += [texts[0]] * 30 + ["", "lonely", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [*range(1300), 1530, 1531]  # more long queries than are searched at once, and short ones
    asks = spark.createDataFrame([(str(i), texts[i]) for i in asked] + [("short", "x1 y2"), ("none", "unknown")], "query string, text string")
    index = topk.build_index(docs, shard_docs=700)
    monkeypatch.setattr(topk, "SENT_TERMS", 9000)
    found = topk.search(index, asks, 7)
    assert found._jdf.queryExecution().logical().toString().count("MapInArrow") == 1  # the index is read and dealt out once, however many broadcasts
    got = defaultdict(list)
    for r in found.collect():
        got[r["query"]].append((r["rank"], r["doc_id"], r["score"]))
    own = [Counter(topk.words(t)) for t in texts]
    number = {w: i for i, w in enumerate(sorted(set().union(*own)))}
    size = np.array([c.total() for c in own])
    parts = np.zeros((len(texts), len(number)))
    for d, c in enumerate(own):
        for w, tf in c.items():
            parts[d, number[w]] = topk.part(tf, int(size[d]), size.mean())
    df = (parts > 0).sum(axis=0)
    parts *= np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    for name, words in [(str(i), own[i]) for i in asked] + [("short", ["x1", "y2"])]:
        scores = parts[:, [number[w] for w in words]].sum(axis=1)
        want = sorted((-round(x, 9), d) for d, x in enumerate(scores) if x > 0)[:7]
        assert [x[2] for x in sorted(got.pop(name, []))] == pytest.approx([-x for x, _ in want]), name
    assert not got
    again = topk.search(topk.build_index(docs), asks.where("query IN ('0', '3', 'short')"), 40).collect()
    assert [r["doc_id"] for r in sorted(again) if r["query"] == "0"][:31] == [0, *range(1500, 1530)]  # equal scores: the smaller doc_id


def test_op4_divides_a_shard_by_kinds():
    docs = np.array([0, 2, 4, 1, 3, 5], np.int32)  # one term stands in the even documents, another in the odd ones
    rows = {"number": np.arange(2), "n": np.array([3, 3]), "idf": np.ones(2), "most": np.ones(2, int), "least": np.ones(2, int), "docs": docs, "tfs": np.ones(6, np.int32)}
    shard = topk.Shard(rows, np.arange(6), np.ones(6, np.int32), 1.0)
    shard.prepare()
    assert sorted(shard.widths.tolist()) == [0] * (topk.KINDS - 2) + [64, 64]
    for kind in np.flatnonzero(shard.widths):
        _, score, doc_id = shard.pruned(kind, np.array([0]), np.array([0]), np.array([-np.inf]), 6)
        assert sorted(doc_id) in ([], [0, 2, 4]) and set(score) <= {1.0}


# --- audio


def test_op1(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, 64)
    shifted = np.concatenate([rng.normal(0, 0.2, 20), v[:44]])
    rows = [(50, v), (1, shifted), (2, rng.normal(0, 0.2, 64)), (3, v), (100, [0.1] * 64), (6, [0.1] * 80), (7, [float("nan")] * 64), (8, [0.3])]
    vectors = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in rows] + [(4, None), (5, []), (None, [0.5]), (50, [float(x) for x in v]), (9, [0.2] * 40), (9, [-0.2] * 40), (None, None)], "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    every = audio.op1_chroma(spark, save(spark, tmp_path, embeddings=vectors)).collect()
    assert Counter(r["vec_id"] for r in every) == Counter(r["vec_id"] for r in vectors.collect())  # repeated ids stay single rows
    assert len({tuple(map(str, r)) for r in every if r["vec_id"] == 50}) == 1
    got = {r["vec_id"]: r for r in every}
    assert got[50]["class_id"] == got[3]["class_id"] == 3 and got[4]["class_id"] is None
    assert [(m["class_id"], m["offset"]) for m in got[50]["matches"]] == [(1, 20)] and got[50]["matches"][0]["bit_error"] < 0.05
    assert [m["class_id"] for m in got[100]["matches"]] == [6] and got[1]["matches"] is None
    # held notes met only on stretches
    members, pairs = audio.align(audio.fingerprints(audio.rendered(vectors)), common=0)
    assert {(r["query"], r["found"], r["offset"]) for r in pairs.collect()} >= {(3, 1, 20)}
    assert audio.align(audio.fingerprints(audio.rendered(vectors.limit(0))))[0].count() == 0


def test_alignment_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = [rng.normal(0, 0.2, 64) for _ in range(60)]
    rows = list(base)
    for i in range(60):  # parts of others, moved and with some numbers altered
        part = np.concatenate([rng.normal(0, 0.2, i % 20), base[i][: 64 - i % 20]])
        part[rng.choice(64, i % 6, replace=False)] += 0.1
        rows.append(part)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    prints = {r["id"]: np.array(r["items"], np.int32) for r in audio.played(vectors).collect()}
    assert {r["id"]: r["items"] for r in audio.fingerprints(audio.rendered(vectors)).collect()} == {i: x.tolist() for i, x in prints.items()}
    want = set()
    for q in range(0, 120, 5):
        for f in range(120):
            a, b = prints[q], prints[f]
            if f != q and prints[q].tolist() != prints[f].tolist():  # equal ones are a class
                for offset in range(8 - len(a), len(b) - 7):
                    lo, n = max(0, -offset), min(len(a), len(b) - offset) - max(0, -offset)
                    if n >= 20 and np.bitwise_count(a[lo : lo + n].view(np.uint32) ^ b[lo + offset : lo + offset + n].view(np.uint32)).sum() <= 0.15 * 32 * n:
                        want.add((q, f))
    assert len(want) >= 15
    for common in (0, 5, 1000):
        got = {(r["query"], r["found"]) for r in audio.align(spark.createDataFrame([(i, x.tolist()) for i, x in prints.items()], "id long, items array<int>"), "id % 5 = 0", common=common)[1].collect()}
        assert len(want & got) >= 0.9 * len(want), sorted(want - got)


def test_frequent_integers_vote(spark):
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 2**31, 4).tolist()  # met by all classes, and all that 0 and 1 share
    items = {i: rng.integers(0, 2**31, 12).tolist() for i in range(40)}
    for i in range(40):
        for j in range(4):  # in the same places of 0 and 1, elsewhere in the others
            items[i][3 * j if i < 2 else (3 * j + i * (j + 1)) % 12] = shared[j]
    prints = spark.createDataFrame([(i, [x - 2**31 if x % 2 else x for x in v]) for i, v in items.items()], "id long, items array<int>")

    def votes(common):
        pairs = audio.align(prints, "id = 0", max_error=1.0, common=common)[1].collect()
        return sorted((r["found"], r["offset"], r["votes"]) for r in pairs)

    want = []
    for f in range(1, 40):
        count = Counter(d - q for q, a in enumerate(items[0]) for d, b in enumerate(items[f]) if a == b)
        votes_of, offset = max((n, -abs(o), -o) for o, n in count.items())[0], -max((n, -abs(o), -o) for o, n in count.items())[2]
        if votes_of >= 3 and min(12, 12 - offset) - max(0, -offset) >= 8:
            want.append((f, offset, votes_of))
    assert (1, 0, 4) in want
    assert votes(1000) == votes(3) == votes(0) == want


def test_fingerprint_bits_agree_under_noise():
    rng = np.random.default_rng(2)
    t = np.arange(24_000) / 4000
    tune = sum(np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * g * t) > 0) for f, g in ((220, 0.7), (330, 1.1), (440, 1.9))) / 3
    a, b = audio.fingerprint(tune, 4000), audio.fingerprint(tune + rng.normal(0, 0.02, len(t)), 4000)
    other = audio.fingerprint(rng.normal(0, 0.3, len(t)), 4000)
    error = lambda x, y: np.bitwise_count(x ^ y).sum() / (32 * len(x))
    assert error(a, b) < 0.1 < 0.2 < error(a, other)
