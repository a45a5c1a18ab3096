"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodetext.llm.shared import SALTS, components, drop_stored, lean, stored

#: A segment's table entries beyond this take the midpoint route, which is as exact; it is no cap.
BUCKET = 256
#: Longs of the bitmap of a text's shingles, by which pairs are ruled out before they are compared.
MARKS = 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority SimHash over the XXH64 (seed 42) of word shingles as a signed 64-bit integer; 0 without words."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str, words: int = 3):
    @F.pandas_udf(T.LongType())
    @lean
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return simhash(F.col(text))


def near_links(prints: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v, of distinct fingerprints (column fp) that link all those at `bits` (0 to 3) or fewer differing bits.

    Multi-index hashing: of the two 32-bit segments of a pair within `bits`, one differs in at most bits // 2 <= 1 places.
    Each fingerprint is in the table of each segment under its value, probes every value of the Hamming ball around its own,
    and complete distances of what it meets are verified. Where one table entry holds over `bucket` fingerprints,
    all who meet there are linked by midpoints instead: two fingerprints differ in at most 2 bits exactly if
    some value is within one bit of both, so grouping the 65 values around each and tying every group to its smallest member
    yields the same components without pairs (for 3 bits: groups around either of two adjacent values, see below).
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    masks = [0] + ([1 << i for i in range(32)] if bits >= 2 else [])
    ball = F.array(*[F.lit(m).cast("long") for m in masks])
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)
    table = prints.select("fp", F.explode(F.array(high, low)).alias("key"))
    probes = prints.select("fp", F.explode(F.concat(F.transform(ball, lambda m: high.bitwiseXOR(m)), F.transform(ball, lambda m: low.bitwiseXOR(m)))).alias("key"))
    hot = stored(table.groupBy("key").count().where(F.col("count") > bucket).select("key"), "hot")
    met = probes.withColumnRenamed("fp", "u").join(table.join(hot, "key", "left_anti").withColumnRenamed("fp", "v"), "key")
    links = met.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v")
    crowd = probes.join(hot, "key", "left_semi").select("fp").distinct()
    flips = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    near = flips if bits >= 2 else flips[:1]
    around = F.array(*[F.lit(m).cast("long") for m in near])
    if bits in (1, 3):  # an odd distance has no midpoint: one side steps once more, which the distinct pairs of values below show
        step = F.array(*[F.lit(m).cast("long") for m in flips])
        wide = crowd.select("fp", F.explode(F.transform(around, lambda m: F.col("fp").bitwiseXOR(m))).alias("x"))
        wide = wide.select("fp", "x", F.explode(F.transform(step, lambda m: F.col("x").bitwiseXOR(m))).alias("y"))
        spread = wide.select("fp", F.least("x", "y").alias("value"), F.greatest("x", "y").alias("other"))
    else:
        spread = crowd.select("fp", F.explode(F.transform(around, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"), F.lit(0).cast("long").alias("other"))
    first = spread.groupBy("value", "other").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = spread.join(first, ["value", "other"]).select(F.col("fp").alias("u"), "v").where("u != v")
    return links.union(ties)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp (signed 64-bit), root (a fingerprint of its component), component_id.

    component_id is the smallest doc_id reachable over links of at most `bits` differing bits, itself included. Null and empty
    texts have fingerprint zero and link like any other; rows without doc_id take part, their component_id is null only if no
    member has one. Repeated rows are kept, each with the same result. Other columns are ignored. Copies share a fingerprint, and only
    distinct fingerprints are compared, so a group of copies of any size costs one, and its rows get their result in SALTS tasks.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text", words).alias("fp")), "prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    tied = stored(components(near_links(prints.select("fp"), bits, bucket)), "roots")
    whole = tied.join(prints, tied["node"] == prints["fp"]).select("fp", "root", "first")
    lowest = whole.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = whole.join(lowest, "root").select("fp", "root", "least")
    several = prints.join(of_linked, "fp", "left").where("n > 1 OR root IS NOT NULL")  # any other row is its own component
    several = several.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    salted = several.select("*", F.lit(True).alias("known"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, ["fp", "salt"], "left")
    return dealt.select("doc_id", "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



def hashed(text: str | None, words: int) -> tuple[bytes, np.ndarray]:
    """The normalised words of a text and the distinct hashes of its shingles."""
    w = (text or "").encode().lower().split()
    if not w:
        return b"", np.zeros(0, np.uint64)
    shingles = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    return b" ".join(w), np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def sketched(text: str | None, words: int, sketches: int, sample: int) -> dict:
    """key (of the normalised words), size (number of distinct shingles), fp (their SimHash) the SimHashes of `sketches` min-wise samples of them, and marks, the bitmap of all."""
    plain, hashes = hashed(text, words)
    key = hashlib.md5(plain).hexdigest()
    if not len(hashes):
        return {"key": key, "size": 0, "fp": 0, "samples": [0] * sketches, "marks": [0] * MARKS}
    found = []
    for j in range(sketches):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.argpartition(mixed, sample - 1)[:sample] if len(mixed) > sample else np.arange(len(mixed))
        found.append(majority(hashes[least]))
    marked = np.zeros(64 * MARKS, np.uint8)
    marked[hashes % np.uint64(64 * MARKS)] = 1
    return {"key": key, "size": len(hashes), "fp": majority(hashes), "samples": found, "marks": np.packbits(marked, bitorder="little").view(np.int64).tolist()}


def block_pairs(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v), u > v, of all keys that share a bucket (k, value), differ in root and may have the similarity: members has k, value, key, root, and size and marks of the text.

    A bucket is divided by a hash of the key into blocks of about `block` members, and each pair of blocks is a join key of its own: no task
    has to take a large bucket whole. Every bit set in one bitmap only is a shingle of one text only, which bounds what both share from above.
    """
    blocks = members.groupBy("k", "value").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = blocks.where("low <> high").drop("low", "high")
    rest = members.join(blocks, ["k", "value"]).withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    unmarked = F.expr("size - " + " - ".join(f"bit_count(marks[{i}])" for i in range(MARKS))).alias("spare")
    fields = F.struct("key", "root", "size", unmarked, *[F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)])
    one = rest.select("k", "value", F.col("b").alias("i"), F.explode(F.expr("sequence(b, blocks - 1)")).alias("j"), fields.alias("x"))
    two = rest.select("k", "value", F.explode(F.expr("sequence(0, b)")).alias("i"), F.col("b").alias("j"), fields.alias("y"))
    at_most = "least(x.spare, y.spare) + " + " + ".join(f"bit_count(x.m{i} & y.m{i})" for i in range(MARKS))
    both = one.join(two, ["k", "value", "i", "j"]).where("x.root <> y.root AND (i < j OR x.key > y.key)")
    both = both.where(f"{1 + similarity}D * ({at_most}) >= {similarity}D * (x.size + y.size) - 1e-9D")
    return both.select(F.greatest("x.key", "y.key").alias("u"), F.least("x.key", "y.key").alias("v"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2, sketches: int = 10, sample: int = 3, block: int = 256) -> DataFrame:
    """(doc_id, exact, key, root) per row of docs (doc_id, text): root is equal for rows joined by links of Jaccard similarity `similarity`.

    The similarity is of sets of `words`-word shingles (fewer words: the whole; none: equal to each other only). A 64-bit SimHash alone
    parts texts at 0.8 by about ten bits, out of reach of any small ball, so a document has, besides the fingerprint of all its shingles (multi-index
    hashing within `bits`), fingerprints of `sketches` min-wise samples of `sample` shingles: texts of similarity s agree in one with chance
    s^sample, in any of ten at 0.8 with 0.999. Texts that agree in one of these eleven are a bucket, and every pair of a bucket is either compared in
    full or joined already by other links: first all are compared with three heads (the smallest key, the most copied, and the one of most
    company in all its buckets, as the origin of many separate edits has), which joins most; then all pairs that are still apart, in blocks.
    Pairs whose sizes or bitmaps rule the similarity out are not compared. Equal texts are one class before all this. exact is the md5 of the text.
    """

    @F.pandas_udf("struct<key: string, size: long, fp: long, samples: array<long>, marks: array<long>>")
    @lean
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketched(t, words, sketches, sample) for t in texts], columns=["key", "size", "fp", "samples", "marks"])

    @F.pandas_udf("array<long>")
    @lean
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hashed(t, words)[1].view(np.int64) for t in texts])

    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("exact"), sketch("text").alias("s")).select("doc_id", "exact", "s.*"), "sketches")
    classes = stored(rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "exact")).alias("at"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("samples").alias("samples"), F.first("marks").alias("marks")), "classes")
    of_print = classes.groupBy("fp").agg(F.min("key").alias("v"))
    near = near_links(of_print.select("fp"), bits)
    near = near.join(of_print.select(F.col("fp").alias("u"), F.col("v").alias("a")), "u").join(of_print.select(F.col("fp").alias("v"), F.col("v").alias("b")), "v")
    spread = classes.select("key", "n", F.posexplode(F.concat(F.array("fp"), "samples")).alias("k", "value"))
    several = spread.groupBy("k", "value").agg(F.count("*").alias("company")).where("company > 1")
    shared = stored(spread.join(several, ["k", "value"]), "buckets")
    company = shared.groupBy("key").agg(F.sum("company").alias("all_company"))
    ranked = shared.join(company, "key")
    heads = ranked.groupBy("k", "value").agg(F.min("key").alias("least"), F.max_by("key", F.struct("n", "key")).alias("most"), F.max_by("key", F.struct("all_company", "key")).alias("amid"))
    met = shared.join(heads, ["k", "value"]).select("key", F.explode(F.array_distinct(F.array("least", "most", "amid"))).alias("v"))
    pairs = near.select("a", "b").union(met)
    pairs = stored(pairs.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")

    needed = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().join(classes, "key").select("key", F.col("at.doc_id").alias("id"), F.col("at.exact").alias("is"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("exact"), "text")
    texts = texts.join(needed, texts["doc_id"].eqNullSafe(needed["id"]) & (texts["exact"] == needed["is"])).select("key", shingles("text").alias("set"))
    sets = stored(texts.groupBy("key").agg(F.min("set").alias("set")), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar. A text of many pairs, as a head is, meets them in parts of about `block`."""
        busy = pairs.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
        busy = stored(busy, "busy")
        dealt = sets.join(busy, "key", "left").select("key", "set", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("part"))
        both = pairs
        for one, other, part in (("u", "v", "i"), ("v", "u", "j")):
            both = both.join(busy.withColumnRenamed("key", one), one, "left").withColumn(part, F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        for one, part, name in (("u", "i", "a"), ("v", "j", "b")):
            both = both.join(dealt.toDF(one, name, part), [one, part]).drop(part)
        both = both.where(F.least(F.size("a"), F.size("b")) >= similarity * F.greatest(F.size("a"), F.size("b")) - 1e-9).withColumn("c", F.size(F.array_intersect("a", "b")))
        found = stored(both.where((F.col("c") > 0) & (F.col("c") >= similarity * (F.size("a") + F.size("b") - F.col("c")) - 1e-9)).select("u", "v"), "links")
        drop_stored(busy)
        return found

    links = verified(pairs)
    roots = stored(components(links), "roots")
    members_before = stored(shared.join(roots, shared["key"] == roots["node"], "left").select("k", "value", "key", F.coalesce("root", "key").alias("root")), "members")
    mixed = members_before.groupBy("k", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k", "value")
    apart = stored(members_before.join(mixed, ["k", "value"], "left_semi").join(classes.select("key", "size", "marks"), "key"), "apart")
    rest = block_pairs(apart, similarity, block)
    rest = stored(rest.distinct().join(pairs, ["u", "v"], "left_anti"), "rest")
    more = verified(rest)
    if not more.isEmpty():
        roots = stored(components(links.union(more)), "roots")
    for done in (classes, shared, pairs, sets, links, more, members_before, apart, rest):
        drop_stored(done)
    return rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "exact", "key", F.coalesce("root", "key").alias("root"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of every group of near copies: of the smallest doc_id (null last), then md5; of equal rows one. All columns are kept."""
    marks = near_copies(docs, **options).groupBy("root", "doc_id", "exact").agg(F.count("*").alias("n"))
    marks = stored(marks, "marks")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "exact")
    several = marks.groupBy("root").agg(F.min(place).alias("stay"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    salted = several.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    marks = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id", "exact"), F.lit(SALTS))).join(salted, ["root", "salt"], "left")
    marks = marks.withColumn("stays", F.coalesce(place == F.col("stay"), F.lit(True)))
    one, two = "lodetext_id", "lodetext_exact"
    named = lambda condition: marks.where(condition).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(one), F.col("exact").alias(two))
    rows = docs.withColumn(one, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).withColumn(two, F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.join(named("NOT stays"), [one, two], "left_anti")
    several = named("stays AND n > 1")
    if not several.isEmpty():
        rows = rows.join(several, [one, two], "left_anti").unionByName(rows.join(several, [one, two], "left_semi").dropDuplicates([one, two]))
    return rows.select(*docs.columns)
