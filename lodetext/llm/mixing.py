"""Mixing of overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm.shared import stored

GAP = r"[\x20\x09-\x0D]+"
SEED = 17
#: Hex digits of the seeded order that make a bucket: 16^3 of them.
DIGITS = 3
#: Patterns, and sources, up to which what is planned for each is broadcast; more are joined by shuffle.
BROADCAST_PATTERNS = 10_000


def n_words(text: str):
    """Words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAP), "")).cast("long")


def row_key(doc_id, text):
    """What the seeded order is drawn from."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, repeats: int) -> dict[str | None, float]:
    """What each source is to give: share * all sizes by weight, at most repeats * its size, the excess by weight again until none is above.

    That is min(cap, level * weight) for one level; sources are filled in ascending cap / weight, by Fraction where equality matters.
    """
    caps = {s: repeats * n for s, n in sizes.items()}
    total = share * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (Fraction(caps[s]) / Fraction(weights[s]), s is None, s or ""))
    weight, done = sum(weights.values()), 0
    level = 0.0
    for s in order:
        level = (total - done) / weight
        if level * weights[s] <= caps[s]:
            break
        done, weight = done + caps[s], weight - weights[s]
    else:
        level = float("inf")
    return {s: float(min(caps[s], level * weights[s])) for s in sizes}


def flow(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int) -> dict[tuple, dict[str | None, int]]:
    """Tokens each membership pattern gives to each of its sources, by min-cost flow.

    Network: origin -> pattern (one arc of the pattern's capacity for each repetition, the r-th at cost r: convex, so first copies
    of any pattern are used before second ones of another) -> its sources -> goal (quota). Successive shortest paths with potentials:
    costs are small integers, so the number of augmentations is bounded by the arcs, not by the tokens. Patterns and sources number
    what the corpus is made of, not its documents.
    """
    names = sorted(patterns, key=lambda p: tuple((s is None, s or "") for s in p))
    sources = sorted(quotas, key=lambda s: (s is None, s or ""))
    node = {("p", p): i + 2 for i, p in enumerate(names)} | {("s", s): i + 2 + len(names) for i, s in enumerate(sources)}
    to, room, cost, arcs = [], [], [], [[] for _ in range(2 + len(node))]

    def arc(a: int, b: int, capacity: int, price: int):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    where = {}
    for p in names:
        for r in range(repeats):
            arc(0, node["p", p], patterns[p], r)
        for s in p:
            where[p, s] = len(to)
            arc(node["p", p], node["s", s], repeats * patterns[p], 0)
    for s in sources:
        arc(node["s", s], 1, quotas[s], 0)
    potential = [0] * len(arcs)
    while True:
        best, via, heap = [None] * len(arcs), [None] * len(arcs), [(0, 0)]
        best[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in arcs[x]:
                if room[e] > 0 and (best[to[e]] is None or d + cost[e] + potential[x] - potential[to[e]] < best[to[e]]):
                    best[to[e]], via[to[e]] = d + cost[e] + potential[x] - potential[to[e]], e
                    heapq.heappush(heap, (best[to[e]], to[e]))
        if best[1] is None:
            break
        most = max(d for d in best if d is not None)
        potential = [p + (most if d is None else d) for p, d in zip(potential, best, strict=True)]
        path, x = [], 1
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        pushed = min(room[e] for e in path)
        for e in path:
            room[e] -= pushed
            room[e ^ 1] += pushed
    return {p: {s: room[where[p, s] ^ 1] for s in p} for p in names}


def mix(docs: DataFrame, members: str = "sources", size: str = "size", key: str = "doc_id", weights=(3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """docs with mix_taken (words the mix takes of the row, repeats counted) and mix_shares, map<source, words> of its pattern's flow, mix_targets.

    members: array of the names of the sources a row belongs to (null counts as a name; an empty or null array is in no source and gives
    nothing). Sources by code point, null last, weigh `weights`, repeating. Rows with one set of sources are one pattern. A pattern that gives f
    words of its n gives every document f // n times whole, and once more the first ones in seeded order until f is met; the last of those is cut.
    Order: md5 of seed and key, then size; equal rows are interchangeable. Reruns agree. key should tell rows apart, as an id and the md5 of a
    text do: rows with one key are in one bucket of the order.

    The pattern's running sum is two-level: sums of 16^digits buckets of the md5 are aggregated and accumulated, and only rows
    of the one bucket where a pattern ends are ordered, so a source with a third of all rows is never in one task.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>"))), lambda a, b: F.when(a.eqNullSafe(b), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).otherwise(1))
    rows = docs.withColumn("mix_pattern", names).withColumn("mix_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = rows.withColumn("mix_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("mix_bucket", F.substring("mix_order", 1, digits))
    sums = {tuple(r[0]): r[1] for r in rows.groupBy("mix_pattern").agg(F.sum("mix_size")).collect()}  # one row a pattern
    sizes: dict[str | None, int] = {}
    for p, n in sums.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, repeats)
    given = flow({p: n for p, n in sums.items() if p}, {s: round(aims[s]) for s in order}, repeats)

    schema = "mix_pattern array<string>, mix_whole long, mix_rest long, mix_shares map<string,long>, mix_targets map<string,double>"
    plan = []
    for p, n in sums.items():
        f = sum(given[p].values()) if p else 0
        named = lambda d, p=p: {"" if s is None else f"={s}": d[s] for s in p}  # noqa: E731  map keys can't be null
        plan.append((list(p), f // n if n else 0, f % n if n else 0, named(given[p]) if p else {}, named(aims)))
    small = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)
    plan = spark.createDataFrame(plan, schema)

    cell = rows.groupBy("mix_pattern", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    running = Window.partitionBy("mix_pattern").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16^digits rows a pattern
    cell = cell.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(running), F.lit(0))).join(small(plan), "mix_pattern")
    cell = cell.withColumn("mix_left", F.col("mix_rest") - F.col("mix_before"))
    edge = cell.where((F.col("mix_left") > 0) & (F.col("mix_left") < F.col("mix_sum"))).select("mix_pattern", F.col("mix_bucket").alias("mix_edge"), F.col("mix_left").alias("mix_edge_left"))
    plan = plan.join(edge, "mix_pattern", "left")
    rows = rows.join(small(plan), "mix_pattern")
    # buckets before the edge are taken whole; without an edge the pattern's rest ends between buckets
    ends = cell.where("mix_left >= mix_sum AND mix_sum > 0").groupBy("mix_pattern").agg(F.max("mix_bucket").alias("mix_last"))
    rows = rows.join(small(ends), "mix_pattern", "left")
    inside = F.coalesce(F.col("mix_bucket") <= F.col("mix_last"), F.lit(False))
    at_edge = F.coalesce(F.col("mix_bucket") == F.col("mix_edge"), F.lit(False))
    calm = rows.where(~at_edge).withColumn("mix_more", F.when(inside, F.col("mix_size")).otherwise(F.lit(0).cast("long")))
    one = Window.partitionBy("mix_pattern").orderBy("mix_order", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(at_edge).withColumn("mix_more", F.col("mix_edge_left") - F.coalesce(F.sum("mix_size").over(one), F.lit(0)))
    cut = cut.withColumn("mix_more", F.greatest(F.lit(0).cast("long"), F.least("mix_size", "mix_more")))
    every = calm.unionByName(cut).withColumn("mix_taken", F.col("mix_whole") * F.col("mix_size") + F.col("mix_more"))
    return every.select(*docs.columns, "mix_taken", "mix_shares", "mix_targets")


def leading_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if k >= n:
            break
        end = m.end()
    return text[:end]


def materialised(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, ...) as mixed: each row as often as it is taken whole, then once more cut to the words that are left. n_chars, if there, follows a cut."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # whole, so that no name can clash
    sized = docs.select(row, F.col("doc_id").alias("key"), F.array("source").alias("sources"), n_words("text").alias("size"))
    sized = sized.withColumn("key", row_key(F.col("key"), F.col("row.text")))
    mixed = mix(sized, key="key", **options).withColumn("size", F.greatest("size", F.lit(1).cast("long")))
    whole = mixed.where("mix_taken >= size").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("mix_taken div size")))).select("row.*")
    rest = mixed.where("mix_taken % size > 0").withColumn("rest", F.expr("CAST(mix_taken % size AS INT)"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([leading_words(t or "", k) for t, k in zip(text, n, strict=True)], dtype=object)

    rest = rest.withColumn("cut", cut("row.text", "rest")).withColumn("row", F.col("row").withField("text", F.col("cut")))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("row", F.col("row").withField("n_chars", F.char_length("cut").cast(docs.schema["n_chars"].dataType)))
    return whole.unionByName(rest.select("row.*"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array("source").alias("sources"), "source", n_words("text").alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    docs = stored(docs, "sizes")  # the texts are read once
    mixed = mix(docs, key="key")
    per_source = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    small = F.broadcast if per_source.count() <= BROADCAST_PATTERNS else (lambda df: df)
    taken = mixed.join(small(per_source), mixed["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    target = F.element_at("mix_targets", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    return taken.select("doc_id", "size", "source_size", target.alias("target"), F.col("mix_taken").alias("taken"))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, CAST([3, 1, 2][CAST(i % 3 AS INT) + 1] AS DOUBLE) AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS k, 1.5 * CAST(sum(n) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(2 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY 2 * n / weight, source NULLS LAST)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM r),
v AS (SELECT arg_min(level, k) AS level FROM l WHERE level * weight <= 2 * n),
t AS (SELECT source, n, CAST(least(2 * n, coalesce(v.level, 'inf'::DOUBLE) * weight) AS DOUBLE) AS target FROM w, v),
f AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
c AS (SELECT d.doc_id, d.size, f.n, f.target, f.quota,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(CASE WHEN n = 0 THEN 0 ELSE (quota // n) * size + greatest(0, least(size, quota % n - before)) END AS BIGINT) AS taken
FROM c
"""
