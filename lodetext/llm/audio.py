"""Chroma audio fingerprints and their alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm.shared import SALTS, lean, stored

FRAME, HOP, CLASSES = 1024, 400, 12
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Sixteen filters by rule: kind, first pitch class, pitch classes, frames.
FILTERS = [(k % 6, (5 * k) % CLASSES, 2 + 2 * (k % 3), 4 + 2 * (k % 3)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes (55 Hz to 1,760 Hz) in Hann-windowed frames, smoothed over five frames, each of norm 1 (0 if silent)."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hertz >= 55) & (hertz <= 1760)
    pitch = np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % CLASSES
    energy = np.zeros((len(frames), CLASSES))
    for c in range(CLASSES):
        energy[:, c] = power[:, use][:, pitch == c].sum(axis=1)
    padded = np.pad(energy, ((2, 2), (0, 0)), mode="edge")
    energy = sum(w * padded[i : i + len(energy)] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0.0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one a frame but for the last few: two Gray-coded bits from each of sixteen filters on the integral image of the chroma.

    Shorter recordings than the widest filter are repeated at their last frame.
    """
    image = chroma(samples, rate)
    if len(image) < WIDEST:
        image = np.pad(image, ((0, WIDEST - len(image)), (0, 0)), mode="edge")
    image = np.hstack([image, image])  # pitch classes go round
    whole = np.pad(image.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    n = len(image) - WIDEST + 1
    at = np.arange(n)

    def area(t0, c0, t1, c1):  # frames t0 to t1, classes c0 to c1, from every frame
        return whole[at + t1, c1] - whole[at + t0, c1] - whole[at + t1, c0] + whole[at + t0, c0]

    packed = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        t2, c2, t3, c3 = w // 2, h // 2, max(1, w // 3), max(1, h // 3)
        total = area(0, c, w, c + h)
        part = [
            lambda: total / 2,
            lambda: area(0, c, w, c + c2),
            lambda: area(0, c, t2, c + h),
            lambda: area(0, c, t2, c + c2) + area(t2, c + c2, w, c + h),
            lambda: area(0, c + c3, w, c + h - c3),
            lambda: area(t3, c, w - t3, c + h),
        ][kind]()
        rest = area(0, (c + h) % CLASSES, w, (c + h) % CLASSES + h) / 2 if kind == 0 else total - part
        level = np.log((1 + part) / (1 + rest))
        packed = (packed << np.uint32(2)) | GRAY[np.searchsorted(STEPS, level)]
    return packed


def items_of(samples: np.ndarray | None, rate: int) -> np.ndarray | None:
    return None if samples is None else fingerprint(samples, rate).view(np.int32)


def fingerprints(recordings: DataFrame, rate: int = 4000) -> DataFrame:
    """Per row of recordings (id long, pcm binary: mono 16-bit little-endian): id and items, array<int>, null where pcm is null or empty."""

    @F.pandas_udf("array<int>")
    @lean
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pcm in batches:
            yield pd.Series([items_of(np.frombuffer(x[: len(x) // 2 * 2], "<i2") / 32768 if x is not None and len(x) > 1 else None, rate) for x in pcm])

    return recordings.select("id", items("pcm").alias("items"))


def tune(vector, rate: int, note: float) -> np.ndarray | None:
    """16-bit samples of a vector: each number plays a note of `note` seconds, its pitch by the number in semitones of 0.02 around 440 Hz within two octaves. None for null or empty vectors; null numbers are silent."""
    if vector is None or not len(vector):
        return None
    v, n = np.array([np.nan if x is None else x for x in vector], float), int(rate * note)
    pitch = 440.0 * 2 ** (np.clip(np.nan_to_num(np.floor(v / 0.02)), -12, 12) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / rate, n))
    return (np.sin(phase) * np.repeat(np.where(np.isnan(v), 0.0, 0.5), n) * 32767).astype("<i2")


def rendered(vectors: DataFrame, rate: int = 4000, note: float = 0.1) -> DataFrame:
    """Recordings (id, pcm) of vectors (vec_id, embedding), by tune(). Null or empty vectors have null pcm."""

    @F.pandas_udf("binary")
    @lean
    def play(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([None if (x := tune(v, rate, note)) is None else x.tobytes() for v in some], dtype=object)

    return vectors.select(F.col("vec_id").cast("long").alias("id"), play("embedding").alias("pcm"))


def played(vectors: DataFrame, rate: int = 4000, note: float = 0.1) -> DataFrame:
    """fingerprints(rendered(vectors)), one recording at a time: no samples of more than one are held or moved."""

    @F.pandas_udf("array<int>")
    @lean
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([items_of(None if (x := tune(v, rate, note)) is None else x / 32768, rate) for v in some])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), items("embedding").alias("items"))


def align(prints: DataFrame, asks: str = "id % 50 = 0", least_votes: int = 3, max_error: float = 0.3, least_overlap: int = 8, common: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Matches of the recordings with condition `asks` among all prints (id, items): (query, found, offset, overlap, votes, bit_error) and membership.

    Equal fingerprints are one class, numbered for the run and named by its smallest id; returned are (members, a row for each print: id, class, class_id,
    n_items, null without items or with none) and (matches between classes: class of the query, names of both, what was found; a class with itself left out). Rows
    may share an id, with the same items or others; a class of which no row has an id has no name, and what aligns with it has a null there.

    Seeds are the integers where a run of equal ones begins. The places of an integer in over `common` classes (silence, a held
    note) are dealt into blocks of about `common` by a hash of their class, and a query's place meets each block in a join key of its own: every
    shared integer votes, whatever its frequency, and no task has to take one sound whole. Seeds vote for offsets; for each pair the offset of most votes, then the smallest, is kept if
    it has least_votes, its overlap is at least least_overlap and the share of differing bits in it is at most max_error. Only rows of classes of
    several look their class up, dealt by SALTS.
    """
    has = F.coalesce(F.size("items") > 0, F.lit(False))
    rows = prints.where(has).withColumn("same", F.md5(F.col("items").cast("string")))
    classes = rows.groupBy("same").agg(F.min("id").alias("class_id"), F.first("items").alias("items"), F.coalesce(F.max(F.expr(asks)), F.lit(False)).alias("asks"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    named = classes.select("same", "n", "class", "class_id", F.size("items").alias("n_items"))
    several = named.where("n > 1").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    copies = rows.select("id", "same", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).join(several, ["same", "salt"])
    columns = ["id", "class", "class_id", "n_items"]
    members = named.where("n = 1").withColumn("id", F.col("class_id")).select(columns).unionAll(copies.select(columns))
    nothing = prints.where(~has).select("id", *[F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("long", "long", "int"), strict=True)])
    members = stored(members.unionAll(nothing), "members")

    starts = "filter(sequence(0, size(items) - 1), i -> i = 0 OR items[i] <> get(items, i - 1))"
    seen = stored(classes.select("class", "asks", "items", F.explode(F.expr(starts)).alias("at")).select("class", "asks", "at", F.expr("items[at]").alias("seed")), "seeds")
    frequent = seen.groupBy("seed").agg(F.count_distinct("class").alias("n")).where(F.col("n") > common).select("seed", F.ceil(F.col("n") / max(1, common)).cast("int").alias("blocks"))
    left = seen.where("asks").join(frequent, "seed", "left").select(F.col("class").alias("a"), "seed", F.col("at").alias("q"), F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")).alias("block"))
    right = seen.join(frequent, "seed", "left").select(F.col("class").alias("b"), "seed", F.col("at").alias("d"), F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    votes = left.join(right, ["seed", "block"]).where("a <> b")
    votes = votes.groupBy("a", "b", F.expr("d - q").alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least_votes)
    best = votes.groupBy("a", "b").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.abs("offset"), -F.col("offset"))).alias("best"))
    one = classes.select(F.col("class").alias("a"), F.col("class_id").alias("query"), F.col("items").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("class_id").alias("found"), F.col("items").alias("y"))
    pairs = best.select("a", "b", "best.*").join(one, "a").join(two, "b")
    pairs = pairs.withColumn("from", F.greatest(F.lit(0), -F.col("offset"))).withColumn("overlap", F.least(F.size("x"), F.size("y") - F.col("offset")) - F.col("from"))
    errors = F.expr("aggregate(sequence(from, from + overlap - 1), 0L, (n, i) -> n + bit_count((x[i] ^ y[i + offset]) & 4294967295L))")
    pairs = pairs.where(F.col("overlap") >= least_overlap).withColumn("bit_error", errors / (32.0 * F.col("overlap"))).where(F.col("bit_error") <= max_error)
    return members, pairs.select(F.col("a").alias("class"), "query", "found", "offset", "overlap", "votes", "bit_error")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per embeddings row, played as a recording: its class of equal fingerprints and, where vec_id is divisible by 50, the classes it aligns with."""
    prints = stored(played(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "chroma")
    members, matches = align(prints)
    by_class = matches.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.col("found").alias("class_id"), "offset", "overlap", "votes", "bit_error"))).alias("matches"))
    asks = F.coalesce(F.col("id") % 50 == 0, F.lit(False))
    asked = members.where(asks).join(by_class, "class", "left").withColumn("matches", F.coalesce("matches", F.array()))
    rows = asked.unionByName(members.where(~asks), allowMissingColumns=True)
    return rows.select(F.col("id").alias("vec_id"), "class_id", "n_items", "matches")
