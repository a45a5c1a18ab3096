"""Quality scores by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm.shared import lean, stored

UPPER = bytes([*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
DIGITS, SPACE, STOPS = b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-?()"
TEXT_FEATURES = 13


def text_features(text: str | None) -> list[float]:
    """Thirteen numbers of a whole text; zeros without words. Characters beyond Latin-1 count as letters."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * TEXT_FEATURES
    raw = text.encode("latin-1", "replace") if text.isascii() else text.translate({0x3F: 0x2E}).encode("latin-1", "replace").replace(b"?", b"\xe9")
    n, size = len(words), len(raw)
    count = lambda kind: size - len(raw.translate(None, kind))
    letters, upper, digits, stops = count(LETTERS), count(UPPER), count(DIGITS), count(STOPS)
    symbols = size - letters - digits - stops - count(SPACE)
    counts = Counter(words)
    lines = text.split("\n")
    again = len(lines) - len(set(lines))
    return [
        float(np.log1p(n)),
        letters / n,
        upper / max(1, letters),
        digits / size,
        stops / n,
        symbols / n,
        counts.most_common(1)[0][1] / n,
        len(counts) / n,
        len(counts) / n**0.7,
        sum(1 for w in words if len(w) > 20) / n,
        sum(map(eq, words, words[1:])) / n,
        again / len(lines),
        n / len(lines),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Buckets of source and language, and the log of the stated length (-1 for null)."""
    bucket = lambda x, n: float(zlib.crc32(x.encode()) % n) if x is not None else float(n)
    return [bucket(source, 64), bucket(lang, 32), -1.0 if n_chars is None or n_chars != n_chars or n_chars < 0 else float(np.log1p(n_chars))]


@dataclass
class View:
    """A classifier of one view: features in bins, a weight for each bin, a Platt line to the log odds of good quality."""

    edges: list[np.ndarray]
    weights: np.ndarray
    line: tuple[float, float] = (0.0, 1.0)

    def design(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        return np.hstack([np.ones((len(x), 1)), *(np.eye(len(e) + 1)[b] for e, b in zip(self.edges, bins, strict=True))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, at = np.full(len(x), self.weights[0]), 1
        for j, e in enumerate(self.edges):
            z += self.weights[at + np.searchsorted(e, x[:, j], side="left")]
            at += len(e) + 1
        return z

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] + self.line[1] * self.raw(x)


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, whole: list[int], bins: int = 12) -> View:
    """whole: columns with a bin for each value; the others are cut at quantiles."""
    edges = [np.unique(x[:, j])[:-1] + 0.5 if j in whole else np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    view = View(edges, np.zeros(1))
    view.weights = ridge_logistic(view.design(x), y)
    return view


@dataclass
class Quality:
    text: View | None
    meta: View | None
    blend: np.ndarray | None

    def of(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.blend is None:
            return np.ones(len(text))
        z = self.blend[0] + self.blend[1] * self.text.odds(text) + self.blend[2] * self.meta.odds(meta)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_of(self, x: str) -> Column:
        """The same over a column of features()."""
        model = self

        @F.pandas_udf("double")
        @lean
        def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                every = np.array(rows.tolist(), float).reshape(-1, TEXT_FEATURES + 3)
                yield pd.Series(model.of(every[:, :TEXT_FEATURES], every[:, TEXT_FEATURES:]))

        return quality(F.col(x))

    def score(self) -> Column:
        """Column over text, source, lang and n_chars: the probability of good quality."""
        model = self

        @F.pandas_udf("double")
        @lean
        def quality(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for texts, sources, langs, sizes in batches:
                x = np.array([text_features(t) for t in texts], float).reshape(-1, TEXT_FEATURES)
                m = np.array([meta_features(*r) for r in zip(sources, langs, sizes, strict=True)], float).reshape(-1, 3)
                yield pd.Series(model.of(x, m))

        return quality(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("double"))


#: For a view (0 text, 1 metadata) and a label the features of the rows it tells the other view.
Told = dict[tuple[int, int], np.ndarray]


def cotrain(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, surest: Callable[[list[View], dict[int, int], float], Told], rounds: int = 5, grow: int = 200, sure: float = 0.95) -> Quality:
    """Co-training on labelled rows of features; rows where calibrate is true are kept for calibration.

    Each round either view is fitted to the labels and to what the other has told it, and tells the other its up to `grow` surest
    unlabelled rows, of each class in proportion to the labels and only where it is `sure`: surest(fits, most of each label, sure) finds them. Platt lines and the
    blend of the views are fitted to the rows kept.
    """
    known = ~calibrate
    if len(set(y[known])) < 2 or len(set(y[calibrate])) < 2:
        return Quality(None, None, None)
    part = lambda rows, k: rows[:, TEXT_FEATURES:] if k else rows[:, :TEXT_FEATURES]
    learned = [(part(x[known], k), y[known]) for k in (0, 1)]
    share = float(y[known].mean())
    most = {1: max(1, round(grow * share)), 0: max(1, round(grow * (1 - share)))}
    for r in range(rounds + 1):
        fits = [fit_view(*learned[k], [0, 1] if k else []) for k in (0, 1)]
        if r < rounds:
            for (k, label), rows in surest(fits, most, sure).items():
                if len(rows):
                    learned[1 - k] = np.vstack([learned[1 - k][0], part(rows, 1 - k)]), np.append(learned[1 - k][1], np.full(len(rows), label))
    one = lambda z: np.hstack([np.ones((len(z), 1)), z.reshape(len(z), -1)])
    held = [part(x[calibrate], k) for k in (0, 1)]
    for rows, view in zip(held, fits, strict=True):
        a = ridge_logistic(one(view.raw(rows)), y[calibrate], 0.01)
        view.line = (float(a[0]), float(max(0.0, a[1])))
    blend = ridge_logistic(one(np.column_stack([view.odds(rows) for rows, view in zip(held, fits, strict=True)])), y[calibrate], 1.0)
    return Quality(fits[0], fits[1], np.array([blend[0], *np.maximum(0, blend[1:])]))


def certain(fits: list[View], x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """How sure each view is of each label for rows of features."""
    p = [1 / (1 + np.exp(-np.clip(fits[k].raw(x[:, TEXT_FEATURES:] if k else x[:, :TEXT_FEATURES]), -30, 30))) for k in (0, 1)]
    return {(k, label): p[k] if label else 1 - p[k] for k in (0, 1) for label in (1, 0)}


def pool_of(features: DataFrame, labelled: set[int]) -> Callable[[list[View], dict[int, int], float], Told]:
    """surest() over all rows of features (doc_id, x) that have an id and no label.

    A round is one pass over the features: each task keeps its surest rows of either view and label, and of those the surest of all come to the driver,
    some times as many as are wanted, so that copies with the same features count once. No row is told to a view twice.
    """
    spark, told, times = features.sparkSession, [set(labelled), set(labelled)], 4

    def surest(fits: list[View], most: dict[int, int], sure: float) -> Told:
        sent = spark.sparkContext.broadcast((fits, told))  # numbers of bins, and ids of at most the labels and what was told

        @lean
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            views, out = sent.value
            held: dict[tuple[int, int], list[tuple]] = {(k, label): [] for k in (0, 1) for label in (0, 1)}
            for rows in batches:
                ids, x = rows["doc_id"].to_numpy(), np.array(rows["x"].tolist(), float).reshape(-1, TEXT_FEATURES + 3)
                mix = ids * np.int64(-7046029254386353131)
                for (k, label), q in certain(views, x).items():
                    at = np.flatnonzero(q >= sure)
                    at = at[np.lexsort((mix[at], -q[at]))]
                    mine = [(float(q[i]), int(mix[i]), int(ids[i]), x[i].tolist()) for i in at[: times * most[label] + len(out[1 - k])] if int(ids[i]) not in out[1 - k]]
                    held[k, label] = sorted(held[k, label] + mine, key=lambda r: (-r[0], r[1]))[: times * most[label]]
            yield pd.DataFrame([(k, label, *r) for (k, label), found in held.items() for r in found], columns=["view", "label", "q", "mix", "doc_id", "x"])

        found = features.where("doc_id IS NOT NULL").mapInPandas(best, "view int, label int, q double, mix long, doc_id long, x array<double>")
        order = Window.partitionBy("view", "label").orderBy(F.desc("q"), "mix")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= times * max(most.values())).orderBy("view", "label", "place").collect()
        chosen: dict[tuple[int, int], dict[tuple, int]] = {}
        for r in found:
            own = chosen.setdefault((r["view"], r["label"]), {})
            if len(own) < most[r["label"]]:
                own.setdefault(tuple(r["x"]), r["doc_id"])
        for (k, _), own in chosen.items():
            told[1 - k].update(own.values())
        return {kind: np.array(list(own), float).reshape(-1, TEXT_FEATURES + 3) for kind, own in chosen.items()}

    return surest


def described(docs: DataFrame) -> DataFrame:
    """docs' doc_id and what the views read; columns that docs lacks are null."""
    has = set(docs.columns)
    column = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)
    return docs.select("doc_id", column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "double"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row of docs, materialised: sixteen numbers, of the whole text and of the metadata."""

    @F.pandas_udf("array<double>")
    @lean
    def taken(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, sources, langs, sizes in batches:
            yield pd.Series([text_features(t) + meta_features(s, g, n) for t, s, g, n in zip(texts, sources, langs, sizes, strict=True)])

    return stored(described(docs).select(F.col("doc_id").cast("long").alias("doc_id"), taken("text", "source", "lang", "n_chars").alias("x")), "features")


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = 12_000, rounds: int = 5) -> Quality:
    """Fits to rows of features(): labels (doc_id, quality 0/1, others left out) are a bounded sample, `max_rows` by a hash of doc_id; the unlabelled rows are all the others.

    Several rows of one doc_id count once, with the smallest features; several labels of one doc_id with the smallest. Rows without doc_id are only scored.
    Without both classes every document scores 1.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    taken = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))  # max_rows ids
    sample = taken.toPandas().sort_values("doc_id")  # at most max_rows rows of sixteen numbers
    if sample.empty:
        return Quality(None, None, None)
    calibrate = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 4 == 0 for i in sample["doc_id"]])
    return cotrain(np.array(sample["x"].tolist(), float), sample["quality"].to_numpy(), calibrate, pool_of(rows, set(sample["doc_id"].tolist())), rounds)


def held_out(doc_id: str) -> Column:
    """A third of the rows, for measuring; no label of theirs is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, rows: DataFrame, sf_dir: str) -> Quality:
    """Fitted to rows of features() and the labels beside them, without those that are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(rows, labels.where(~held_out("doc_id")))


def op6_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, whether it is held out, the probability of good quality, and whether it stays."""
    rows = features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scored = rows.select("doc_id", held_out("doc_id").alias("held_out"), fitted(spark, rows, sf_dir).score_of("x").alias("score"))
    return scored.withColumn("keep", F.col("score") >= threshold)
