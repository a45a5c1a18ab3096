"""Toxicity scores of texts restored by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm.shared import drop_stored, lean, stored

#: What a character may stand for in disguised words.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "£": "l", "€": "e", "¢": "c", "§": "s",
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
}
#: Characters the language model tells apart; the others share one symbol.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ")
EDGE, OTHER = "\x02", "\x03"
#: Stands for what lies between two pieces of a token; white space lies between neighbouring tokens of up to SHORT characters.
GAP, SHORT = "\x01", 2
TWICE = re.compile(r"(.)\1+")
SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ ._*~-]{1,2}[^\W_]){2,}(?![^\s.,;:!?])")
TAIL = re.compile(r"[\W_]+$")
HEAD = re.compile(r"^[\W_]*?(?=[@$€£¡!|+]?[^\W_]|$)")
#: Punctuation that only ends a token, and that only begins one.
AFTER, BEFORE = ".,;:!?\"')", ".,;:?\"'("
PARTS = re.compile(r"[^\w@$!|+(<¡£€¢§]+|_+")


def symbol(c: str) -> str:
    return c if c in LETTERS else OTHER


def grams(word: str) -> Iterator[str]:
    """Character trigrams of a word between two edges and one."""
    s = EDGE + EDGE + "".join(map(symbol, word)) + EDGE
    for i in range(len(s) - 2):
        yield s[i : i + 3]


class CharModel:
    """Interpolated character trigram model: log P(c | a b) from trigram counts."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one = counts, Counter(), Counter()
        self.after_two, self.after_one = Counter(), Counter()
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.after_two[g[:2]] += n
            self.after_one[g[1]] += n
        self.total, self.known = sum(self.one.values()), {}

    def __call__(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        found = self.known.get(g)
        if found is None:
            p = (self.one[c] + 0.5) / (self.total + 40)
            p = (self.two[b + c] + 4 * p) / (self.after_one[b] + 4)
            p = (self.three.get(g, 0) + 4 * p) / (self.after_two[a + b] + 4)
            found = self.known[g] = math.log(p)
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of one character the strings it may stand for, with log channel weights; a gap is dropped or ends the word."""
    steps = []
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], len(m[0])
        if c == GAP:
            steps.append([("", -1.0), (EDGE, 0.0)])
        elif c in LETTERS or c.isalpha() and c not in STANDS_FOR:
            steps.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, -1.5)] if n == 2 else [(c, -0.5), (c * 2, -1.0)])
        elif c in STANDS_FOR:
            one = [(x, -0.7) for x in STANDS_FOR[c]]
            steps.append(one + ([(x * 2, -1.0) for x in STANDS_FOR[c]] if n > 1 else []) + ([] if c.isalnum() else [("", -6.0)]))
        else:
            steps.append([("", -1.0)])
    return steps


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token: Viterbi over its lattice, with the last two characters as state; EDGE between words where gaps end one."""
    states = {(EDGE, EDGE): (0.0, None)}  # value: log probability, (string so far) as linked pairs
    for choices in lattice(token):
        then: dict = {}
        for (a, b), (score, path) in states.items():
            for text, weight in choices:
                x, y, s = a, b, score + weight
                for c in text:
                    z = EDGE if c == EDGE else symbol(c)
                    s += model(x, y, z)
                    x, y = (EDGE, EDGE) if c == EDGE else (y, z)
                if (x, y) not in then or s > then[x, y][0]:
                    then[x, y] = (s, (path, text) if text else path)
        states = then
    _, path = max(((s + model(a, b, EDGE), p) for (a, b), (s, p) in states.items()), key=lambda v: v[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def plain(word: str) -> bool:
    """Whether all characters stand for themselves."""
    return word.isalpha() and (word.isascii() or not any(c in STANDS_FOR for c in word))


def squeezed(word: str) -> str:
    """A word without its doubled letters."""
    return TWICE.sub(r"\1", word)


def single(word: str) -> bool:
    """Whether the lattice of a word has one path."""
    return plain(word) and not TWICE.search(word)


def readings(token: str, model: CharModel, worth: Callable[[str], bool] = lambda token: True) -> list[str]:
    """Restored words of a lower-case token. One whose lattice has a single path is its own reading; of a plain word with a doubled letter both spellings count.

    Pieces between separators are read one by one and, with the gaps in the lattice, as what they may be parts of. Of a run of short tokens
    only what spans a gap is new; the tokens have their own readings. Lattices for which `worth` is false aren't decoded.
    """
    run = " " in token
    token = TAIL.sub("", HEAD.sub("", token, count=1), count=1)
    if token.isalpha():
        own = [token] if plain(token) else []
        return own if single(token) or not worth(token) else list(dict.fromkeys([*own, decode(token, model)]))
    parts = [x for x in PARTS.split(token) if x]
    found, whole = [], []
    if len(parts) > 1 and any(c.isalpha() for c in token):
        gapped = GAP.join(parts)
        whole = [w for w in decode(gapped, model).split(EDGE) if w] if worth(gapped) else []
        if max(map(len, parts)) <= SHORT and not run:
            parts.append("".join(parts))
    for x in parts:
        if plain(x):
            found.append(x)
        if any(c.isalpha() for c in x) and not single(x) and worth(x):
            found.append(decode(x, model))
    return [w for w in whole if w not in found] if run else list(dict.fromkeys(found + whole))


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case tokens of a whole text, the runs of neighbouring short ones, and joined the letters it spaces out."""
    low = (text or "").lower()
    listed = low.split()
    found = set(listed)
    begun, last = -1, -2
    for i in [i for i, n in enumerate(map(len, listed)) if n <= SHORT]:
        if i > last + 1:
            if last > begun:
                found.add(" ".join(listed[begun : last + 1]))
            begun = i
        last = i
    if last > begun >= 0:
        found.add(" ".join(listed[begun : last + 1]))
    for m in SPACED.finditer(low):
        found.add(re.sub(r"[ ._*~-]", "", m[0]))
    return found


def traits(word: str) -> list[str]:
    """What evidence is kept by: the word and its first four and five characters."""
    return ["=" + word] + [f"^{word[:n]}" for n in (4, 5) if len(word) > n]


#: Symbols of the language model by number; 0 is the edge of a word.
SYMBOLS = [EDGE, OTHER, *sorted(LETTERS)]
#: What may stand before or after a word; any other character beside letters and white space makes a token none.
TRIMMED = ".,;:!?\"'()"
#: Characters counted at once.
STRETCH = 1 << 20


def trigram_counts(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """Counts of the trigrams of the words in lower-case texts, by number; classes: a symbol's number for each code point, -1 white space, -2 what makes a token none."""
    n = len(SYMBOLS)
    code = classes[np.frombuffer(" ".join(["", "", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)]
    none = np.flatnonzero(code == -2)
    if len(none):  # their whole tokens become white space
        token = np.cumsum(code == -1, dtype=np.int32)
        spoilt = np.zeros(int(token[-1]) + 1, bool)
        spoilt[token[none]] = True
        code = np.where(spoilt[token], 0, code)
    code = np.maximum(code, 0).astype(np.int32)
    a, b, c = code[:-2], code[1:-1], code[2:]
    return np.bincount(np.where(b == 0, 0, a * n * n) + b * n + c, minlength=n**3)


def code_classes() -> np.ndarray:
    """For each code point the number of its symbol, 0 for what is trimmed, -1 for white space, -2 for the rest."""
    found = np.full(0x110000, -2, np.int16)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            found[c] = -1
        elif x.isalpha():
            found[c] = 1
    found[[ord(x) for x in TRIMMED]] = 0
    for i, x in enumerate(SYMBOLS[2:], 2):
        found[ord(x)] = i
    return found


def char_counts(docs: DataFrame) -> dict[str, int]:
    """Trigram counts of the words of all docs. A task sends a row for each trigram it has seen; symbols are few, so the sum is bounded."""

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, n = code_classes(), len(SYMBOLS)
        total, held, size = np.zeros(n**3, np.int64), [], 0
        for rows in batches:
            for text in rows["text"]:
                if text:
                    held.append(text.lower())
                    size += len(held[-1])
                if size >= STRETCH:
                    total += trigram_counts(held, classes)
                    held, size = [], 0
        total += trigram_counts(held, classes)
        seen = np.flatnonzero(total[1:]) + 1  # 0: no word
        yield pd.DataFrame([(SYMBOLS[i // n // n] + SYMBOLS[i // n % n] + SYMBOLS[i % n], int(total[i])) for i in seen.tolist()], columns=["gram", "n"])

    sums = docs.select("text").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in sums.collect()}


class Evidence:
    """Strongest log odds of a token's readings, 0 for none; kept for the tokens met first, which changes no result.

    A token is only read where some path of its lattice begins like a trait or is one; the readings of the others have no evidence.
    """

    def __init__(self, odds: dict[str, float], model: CharModel, keep: int = 200_000):
        self.odds, self.model, self.keep = odds, model, keep
        self.none: set[str] = set()
        self.some: dict[str, float] = {}
        self.short = {t[1:] for t in odds if t[0] == "=" and len(t) <= 4}
        self.heads = {t[1 : n + 1] for t in odds for n in range(1, 5) if len(t) > n}
        self.alike = {squeezed(h) for h in self.heads if len(h) == 4}, {squeezed(x) for x in self.short}

    def reachable(self, token: str) -> bool:
        """Whether a word on some path of the lattice, or the token itself or a part of it, has the first four characters of a trait or is a short one."""
        states = {""}  # beginnings of the present word that are beginnings of traits; None: it has another beginning
        for choices in lattice(token):
            then = set()
            for state in states:
                for text, _ in choices:
                    x = state
                    for c in text:
                        if c == EDGE:
                            if x in self.short:
                                return True
                            x = ""
                        elif x is not None:
                            x += c
                            if x not in self.heads:
                                x = None
                            elif len(x) == 4:
                                return True
                    then.add(x)
            states = then
            if states == {None} and GAP not in token:
                return False
        return not self.short.isdisjoint(states)

    def token(self, token: str) -> float:
        word = token.rstrip(AFTER).lstrip(BEFORE)
        if plain(word):  # all its readings are alike but for doubled letters
            twice = TWICE.search(word)
            alike = squeezed(word) if twice else word
            if alike not in self.alike[1] and alike[:4] not in self.alike[0] and alike[:3] not in self.alike[0] and alike[:2] not in self.alike[0] and alike[:1] not in self.alike[0]:
                return 0.0
            words = readings(word, self.model) if twice else [word]
        else:
            words = readings(token, self.model, self.reachable)
        return max((self.odds.get(t, 0.0) for w in words for t in traits(w)), default=0.0)

    def of(self, text: str | None) -> tuple[float, float, float]:
        """The three strongest of a text."""
        strong = []
        for token in tokens(text) - self.none:
            found = self.some.get(token)
            if found is None:
                found = self.token(token)
                if len(token) < 64:
                    if found and len(self.some) < self.keep:
                        self.some[token] = found
                    elif not found and len(self.none) < self.keep:
                        self.none.add(token)
            if found:
                strong.append(found)
        strong = sorted(strong, reverse=True)[:3]
        return tuple(strong + [0.0] * (3 - len(strong)))


def log_odds(counts: dict[str, tuple[int, int]], n: tuple[int, int], least: int, floor: float) -> dict[str, float]:
    """Log odds of traits in at least `least` toxic texts, where at least `floor`."""
    found = {}
    for trait, (c, t) in counts.items():
        if t >= least:
            x = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
            if x >= floor:
                found[trait] = x
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept, first, isn't shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Toxicity:
    """A fitted model: score() gives a Column for a text column."""

    def __init__(self, odds: dict[str, float], counts: dict[str, int], weights: list[float] | None):
        self.odds, self.counts, self.weights = odds, counts, weights

    def score(self, spark: SparkSession, text: str) -> Column:
        """0 to 1, higher: toxic likelier; null and empty texts have no evidence and get the score of that."""
        shared = spark.sparkContext.broadcast((self.odds, self.counts))  # bounded: max_traits, and the symbols to the third
        weights = self.weights

        @F.pandas_udf("double")
        @lean
        def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            odds, counts = shared.value
            evidence = Evidence(odds, CharModel(counts))
            for texts in batches:
                if weights is None:
                    yield pd.Series(np.zeros(len(texts)))
                else:
                    z = weights[0] + np.array([evidence.of(t) for t in texts], float).reshape(-1, 3) @ np.array(weights[1:])
                    yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return toxicity(F.col(text))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, least: int = 5, floor: float = 1.5, max_traits: int = 20_000) -> Toxicity:
    """Fits on docs (doc_id, text) with labels (doc_id, toxic 0/1; null labels are left out, of several for one doc_id the largest counts).

    The character model counts all docs. Labelled texts are a bounded sample, `max_rows` by a hash of doc_id; equal texts in it count once.
    Their traits are aggregated by Spark; those of at least `least` toxic texts and log odds of `floor` are the model, at most
    `max_traits`, most frequent first. Weights of a text's three strongest odds are fitted across two folds, each with the odds of the other. Without
    toxic or without clean rows all scores are 0.
    """
    spark = docs.sparkSession
    counts = char_counts(docs)
    shared = spark.sparkContext.broadcast(counts)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows ids
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), F.xxhash64("text").alias("same"))
    rows = rows.groupBy("same").agg(F.max_by("text", "toxic").alias("text"), F.max("toxic").alias("toxic"), F.max("fold").alias("fold"))
    rows = stored(rows.select("text", "toxic", "fold"), "labelled")  # read twice; max_rows texts

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen, totals = CharModel(shared.value), {}, [Counter() for _ in range(4)]

        def sums():
            every = set().union(*totals)
            yield pd.DataFrame([(t, *(total[t] for total in totals)) for t in every], columns=["trait", "c0", "t0", "c1", "t1"])
            for total in totals:
                total.clear()

        for part in batches:
            for text, toxic, fold in zip(part["text"], part["toxic"], part["fold"], strict=True):
                own = tokens(text)
                for token in own.difference(seen):
                    seen[token] = tuple(t for w in readings(token, model) for t in traits(w))
                held = set().union(*map(seen.get, own))
                held.add("")  # counts texts
                totals[2 * fold + toxic].update(held)
                if len(seen) > 200_000:
                    seen.clear()
                if sum(map(len, totals)) > 300_000:
                    yield from sums()
        yield from sums()

    sums = rows.select("text", "toxic", "fold").mapInPandas(count, "trait string, c0 long, t0 long, c1 long, t1 long")
    sums = stored(sums.groupBy("trait").agg(*[F.sum(x).alias(x) for x in ("c0", "t0", "c1", "t1")]).where(f"trait = '' OR t0 + t1 >= {least}"), "traits")
    n = sums.where("trait = ''").first()
    if not n or not n["c0"] + n["c1"] or n["t0"] + n["t1"] < least:
        return Toxicity({}, counts, None)
    ratio = F.log((F.col("t0") + F.col("t1") + 0.5) / (n["t0"] + n["t1"] + 1.0)) - F.log((F.col("c0") + F.col("c1") + 0.5) / (n["c0"] + n["c1"] + 1.0))
    kept = sums.where(ratio >= floor).where("trait <> ''").orderBy(F.desc(F.col("t0") + F.col("t1")), "trait").limit(max_traits).collect()
    half = math.ceil(least / 2)
    folds = [log_odds({r["trait"]: (r[f"c{k}"], r[f"t{k}"]) for r in kept}, (n[f"c{k}"], n[f"t{k}"]), half, floor) for k in (0, 1)]
    odds = log_odds({r["trait"]: (r["c0"] + r["c1"], r["t0"] + r["t1"]) for r in kept}, (n["c0"] + n["c1"], n["t0"] + n["t1"]), least, floor)
    both = spark.sparkContext.broadcast(folds)

    @lean
    def strongest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CharModel(shared.value)
        by = [Evidence(x, model) for x in both.value]
        for part in batches:
            e = [by[1 - fold].of(text) for text, fold in zip(part["text"], part["fold"], strict=True)]
            yield pd.DataFrame({"toxic": part["toxic"], **{f"e{i}": [x[i] for x in e] for i in range(3)}})

    x = rows.select("text", "toxic", "fold").mapInPandas(strongest, "toxic int, e0 double, e1 double, e2 double").toPandas()  # max_rows rows of four numbers
    drop_stored(rows)
    drop_stored(sums)
    weights = logistic(x[["e0", "e1", "e2"]].to_numpy(float), x["toxic"].to_numpy(float))
    return Toxicity(odds, counts, weights.tolist())


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Toxicity:
    """Fitted to docs and the labels beside them, without those that are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs, labels.where(~held_out("doc_id")))


def op2_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), fitted(spark, docs, sf_dir).score(spark, "text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
