"""Text analysis as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetext.functions.stemmer import stem

#: English stop words that can remain once punctuation is deleted.
ENGLISH_STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn "
    "shan shouldn wasn weren won wouldn".split()
)
#: The short stop list of search servers.
SERVER_STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Contractions that word tokenizers part once punctuation is gone.
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "gimme": "gim me", "lemme": "lem me", "wanna": "wan na"}
PUNCTUATION = r"[!-/:-@\[-`{-~]"


@dataclass(frozen=True)
class AnalyzerConfig:
    """Stages of the token pipeline; tokenizing and the length filter always run."""

    lowercase: bool = True
    remove_punctuation: bool = True
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    stemming: bool = False
    min_length: int = 2
    max_length: int = 50
    contractions: bool = False
    split_on_punctuation: bool = False


PLAIN = AnalyzerConfig(stop_words=())
ENGLISH = AnalyzerConfig(stemming=True, contractions=True)
SERVER = AnalyzerConfig(stop_words=SERVER_STOP_WORDS, split_on_punctuation=True, min_length=1, max_length=255)


def without_punctuation(text: Column) -> Column:
    """ASCII punctuation deleted, so that hyphenated words fuse."""
    return F.regexp_replace(text, PUNCTUATION, "")


def tokens(text: Column, config: AnalyzerConfig = PLAIN) -> Column:
    """Token array of a text: everything but stemming. Null and empty texts give an empty array."""
    text = F.coalesce(text, F.lit(""))
    if config.lowercase:
        text = F.lower(text)
    if config.split_on_punctuation:
        text = F.regexp_replace(text, PUNCTUATION, " ")
    elif config.remove_punctuation:
        text = without_punctuation(text)
    if config.contractions:
        text = F.get(F.transform(F.array(text), expanded), F.lit(0))  # a lambda, so that what is done to the text before is done once
    kept = lambda t: F.length(t).between(config.min_length, config.max_length)
    if config.stop_words:
        return F.filter(F.split(text, r"\s+"), lambda t: kept(t) & ~t.isin(*config.stop_words))
    return F.filter(F.split(text, r"\s+"), kept)


def expanded(text: Column) -> Column:
    """Contractions parted; most texts have none, which is cheaper to see than to replace."""
    parted = text
    for short, full in CONTRACTIONS.items():
        parted = F.regexp_replace(parted, rf"(?<![^\s]){short}(?![^\s])", full)
    return F.when(reduce(or_, [F.contains(text, F.lit(short)) for short in CONTRACTIONS]), parted).otherwise(text)


def analyzed_here(text: str, config: AnalyzerConfig = PLAIN) -> list[str]:
    """tokens() and stemming of an ASCII text without Spark."""
    if not text.isascii():
        raise ValueError("ASCII texts only")
    text = text.lower() if config.lowercase else text
    if config.split_on_punctuation or config.remove_punctuation:
        text = re.sub(PUNCTUATION, " " if config.split_on_punctuation else "", text)
    if config.contractions:
        for short, full in CONTRACTIONS.items():
            text = re.sub(rf"(?<![^\s]){short}(?![^\s])", full, text, flags=re.ASCII)
    stops = set(config.stop_words)
    found = [t for t in re.split(r"\s+", text, flags=re.ASCII) if config.min_length <= len(t) <= config.max_length and t not in stops]
    return [stem(t) for t in found] if config.stemming else found


def joined(found: Column) -> Column:
    """Tokens as text."""
    return F.array_join(found, " ")


def stemmed(words: Column | str) -> Column:
    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(stem, na_action="ignore")

    return stems(words)


def with_stems(exploded: DataFrame, column: str = "term") -> DataFrame:
    """Replaces the terms of an exploded token table by their stems. Each distinct term is stemmed once; only the vocabulary meets Python."""
    vocabulary = exploded.select(column).distinct().withColumn("stem", stemmed(column))
    return exploded.join(vocabulary, column).drop(column).withColumnRenamed("stem", column)


def token_table(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, dl, pos, term): a row per token; positions count what the filters leave."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text), config).alias("toks"))
    rows = rows.select("doc_id", F.size("toks").alias("dl"), F.posexplode("toks").alias("pos", "term"))
    return with_stems(rows) if config.stemming else rows


def word_frequencies(docs: DataFrame, config: AnalyzerConfig = PLAIN, text: str = "text") -> DataFrame:
    """(term, freq) over all texts. Stems are of words already counted: no token is joined."""
    counted = docs.select(F.explode(tokens(F.col(text), config)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    if not config.stemming:
        return counted
    return counted.select(stemmed("term").alias("term"), "freq").groupBy("term").agg(F.sum("freq").alias("freq"))
