"""Cost-balanced packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm.shared import lean

EDGE = re.compile(r" \s|\s ")
#: Fixed value: where byte-level BPE divides a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others by number from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Vocabulary by bytes and added tokens of a tokenizer file that is plain byte-level BPE with ids in the order of its merges; None for any other."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told.get("normalizer")
    added = {t["content"]: t["id"] for t in told["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
    if not plain or len(added) < len(told["added_tokens"]):
        return None
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in added}, added


class Encoder:
    """Ids of a tokenizer file, without special tokens around a text, as little-endian unsigned 32-bit bytes: those its own library gives.

    A vocabulary of plain byte-level BPE is run by the faster of two public libraries, any other by its own. For the former, a single space between
    two other characters always opens a new pre-token, so a text without white space beside a space is the concatenation of its
    space-separated pieces; ids of pieces are kept, up to `keep` of them, and others are computed anew, so the bound changes no result. Where
    `literal` is true, the strings of special tokens are ordinary text, else they have their own ids, as is the library's default.
    """

    def __init__(self, path: str, literal: bool = False, keep: int = 300_000):
        self.keep, self.known, self.added = keep, {}, None
        if found := ranked(path):
            import tiktoken

            run = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=found[0], special_tokens=found[1])
            self.plain = run.encode_ordinary
            self.special = lambda text: run.encode(text, allowed_special="all")
            if found[1] and not literal:
                self.added = re.compile("|".join(map(re.escape, found[1])))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = literal
            self.special = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self.added = re.compile("")  # every text

    def piece(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is None:
            found = array("I", self.plain(text)).tobytes()
            if len(self.known) < self.keep and len(text) < 64:
                self.known[text] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return array("I", self.special(text)).tobytes()
        if not text or text[0] == " " or text[-1] == " " or EDGE.search(text):
            return array("I", self.plain(text)).tobytes()
        first, *rest = text.split(" ")
        return self.piece(first) + b"".join([self.piece(" " + x) for x in rest])


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None, literal: bool) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if (path, literal) not in ENCODERS:
        ENCODERS[path, literal] = Encoder(path, literal)
    return ENCODERS[path, literal]


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a batch of documents, given their token counts.

    As many sequences of `capacity` as the tokens fill are opened, and for the rest one of each power of two in it, so that none
    needs padding. Whole sequences are cut off long documents; what is left is taken in descending length, each to the
    sequence of lowest estimated cost (linear * tokens + quadratic * sum of squared piece lengths) that has room for all of it.
    Where none has, the one with most room takes what it can and the remainder goes on.
    """
    total = int(lengths.sum())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    pieces, sequence = [], 0
    left = []
    for k, n in enumerate(lengths.tolist()):
        for at in range(0, n - n % capacity, capacity):
            pieces.append((k, at, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            left.append((n % capacity, k, n - n % capacity))
    room = np.array(sizes[sequence:], np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    left.sort(key=lambda x: (-x[0], x[1]))
    for n, k, at in left:
        while n:
            best = int(np.where(room >= n, cost, np.inf).argmin())
            if room[best] < n:
                best = int(room.argmax())
            part = min(n, int(room[best]))
            pieces.append((k, at, part, sequence + best, int(used[best])))
            room[best] -= part
            used[best] += part
            cost[best] += linear * part + quadratic * part * part
            n, at = n - part, at + part
    return pieces


def pack(docs: DataFrame, capacity: int = 2048, end: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, batch: int = 4_000_000, path: str | None = None, literal: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_tokens.

    Every document is its ids and then `end`; null and empty texts are `end` alone. Each id lies in exactly one piece,
    sequences are gapless from offset 0 and hold `capacity` tokens or a power of two. Packing is done where the rows are read, in batches of
    about `batch` tokens, without a shuffle: memory is bounded by a batch and one document, and a task that runs again on the same
    input writes the same rows. sequence_id is the number of the partition times 2^33 plus a count: the same table in another file layout
    is packed otherwise, with the same ids and as little padding. Repeated rows are packed each; other columns are ignored. capacity must be a
    power of two. path: a tokenizer file, the public 50k byte-level BPE if not given; literal: special tokens' strings are ordinary text.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, literal).ids
        last = array("I", [end]).tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        names, ids, held = [], [], 0

        def flush():
            nonlocal base
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = assign(lengths, capacity, linear, quadratic)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            size = np.bincount(sequence, weights=length).astype(np.int64)
            for a in range(0, len(pieces), 4096):
                s = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k] for k in doc[s].tolist()], pa.int64()),
                        pa.array(start[s]),
                        pa.array(length[s]),
                        pa.array([ids[k][4 * x : 4 * (x + n)] for k, x, n in zip(doc[s].tolist(), start[s].tolist(), length[s].tolist(), strict=True)], pa.binary()),
                        pa.array(lengths[doc[s]]),
                        pa.array(base + sequence[s]),
                        pa.array(offset[s]),
                        pa.array(size[sequence[s]]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
                )
            base += len(size)
            names.clear()
            ids.clear()

        for rows in batches:
            for name, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                names.append(name)
                ids.append((encode(text.as_py() or "") if text.is_valid else b"") + last)
                held += len(ids[-1]) // 4
                if held >= batch:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
