"""Exact top-k search: inverted index in shards, block-max WAND under BM25, exact merge by global statistics."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.llm.shared import drop_stored, lean, stored

K1, B = 1.2, 0.75
BLOCK = 128
#: Terms of a workload up to which they are broadcast to the index: some tens of MB.
BROADCAST_TERMS = 500_000
#: Terms of a query up to which its lists are walked one document at a time; those of a longer one are bounded and summed by arrays.
WALKED_TERMS = 8
#: Kinds of documents that a shard is divided into, told by at most KIND_TERMS terms that are in more than 1 / KIND_SHARE of it, and rounds of doing so.
KINDS, KIND_TERMS, KIND_SHARE, KIND_ROUNDS = 6, 512, 20, 8
#: Terms in more than 1 / COMMON of a kind's documents, at most DENSE of them, are rows of a matrix there, with a maximum for each block of NEIGHBOURS documents.
COMMON, DENSE, NEIGHBOURS = 48, 1024, 64
#: Products of a matrix in the time of one posting, roughly: more postings than that and a term is multiplied rather than summed.
PRODUCTS = 600
#: Long queries that are searched at once, and scores that their rare terms are summed in at once: what a core's cache holds.
TOGETHER, SUMMED = 512, 1 << 16
#: Share by which sums of single precision may be off, and more.
SLACK = 1e-4
#: Term numbers in the lists that a task holds at once: some tens of MB.
SENT_TERMS = 8_000_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Shards that a task searches one after the other, at most.
LANE_SHARDS = 16


def words(text: str | None) -> list[str]:
    """Lower-case words between white space and ASCII punctuation."""
    text = (text or "").lower()
    for c in PUNCTUATION:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


def inverted(ids: list[int], sizes: list[int], tokens: array, vocabulary: dict[str, int], shard: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard, given its documents' ids and lengths and the term numbers of their words, one document after the other."""
    n, length = len(ids), np.array(sizes, np.int32)
    head = [shard, "", 0, n, np.array(ids, np.int64).tobytes(), length.tobytes(), int(length.sum(dtype=np.int64)), 0]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["shard", "term", "block", "n", "numbers", "tfs", "most", "least"]
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(head, kinds, strict=True)], names=names)
    key = np.frombuffer(tokens, np.int32).astype(np.int64) * n + np.repeat(np.arange(n), length)
    if not len(key):
        return
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tfs = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first]
    term, doc = key // n, (key % n).astype(np.int32)
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    blocks = -(-np.diff(np.append(begin, len(term))) // BLOCK)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(begin, blocks) + BLOCK * number
    end = np.append(start[1:], len(term))
    most, least = np.maximum.reduceat(tfs, start).astype(np.int64), np.minimum.reduceat(length[doc], start).astype(np.int64)
    words, of_block = pa.array(list(vocabulary), pa.string()), term[start]
    for a in range(0, len(start), 8192):
        z = min(a + 8192, len(start))
        offsets = pa.py_buffer((4 * (np.append(start[a:z], end[z - 1]) - start[a])).astype(np.int32).tobytes())
        binary = lambda x, a=a, z=z, offsets=offsets: pa.Array.from_buffers(pa.binary(), z - a, [None, offsets, pa.py_buffer(x[start[a] : end[z - 1]].tobytes())])
        columns = [np.full(z - a, shard), words.take(pa.array(of_block[a:z])), number[a:z].astype(np.int32), (end[a:z] - start[a:z]).astype(np.int32), binary(doc), binary(tfs), most[a:z], least[a:z]]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def build_index(docs: DataFrame, shard_docs: int = 16_384, shard_words: int = 5_000_000) -> DataFrame:
    """Index of every row of docs (doc_id, text), materialised: shard, term, block, n, numbers, tfs, most, least.

    A shard is what one task reads in a row, up to `shard_docs` documents or `shard_words` words: no shuffle, and memory
    bounded by a shard and one document. A row is a block of up to 128 postings of a term: numbers of documents in the shard (int32), term frequencies
    (int32), the largest of them and the smallest document length, which bound BM25 before the average length is known. Term ''
    holds the shard's doc_ids (int64) and lengths (int32), their number n and the sum of the lengths in `most`. Rows without doc_id
    get no number: they count in no statistic and are never found. Null and empty texts count as documents of length 0.
    """
    schema = "shard long, term string, block int, n int, numbers binary, tfs binary, most long, least long"

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24

        def fresh():
            vocabulary: defaultdict[str, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__  # a new term gets the next number
            return [], [], array("i"), vocabulary

        ids, sizes, tokens, vocabulary = fresh()
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                own = words(text.as_py())
                ids.append(doc_id)
                sizes.append(len(own))
                tokens.extend(map(vocabulary.__getitem__, own))
                if len(ids) >= shard_docs or len(tokens) >= shard_words:
                    yield from inverted(ids, sizes, tokens, vocabulary, shard)
                    ids, sizes, tokens, vocabulary = fresh()
                    shard += 1
        if ids:
            yield from inverted(ids, sizes, tokens, vocabulary, shard)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(index, schema), "index")


class Postings:
    """Postings of a term in a shard, with a bound of the term's part of a score for each block and in all."""

    __slots__ = ("docs", "tfs", "last", "bounds", "bound")

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, most: np.ndarray, least: np.ndarray, mean: float):
        """most and least: of each block of BLOCK postings."""
        self.docs, self.tfs = docs.tolist(), tfs.tolist()
        self.last = [self.docs[min(len(self.docs), (i + 1) * BLOCK) - 1] for i in range(len(most))]
        self.bounds = [part(m, n, mean) * (1 + 1e-9) for m, n in zip(most.tolist(), least.tolist(), strict=True)]
        self.bound = max(self.bounds)


def part(tf: int, size: int, mean: float) -> float:
    """A term's part of BM25 without its inverse document frequency."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / mean if mean else 1.0)))


def block_max_wand(terms: list[tuple[float, Postings]], sizes: list[int], ids: list[int], mean: float, k: int, floor: float = -math.inf) -> list[tuple[float, int]]:
    """The k best (score, doc_id) of a shard, by score and then the smaller doc_id; only documents with a term of the query and a score of `floor` or more."""
    count = len(terms)
    at = [0] * count
    ends = [len(p.docs) for _, p in terms]
    live = list(range(count))
    heap: list[tuple[float, int]] = []
    while live:
        live.sort(key=lambda i: terms[i][1].docs[at[i]])
        total, pivot = 0.0, -1
        for j, i in enumerate(live):
            total += terms[i][0] * terms[i][1].bound
            if total >= floor:
                pivot = j
                break
        if pivot < 0:
            break
        doc = terms[live[pivot]][1].docs[at[live[pivot]]]
        while pivot + 1 < len(live) and terms[live[pivot + 1]][1].docs[at[live[pivot + 1]]] == doc:
            pivot += 1
        bound, border = 0.0, None
        for i in live[: pivot + 1]:
            idf, p = terms[i]
            b = bisect_left(p.last, doc, at[i] // BLOCK)
            if b < len(p.last):
                bound += idf * p.bounds[b]
                if border is None or p.last[b] + 1 < border:
                    border = p.last[b] + 1
        if bound >= floor:
            if terms[live[0]][1].docs[at[live[0]]] == doc:
                score, size = 0.0, sizes[doc]
                for i in sorted(live[: pivot + 1]):  # in the order of the query's terms, whatever the shard
                    score += terms[i][0] * part(terms[i][1].tfs[at[i]], size, mean)
                    at[i] += 1
                entry = (score, -ids[doc])
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    floor = max(floor, heap[0][0])
            else:
                for i in live[:pivot]:
                    if terms[i][1].docs[at[i]] < doc:
                        at[i] = bisect_left(terms[i][1].docs, doc, at[i])
        else:  # no document before the nearest block end or the next list can get in
            after = terms[live[pivot + 1]][1].docs[at[live[pivot + 1]]] if pivot + 1 < len(live) else None
            to = border if after is None else min(border, after)
            for i in live[: pivot + 1]:
                if terms[i][1].docs[at[i]] < to:
                    at[i] = bisect_left(terms[i][1].docs, to, at[i])
        live = [i for i in live if at[i] < ends[i]]
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


class Shard:
    """The postings of a shard with their parts of scores. Long queries are searched by block maxima, over blocks of neighbouring documents, many at once.

    Documents are divided into kinds (languages, mostly) by the common terms they hold, so that blocks are of a kind and most terms are either frequent or absent in it. For a kind
    and a batch of queries, which are alike too, rare terms are summed for all documents. Common terms lie in a matrix, and the sum of their maxima in a block bounds what they
    can add there: only queries and blocks where one may still reach its k-th best score so far are multiplied. Who is within rounding of the k-th best is summed again in the order of
    the terms' numbers, so that equal documents have equal scores in whatever shard they are.
    """

    def __init__(self, rows: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, mean: float):
        """rows: number (ascending), n, idf, most and least of the blocks, docs and tfs of their postings."""
        self.rows, self.ids, self.sizes, self.mean, self.n = rows, ids, sizes, mean, len(sizes)
        counts = rows["n"]
        self.terms, self.block_starts = np.unique(rows["number"], return_index=True)
        self.block_ends = np.append(self.block_starts[1:], len(counts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.append(starts[self.block_starts], starts[-1])
        self.ready: dict[int, tuple[float, Postings]] = {}
        self.long = False

    def prepare(self) -> None:
        """What only long queries need."""
        if self.long:
            return
        rows, docs, held, n_terms = self.rows, self.rows["docs"], np.diff(self.starts), len(self.terms)
        values = part(rows["tfs"].astype(float), self.sizes[docs].astype(float), self.mean)
        values *= np.repeat(rows["idf"], rows["n"])
        kind = self.divide(docs, values, held)
        order = np.lexsort((self.sizes, kind))
        sizes = np.bincount(kind, minlength=KINDS)
        self.widths = -(-sizes // NEIGHBOURS) * NEIGHBOURS  # documents of a kind, and places without one up to a whole block
        self.firsts = np.cumsum(self.widths) - self.widths
        place = np.empty(self.n, np.int32)
        place[order] = np.arange(self.n) + np.repeat(self.firsts - (np.cumsum(sizes) - sizes), sizes)
        self.at_place = np.zeros(self.widths.sum(), np.int64)
        self.at_place[place] = self.ids
        terms, places = np.repeat(np.arange(n_terms, dtype=np.int32), held), place[docs]
        by = np.argsort(places, kind="stable")
        self.doc_terms, self.doc_values = terms[by], values[by]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(self.at_place)))])
        # from here on a term of a kind has the number kind * n_terms + term
        places -= self.firsts.astype(np.int32)[kind][docs]
        terms = kind[docs] * n_terms + terms
        self.kind_held = np.bincount(terms, minlength=KINDS * n_terms)
        self.kind_starts = np.concatenate([[0], np.cumsum(self.kind_held)])
        by = np.argsort(terms, kind="stable")
        del terms
        self.packed = np.empty((len(docs), 2), np.int32)  # place in the kind and part of a score in single precision, to be fetched as one
        self.packed[:, 0] = places[by]
        self.packed[:, 1] = values.astype(np.float32)[by].view(np.int32)
        del by, places, values
        self.column_of = np.full(KINDS * n_terms, DENSE, np.int16)  # DENSE: in no matrix
        self.dense, self.peaks, self.column_held = [], [], []
        for i, (size, width) in enumerate(zip(sizes, self.widths, strict=True)):
            held = self.kind_held[i * n_terms : (i + 1) * n_terms]
            common = np.flatnonzero(held * COMMON > size)
            common = common[np.argsort(-held[common], kind="stable")[:DENSE]]
            self.column_of[i * n_terms + common] = np.arange(len(common))
            dense = np.zeros((len(common), width), np.float32)
            for row, t in enumerate((i * n_terms + common).tolist()):
                at = slice(self.kind_starts[t], self.kind_starts[t + 1])
                dense[row, self.packed[at, 0]] = self.packed[at, 1].view(np.float32)
            self.dense.append(dense)
            self.peaks.append(dense.reshape(len(common), width // NEIGHBOURS, NEIGHBOURS).max(axis=2))
            self.column_held.append(held[common])
        self.asked = np.zeros(n_terms, bool)
        self.long = True

    def divide(self, docs: np.ndarray, values: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The kind of each document: k-means of the directions of its common terms' parts, from slices of the documents by strongest term."""
        common = np.flatnonzero(held * KIND_SHARE > self.n)
        common = common[np.argsort(-held[common], kind="stable")[:KIND_TERMS]]
        self.told_by = np.full(len(held), -1, np.int32)
        self.told_by[common] = np.arange(len(common))
        rows = np.zeros((self.n, len(common)), np.float32)
        for column, t in enumerate(common.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            rows[docs[at], column] = values[at]
        kind = np.zeros(self.n, np.int64)
        self.centres = np.zeros((KINDS, len(common)), np.float32)
        if len(common):
            rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
            kind[np.argsort(rows.argmax(axis=1), kind="stable")] = np.arange(self.n) * KINDS // self.n
            for _ in range(KIND_ROUNDS):
                sums = (kind == np.arange(KINDS)[:, None]).astype(np.float32) @ rows
                self.centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1)), 1e-9)[:, None]
                kind = (rows @ self.centres.T).argmax(axis=1)
        return kind

    def likeness(self, at: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
        """How much count queries are like each kind; at: places of their terms among the shard's, of: whose they are."""
        asks, column = np.zeros((count, self.centres.shape[1]), np.float32), self.told_by[at]
        asks[of[column >= 0], column[column >= 0]] = 1
        return asks @ self.centres.T

    def pruned(self, kind: int, at: np.ndarray, of: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, doc_id) of the k best or more of the documents of a kind for each query, by arrays; only documents with a term of it and a score of its floor or more.

        at: places of the queries' terms among the shard's; of: whose they are, ascending; floors: of the queries, -inf for none.
        """
        count, width, n_terms = len(floors), int(self.widths[kind]), len(self.terms)
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        here = kind * n_terms + at
        held = self.kind_held.take(here)
        some = np.flatnonzero(held)
        here, held, owner = here.take(some), held.take(some), of.take(some)
        column = self.column_of.take(here)
        asked = np.bincount(column, minlength=DENSE + 1)[: len(self.column_held[kind])] * self.column_held[kind]  # postings, if a column is not multiplied
        columns = int(np.argmin(np.arange(len(asked) + 1) * (count * width / PRODUCTS) - np.concatenate([[0], np.cumsum(asked)])))
        common, rare = np.flatnonzero(column < columns), np.flatnonzero(column >= columns)
        asks = np.zeros((count, columns), np.float32)
        asks[owner.take(common), column.take(common)] = 1
        begin, held, owner = self.kind_starts.take(here.take(rare)), held.take(rare), owner.take(rare)
        total, step = np.empty((count, width), np.float32), max(1, SUMMED // max(1, width))
        for a in range(0, count, step):
            some, (x, y) = min(step, count - a), np.searchsorted(owner, [a, a + step])
            h = held[x:y]
            own = np.repeat(begin[x:y] - (np.cumsum(h) - h), h)
            own += np.arange(len(own))
            own = self.packed.view(np.int64).ravel().take(own).view(np.int32)
            key = np.repeat((owner[x:y] - a) * width, h)
            key += own[::2]
            total[a : a + some] = np.bincount(key, weights=own.view(np.float32)[1::2], minlength=some * width).reshape(some, width)
        most = np.maximum.reduceat(total.ravel(), np.arange(0, count * width, NEIGHBOURS)).reshape(count, -1) if width else np.zeros((count, 0), np.float32)
        bound = (most + asks @ self.peaks[kind][:columns]) * (1 + SLACK)
        least = np.where(floors > 0, floors * (1 - SLACK), 0.0)
        alive = (bound >= least[:, None]) & (bound > 0)
        queries, blocks = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(queries):
            return none
        places = (blocks[:, None] * NEIGHBOURS + np.arange(NEIGHBOURS)).ravel()
        if len(places) < width:
            scores = asks[queries] @ self.dense[kind][:columns, places]
            scores += total[queries[:, None], places]
        else:
            scores = asks[queries] @ self.dense[kind][:columns]
            scores += total[queries]
        least, new = least[queries], np.flatnonzero(floors[queries] == -math.inf)
        if len(new) and len(places) > k:
            kth = np.partition(scores[new], len(places) - k, axis=1)[:, -k].astype(float)
            least[new] = np.maximum(least[new], kth * (1 - SLACK))
        near = (scores >= least.astype(np.float32)[:, None]) & (scores > 0)
        hits = np.flatnonzero(near)
        if not len(hits):
            return none
        row, hit = hits // len(places), hits % len(places)
        rows, x = np.unique(row, return_index=True)
        found, (mine, until) = ([], [], []), np.searchsorted(of, [queries[rows], queries[rows] + 1])
        for i, x, y, m, u in zip(rows.tolist(), x.tolist(), [*x[1:].tolist(), len(row)], mine.tolist(), until.tolist(), strict=True):
            d = hit[x:y]
            if y - x > k:
                own = scores[i, d]
                d = d[own >= float(np.partition(own, len(own) - k)[len(own) - k]) * (1 - SLACK)]
            d = places[d] + self.firsts[kind]
            self.asked[at[m:u]] = True
            spans = [slice(p, q) for p, q in zip(self.doc_starts[d].tolist(), self.doc_starts[d + 1].tolist(), strict=True)]
            kept = [self.asked.take(self.doc_terms[s]) for s in spans]
            self.asked[at[m:u]] = False
            found[0].append(np.full(len(d), queries[i]))
            found[1].append(np.array([self.doc_values[s][z].cumsum()[-1] for s, z in zip(spans, kept, strict=True)]))
            found[2].append(self.at_place[d])
        return tuple(np.concatenate(x) for x in found) if found[0] else none

    def walked(self, query: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, doc_id) of a query, given the places of its terms (-1: not here), by block-max WAND; by score and then the smaller doc_id, only documents with a score of `floor` or more."""
        mine = []
        for i in query[query >= 0].tolist():
            if i not in self.ready:
                at, blocks, r = slice(self.starts[i], self.starts[i + 1]), slice(self.block_starts[i], self.block_ends[i]), self.rows
                self.ready[i] = (float(r["idf"][blocks.start]), Postings(r["docs"][at], r["tfs"][at], r["most"][blocks], r["least"][blocks], self.mean))
            mine.append(self.ready[i])
        return block_max_wand(mine, self.sizes.tolist() if mine else [], self.ids.tolist() if mine else [], self.mean, k, floor) if mine else []


def query_terms(queries: DataFrame, index: DataFrame, n_docs: int, mean: float, n_terms: int | None, least_df: int = 1) -> DataFrame:
    """(query, term, idf) of queries (query, text): the n_terms terms that weigh most under BM25 in the whole text itself, all for None.

    Terms in fewer than least_df documents are left out: 2 leaves out what finds nothing but the document it was taken from.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a in range(0, len(rows), 256):
                some = rows.iloc[a : a + 256]
                yield pd.DataFrame([(q, t, n, sum(c.values())) for q, x in zip(some["query"], some["text"], strict=True) for c in [Counter(words(x))] for t, n in c.items()], columns=["query", "term", "tf", "size"])

    found = queries.select("query", "text").mapInPandas(split, "query string, term string, tf long, size long")
    df = index.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= least_df)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ranked = found.join(df, "term").withColumn("idf", idf)
    if n_terms is not None:
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
        best = Window.partitionBy("query").orderBy(F.desc(weight), "term")
        ranked = ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_terms)
    return ranked.select("query", "term", "idf")


def flat(column: pa.BinaryArray, kind) -> np.ndarray:
    """The numbers in all values of a binary column, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if column.buffers()[2] is not None else np.zeros(0, kind)


def merged(best: tuple[np.ndarray, np.ndarray], query: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
    """Puts documents found for queries among their best scores (queries x k, descending, -inf for none) and doc_ids."""
    scores, ids = best
    rows, k = np.unique(query), scores.shape[1]
    query, score, doc_id = np.concatenate([np.repeat(rows, k), query]), np.concatenate([scores[rows].ravel(), score]), np.concatenate([ids[rows].ravel(), doc_id])
    order = np.lexsort((doc_id, -score, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    order, query, rank = order[rank < k], query[rank < k], rank[rank < k]
    scores[query, rank], ids[query, rank] = score[order], doc_id[order]


def searched(sent: list, n_queries: int, n_terms: int, mean: float, k: int):
    """The function that searches shards, given their postings one after the other, for the queries of all broadcasts; it holds one of these at a time."""

    def each() -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
        first = 0
        for i, block in enumerate(sent):
            names, offsets, numbers = block.value
            yield i, first, names, offsets, numbers
            first += len(names)
            if len(sent) > 1:
                block.__dict__.pop("_value", None)  # the next use reads it from the executor's file

    @lean
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((n_queries, k), -math.inf), np.zeros((n_queries, k), np.int64)
        turns: dict[int, np.ndarray] = {}  # the order of the long queries of a block, by kind

        def search(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts.clear()
            if rows.column("number")[0].as_py() >= 0 or len(rows) == 1:
                return
            ids, sizes = (np.frombuffer(rows.column(c)[0].as_py(), kind) for c, kind in (("numbers", np.int64), ("tfs", np.int32)))
            rows = rows.slice(1)
            of = {c: rows.column(c).to_numpy() for c in ("number", "n", "idf", "most", "least")}
            shard = Shard(of | {"docs": flat(rows.column("numbers"), np.int32), "tfs": flat(rows.column("tfs"), np.int32)}, ids, sizes, mean)
            table = np.full(n_terms, -1, np.int32)
            table[shard.terms] = np.arange(len(shard.terms))

            def known(some: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Places of the terms of some queries among the shard's, and whose they are."""
                size = offsets[some + 1] - offsets[some]
                at = table[numbers[np.repeat(offsets[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
                return at[at >= 0], np.repeat(np.arange(len(some)), size)[at >= 0]

            for block, first, _, offsets, numbers in each():
                size = np.diff(offsets)
                for i in np.flatnonzero(size <= WALKED_TERMS).tolist():
                    more = shard.walked(np.sort(table[numbers[offsets[i] : offsets[i + 1]]]), k, float(top[0][first + i, -1]))
                    if more:
                        merged(top, np.full(len(more), first + i), *map(np.array, zip(*more, strict=True)))
                if block not in turns:
                    long = np.flatnonzero(size > WALKED_TERMS)
                    if len(long) > TOGETHER:
                        shard.prepare()
                        parts = [long[a : a + TOGETHER] for a in range(0, len(long), TOGETHER)]
                        long = long[np.lexsort((size[long], np.concatenate([shard.likeness(*known(x, offsets, numbers), len(x)).argmax(axis=1) for x in parts])))]
                    turns[block] = long.astype(np.int32)
                for a in range(0, len(turns[block]), TOGETHER):
                    some = turns[block][a : a + TOGETHER]
                    at, whose = known(some, offsets, numbers)
                    if not len(at):
                        continue
                    shard.prepare()
                    order = np.argsort(-shard.likeness(at, whose, len(some)).sum(axis=0), kind="stable")  # the best first, for a high floor
                    for kind in order[shard.widths[order] > 0].tolist():
                        query, score, doc_id = shard.pruned(kind, at, whose, top[0][first + some, -1], k)
                        merged(top, first + some[query], score, doc_id)

        held: list[pa.RecordBatch] = []
        for rows in batches if k else ():
            shards = rows.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[0].column("shard")[0].as_py() != shards[a]:
                    search(held)
                held.append(rows.slice(a, b - a))
        if held:
            search(held)
        for _, first, names, _, _ in each():
            for a in range(0, len(names), 1024):
                query, rank = np.nonzero(top[0][first + a : first + min(a + 1024, len(names))] > -math.inf)
                if len(query):
                    out = [pa.array(names[a : a + 1024], pa.string()).take(pa.array(query)), pa.array(top[1][first + a + query, rank]), pa.array(top[0][first + a + query, rank])]
                    yield pa.RecordBatch.from_arrays(out, names=["query", "doc_id", "score"])

    return best


def search(index: DataFrame, queries: DataFrame, k: int = 10, n_terms: int | None = None, least_df: int = 1, queries_at_once: int = 262_144, lanes: int | None = None) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of each of queries (query string, text), by BM25 and then the smaller doc_id.

    Scores use the document frequencies, number and average length of all documents, so a shard's k best are final and merging them is
    exact. A task searches the shards of one of `lanes` lanes (two for each core or more, so that none has over LANE_SHARDS, if not given), one after the other, for at most about `queries_at_once` queries,
    of which it holds the k best so far: it gets the postings of their terms by one shuffle and the numbers of the terms of each query by broadcasts of at most about SENT_TERMS, one of which it holds at a time. The
    k-th best score of the shards before is the floor in the next. So lanes, not shards, times k rows of a query are merged. Block maxima skip what
    can't reach the floor: by walking the lists up to WALKED_TERMS terms, by arrays beyond. A query without known terms gives no rows.
    """
    spark = index.sparkSession
    whole = index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("most"), F.lit(0)).alias("total")).first()
    n_docs, mean = whole["n"], (whole["total"] / whole["n"] if whole["n"] else 0.0)
    terms = stored(query_terms(queries, index, n_docs, mean, n_terms, least_df), "terms")
    asked = terms.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("terms")).first()
    if not asked["queries"]:
        return spark.createDataFrame([], "query string, rank int, doc_id long, score double")
    rounds = math.ceil(asked["queries"] / queries_at_once)
    blocks = rounds * math.ceil(asked["terms"] / rounds / SENT_TERMS)
    numbered = stored(terms.groupBy("term").agg(F.first("idf").alias("idf")).withColumn("number", F.monotonically_increasing_id()), "needed")
    counts = sorted(numbered.groupBy(F.shiftright("number", 33).alias("part")).count().collect())  # a row a partition
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    first = F.element_at(F.create_map(*(F.lit(x) for (part, _), n in zip(counts, before[:-1], strict=True) for x in (part, n))), F.shiftright("number", 33))
    numbered = numbered.withColumn("number", first + F.col("number").bitwiseAND((1 << 33) - 1))  # from 0, without gaps
    broadcast = F.broadcast if before[-1] <= BROADCAST_TERMS else (lambda df: df)  # else both sides are shuffled by term
    listed = terms.select("query", "term").join(broadcast(numbered.select("term", "number")), "term").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    lists = stored(listed.groupBy("part", "query").agg(F.sort_array(F.collect_list(F.col("number").cast("int"))).alias("numbers")), "lists")
    drop_stored(terms)
    heads = stored(index.where("term = ''").select("shard").distinct(), "shards")
    lanes = lanes or max(2 * spark.sparkContext.defaultParallelism, math.ceil(heads.count() / LANE_SHARDS))
    order = Window.orderBy("shard")
    lane = stored(heads.withColumn("lane", ((F.row_number().over(order) - 1) % lanes).cast("int")), "lanes")  # a row a shard
    found = []
    for start in range(0, blocks, blocks // rounds):
        parts, sent, n_queries = list(range(start, start + blocks // rounds)), [], 0
        for block in parts:
            mine = lists.where(F.col("part") == block).select("query", "numbers").toArrow().combine_chunks()  # about SENT_TERMS
            if mine.num_rows:
                column = mine.column("numbers").combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                sent.append(spark.sparkContext.broadcast((mine.column("query").to_pylist(), column.offsets.to_numpy().astype(np.int64), column.values.to_numpy())))
                sent[-1].__dict__.pop("_value", None)  # the driver keeps the file only
                n_queries += mine.num_rows
        if not sent:
            continue
        needed = numbered if rounds == 1 else numbered.join(lists.where(F.col("part").isin(parts)).select(F.explode("numbers").cast("long").alias("number")).distinct(), "number", "left_semi")
        postings = index.where("term <> ''").join(broadcast(needed), "term").drop("term")
        sides = index.where("term = ''").drop("term").withColumns({"idf": F.lit(0.0), "number": F.lit(-1).cast("long")}).unionByName(postings)
        sides = sides.join(F.broadcast(lane), "shard").repartitionById(lanes, F.col("lane")).drop("lane").sortWithinPartitions("shard", "number", "block")
        found.append(sides.mapInArrow(searched(sent, n_queries, before[-1], mean, k), "query string, doc_id long, score double"))
    of_lanes = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return of_lanes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str, k: int = 10, n_terms: int | None = None, least_df: int = 1) -> DataFrame:
    """The k best of all documents for each document whose doc_id is divisible by 50, asked by all words of its whole text (or the n_terms terms that weigh most, of those in least_df documents or more). Equal texts are one query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = build_index(docs)
    rows = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("query", F.md5("text"))
    rows = stored(rows, "queries")
    queries = rows.groupBy("query").agg(F.first("text").alias("text"))
    found = search(index, queries, k, n_terms, least_df)
    return rows.select("query_id", "query").distinct().join(found, "query").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
