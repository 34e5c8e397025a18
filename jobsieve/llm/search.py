"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are maximal runs of letters A-Z, digits and characters outside ASCII, A-Z lower-cased. A document's impact for a term
depends on the two alone, so every term has a list of documents by falling impact. A query reads its lists from the top; a
document met anywhere is completed by direct accesses to all lists of the query, and both kinds of access mark positions as
seen. The best position of a list ends its contiguous seen run; no unseen document can score above the sum of weight times
impact just behind the best positions (the first unseen ones). Reading stops when that sum is strictly below the k-th score (a tie could still win by id).

On Spark: one pass over all texts writes, per document, its length and the frequencies of terms that some query holds; counts
over that table give N, L and document frequencies; then tasks build the impact lists of shards of up to ``SHARD_POSTINGS``
postings and answer every query on each shard. A task keeps the k best per query over its shards, so later shards stop
against an already high k-th score; the k best of all tasks are picked by a window. Queries go to the tasks in blocks of at
most ``block_bytes`` of terms (one block for usual query sets, more for larger ones, each a pass of its own); nothing else
is broadcast, and from the corpus only two totals and the document frequencies of a block's own terms reach the driver.

Defined cases: null and empty texts have no terms, are not counted in N and never rank; queries without terms and queries
that match nothing give no rows; query rows with the same id are one query with the terms of all; a null query id is an id of its
own; every document row is ranked, repeated ids too, ties by document id (null first). Only id and text columns are
read, so other columns cannot clash. Impacts are 64-bit integers, exact."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.common import binary_rows, bounded_slices, materialise, small_arrow_batches

#: postings a shard holds at most, or one batch of documents (a few hundred bytes of memory each at the peak)
SHARD_POSTINGS = 1 << 20
#: first depth read from the lists of a query at once; doubled every round
FIRST_DEPTH = 16
IMPACT_UNIT = 1_000_000_000
NULL_ID = -(1 << 63)

# ASCII letters and digits and every byte outside ASCII belong to terms; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ") if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (IMPACT_UNIT * tf) // (1000 * tf + 20 * m)


# ---- the documents' postings ----------------------------------------------------------------------------------

def _postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs): all terms counted in n, the vocabulary's as numbers with frequencies. Documents without a
    term have no row."""
    small_arrow_batches(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text"):
            ids, sizes, held, tfs = [], [], [], []
            for doc, text in zip(batch.column("id"), binary_rows(batch.column("text"))):
                found = Counter(terms(text))
                found.pop(b"", None)
                if found:
                    known = [(vocabulary[t], k) for t, k in found.items() if t in vocabulary]
                    ids.append(doc.as_py())
                    sizes.append(found.total())
                    held.append([t for t, _ in known])
                    tfs.append([k for _, k in known])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])

    rows = documents.select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(count, "id bigint, n bigint, terms array<int>, tfs array<bigint>")


# ---- one shard ------------------------------------------------------------------------------------------------

class Shard:
    """Impact lists of some documents and, per document, where it stands in them (for direct access).

    Postings are numbered list by list: list t is ``starts[t]:starts[t + 1]``, impacts falling."""

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        row = np.repeat(np.arange(len(docs)), lengths)
        order = np.lexsort((-impact, term))
        self.docs, self.doc_of, self.impact = docs, row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        # the same postings by document: term, impact and place in the lists
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.term, self.own_impact = term, impact
        self.first = np.concatenate(([0], np.cumsum(lengths)))

    def direct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings (in document order) of these documents and how many each has."""
        sizes = self.first[rows + 1] - self.first[rows]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return np.arange(offsets[-1]) + np.repeat(self.first[rows] - offsets[:-1], sizes), offsets

    def best(self, query: np.ndarray, weights: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with a score above 0 that may be among the k best, their scores, and the postings read in order.
        ``weights`` has one entry per term of the index, 0 for terms not asked; ``kth`` is a score that k documents
        elsewhere reach already (0: none known)."""
        query = query[self.starts[query] < self.starts[query + 1]]
        lists = [(int(self.starts[t]), int(self.starts[t + 1]), int(weights[t])) for t in query]
        seen = np.zeros(len(self.impact) + 1, bool)  # one more, never seen: ends every contiguous run
        known = np.zeros(len(self.docs), bool)
        best_position = [a for a, _, _ in lists]  # next position after the contiguous seen run
        read_to = [a for a, _, _ in lists]
        rows, scores, n_read, depth = [], [], 0, FIRST_DEPTH
        top = np.zeros(0, np.int64)
        while True:
            fresh = []
            for i, (_, b, _) in enumerate(lists):
                a = max(read_to[i], best_position[i])  # positions of the seen run need no second reading
                end = min(a + depth, b)
                if end > a:
                    fresh.append(self.doc_of[a:end])
                    n_read += end - a
                    seen[a:end] = True
                    read_to[i] = end
            if fresh:
                new = np.unique(np.concatenate(fresh))
                new = new[~known[new]]
                if len(new):
                    known[new] = True
                    at, offsets = self.direct(new)
                    w = weights[self.term[at]]
                    seen[self.place[at[w > 0]]] = True
                    total = np.concatenate(([0], np.cumsum(w * self.own_impact[at])))
                    score = total[offsets[1:]] - total[offsets[:-1]]
                    keep = score > 0
                    rows.append(new[keep])
                    scores.append(score[keep])
                    top = np.sort(np.concatenate((top, score[keep])))[-k:]
                    if len(top) == k:
                        kth = max(kth, int(top[0]))
            bound = 0
            for i, (_, b, w) in enumerate(lists):
                p = best_position[i]
                while p < b and seen[p]:  # to the end of the contiguous run, block by block
                    run = seen[p:min(p + 4096, b)]
                    gap = int(np.argmin(run))
                    p += len(run) if run[gap] else gap
                best_position[i] = p
                if p < b:
                    bound += w * int(self.impact[p])
            if bound < kth or not fresh:
                break
            depth *= 2
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_read
        row, score = np.concatenate(rows), np.concatenate(scores)
        may = score >= kth
        return row[may], score[may], n_read


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rank_shards(postings: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, id, score, read): the k best of every task."""
    n_vocabulary = len(weights)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [np.zeros(0, np.int64) for _ in queries]
        scores = [np.zeros(0, np.int64) for _ in queries]
        reads = 0
        for held in _shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = pc.list_value_length(table["terms"]).to_numpy()
            docs = table["id"].fill_null(NULL_ID).to_numpy()
            n = np.repeat(table["n"].to_numpy(), lengths)
            term = pc.list_flatten(table["terms"]).to_numpy().astype(np.int64)
            tf = pc.list_flatten(table["tfs"]).to_numpy()
            shard = Shard(docs, lengths, term, impacts(tf, n, n_docs, n_terms), n_vocabulary)
            own = np.zeros(n_vocabulary, np.int64)
            for q, query in enumerate(queries):
                own[query] = weights[query]
                kth = int(scores[q].min()) if len(scores[q]) == k else 0
                row, score, n_read = shard.best(query, own, k, kth)
                own[query] = 0
                reads += n_read
                if len(row):
                    i, s = np.concatenate((ids[q], shard.docs[row])), np.concatenate((scores[q], score))
                    top = np.lexsort((i, -s))[:k]
                    ids[q], scores[q] = i[top], s[top]
        for a in range(0, len(queries), 256):
            part = range(a, min(a + 256, len(queries)))
            where = np.concatenate([np.full(len(ids[q]), q, np.int32) for q in part])
            found = np.concatenate([ids[q] for q in part])
            yield pa.RecordBatch.from_arrays([
                pa.array(where), pa.array(found, mask=found == NULL_ID), pa.array(np.concatenate([scores[q] for q in part])),
                pa.array(np.full(len(where), reads, np.int64))], names=["query", "id", "score", "read"])

    return postings.mapInArrow(rank, "query int, id bigint, score bigint, read bigint")


# ---- search ---------------------------------------------------------------------------------------------------

def _query_terms(queries: DataFrame) -> DataFrame:
    """(id, term) distinct, by the same splitting as the documents'."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text"):
            ids, found = [], []
            for q, text in zip(batch.column("id").to_pylist(), binary_rows(batch.column("text"))):
                own = set(terms(text)) - {b""}
                ids += [q] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "term"])

    return queries.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(split, "id bigint, term binary").distinct()


def best_documents(documents: DataFrame, queries: DataFrame, k: int = 50, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of ``documents`` (id, text) for each of ``queries`` (id, text)."""
    spark = documents.sparkSession
    asked = materialise(_query_terms(queries), "query-terms")
    size = asked.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        mine = asked.where(block == b).collect() if n_blocks > 1 else asked.collect()  # about block_bytes of query terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in mine}))}
        by_query: dict[int | None, list[int]] = {}
        for r in mine:
            by_query.setdefault(r.id, []).append(vocabulary[bytes(r.term)])
        postings = materialise(_postings(documents, vocabulary), "postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        names = list(by_query)
        found = _rank_shards(postings, [np.array(sorted(t for t in by_query[q] if weights[t] > 0), np.int64) for q in names],
                             weights, n_docs, n_terms or 1, k)
        named = spark.createDataFrame([(i, q) for i, q in enumerate(names)], "query int, query_id bigint")
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id")))).where(F.col("rank") <= k)
        best = best.join(named, "query").select("query_id", "rank", F.col("id").alias("doc_id"), "score")
        out = best if out is None else out.unionByName(best)
    return out
