import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobsieve.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, queries, k):
    found = [(i, d, Counter(TERM.findall(fold(t)))) for i, (d, t) in enumerate(docs)]
    found = [(i, d, c) for i, d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, _, c in found)
    df = Counter(t for _, _, c in found for t in c)
    asked = defaultdict(set)
    for q, t in queries:
        asked[q] |= set(TERM.findall(fold(t)))
    out = set()
    for q, ts in asked.items():
        scored = []
        for _, d, c in found:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out |= {(q, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Ünter", "x1", "straße", "İ"] + [f"w{i}" for i in range(300)]
    docs = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(vocabulary, [40, 30, 5, 5, 5, 2] + [1] * 300, k=rng.randrange(60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (None, "the w1 w2"), (3, "w5 w5 w5 W5"), (n + 3, "w7 " * 20_000)]
    docs += [(n + 10 + i, "w1 w2 w3 the the of") for i in range(70)]  # more equal scores than k
    rng.shuffle(docs)
    queries = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(12)] + [(50, "w1 w2 w3"), (51, None), (52, "?"), (None, "w5"), (53, "nowhere"),
                                                                                  (54, "the of"), (54, "w9")]
    return docs, queries


@pytest.mark.parametrize("seed, postings, blocks", [(1, 1 << 20, 16 << 20), (2, 150, 16 << 20), (3, 400, 1200)])
def test_same_as_brute_force(spark, monkeypatch, seed, postings, blocks):
    monkeypatch.setattr(search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(search, "FIRST_DEPTH", 2)
    docs, queries = corpus(seed, 300)
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "id bigint, text string, score int, term string").repartition(3)
    q = spark.createDataFrame(queries, "id bigint, text string")
    got = [tuple(r) for r in search.best_documents(d, q, 20, blocks).select("query_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, queries, 20)


def test_reading_stops_early():
    """A document that leads every list by far ends the search before the lists' ends."""
    n, n_terms = 20_000, 3
    rng = np.random.default_rng(1)
    impact = rng.integers(1, 1000, n * n_terms)
    impact[: 60 * n_terms] += 900_000
    shard = search.Shard(np.arange(n), np.full(n, n_terms), np.tile(np.arange(n_terms), n), impact, n_terms)
    row, score, read = shard.best(np.arange(n_terms), np.array([5, 3, 2]), 50, 0)
    full = (impact.reshape(n, n_terms) * [5, 3, 2]).sum(1)
    assert sorted(full, reverse=True)[:50] == sorted(score, reverse=True)[:50] and read < 1000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    assert search.best_documents(none, some).count() == 0
    assert search.best_documents(some, none).count() == 0
