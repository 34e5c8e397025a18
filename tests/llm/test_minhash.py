import random
import re

import pytest

from jobsieve.llm import minhash, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (low.get(r) is None or d < low[r]):
            low[r] = d
    return sorted(((d, len(sets[i]), low.get(find(i)), low.get(find(i)) == d) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_matches_brute_force(spark, block):
    rng = random.Random(5)
    texts = sum([family(rng, 40, 150, 6), family(rng, 25, 60, 2), family(rng, 30, 12, 1), family(rng, 12, 400, 14)], [])
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += ["", None, "  \n\t", "one two", "ONE two", "one", "one two three four five", "a b c d e f g", "a b c d e f", "É b c d e", "é b c d e", "x y b c d e"]
    texts += texts[:3] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, k string, c int")
    got = minhash.near_duplicates(docs, minhash.MinHashParams(block=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g h", 5), (2, "a b c d e f g h", 6), (1, "a b c d e f g h", 5), (3, "", 1), (4, None, 2), (5, "other words here are five six", 3),
            (5, "a b c d e f g h", 9), (None, "lonely words without any id at all", 1), (None, "lonely words without any id at all", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    kept = minhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, None]
    assert minhash.keep_one_per_group(docs.where("false")).count() == 0


def test_pruning_bounds_grow_and_keep_likely_pairs():
    need = minhash.needed_matches(minhash.MinHashParams())
    assert need == sorted(need) and all(m < 0.85 * 32 * (i + 1) for i, m in enumerate(need)) and need[-1] > 0.7 * 256


def test_hashes_follow_words():
    a, b = shingles.shingle_sets([b"The quick  brown\nfox jumps over", b"the QUICK brown fox\tjumps over"])
    assert (a == b).all() and len(a) == 2


def test_components_of_random_links(spark):
    from jobsieve.llm.common import connected_components
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(9)] + [(5, 5), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(parent))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
