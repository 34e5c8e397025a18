import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from jobsieve.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def want(text):
    enc = bpe.encoder(PATH, P.PATTERN)
    ids = enc.encode_ordinary(text or "")
    raw = (text or "").encode()
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


TEXTS = [None, "", " ", "a", "hello world's <|endoftext|> end", "é" * 500, " " * 900, "x" * 700 + " yy zz " * 90,
         "\n\n  \t a\r\nb   c " * 60, "It's 3,5 % " * 120, "日本語 テキスト。" * 90, "a\x1cb \x85 c" * 100,
         "word " * 40 + " " * 300 + "tail 12'll" * 50, "word " * 40 + " " * 300 + "tail 12'll" * 50]


@pytest.mark.parametrize("chunk,overlap", [(100, 16), (257, 32), (100_000, 64)])
def test_matches_the_library_and_round_trips(spark, chunk, overlap):
    rows = [(i % 9, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id " * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = bpe.encode_digests(docs, PATH, P.PATTERN, chunk, overlap).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *want(t)) for i, t, _ in rows], key=key)


def test_chunks_of_real_documents_are_stitched(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_digests(docs, PATH, P.PATTERN, 512, 64).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.select("doc_id", "text").collect()}


def test_cut_places_are_real_boundaries():
    text = "some words, 12 numbers and   spaces\n\nlines " * 30
    chunk, overlap = 100, 20
    n = -(-len(text) // chunk)
    cuts = []
    for i in range(n):
        h, t = bpe.edge_boundaries(text[i * chunk:(i + 1) * chunk + overlap], P.PATTERN, overlap, i == 0, (i + 1) * chunk >= len(text))
        cuts.append((i * chunk, [i * chunk + b for b in h], [i * chunk + b for b in t]))
    got = bpe.stitch(cuts, overlap)
    assert len(got) == n - 1 and set(got) <= set(bpe.boundaries(text, P.PATTERN, 0))


def test_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id bigint, text string"), PATH, P.PATTERN).count() == 0
