import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from jobsieve.llm import suffix, suffix_array


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = word(300), word(120)
    rows = [word(rng.randrange(0, 900)) for _ in range(30)]
    for _ in range(25):
        t = word(rng.randrange(300))
        cut = rng.randrange(60)
        rows.append(t + passage[cut:cut + rng.randrange(150, 300)] + word(rng.randrange(300)))
        rows.append(word(rng.randrange(200)) + line + word(rng.randrange(200)))
    rows += ["ab" * 700, "a" * 2500, "x" * 100 + "ab" * 300, "", None, "short", word(400) * 2, "\0" * 450 + "z", "nul\0" * 90]
    rows += rows[:4] + [rows[40]]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [out[3], (None, rows[33])]


@pytest.mark.parametrize("p", [suffix.RepeatParams(), suffix.RepeatParams(hot=3, block=2000), suffix.RepeatParams(width=64, gram=16, hot=2, block=1)])
def test_matches_brute_force(spark, p):
    rows = corpus(random.Random(11))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, digest string").repartition(3)
    assert sorted(map(tuple, suffix.remove_repeats(docs, p).collect()), key=str) == brute(rows, p.width)


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, suffix.remove_repeats(docs).collect()), key=str) == brute(rows, 200)


def test_stage_keeps_rows_and_columns(spark):
    text = "é" * 50 + "".join(chr(97 + i * 7 % 26) for i in range(400))
    rows = [(1, text + "tail one", "a", 999), (2, "head two" + text, "b", 999), (3, None, "c", 0), (4, "fine", "d", 4), (4, "fine", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_chars int")
    got = suffix.without_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "tail one", "a", 8), (2, "head two", "b", 8), *rows[2:]], key=str)
    assert suffix.without_repeats(docs.where("false")).count() == 0


def test_suffix_order_and_shard_repeats():
    rng = random.Random(4)
    for width, letters in ((9, 1), (16, 2), (25, 4), (31, 2), (200, 3)):
        base = bytes(rng.randrange(letters) for _ in range(width + 60))
        segs = list(dict.fromkeys([base[i:i + width + 9] for i in range(0, 50, 7)] + [bytes(rng.randrange(letters) for _ in range(width + rng.randrange(40))) for _ in range(9)]))
        found, order, _ = suffix_array.repeated_windows(segs, width)
        count = Counter(s[i:i + width] for s in segs for i in range(len(s) - width + 1))
        assert [f.tolist() for f in found] == [[count[s[i:i + width]] > 1 for i in range(len(s) - width + 1)] for s in segs]
        text = b"".join(segs)
        assert [text[a:a + width] for a in order] == sorted(text[a:a + width] for a in order)


def test_equal_windows_have_equal_keys():
    rng = random.Random(6)
    passage = bytes(rng.randrange(256) for _ in range(260))
    keys = []
    for pre in (b"", b"abc" * 30, passage[:90]):
        data = pre + passage + b"zz"
        m, start, size, _ = suffix_array.window_runs(data, 200, 48)
        assert size.sum() == len(data) - 199
        per = np.repeat(m, size)
        keys.append(per[len(pre):len(pre) + 61].tolist())
    assert keys[0] == keys[1] == keys[2]


def test_merge_by_binary_search():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 60, size=20).astype("S16")) for _ in range(5)]
    count = Counter(x for r in runs for x in r.tolist())
    assert [h.tolist() for h in suffix_array.merge_runs(runs)] == [[count[x] > 1 for x in r.tolist()] for r in runs]
