import random
import zlib

import pytest

from jobsieve.llm import toxicity

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.classify(docs, labels).collect()


def test_held_out_accuracy(scored):
    docs, labels, rows = scored
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    tox = [r for r in held if truth[r.doc_id] == 1]
    ok = [r for r in held if truth[r.doc_id] == 0]
    assert sum(r.predicted for r in tox) / len(tox) >= 0.75
    assert sum(r.predicted for r in ok) / len(ok) <= 0.01


def test_every_row_once_with_its_fold(scored):
    docs, _, rows = scored
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark, scored):
    docs, labels, rows = scored
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = toxicity.classify(docs.limit(300), flipped)
    first = toxicity.classify(docs.limit(300), labels)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def test_edge_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda bad: " ".join(rng.choice(["zzqqvillain", "xxwwrotter"]) if bad and rng.random() < 0.2 else word() for _ in range(80))
    rows = [(i, text(i % 4 == 0), 1.0) for i in range(240)] + [(None, None, 2.0), (900, "", 2.0), (900, "", 2.0), (901, text(True) * 300, 0.0), (902, text(True), 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(1, 1), (None, 1), (900, None)], "doc_id bigint, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.predicted for r in got}
    assert by[901] == 1 and by[902] == 1 and by[900] == 0 and by[None] == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}


def test_gains_equal_a_plain_compression_of_every_window(spark):
    rng = random.Random(9)
    p = toxicity.ToxicityParams()
    texts = [" ".join(rng.choice(["aaa", "bbcd", "Vile\tword", "eé", "zq" * 5]) for _ in range(rng.randrange(60))) for _ in range(30)] + ["", " "]
    ordinary, nasty = b" aaa bbcd ccc " * 20, b" vile word zqzq " * 5
    f = toxicity.GainScorer(ordinary, nasty, p).features(texts)
    for row, t in zip(f, texts):
        gains = [len(toxicity._compressor(ordinary, p.level).compress(w)) - len(toxicity._compressor(nasty + ordinary, p.level).compress(w)) for w in toxicity.windows(t, p.window)]
        assert list(row) == [*[sum(g >= n for g in gains) for n in p.gain_levels], len(gains), max([0, *gains])]


def test_long_training_texts_are_read_in_pieces():
    text = " ".join(f"w{i}" for i in range(20_000))
    part = toxicity.bounded_text(text, 16_000)
    assert 15_000 < len(part.encode()) <= 16_000 and set(part.split()) <= set(text.split())
    assert toxicity.bounded_text("short", 16_000) == "short" and toxicity.bounded_text("x" * 50_000, 16_000) == ""


def test_a_class_of_long_texts_only_still_trains(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["zzqqvillain", "xxwwrotter", "abc"] if i % 2 else ["cow", "barn", "hay"]) + str(rng.randrange(9)) for _ in range(3000 if i % 2 else 40)), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels) is not None
