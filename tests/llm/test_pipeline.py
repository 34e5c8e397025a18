import sys
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_minhash import shingle_set
from test_suffix import brute as repeats

DIR = "/root/testdata/sf0.01"


def near_groups_at_80(rows):
    """(doc_id, set size, smallest linked id, kept) by comparing all pairs at a similarity of 0.8, the pipeline's."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows)]


def test_every_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        outs.append(docs := spark.read.parquet(str(tmp_path / name)))
        if name != "packing":
            assert docs.columns == columns
    rows = [{r.doc_id: r.text for r in o.collect()} for o in outs[:4]]
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    # rejected documents go, good ones stay
    good = [d for d in first if d in labels and labels[d].quality == 1]
    junk = [d for d in first if d in labels and labels[d].quality == 0]
    assert sum(d in rows[0] for d in good) >= 0.9 * len(good) and sum(d in rows[0] for d in junk) < 0.5 * len(junk)
    toxic = [d for d in rows[0] if d in labels and labels[d].toxic == 1]
    clean = [d for d in rows[0] if d in labels and labels[d].toxic == 0]
    assert sum(d in rows[1] for d in toxic) < 0.3 * len(toxic) and sum(d in rows[1] for d in clean) >= 0.98 * len(clean)
    # one of each group, then no repeated passage is left as it was
    assert set(rows[2]) == {d for d, _, _, kept in near_groups_at_80(list(rows[1].items())) if kept}
    assert all(rows[2][d] == rows[1][d] for d in rows[2])
    lost = {d: n for d, _, n, _, _ in repeats(list(rows[2].items()), 200)}
    assert set(rows[3]) == set(rows[2])
    for d, t in rows[3].items():
        assert (t == rows[2][d]) == (lost[d] == 0)
        assert abs(len(t.encode()) - (len(rows[2][d].encode()) - lost[d])) <= 6
    assert all(r.n_chars == len(r.text) for r in outs[3].collect() if lost[r.doc_id])
    places = defaultdict(list)
    for r in outs[4].collect():
        places[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in outs[4].where("piece = 0").collect()) == Counter(rows[3].keys())
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_run_chains_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    assert "corpus_pipeline" in sys.modules


def test_near_copies_from_80_percent_go(spark):
    texts = []
    for g in range(60):
        words = [f"w{g}x{i}" for i in range(104)]
        other = list(words)
        for i in range(g % 4):
            other[10 + 25 * i] = f"y{g}x{i}"
        texts += [" ".join(words), " ".join(other)]
    sets = [shingle_set(t) for t in texts]
    percent = [100 * len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(80 <= p < 85 for p in percent) >= 10 and any(p < 80 for p in percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect())
    assert got == [i for i in range(len(texts)) if i % 2 == 0 or percent[i // 2] < 80]


def test_columns_with_internal_names_stay(spark):
    """Every stage hands back extra columns as they were, whatever their names."""
    names = ["_text", "_score", "_llm_key", "_llm_digest", "_llm_copies", "_llm_kept", "_llm_i", "_llm_d", "component", "digest", "k", "stratum", "kept", "rid"]
    base = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 150")
    docs = base.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != "packing":
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert all(r[n] == f"{n}:{r.doc_id}" for n in names), name
        else:
            assert out.count() >= base.count()


def test_stages_on_null_rows_and_empty_tables(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, DIR).collect()
        assert stage(spark, odd.limit(0), DIR).count() == 0, name
