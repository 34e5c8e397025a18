import datetime as dt

from pyspark.sql import functions as F

from jobsieve.operators import maintain as mt
from jobsieve.operators import similar as si
from jobsieve.sources import files as fl


def test_upsert_keeps_id_and_updates(make_postings):
    existing = make_postings([dict(id="a", source="s", source_posting_id="p1", title="Old"),
                              dict(id="b", source="s", source_posting_id="p2", title="Keep")])
    batch = make_postings([dict(id="new-1", source="s", source_posting_id="p1", title="New 1"),
                           dict(id="new-2", source="s", source_posting_id="p1", title="New 2"),   # later row wins
                           dict(id="c", source="s", source_posting_id="p3", title="Inserted")]) \
        .withColumn("_ord", F.monotonically_increasing_id())
    out = {r["id"]: r["title"] for r in mt.upsert(existing, batch, order="_ord").collect()}
    assert out == {"a": "New 2", "b": "Keep", "c": "Inserted"}
    # a second run with the same batch changes nothing
    again = {r["id"]: r["title"] for r in mt.upsert(mt.upsert(existing, batch, "_ord"), batch, "_ord").collect()}
    assert again == out


def test_expiry_is_strict(make_postings):
    now = dt.datetime(2026, 6, 1)
    df = make_postings([dict(id="1", expires_at=now), dict(id="2", expires_at=now - dt.timedelta(seconds=1))])
    got = {r["id"]: r["is_expired"] for r in mt.expire(df, now).collect()}
    assert got == {"1": False, "2": True}


def test_similar_jobs_scores(make_postings):
    df = make_postings([
        dict(id="t", title="T", role_type="R", occupation_group="G", location="L", remote_status="remote", required_skills=["A", "b"]),
        dict(id="x", title="X", role_type="R", occupation_group="G", location="L", remote_status="remote", required_skills=["a"]),
        dict(id="y", title="Y", role_type="R", location="M", required_skills=["B", "b"]),
        dict(id="z", title="Z", role_type="Q", location="M", required_skills=[]),
    ])
    got = [(r["id"], r["score"]) for r in si.similar_jobs(df, ["t"], limit=5).orderBy("rank").collect()]
    assert got == [("x", 5 + 4 + 3 + 2 + 1), ("y", 5 + 1)]


def test_versioned_table_roundtrip(spark, tmp_path):
    root = str(tmp_path / "t")
    assert fl.read_current(spark, root) is None
    fl.write_version(spark.range(3), root)
    fl.write_version(spark.range(5), root)
    assert fl.read_current(spark, root).count() == 5


def test_stream_bronze_available_now(spark, tmp_path):
    from jobsieve.streaming import ingest as st
    src = tmp_path / "topic"
    src.mkdir()
    (src / "m.json").write_text('{"id": "1", "source": "s", "required_skills": ["a"], "posted_date": "2026-05-01T10:00:00"}\n'
                                '{broken\n')
    q = st.start_bronze(spark, st.read_topic(spark, str(src)), str(tmp_path / "b"), str(tmp_path / "q"), str(tmp_path / "c"))
    q.awaitTermination()
    b = spark.read.parquet(str(tmp_path / "b")).collect()
    assert [(r["id"], str(r["posted_date"])) for r in b] == [("1", "2026-05-01")]
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_point_in_time_hot_key_matches_brute_force(spark):
    import random
    from jobsieve.operators import features as fe
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    feats = [(u, base + dt.timedelta(hours=rnd.randint(0, 24 * 200)), float(i))
             for i, u in enumerate([1] * 300 + [2] * 20 + [3] * 5)]  # user 1 is a hot key
    ents = [(i, u, base + dt.timedelta(hours=rnd.randint(0, 24 * 200))) for i, u in enumerate([1] * 100 + [2] * 10 + [4] * 3)]
    fdf = spark.createDataFrame(feats, "user_id long, ts timestamp_ntz, value double")
    edf = spark.createDataFrame(ents, "row_id long, user_id long, ts timestamp_ntz")
    got = {r["row_id"]: r["value"] for r in fe.point_in_time(edf, fdf, "user_id", "ts", ["value"],
                                                             ttl=dt.timedelta(days=30)).collect()}
    for rid, u, t in ents:
        cands = [(ft, v) for fu, ft, v in feats if fu == u and ft <= t]
        best = max(cands)[1] if cands and max(cands)[0] >= t - dt.timedelta(days=30) else None
        assert got[rid] == best, rid


def test_raw_text_is_kept_for_bad_rows_alone(spark, tmp_path, monkeypatch):
    from jobsieve.sources.posting_table import PostingTable
    from jobsieve.streaming import ingest as st
    good = '{"id": "1", "title": "t", "company": "c", "location": "l", "description": "d", "source": "legal_demo_csv", "salary_min": 1.0, "salary_max": 2.0, "required_skills": ["a"], "posted_date": "2026-01-02T00:00:00"}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{good}\n{{broken\n")
    stored, cut = [], st.cut_lineage
    monkeypatch.setattr(st, "cut_lineage", lambda df: (stored.append(cut(df)), stored[-1])[1])
    decoded = st.decode(spark.read.text(str(tmp_path / "in")))
    st.ingest_batch(PostingTable(spark, str(tmp_path / "t")), decoded, "w", 0, dt.datetime(2026, 6, 1), str(tmp_path / "q"))
    assert [r.value for r in stored[0].orderBy("value").collect()] == [None, "{broken"]
    assert [(r.value, r.reasons[0]) for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [("{broken", "corrupt")]
    assert "value" not in st.dedupe_stream(st.decode(st.read_topic(spark, str(tmp_path / "in")))).columns


def test_stream_bronze_keeps_no_batch_in_memory(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from jobsieve.streaming import ingest as st
    kept = []
    for name in ("persist", "cache"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _n=name: kept.append(_n) or self)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": "1", "source": "s"}\n{broken\n{"source": "no id"}\n{"id": "2", "salary_min": "odd"}\n')
    st.start_bronze(spark, st.read_topic(spark, str(tmp_path / "in")), *(str(tmp_path / x) for x in "bqc")).awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / x)).collect() for x in "bq")
    assert not kept
    assert sorted((r.id, r.source, r.salary_min) for r in good) == [("1", "s", None), ("2", None, None)]
    assert sorted(r.value for r in bad) == ['{"source": "no id"}', "{broken"]
    assert len({r.ingested_at for r in [*good, *bad]}) == 1
