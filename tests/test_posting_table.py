import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import ingest as ig
from jobsieve.operators import maintain as mt
from jobsieve.sources.posting_table import CommitConflict, PostingTable
from jobsieve.streaming import ingest as st

NOW = dt.datetime(2026, 6, 1)


def rows(make_postings, ids, title="t", **kw):
    return make_postings([dict(id=str(i), source="legal_demo_csv", source_posting_id=str(i), title=f"{title}{i}", **kw) for i in ids])


def load(table, batch, name, as_of=None):
    b = batch.withColumn("_ord", F.monotonically_increasing_id())
    existing = table.current()
    return table.commit(mt.changed_rows(batch.limit(0) if existing is None else existing, b, "_ord", name, as_of), name)


def titles(table, version=None):
    out = [(r.id, r.title) for r in table.current(version).collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/data") for f in fs)


def test_a_commit_writes_the_batch_not_the_table(spark, make_postings, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.current() is None and table.manifest().version == 0
    load(table, spark.range(20_000).select(*[c for c in rows(make_postings, [1]).columns if c == "_"],).crossJoin(rows(make_postings, [1])).withColumn(
        "id", F.monotonically_increasing_id().cast("string")).withColumn("source_posting_id", F.col("id")).withColumn("title", F.concat(F.lit("t"), F.md5("id"))), "b1")
    whole = size(table.root)
    ids = [r.id for r in table.current().limit(10).collect()]
    m = load(table, rows(make_postings, ids, "new "), "b2")
    assert m.commit["changed"] == 10 and m.commit["inserted"] == 0 and m.rows == 20_000
    assert size(table.root) - whole < whole / 10
    got = titles(table)
    assert len(got) == 20_000 and all(got[i] == f"new {i}" for i in ids) and sum(t.startswith("new") for t in got.values()) == 10


def test_versions_compaction_and_vacuum(spark, make_postings, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"), buckets=3)
    load(table, rows(make_postings, range(30), "a"), "b1")
    for n in range(2, 6):
        load(table, rows(make_postings, range(n, n + 3), f"b{n}-"), f"b{n}")
    load(table, rows(make_postings, [100, 101], "new"), "b6")
    want = {str(i): f"a{i}" for i in range(30)}
    for n in range(2, 6):
        want |= {str(i): f"b{n}-{i}" for i in range(n, n + 3)}
    want |= {"100": "new100", "101": "new101"}
    assert titles(table) == want
    first = titles(table, 1)
    assert first == {str(i): f"a{i}" for i in range(30)}
    assert table.compact(max_deltas=2, share=10) > 0
    assert titles(table) == want and table.manifest().rows == 32
    assert table.compact(max_deltas=99, share=99) == 0
    deltas = [s for s in table.manifest().segments if s.kind == "delta"]
    assert table.vacuum(keep=1) > 0 and titles(table) == want
    assert table.compact(max_deltas=1) >= (1 if deltas else 0) and titles(table) == want
    assert not [s for s in table.manifest().segments if s.kind == "delta"]


def test_replayed_and_concurrent_commits(spark, make_postings, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"))
    load(table, rows(make_postings, [1, 2]), "b1")
    again = load(table, rows(make_postings, [1, 2], "changed "), "b1")
    assert again.version == 1 and titles(table) == {"1": "t1", "2": "t2"}
    stale = table.manifest()
    load(table, rows(make_postings, [3]), "b2")
    with pytest.raises(CommitConflict):
        table._publish(type(stale)(stale.version + 1, stale.buckets, stale.schema, stale.segments, stale.applied, stale.rows, stale.active))
    assert titles(table) == {"1": "t1", "2": "t2", "3": "t3"}


def test_expiry_sweep_writes_flips_and_counts(spark, make_postings, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"))
    past, later = dt.datetime(2026, 5, 2), dt.datetime(2027, 1, 1)
    first = rows(make_postings, [1, 2], expires_at=later).unionByName(rows(make_postings, [3, 4], expires_at=past))
    load(table, first, "b1")                                   # without a sweep
    m = load(table, rows(make_postings, [4, 5], "n", expires_at=past), "b2", NOW)
    assert m.commit["expired"] == 3 and m.commit["changed"] == 3 and m.commit["inserted"] == 1 and (m.rows, m.active) == (5, 2)
    assert {r.id: r.is_expired for r in table.current().collect()} == {"1": False, "2": False, "3": True, "4": True, "5": True}
    h = {r.version: (r.writer, r.rows, r.active, r.expired) for r in table.history().collect()}
    assert h == {1: ("b1", 4, 4, 0), 2: ("b2", 5, 2, 3)}


def test_ingest_twice_and_again_with_the_same_batch(spark, make_postings, tmp_path):
    root = str(tmp_path / "t")
    data = lambda ids, **kw: rows(make_postings, ids, company="c", location="l", description="d", **kw)
    one = ig.ingest(spark, {"legal_demo_csv": data([1, 2])}, root, "b1", NOW).first()
    two = ig.ingest(spark, {"legal_demo_csv": data([2, 3], title="new ")}, root, "b2", NOW).first()
    again = ig.ingest(spark, {"legal_demo_csv": data([2, 3], title="late ")}, root, "b2", NOW).first()
    assert (one.active_after, two.active_after, again.active_after) == (2, 3, 3)
    assert titles(PostingTable(spark, root)) == {"1": "t1", "2": "new 2", "3": "new 3"}


MESSAGE = '{{"id": "{}", "title": "{}", "company": "c", "location": "l", "description": "d", "source": "{}", "salary_min": {}, "salary_max": 20, "required_skills": ["a"], "posted_date": "2026-05-01T10:00:00"}}\n'


def test_stream_killed_between_table_and_checkpoint(spark, tmp_path, monkeypatch):
    """The batch is in the table but not in the checkpoint: the restarted query runs it again, without effect."""
    topic = tmp_path / "topic"
    topic.mkdir()
    feed = lambda name, *m: (topic / name).write_text("".join(m))
    feed("a.json", MESSAGE.format(1, "one", "legal_demo_csv", 10), MESSAGE.format(2, "blocked", "linkedin", 10), "{broken\n")
    root, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    start = lambda: st.start_microbatch_ingest(spark, st.decode(st.read_topic(spark, str(topic), max_files_per_trigger=1)), root, ckpt, NOW)
    start().awaitTermination()
    feed("b.json", MESSAGE.format(1, "one again", "legal_demo_csv", 10), MESSAGE.format(3, "three", "company_feed", 10), MESSAGE.format(4, "bounds", "company_feed", 30))
    whole = PostingTable.commit

    def killed(self, *args):
        whole(self, *args)
        raise RuntimeError("killed")

    monkeypatch.setattr(PostingTable, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.setattr(PostingTable, "commit", whole)
    table = PostingTable(spark, root)
    written = table.manifest()
    start().awaitTermination()
    assert table.manifest() == written
    got = {r.id: (r.title, r.ingestion_batch_id, r.is_expired) for r in table.current().collect()}
    assert got == {"1": ("one again", "stream-1", False), "3": ("three", "stream-1", False)}
    feed("c.json", MESSAGE.format(5, "five", "company_feed", 10))
    start().awaitTermination()
    assert set(titles(table)) == {"1", "3", "5"} and [r.transaction for r in table.history().orderBy("version").collect()] == [0, 1, 2]
    bad = sorted(tuple(r.reasons) for r in spark.read.parquet(f"{root}/_quarantine").collect())
    assert bad == [("corrupt",), ("salary_bounds_are_valid",), ("source",)]


def test_rows_of_one_later_commit_are_not_regrouped(spark, make_postings, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"), buckets=2)
    load(table, rows(make_postings, range(6)), "b1")
    load(table, rows(make_postings, range(4, 9), "u"), "b2")
    assert "max_by" not in table.current()._jdf.queryExecution().executedPlan().toString()
    assert titles(table) == {str(i): f"{'t' if i < 4 else 'u'}{i}" for i in range(9)}
    load(table, rows(make_postings, [0, 5], "v"), "b3")
    assert titles(table) == {str(i): f"{'v' if i in (0, 5) else 't' if i < 4 else 'u'}{i}" for i in range(9)}
