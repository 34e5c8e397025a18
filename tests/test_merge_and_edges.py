import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobsieve import session
from jobsieve.operators import ingest as ig
from jobsieve.operators import maintain as mt
from jobsieve.operators import salary as sa
from jobsieve.operators import search as se
from jobsieve.operators import stats as sx
from jobsieve.operators import taxonomy as tx
from jobsieve.sources import files as fl
from jobsieve.functions.text import decode_skills


def merge(make_postings, existing, batch):
    b = make_postings(batch).withColumn("_ord", F.monotonically_increasing_id())
    return mt.upsert(make_postings(existing) if existing else b.drop("_ord").limit(0), b, "_ord", "b1").collect()


def test_rows_without_identity_or_id_are_never_grouped(make_postings):
    out = merge(make_postings, [], [dict(title="a"), dict(title="a"), dict(title="b", source="", source_posting_id="1"), dict(title="c", source="s", source_posting_id="")])
    assert sorted(r.title for r in out) == ["a", "a", "b", "c"] and len({r.id for r in out}) == 4


def test_empty_identity_falls_back_to_the_id(make_postings):
    out = merge(make_postings, [], [dict(id="7", source="s", source_posting_id="", title="x"), dict(id="8", source="s", source_posting_id="", title="y"), dict(id="8", title="z", source="")])
    assert {r.id: r.title for r in out} == {"7": "x", "8": "z"}


def test_two_batch_rows_on_one_target_leave_one_row(make_postings):
    existing = [dict(id="A", source="s", source_posting_id="1", title="old")]
    out = merge(make_postings, existing, [dict(id="B", source="s", source_posting_id="1", title="by key"), dict(id="A", source="", title="by id")])
    assert [(r.id, r.title) for r in out] == [("A", "by id")]


def test_new_rows_sharing_an_id_or_an_identity_merge(make_postings):
    out = merge(make_postings, [], [dict(id="Q", source="s", source_posting_id="1", title="first"), dict(id="Q", source="s", source_posting_id="2", title="second"),
                                    dict(id="R", source="t", source_posting_id="9", title="third"), dict(id="S", source="t", source_posting_id="9", title="fourth"),
                                    dict(id=None, source="u", source_posting_id="5", title="made"), dict(id=None, source="u", source_posting_id="5", title="made again")])
    got = {r.id: r.title for r in out}
    assert got.pop("Q") == "second" and got.pop("R") == "fourth" and list(got.values()) == ["made again"] and len(out) == 3


def test_merge_agrees_with_a_sequential_fold(make_postings):
    rng = random.Random(7)
    row = lambda n: dict(id=rng.choice([None, "", *map(str, range(12))]), source=rng.choice([None, "s", "t"]), source_posting_id=rng.choice([None, "", "1", "2", "3"]), title=f"t{n}")
    existing = [dict(id=str(i), source="s", source_posting_id=str(i), title=f"e{i}") for i in range(4)]
    batch = [row(n) for n in range(30)]
    table = {e["id"]: dict(e) for e in existing}
    made = 0
    start = {(e["source"], e["source_posting_id"]): e["id"] for e in existing}
    goes = dict(start)
    for b in batch:
        key = (b["source"], b["source_posting_id"]) if b["source"] and b["source_posting_id"] else None
        if key and key in goes:
            target = goes[key]
        elif key:
            target = goes[key] = b["id"] or f"key {key}"
        elif b["id"]:
            target = b["id"]
        else:
            made += 1
            target = f"lone {made}"
        table[target] = b
    out = merge(make_postings, existing, batch)
    assert sorted(r.title for r in out) == sorted(r["title"] for r in table.values()) and len({r.id for r in out}) == len(out)
    given = {k: v["title"] for k, v in table.items() if not k.startswith(("key", "lone"))}
    assert {k: v for k, v in {r.id: r.title for r in out}.items() if k in given} == given


def test_dry_run_writes_nothing_and_counts_the_current_table(spark, make_postings, tmp_path):
    as_of = dt.datetime(2026, 6, 1)
    rows = lambda n: make_postings([dict(id=f"{n}{i}", source="legal_demo_csv", source_posting_id=f"{n}{i}", title="t", company="c", location="l", description="d",
                                         expires_at=dt.datetime(2026, 5, 2) if i == 0 else None) for i in range(3)])
    root = str(tmp_path / "t")
    first = ig.ingest(spark, {"legal_demo_csv": rows("a")}, root, "b1", as_of, dry_run=True).first()
    assert (first.fetched, first.saved, first.expired, first.active_after) == (3, 0, 0, 0) and fl.read_current(spark, root) is None
    done = ig.ingest(spark, {"legal_demo_csv": rows("a")}, root, "b2", as_of).first()
    assert (done.saved, done.expired, done.active_after, done.reason) == (3, 1, 2, ig.REASON_SAVED)
    again = ig.ingest(spark, {"legal_demo_csv": rows("b")}, root, "b3", as_of, dry_run=True).first()
    assert (again.fetched, again.saved, again.active_after) == (3, 0, 2)
    kept = ig.ingest(spark, {"legal_demo_csv": rows("c")}, root, "b4", as_of, mark_expired=False).first()
    assert (kept.expired, kept.active_after) == (0, 5)
    states = {(r.batch_id, r.status) for r in spark.read.parquet(f"{root}/_audit").collect()}
    assert states == {("b2", "running"), ("b2", "completed"), ("b4", "running"), ("b4", "completed")}


def test_mixed_headers_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title,company,location,description,salary_min,salary_max\n1,Java job,Acme,Hof,python,10,20\n")
    (tmp_path / "b.csv").write_text('max_salary,"location",job_title,company_name,id,min_salary\n0,Ulm,Other job,Beta,2,x\n')
    (tmp_path / "c.csv").write_text("no,known,column\n1,2,3\n")
    got = {r.id: r for r in fl.read_alternate_csv_dir(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].title, got["1"].location, got["1"].salary_max) == ("Java job", "Hof", 20.0)
    assert (got["2"].title, got["2"].company, got["2"].location, got["2"].salary_min, got["2"].salary_max) == ("Other job", "Beta", "Ulm", None, None)


def test_quoted_line_break_in_a_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,job_title,job_description\n1,Java job,"first line\nsecond, ""quoted"" line"\n2,Other job,plain\n')
    got = {r.id: (r.title, r.description) for r in fl.read_alternate_csv_dir(spark, str(tmp_path)).collect()}
    assert got == {"1": ("Java job", 'first line\nsecond, "quoted" line'), "2": ("Other job", "plain")}
    plain = fl.read_alternate_csv_dir(spark, str(tmp_path), multi_line=False).collect()
    assert len(plain) == 3


def test_non_numeric_salary_becomes_null(spark):
    raw = spark.createDataFrame([("1", "abc", "12.5", "n/a")], "id string, salary_min string, salary_max string, salary_confidence string")
    r = fl.normalize_raw(raw, "p", None).first()
    assert (r.salary_min, r.salary_max, r.salary_confidence) == (None, 12.5, None)


def test_skill_json_is_escaped(spark):
    skills = ['say "hi"', "back\\slash", "tab\t", "plain"]
    df = spark.createDataFrame([(skills,), ([],)], "required_skills array<string>").withColumn("t", se.skills_json_text())
    import json
    rows = df.collect()
    assert json.loads(rows[0].t) == skills and rows[0].t.startswith('["say \\"hi\\"", ') and rows[1].t is None
    assert spark.createDataFrame([(json.dumps(["a", "b"]),)], "t string").select(decode_skills("t").alias("d")).first().d == ["a", "b"]


def test_null_group_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    assert {r.g: (r["count"], r.q1) for r in sa.group_salary_stats(df, "g", "v").collect()} == {None: (2, 1.0), "a": (1, 2.0)}
    same = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert sx.ks_statistic(same, same, "v").first().wasserstein_normed is None
    assert sx.ks_statistic(same.limit(0), same, "v").first().ks_statistic is None
    t = sx.welch_t_test(spark.createDataFrame([("remote", 1.0), ("remote", 1.0), ("onsite", 1.0), ("onsite", 1.0)], "g string, v double"), F.col("g"), F.col("v")).first()
    assert t.t_statistic is None and not t.significant


def test_fingerprint_tells_null_positions_apart(spark):
    f = lambda rows: sx.fingerprint(spark.createDataFrame(rows, "a string, b string")).first().hash_sum
    assert f([(None, "a")]) != f([("a", None)]) and f([("x", "y"), (None, "a")]) == f([(None, "a"), ("x", "y")])


def test_taxonomy_join_equals_the_literal_matcher_also_for_large_tables(spark):
    rng = random.Random(5)
    word = lambda n=6: "".join(rng.choice("abcdefghij") for _ in range(n))
    seed = tx.load_concepts(spark)
    labels = [r.preferred_label for r in seed.collect()]
    texts = [(str(i), " ".join([word(), rng.choice(labels), word(), rng.choice(["IT", "qa", "Data", "engineer", ""])])) for i in range(60)] + [("n", None), ("e", "")]
    df = spark.createDataFrame(texts, "id string, t string")
    want = {(r.id, c.ordinal) for r in tx.match_concepts(df, F.col("t"), tx.concept_set(spark), "m").collect() for c in (r.m or [])}
    assert want and {tuple(r) for r in tx.match_concepts_join(df, "id", F.col("t"), seed).collect()} == want
    made = [(100 + i, "skill", f"{word(4)} {word(5)}", None, None, [], ) for i in range(21_000)]
    big = seed.unionByName(spark.createDataFrame([(i, k, p, u, b, a, [p]) for i, k, p, u, b, a in made],
                                                 "ordinal int, concept_type string, preferred_label string, concept_uri string, broader_group string, aliases array<string>, all_terms array<string>"))
    planted = df.unionByName(spark.createDataFrame([("big", f"xx {made[7][2]} yy")], "id string, t string"))
    got = {tuple(r) for r in tx.match_concepts_join(planted, "id", F.col("t"), big).collect()}
    assert want <= got and ("big", 107) in got


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
