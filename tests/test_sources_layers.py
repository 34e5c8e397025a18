import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import medallion as md
from jobsieve.operators import salary as sal
from jobsieve.operators import similar as si
from jobsieve.operators import stats as sx
from jobsieve.operators import validation as va
from jobsieve.sources import files as fl

NOW = dt.datetime(2026, 6, 1)


def test_a_quoted_line_break_is_read_whole_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,description\n1,Job,"first line\nsecond, ""quoted"""\n2,Other,plain\n')
    got = {r.id: r.description for r in fl.normalize_raw(fl.read_csv_text(spark, str(tmp_path)), "p", None).collect()}
    assert got == {"1": 'first line\nsecond, "quoted"', "2": "plain"}


def test_values_survive_a_csv_round_trip(spark, tmp_path):
    texts = [" lead", "trail ", "a\nb", 'say "x"', "c,d", "back\\slash"]
    df = spark.createDataFrame([(str(i), t, ["p", "q"]) for i, t in enumerate(texts)], "id string, title string, required_skills array<string>")
    fl.write_csv(df, str(tmp_path / "out"))
    back = {r.id: (r.title, r.required_skills) for r in fl.read_csv_text(spark, str(tmp_path / "out")).collect()}
    assert back == {str(i): (t, "p;q") for i, t in enumerate(texts)}


def test_folder_with_bad_files_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"job_title, long",company_name\n1,"x, y",Acme\n2,z,Beta,extra\n')
    (tmp_path / "b.csv.gz").write_bytes(b"\x1f\x8b\x08 torn")
    (tmp_path / "c.csv").write_text("what,else\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    got = {r.file: (r.status, r.rows, r.corrupt_rows) for r in fl.csv_dir_report(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("read", 1, 1), "b.csv.gz": ("unreadable", 0, 0), "c.csv": ("unknown_layout", 0, 0)}
    assert [(r.id, r.company) for r in fl.read_alternate_csv_dir(spark, str(tmp_path)).collect()] == [("1", "Acme")]


def test_validating_sinks(spark, make_postings, tmp_path):
    good = dict(title="t", company="c", location="l", description="d")
    df = make_postings([dict(id="1", **good), dict(id="2", salary_min=5.0, salary_max=1.0, **good), dict(id="3", salary_min=-1.0, **good)])
    counts = {r.rule: r.rows for r in fl.save_valid(df, str(tmp_path / "j"), NOW, "json").collect()}
    assert counts == {"valid": 1, "salary_bounds_are_valid": 1, "greater_than_0:salary_min": 1}
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).collect()] == ["1"]
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "j_rejected")).collect()) == ["2", "3"]
    with pytest.raises(ValueError, match="salary_bounds"):
        fl.save_valid(df, str(tmp_path / "s"), NOW, strict=True)
    assert not (tmp_path / "s").exists()


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_sinks_write_less_than_their_text(spark, make_postings, tmp_path, kind):
    rows = [dict(id=str(i), title="t", company="c", location="l", description=f"Role in a place requiring old widget, new rod, {i}", salary_min=-1.0 if i % 2 else None) for i in range(400)]
    counts = {r.rule: r.rows for r in fl.save_valid(make_postings(rows), str(tmp_path / "s"), NOW, kind).collect()}
    assert counts == {"valid": 200, "greater_than_0:salary_min": 200}
    for part in ("s", "s_rejected"):
        files = [f for f in (tmp_path / part).iterdir() if f.name.startswith("part-")]
        assert files and all(f.suffix == ".gz" for f in files) and sum(f.stat().st_size for f in files) < 200 * 60
    good = fl.read_csv_text(spark, str(tmp_path / "s")) if kind == "csv" else spark.read.json(str(tmp_path / "s"))
    assert {r.id for r in good.collect()} == {str(i) for i in range(0, 400, 2)} and good.first().title == "t"
    assert {r.id for r in spark.read.json(str(tmp_path / "s_rejected")).collect()} == {str(i) for i in range(1, 400, 2)}


def test_boolean_coercion(spark):
    df = spark.createDataFrame([("1", "perhaps"), ("2", "true"), ("3", None), ("4", "0")], "id string, salary_is_estimated string")
    bad = {r.id for r in va.with_failures(df, NOW).where(F.array_contains("failures", "coerce_bool:salary_is_estimated")).collect()}
    assert bad == {"1"}


def test_unknown_source_and_limits(spark, make_postings):
    rows = make_postings([dict(id=str(i), title="nurse", source="s") for i in range(5)])
    feeds = [fl.Feed("s", rows, "basis")]
    got = fl.run_sources(feeds, ["S"], ["nurse"], 3).collect()
    assert [r.id for r in got] == ["0", "1", "2"] and {r.source_legal_basis for r in got} == {"basis"}
    with pytest.raises(ValueError, match="No provider registered"):
        fl.run_sources(feeds, ["s", "other"], [], 3)


def test_layers_follow_batches(spark, tmp_path):
    cols = "id string, title string, company string, location string, description string, source string, salary_min double, salary_max double, required_skills array<string>, posted_date timestamp_ntz, ingested_at timestamp_ntz"
    day = lambda m, d=1: dt.datetime(2026, m, d)
    row = lambda i, t, m, seen, skills=("a",): (i, t, "c", "l", "d", "s", 10.0, 20.0, list(skills), m and day(m), day(seen))
    one = spark.createDataFrame([row("1", "x", 1, 6), row("2", "y", 2, 6), row("3", "z", None, 6), row("5", "w", 3, 6)], cols)
    two = spark.createDataFrame([row("4", "X ", 2, 7, ("b",)), row("6", "w", 4, 5)], cols)  # 4 moves x from month 1, 6 is older than 5
    root = str(tmp_path / "t")
    md.refresh_layers(root, one, "1")
    before = {p.name for p in (tmp_path / "t" / "silver").glob("month=*")}
    touched = md.refresh_layers(root, two, "2")
    assert touched["months"] == 4 and "month=2026-01-01" in before and not (tmp_path / "t" / "silver" / "month=2026-01-01").exists()
    whole = md.silver(one.unionByName(two))
    pick = lambda df: sorted((r.id, r.title) for r in df.collect())
    assert pick(spark.read.parquet(f"{root}/silver")) == pick(whole) == [("2", "y"), ("3", "z"), ("4", "x"), ("5", "w")]
    mart = lambda df: sorted((r.skill, str(r.month), r.job_count) for r in df.collect())
    assert mart(spark.read.parquet(f"{root}/gold")) == mart(md.skill_month_mart(whole))


def test_rungs_and_similar_postings_plans(spark, make_postings):
    df = make_postings([dict(id=str(i), title=f"t{i}", role_type="R" if i % 2 else None, location="L", experience_level=["a", "b"][i % 3 % 2], occupation_group="G",
                             salary_min=None if i % 4 == 0 else 1000.0 * i, salary_max=None if i % 4 == 0 else 2000.0 * i, required_skills=[None, "S"][i % 2:]) for i in range(1, 20)])
    e = sal.estimate_salaries(df)
    assert e.count() == 19
    assert e._jdf.queryExecution().executedPlan().toString().count("Expand") <= 2  # one, shown in both the initial and the final plan
    top = si.similar_jobs(df, ["1"], 3).collect()
    assert [r.rank for r in top] == [1, 2, 3] and all(r.target_id == "1" and r.id != "1" for r in top)


def test_drift_of_equal_and_apart_samples(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(50)], "v double, k string")
    b = spark.createDataFrame([(float(i + 100), "y") for i in range(50)], "v double, k string")
    same = {r.feature: r.score for r in sx.drift_report(a, a, ["v"], ["k"]).collect()}
    apart = {r.feature: (r.score, r.drifted, r.share_drifted) for r in sx.drift_report(a, b, ["v"], ["k"]).collect()}
    assert same == {"v": 0.0, "k": 0.0}
    sd = (sum((i - 24.5) ** 2 for i in range(50)) / 49) ** 0.5
    assert apart["v"] == (round(100 / sd, 6), True, 1.0) and apart["k"][0] == 0.832555
    assert sx.ks_statistic(a, b, "v").first().ks_statistic == 1.0


def test_layers_store_what_a_batch_reads_again(spark, tmp_path, monkeypatch):
    stored, cut = [], md.cut_lineage
    monkeypatch.setattr(md, "cut_lineage", lambda df: (stored.append(set(df.columns)), cut(df))[1])
    row = ("1", "x", "c", "l", "d", "s", 10.0, 20.0, ["a"], dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2))
    md.refresh_layers(str(tmp_path / "t"), spark.createDataFrame([row], ", ".join(f"{c} {t}" for c, t in zip(
        md.BRONZE_COLUMNS, ["string"] * 6 + ["double"] * 2 + ["array<string>"] + ["timestamp_ntz"] * 2))), "1")
    assert stored.count({*md.BRONZE_COLUMNS, "month"}) == 3  # the batch's silver rows, those they replace, and the months' new rows


def test_order_lines_are_listed_after_their_shuffle(spark, tmp_path):
    from jobsieve.sources.tables import order_lines
    line = [(k % 5, n, (k + (n or 0)) % 3, (n or 0) % 2) for k in range(20) for n in (2, 1, None)] + [(None, 1, 1, 1)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(0, "a", "x"), (1, "b", None), (1, "c", "y"), (2, None, "z")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = order_lines(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(l_orderkey"):]  # no list is begun where lines are read
    key = lambda r: tuple((v is not None, v) for v in r)
    want = {}
    for o, n, p, s in line:
        want.setdefault(o, []).extend((n, p, s, name, kind) for q, name, kind in parts if q == p)
    assert {r.l_orderkey: [tuple(x) for x in r.lines] for r in got.collect()} == {o: sorted(v, key=key) for o, v in want.items()}
