import statistics

from pyspark.sql import functions as F

from jobsieve.operators import skills as sk


def _skill_rows():
    # F-B: four postings; one without salary, one with zero salary
    return [
        dict(id="1", title="Data Engineer", required_skills=["Python", "SQL", "Spark"], salary_min=60000.0, salary_max=80000.0),
        dict(id="2", title="Backend Dev", required_skills=["Python", "Django", "PostgreSQL"], salary_min=55000.0, salary_max=75000.0),
        dict(id="3", title="Analyst", required_skills=["SQL", "Excel"], salary_min=None, salary_max=None),
        dict(id="4", title="Intern", required_skills=["Python", "Python"], salary_min=0.0, salary_max=30000.0),
    ]


def test_skill_stats_counts_mentions_and_means(make_postings):
    df = make_postings(_skill_rows())
    rows = {r["skill"]: r for r in sk.skill_stats(df).collect()}
    total = 3 + 3 + 2 + 2
    assert rows["Python"]["occurrences"] == 4  # listed twice in posting 4 counts twice
    assert abs(rows["Python"]["percentage"] - 4 / total * 100) < 1e-6
    # zero salary is "missing" for this operator
    assert rows["Python"]["salary_count"] == 2
    assert abs(rows["Python"]["salary_mean"] - statistics.mean([70000, 65000])) < 1e-6
    assert abs(rows["Python"]["salary_stdev"] - statistics.stdev([70000, 65000])) < 1e-6
    assert rows["Excel"]["salary_mean"] is None
    assert rows["Spark"]["salary_stdev"] == 0.0


def test_top_skills_ties_by_name(make_postings):
    df = make_postings(_skill_rows())
    top = [r["skill"] for r in sk.top_skills(df, top_n=3).collect()]
    assert top == ["Python", "SQL", "Django"]


def test_categories_and_related(make_postings):
    df = make_postings(_skill_rows())
    cats = {(r["category"], r["skill"]) for r in sk.skill_categories(df).collect()}
    assert ("Programming Languages", "Python") in cats and ("Databases", "PostgreSQL") in cats
    assert ("Data & Analytics", "SQL") in cats and ("Data & Analytics", "Spark") in cats
    rel = {r["skill"]: r["co_occurrences"] for r in sk.related_skills(df, "Python", threshold=1).collect()}
    assert rel == {"SQL": 1, "Spark": 1, "Django": 1, "PostgreSQL": 1}


def test_premium_uses_unweighted_mean_of_skill_means(make_postings):
    df = make_postings(_skill_rows())
    means = {r["skill"]: r["salary_mean"] for r in sk.skill_stats(df).collect() if r["salary_mean"] is not None}
    base = statistics.mean(means.values())
    prem = {r["skill"]: r for r in sk.salary_premium(df).collect()}
    assert abs(prem["SQL"]["base_salary"] - base) < 1e-4
    assert abs(prem["SQL"]["premium_percentage"] - (means["SQL"] - base) / base * 100) < 1e-4


def test_result_does_not_depend_on_partitioning(make_postings):
    df = make_postings(_skill_rows() * 3)
    a = sorted(sk.top_skills(df, 5).collect())
    b = sorted(sk.top_skills(df.repartition(7), 5).collect())
    assert a == b
