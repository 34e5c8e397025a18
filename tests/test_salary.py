import random

from pyspark.sql import functions as F

from jobsieve.functions import salary as S
from jobsieve.operators import salary as sal


def _floor_q(values, f):
    s = sorted(values)
    return s[int((len(s) - 1) * f)]


def test_floor_quantiles_match_python(spark):
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 50))) for g in "abc" for _ in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in sal.floor_quantiles(df, ["g"], "v", {"q1": 0.25, "q3": 0.75}).collect()}
    for g in "abc":
        vals = [v for k, v in rows if k == g]
        assert got[g]["q1"] == _floor_q(vals, 0.25)
        assert got[g]["q3"] == _floor_q(vals, 0.75)


def test_anomalies_flag_far_outlier(make_postings):
    # F-H: four postings, one far outlier
    rows = [dict(id=str(i), title="Nurse", company="C", location="Berlin", salary_min=lo, salary_max=hi)
            for i, (lo, hi) in enumerate([(40000.0, 50000.0), (42000.0, 52000.0), (41000.0, 51000.0), (200000.0, 250000.0)])]
    df = make_postings(rows)
    out = sal.salary_anomalies(df, "id", F.col("title"), S.midpoint()).collect()
    assert [r["job_id"] for r in out] == ["3"]
    assert "overall_outlier" in out[0]["reasons"]


def test_estimate_rungs_and_rounding(make_postings):
    rows = [
        dict(id="1", role_type="Nursing", location="Berlin", experience_level="senior", salary_min=50000.0, salary_max=60000.0),
        dict(id="2", role_type="Nursing", location="Berlin", experience_level="senior", salary_min=52000.0, salary_max=62000.0),
        dict(id="3", role_type="Nursing", location="Berlin", experience_level="senior"),  # rung 1
        dict(id="4", role_type="Nursing", location="Munich", experience_level="junior"),  # rung 4 with multipliers
        dict(id="5", role_type="Other", occupation_group=None, location="X"),  # occupation group '' == ''
    ]
    df = make_postings(rows)
    got = {r["id"]: r for r in sal.estimate_salaries(df).collect()}
    assert got["3"]["salary_estimation_basis"] == "role type + location + experience level"
    assert got["3"]["eff_salary_min"] == 51000.0 and got["3"]["eff_salary_confidence"] == 0.9
    assert got["3"]["salary_label"] == "Estimated 51,000-61,000 EUR"
    assert got["4"]["salary_estimation_basis"] == "role type"
    m = 0.9 * 1.05
    assert got["4"]["eff_salary_min"] == round(51000 * m, -2)
    assert got["4"]["salary_midpoint"] == round((51000 * m + 61000 * m) / 2, 2)
    assert got["5"]["salary_estimation_basis"] == "occupation group"
    assert got["1"]["salary_type"] == "listed" and got["1"]["eff_salary_confidence"] == 1.0


def test_half_even_rounding_like_python(spark):
    v = spark.range(1).select(F.bround(F.lit(44250.0), -2).alias("a")).first()["a"]
    assert v == round(44250.0, -2) == 44200.0
