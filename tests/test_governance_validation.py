import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import governance as gv
from jobsieve.operators import validation as va


def test_source_decisions(spark):
    df = spark.createDataFrame([("legal_demo_csv", None), ("LinkedIn ", None), ("acme", "Licensed data feed"), ("acme", None)],
                               "source string, source_legal_basis string")
    got = [(r["source"], r["allowed"], r["reason"]) for r in gv.evaluate_sources(df).collect()]
    assert got[0][1] is True and got[0][2] == gv.REASON_REGISTRY_ALLOWED
    assert got[1][1] is False and got[1][2] == gv.REASON_NOT_APPROVED
    assert got[2][1] is True and got[2][2] == gv.REASON_LEGAL_BASIS
    assert got[3][1] is False and got[3][2] == gv.REASON_NO_BASIS


def test_gate_raises_for_blocked(spark):
    with pytest.raises(ValueError, match="linkedin"):
        gv.require_approved(spark, ["local_csv", "linkedin"])
    gv.require_approved(spark, ["local_csv"])


AS_OF = dt.datetime(2026, 6, 1)


@pytest.mark.parametrize("change,rule", [
    (dict(salary_min=-10.0), "greater_than_0:salary_min"),            # F-C negative salary
    (dict(posted_date=dt.datetime(2027, 1, 1)), "not_in_future:posted_date"),  # F-C future date
    (dict(company=None), "not_null:company"),                          # F-C null company
    (dict(salary_min=90000.0, salary_max=50000.0), "salary_bounds_are_valid"),
])
def test_validation_rejects_batch(make_postings, change, rule):
    good = dict(id="1", title="T", company="C", location="L", description="d", salary_min=1.0, salary_max=2.0)
    bad = dict(good, id="2", **change)
    df = make_postings([good, bad])
    counts = {r["rule"]: r["failures"] for r in va.rule_counts(df, AS_OF).collect()}
    assert counts == {rule: 1}
    assert va.batch_verdict(df, AS_OF).first()["accepted"] is False
    with pytest.raises(ValueError, match=rule.split(":")[0]):
        va.validate_strict(df, AS_OF)


def test_silver_cleaning(spark):
    df = spark.createDataFrame([(" A ", "B", "C", 10.0, 5.0, [" Py ", " ", "SQL"])],
                               "title string, company string, location string, salary_min double, salary_max double, required_skills array<string>")
    r = va.clean_text(va.clean_salary(df)).first()
    assert r["title"] == "a" and r["salary_min"] is None and r["salary_max"] is None
    assert list(r["required_skills"]) == ["py", "sql"]


def test_own_registry_is_broadcast(spark):
    df = spark.createDataFrame([("legal_demo_csv",)], "source string")
    plan = gv.evaluate_sources(df, legal_basis=None)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
