import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("jobsieve-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="jobsieve-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


POSTING_SCHEMA = ("id string, title string, company string, location string, description string, job_type string, "
                  "source string, salary_min double, salary_max double, salary_is_estimated boolean, "
                  "required_skills array<string>, source_legal_basis string, remote_status string, role_type string, "
                  "occupation_group string, experience_level string, employment_type string, url string, "
                  "application_url string, city string, federal_state string, posted_date timestamp_ntz, "
                  "expires_at timestamp_ntz, is_expired boolean, source_posting_id string, salary_confidence double, "
                  "currency string")


def posting(**kw):
    import datetime as dt
    base = dict(id=None, title="", company="", location="", description="", job_type="Full-time", source="legal_demo_csv",
                salary_min=None, salary_max=None, salary_is_estimated=False, required_skills=[], source_legal_basis=None,
                remote_status=None, role_type=None, occupation_group=None, experience_level=None, employment_type="permanent",
                url=None, application_url=None, city=None, federal_state=None, posted_date=dt.datetime(2026, 5, 1),
                expires_at=None, is_expired=False, source_posting_id=None, salary_confidence=None, currency="EUR")
    base.update(kw)
    return tuple(base[f.split()[0]] for f in POSTING_SCHEMA.split(", "))


@pytest.fixture()
def make_postings(spark):
    def mk(rows):
        return spark.createDataFrame([posting(**r) for r in rows], POSTING_SCHEMA)
    return mk
