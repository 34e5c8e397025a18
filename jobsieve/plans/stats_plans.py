"""Statistics plans over the posting view and its train/production split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint_any
from jobsieve.operators import stats as stx
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import register
from jobsieve.sources.tables import postings

SPLIT = dt.datetime(1998, 1, 1)
_SPLIT = f"TIMESTAMP '{SPLIT:%Y-%m-%d %H:%M:%S}'"
_AVG_ANY = ("CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 "
            "WHEN salary_min IS NOT NULL THEN salary_min WHEN salary_max IS NOT NULL THEN salary_max END")
_WM = "CASE WHEN lower(remote_status) IN ('remote', 'onsite', 'hybrid') THEN lower(remote_status) ELSE 'unknown' END"


@register("a17_file_overview", with_postings(
    """SELECT (SELECT count(*) FROM postings) AS rows, round(avg(v), 6) AS mean, median(v) AS median, min(v) AS min, max(v) AS max
       FROM (SELECT salary_min AS v FROM postings UNION ALL SELECT salary_max FROM postings) WHERE v IS NOT NULL"""))
def a17_file_overview(spark, sf_dir):
    return stx.file_overview(postings(spark, sf_dir))


@register("a17_top_companies", with_postings(
    "SELECT company, count(*) AS count FROM postings WHERE company IS NOT NULL GROUP BY company ORDER BY count DESC, company LIMIT 5"))
def a17_top_companies(spark, sf_dir):
    return stx.top_values(postings(spark, sf_dir), "company", 5)


@register("a17_top_locations", with_postings(
    "SELECT location, count(*) AS count FROM postings WHERE location IS NOT NULL GROUP BY location ORDER BY count DESC, location LIMIT 5"))
def a17_top_locations(spark, sf_dir):
    return stx.top_values(postings(spark, sf_dir), "location", 5)


def _profile_sql() -> str:
    def counted(name, c):
        return f"SELECT '{name}_distribution:' || {c} AS name, CAST(count(*) AS DOUBLE) AS value FROM _p WHERE {c} IS NOT NULL GROUP BY {c}"
    stats = {"count": "count(v)", "mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "25%": "quantile_cont(v, 0.25)", "50%": "quantile_cont(v, 0.5)",
             "75%": "quantile_cont(v, 0.75)", "max": "max(v)"}
    parts = [counted(n, c) for n, c in (("label", "role_type"), ("remote_status", "remote_status"), ("source", "source"))]
    parts += ["SELECT 'row_count', CAST(count(*) AS DOUBLE) FROM _p", "SELECT 'column_count', 37.0"]
    parts += [f"SELECT 'salary_avg:{n}', coalesce(CAST({e} AS DOUBLE), 0.0) FROM _p" for n, e in stats.items()]
    return with_postings(f"SELECT 'postings' AS section, name, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)})",
                         f"_p AS (SELECT role_type, coalesce(remote_status, 'unknown') AS remote_status, coalesce(source, 'unknown') AS source, {_AVG_ANY} AS v FROM postings)")


@register("a18_dataset_profile", _profile_sql())
def a18_dataset_profile(spark, sf_dir):
    """Rows, columns, distributions and description of the prepared posting frame."""
    from jobsieve.operators import model as ml
    return ml.dataset_profile({"postings": ml.feature_frame(postings(spark, sf_dir))}).withColumn("value", F.round("value", 6))


@register("a18_label_distribution", with_postings(
    "SELECT role_type, count(*) AS count FROM postings WHERE role_type IS NOT NULL GROUP BY role_type"))
def a18_label_distribution(spark, sf_dir):
    return stx.distribution(postings(spark, sf_dir), "role_type")


@register("a18_salary_describe", with_postings(
    f"""SELECT count(v) AS count, coalesce(round(avg(v), 6), 0.0) AS mean, coalesce(round(stddev_samp(v), 6), 0.0) AS std,
               coalesce(min(v), 0.0) AS min, coalesce(round(quantile_cont(v, 0.25), 6), 0.0) AS p25,
               coalesce(round(quantile_cont(v, 0.5), 6), 0.0) AS p50, coalesce(round(quantile_cont(v, 0.75), 6), 0.0) AS p75,
               coalesce(max(v), 0.0) AS max
        FROM (SELECT {_AVG_ANY} AS v FROM postings)"""))
def a18_salary_describe(spark, sf_dir):
    return stx.describe(postings(spark, sf_dir), midpoint_any())


@register("a21_work_mode_summary", with_postings(
    f"""SELECT {_WM} AS "group", count(id) AS count, round(avg(v), 6) AS avg_salary, round(median(v), 6) AS median_salary,
               round(stddev_samp(v), 6) AS salary_std
        FROM (SELECT *, {_AVG_ANY} AS v FROM postings) GROUP BY 1"""))
def a21_work_mode_summary(spark, sf_dir):
    return stx.group_summary(postings(spark, sf_dir), stx.normalized_work_mode(), midpoint_any())


_COLUMNS = ["id", "source_posting_id", "source", "source_legal_basis", "title", "company", "location", "city", "country", "federal_state", "description", "job_type",
            "employment_type", "salary_min", "salary_max", "salary_period", "salary_is_estimated", "salary_confidence", "currency", "required_skills", "posted_date",
            "posted_at", "expires_at", "last_seen_at", "is_expired", "url", "application_url", "company_career_url", "remote_status", "role_type", "occupation_group",
            "experience_level", "ingestion_batch_id"]


@register("a22_missing_counts", with_postings(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM postings""" for c in _COLUMNS)))
def a22_missing_counts(spark, sf_dir):
    return stx.missing_counts(postings(spark, sf_dir))


@register("a22_describe", with_postings(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
      round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM postings"""
    for c in ("salary_min", "salary_max", "salary_confidence"))))
def a22_describe(spark, sf_dir):
    return stx.describe_columns(postings(spark, sf_dir), ["salary_min", "salary_max", "salary_confidence"])


@register("a23_value_counts_with_null", with_postings(
    "SELECT occupation_group, count(*) AS count FROM postings GROUP BY occupation_group ORDER BY count DESC, occupation_group LIMIT 20"))
def a23_value_counts_with_null(spark, sf_dir):
    d = stx.distribution(postings(spark, sf_dir), "occupation_group", keep_null=True)
    return d.orderBy(F.col("count").desc(), F.col("occupation_group").asc_nulls_first()).limit(20)


_RO = f"(SELECT {_WM} AS g, {_AVG_ANY} AS v FROM postings) WHERE g IN ('remote', 'onsite') AND v IS NOT NULL"


@register("a24_histogram", with_postings(f"""
SELECT g AS "group", bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*) AS count FROM (
  SELECT g, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / w), 29) END AS INTEGER) AS bin, lo, w
  FROM (SELECT g, v, min(v) OVER () AS lo, (max(v) OVER () - min(v) OVER ()) / 30 AS w FROM {_RO}))
GROUP BY g, bin, lo, w"""))
def a24_histogram(spark, sf_dir):
    p = postings(spark, sf_dir).select(stx.normalized_work_mode().alias("g"), midpoint_any().alias("v")) \
        .where(F.col("g").isin("remote", "onsite"))
    return stx.histogram(p, F.col("g"), F.col("v"), 30)


@register("a24_box_stats", with_postings(f"""
SELECT g AS "group", q1, median, q3, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM (SELECT * FROM {_RO}) JOIN (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                                        quantile_cont(v, 0.75) AS q3 FROM {_RO} GROUP BY g) USING (g)
GROUP BY g, q1, median, q3"""))
def a24_box_stats(spark, sf_dir):
    p = postings(spark, sf_dir).select(stx.normalized_work_mode().alias("g"), midpoint_any().alias("v")) \
        .where(F.col("g").isin("remote", "onsite"))
    return stx.box_stats(p, F.col("g"), F.col("v"))


def _m12_sql() -> str:
    number = "coalesce('=' || CAST(CAST({c} AS DECIMAL(38, 6)) AS VARCHAR), '-')"
    text, stamp = "coalesce('=' || {c}, '-')", "coalesce('=' || strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '-')"
    kinds = [("o_orderkey", number), ("o_custkey", number), ("o_orderstatus", text), ("o_totalprice", number), ("o_orderdate", stamp), ("o_orderpriority", text)]
    row = " || chr(31) || ".join(k.format(c=c) for c, k in kinds)
    return f"SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum FROM orders"


@register("m12_dataset_fingerprint", _m12_sql())
def m12_dataset_fingerprint(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    return stx.fingerprint(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def _simpson(start: str) -> str:
    n = stx.T_STEPS
    return (f"list_sum(list_transform(range({n + 1}), lambda i: exp((dof - 1) * ln(greatest(cos(({start} + ({{top}} - {start}) / {n} * i) / sqrt(dof)), 1e-300)))"
            f" * CASE WHEN i = 0 OR i = {n} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)) * ({{top}} - {start}) / {n} / 3").replace(
        "{top}", f"least(pi() / 2 * sqrt(dof), {stx.T_WIDTH})")


@register("m13_welch_t_test", with_postings(f"""
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t_statistic, round(dof, 6) AS dof, round(p, 6) AS p_value, p < 0.05 AS significant
FROM (SELECT *, ({_simpson(f"least(atan(abs(t) / sqrt(dof)) * sqrt(dof), least(pi() / 2 * sqrt(dof), {stx.T_WIDTH}))")}) / ({_simpson("0.0")}) AS p
  FROM (SELECT *, (mean_a - mean_b) / sqrt(va + vb) AS t, (va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)) AS dof
    FROM (SELECT count(v) FILTER (WHERE g = 'remote') AS n_a, count(v) FILTER (WHERE g = 'onsite') AS n_b,
            avg(v) FILTER (WHERE g = 'remote') AS mean_a, avg(v) FILTER (WHERE g = 'onsite') AS mean_b,
            var_samp(v) FILTER (WHERE g = 'remote') / count(v) FILTER (WHERE g = 'remote') AS va,
            var_samp(v) FILTER (WHERE g = 'onsite') / count(v) FILTER (WHERE g = 'onsite') AS vb FROM {_RO})))"""))
def m13_welch_t_test(spark, sf_dir):
    p = postings(spark, sf_dir)
    r = stx.welch_t_test(p, stx.normalized_work_mode(), midpoint_any())
    return r.withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "t_statistic", "dof", "p_value")})


@register("m13_welch_t_statistic", with_postings(f"""
SELECT count(v) FILTER (WHERE g = 'remote') AS n_a, count(v) FILTER (WHERE g = 'onsite') AS n_b,
       avg(v) FILTER (WHERE g = 'remote') AS mean_a, avg(v) FILTER (WHERE g = 'onsite') AS mean_b,
       round((avg(v) FILTER (WHERE g = 'remote') - avg(v) FILTER (WHERE g = 'onsite'))
         / sqrt(var_samp(v) FILTER (WHERE g = 'remote') / count(v) FILTER (WHERE g = 'remote')
                + var_samp(v) FILTER (WHERE g = 'onsite') / count(v) FILTER (WHERE g = 'onsite')), 6) AS t_statistic
FROM {_RO}"""))
def m13_welch_t_statistic(spark, sf_dir):
    r = stx.welch_t_test(postings(spark, sf_dir), stx.normalized_work_mode(), midpoint_any())
    return r.select("n_a", "n_b", "mean_a", "mean_b", F.round("t_statistic", 6).alias("t_statistic"))


def _split(spark, sf_dir):
    p = postings(spark, sf_dir).withColumn("salary_avg", midpoint_any()).withColumn("remote_status", stx.normalized_work_mode())
    return p.where(F.col("posted_date") < F.lit(SPLIT)), p.where(F.col("posted_date") >= F.lit(SPLIT))


def _js_sql(c: str, expr: str) -> str:
    return f"""SELECT '{c}' AS feature, 'jensen_shannon' AS method, round(sqrt(greatest(0.0, (sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END)
    + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2)), 6) AS score
  FROM (SELECT p, q, (p + q) / 2 AS m FROM (SELECT count(*) FILTER (WHERE posted_date < {_SPLIT}) / (SELECT count(*) FROM postings WHERE posted_date < {_SPLIT}) AS p,
    count(*) FILTER (WHERE posted_date >= {_SPLIT}) / (SELECT count(*) FROM postings WHERE posted_date >= {_SPLIT}) AS q
    FROM postings GROUP BY coalesce({expr}, '__null__')))"""


_ANY_MID = "CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 ELSE coalesce(salary_min, salary_max) END"
_MODE = "CASE WHEN lower(remote_status) IN ('remote', 'onsite', 'hybrid') THEN lower(remote_status) ELSE 'unknown' END"
_DRIFT_SQL = with_postings("""
SELECT feature, method, score, score >= 0.1 AS drifted, round(avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END) OVER (), 6) AS share_drifted FROM (
  SELECT 'salary_avg' AS feature, 'wasserstein_normed' AS method, round(sum(abs(fa - fb) * coalesce(nv - v, 0)) / (SELECT stddev_samp(v) FROM _v WHERE a), 6) AS score
  FROM (SELECT v, sum(ca) OVER w / (SELECT count(*) FROM _v WHERE a) AS fa, sum(cb) OVER w / (SELECT count(*) FROM _v WHERE NOT a) AS fb, lead(v) OVER w AS nv
    FROM (SELECT v, count(*) FILTER (WHERE a) AS ca, count(*) FILTER (WHERE NOT a) AS cb FROM _v GROUP BY v) WINDOW w AS (ORDER BY v))
  UNION ALL """ + " UNION ALL ".join(_js_sql(c, e) for c, e in (("remote_status", _MODE), ("role_type", "role_type"), ("location", "location"), ("company", "company"))) + ")",
    f"_v AS (SELECT {_ANY_MID} AS v, posted_date < {_SPLIT} AS a FROM postings WHERE coalesce(salary_min, salary_max) IS NOT NULL)")


@register("m14_drift_report", _DRIFT_SQL)
def m14_drift_report(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return stx.drift_report(ref, cur, ["salary_avg"], ["remote_status", "role_type", "location", "company"])


@register("m14_js_distance_location", with_postings(f"""
SELECT round(sqrt(greatest(0.0, (sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END)
                               + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2)), 6) AS js_distance
FROM (SELECT p, q, (p + q) / 2 AS m FROM (
  SELECT count(*) FILTER (WHERE posted_date < {_SPLIT}) / (SELECT count(*) FROM postings WHERE posted_date < {_SPLIT}) AS p,
         count(*) FILTER (WHERE posted_date >= {_SPLIT}) / (SELECT count(*) FROM postings WHERE posted_date >= {_SPLIT}) AS q
  FROM postings GROUP BY coalesce(location, '__null__')))"""))
def m14_js_distance_location(spark, sf_dir):
    ref, cur = _split(spark, sf_dir)
    return stx.js_distance(ref, cur, "location")
