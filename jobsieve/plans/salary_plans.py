"""Salary plans: role stats, anomalies (postings and events), estimates, filters, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.functions import salary as S
from jobsieve.operators import salary as sal
from jobsieve.plans.oracle_base import POSTINGS_CTE, with_postings
from jobsieve.plans.registry import register
from jobsieve.sources.tables import postings, table

MID = "CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END"


def _fq(col, f):
    return f"list_sort(list({col}))[CAST(floor((count(*) - 1) * {f}) AS BIGINT) + 1]"


_ROLE_STATS_SQL = with_postings(
    f"""SELECT role, min(v) AS "min", max(v) AS "max", median(v) AS median, count(*) AS "count",
               {_fq('v', 0.25)} AS q1, {_fq('v', 0.75)} AS q3
        FROM (SELECT coalesce(title, 'Unknown Role') AS role, {MID} AS v FROM postings) WHERE v IS NOT NULL
        GROUP BY role""")


@register("a9_role_salary_stats", _ROLE_STATS_SQL)
def a9_role_salary_stats(spark, sf_dir):
    p = postings(spark, sf_dir).select(F.coalesce("title", F.lit("Unknown Role")).alias("role"), S.midpoint().alias("v"))
    return sal.group_salary_stats(p, "role", "v")


@register("w2_event_value_quantiles",
          f"SELECT event_type, {_fq('value', 0.25)} AS q1, {_fq('value', 0.5)} AS q2, {_fq('value', 0.75)} AS q3, "
          f"{_fq('value', 0.9)} AS p90 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def w2_event_value_quantiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return sal.floor_quantiles(ev, ["event_type"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9})


def _anomaly_sql(src: str, idc: str, rolec: str, valc: str, role_filter: str = "TRUE") -> str:
    return f"""
WITH _b AS (SELECT {idc} AS job_id, {rolec} AS role, {valc} AS salary_avg FROM {src}
            WHERE {valc} IS NOT NULL AND {role_filter}),
_o AS (SELECT {_fq('salary_avg', 0.25)} AS oq1, {_fq('salary_avg', 0.75)} AS oq3 FROM _b),
_r AS (SELECT role, count(*) AS cnt, {_fq('salary_avg', 0.25)} AS q1, {_fq('salary_avg', 0.75)} AS q3
       FROM _b GROUP BY role),
_j AS (
  SELECT b.job_id, b.role, b.salary_avg, r.q1, r.q3,
         (b.salary_avg > o.oq3 + CASE WHEN o.oq3 - o.oq1 <> 0 THEN (o.oq3 - o.oq1) * 1.5 ELSE 15000.0 END
          OR b.salary_avg < o.oq1 - CASE WHEN o.oq3 - o.oq1 <> 0 THEN (o.oq3 - o.oq1) * 1.5 ELSE 15000.0 END) AS ov,
         (r.cnt >= 4 AND (b.salary_avg > r.q3 + CASE WHEN r.q3 - r.q1 <> 0 THEN (r.q3 - r.q1) * 1.5 ELSE 0.0 END
          OR b.salary_avg < r.q1 - CASE WHEN r.q3 - r.q1 <> 0 THEN (r.q3 - r.q1) * 1.5 ELSE 0.0 END)) AS ro
  FROM _b b JOIN _r r ON b.role = r.role CROSS JOIN _o o
)
SELECT job_id, role AS title, salary_avg, q1 AS expected_min, q3 AS expected_max,
       concat_ws(',', CASE WHEN ov THEN 'overall_outlier' END, CASE WHEN ro THEN 'role_outlier' END) AS reasons
FROM _j WHERE ov OR ro"""


def _flat(df):
    return df.withColumn("reasons", F.array_join("reasons", ","))


@register("j6_anomalies_events", _anomaly_sql("events", "event_id", "event_type", "value"))
def j6_anomalies_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return _flat(sal.salary_anomalies(ev, "event_id", F.col("event_type"), F.col("value")))


@register("j6_anomalies_postings", with_postings(
    "SELECT * FROM _an", "_an AS (" + _anomaly_sql("postings", "id", "coalesce(title, 'Unknown Role')", f"({MID})") + ")"))
def j6_anomalies_postings(spark, sf_dir):
    p = postings(spark, sf_dir)
    return _flat(sal.salary_anomalies(p, "id", F.coalesce("title", F.lit("Unknown Role")), S.midpoint()))


@register("f8_role_filtered_anomalies_events",
          _anomaly_sql("events", "event_id", "event_type", "value", "lower(event_type) LIKE '%purchase%'"))
def f8_role_filtered_anomalies_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.lower("event_type").contains("purchase"))
    return _flat(sal.salary_anomalies(ev, "event_id", F.col("event_type"), F.col("value")))


@register("a10_salary_range_for_role", with_postings(
    f"""SELECT * FROM (
          SELECT role, min(v) AS "min", max(v) AS "max", median(v) AS median, count(*) AS "count"
          FROM (SELECT coalesce(title, 'Unknown Role') AS role, {MID} AS v FROM postings) WHERE v IS NOT NULL
          GROUP BY role HAVING contains(lower(role), 'economy') ORDER BY role LIMIT 1)"""))
def a10_salary_range_for_role(spark, sf_dir):
    return sal.salary_range_for(postings(spark, sf_dir), "Economy")


_EST_COLS = ("id", "eff_salary_min", "eff_salary_max", "salary_midpoint", "salary_label", "salary_type",
             "eff_salary_is_estimated", "eff_salary_confidence", "salary_estimation_basis")


def _k(c):
    return f"lower(coalesce({c}, ''))"


def _estimate_sql(src: str = "postings") -> str:
    """J2 over relation ``src`` (its listed rows are the peers)."""
    rungs = []
    for i, (_, _, cols) in enumerate(sal.RUNGS):
        keys = ", ".join(f"{_k(c)} AS k_{c}" for c in cols)
        gb = ", ".join(_k(c) for c in cols)
        rungs.append(
            f"_r{i} AS (SELECT {keys}, sum(salary_min) AS s_lo, sum(salary_max) AS s_hi, count(*) AS n FROM {src} "
            f"WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL AND NOT coalesce(salary_is_estimated, FALSE) "
            f"GROUP BY {gb})")
    joins = "\n".join(
        f"LEFT JOIN _r{i} ON " + " AND ".join(f"{_k('p.' + c)} = _r{i}.k_{c}" for c in cols)
        for i, (_, _, cols) in enumerate(sal.RUNGS))
    n = "coalesce(" + ", ".join(f"_r{i}.n" for i in range(5)) + ")"
    lo = "coalesce(" + ", ".join(f"_r{i}.s_lo / _r{i}.n" for i in range(5)) + ")"
    hi = "coalesce(" + ", ".join(f"_r{i}.s_hi / _r{i}.n" for i in range(5)) + ")"
    basis = "coalesce(" + ", ".join(f"CASE WHEN _r{i}.n IS NOT NULL THEN '{b}' END" for i, (b, _, _) in enumerate(sal.RUNGS)) + ")"
    conf0 = "coalesce(" + ", ".join(f"CASE WHEN _r{i}.n IS NOT NULL THEN {c} END" for i, (_, c, _) in enumerate(sal.RUNGS)) + ")"
    lvl = "lower(coalesce(p.experience_level, ''))"
    loc = "lower(coalesce(p.location, ''))"
    expm = (f"CASE WHEN {lvl} IN ('entry', 'junior', 'trainee') THEN 0.9 WHEN {lvl} IN ('senior', 'lead', 'manager') "
            f"THEN 1.12 ELSE 1.0 END")
    locm = ("CASE WHEN " + " OR ".join(f"contains({loc}, '{c}')" for c in S.HIGH_COST_CITIES) + " THEN 1.05 WHEN "
            + " OR ".join(f"contains({loc}, '{c}')" for c in S.LOW_COST_CITIES) + " THEN 0.95 ELSE 1.0 END")
    body = f"""
, _e AS (
  SELECT p.*, {n} AS en,
         {lo} * CASE WHEN {basis} IN ('role type', 'occupation group') THEN CAST({expm} AS DOUBLE) * CAST({locm} AS DOUBLE) ELSE 1.0 END AS elo,
         {hi} * CASE WHEN {basis} IN ('role type', 'occupation group') THEN CAST({expm} AS DOUBLE) * CAST({locm} AS DOUBLE) ELSE 1.0 END AS ehi,
         {basis} AS basis, CAST({conf0} AS DOUBLE) AS conf0,
         (p.salary_min IS NOT NULL AND p.salary_max IS NOT NULL) AS has_mid
  FROM {src} p
  {joins}
), _f AS (
  SELECT *, (NOT has_mid AND en IS NOT NULL) AS estimable FROM _e
)
SELECT id,
  CASE WHEN has_mid THEN salary_min WHEN estimable THEN round_even(elo, -2) END AS eff_salary_min,
  CASE WHEN has_mid THEN salary_max WHEN estimable THEN round_even(ehi, -2) END AS eff_salary_max,
  CASE WHEN has_mid THEN (salary_min + salary_max) / 2 WHEN estimable THEN round_even((elo + ehi) / 2, 2) END AS salary_midpoint,
  CASE WHEN has_mid THEN CASE WHEN salary_is_estimated THEN 'Estimated ' ELSE '' END || printf('%,d', CAST(trunc(salary_min) AS BIGINT)) || '-' || printf('%,d', CAST(trunc(salary_max) AS BIGINT)) || ' EUR'
       WHEN estimable THEN 'Estimated ' || printf('%,d', CAST(trunc(round_even(elo, -2)) AS BIGINT)) || '-' || printf('%,d', CAST(trunc(round_even(ehi, -2)) AS BIGINT)) || ' EUR'
       ELSE 'Salary not listed' END AS salary_label,
  CASE WHEN has_mid AND salary_is_estimated THEN 'estimated' WHEN has_mid THEN 'listed' WHEN estimable THEN 'estimated' ELSE 'missing' END AS salary_type,
  CASE WHEN has_mid THEN salary_is_estimated ELSE estimable END AS eff_salary_is_estimated,
  CASE WHEN has_mid AND salary_is_estimated THEN salary_confidence WHEN has_mid THEN 1.0 WHEN estimable THEN round_even(least(conf0 + least(en, 5) * 0.02, 0.9), 2) END AS eff_salary_confidence,
  CASE WHEN has_mid THEN NULL WHEN estimable THEN basis END AS salary_estimation_basis
FROM _f"""
    return "WITH " + POSTINGS_CTE + ",\n" + ",\n".join(rungs) + body


ESTIMATE_SQL = _estimate_sql()


@register("j2_salary_estimates", ESTIMATE_SQL)
def j2_salary_estimates(spark, sf_dir):
    return sal.estimate_salaries(postings(spark, sf_dir)).select(*_EST_COLS)


@register("f2_salary_range_filter",
          f"SELECT * FROM ({ESTIMATE_SQL}) WHERE salary_midpoint >= 150000 AND salary_midpoint <= 300000")
def f2_salary_range_filter(spark, sf_dir):
    e = sal.estimate_salaries(postings(spark, sf_dir))
    return sal.salary_range_filter(e, 150000, 300000).select(*_EST_COLS)


@register("a19_salary_context", with_postings(
    f"""SELECT id AS job_id, {MID} AS target_salary,
               (SELECT count({MID}) FROM postings) AS dataset_salary_count,
               CASE WHEN {MID} IS NOT NULL THEN (SELECT median({MID}) FROM postings) END AS dataset_median_salary,
               CASE WHEN {MID} IS NOT NULL THEN round((SELECT avg({MID}) FROM postings), 6) END AS dataset_mean_salary,
               round(CASE WHEN {MID} IS NULL THEN NULL
                          ELSE ({MID} - (SELECT median({MID}) FROM postings)) / (SELECT median({MID}) FROM postings) * 100 END, 6)
                 AS percent_difference_from_median
        FROM postings"""))
def a19_salary_context(spark, sf_dir):
    return sal.salary_context(postings(spark, sf_dir))
