"""Question plans over conversations and the posting view."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint
from jobsieve.operators import model as ml
from jobsieve.operators import questions as qu
from jobsieve.operators import salary as sal
from jobsieve.operators import skills as sk
from jobsieve.plans.oracle_base import QUESTIONS_CTE
from jobsieve.plans.registry import register
from jobsieve.sources.tables import postings, questions, table

_Q = "lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


def _any(phrases):
    return "(" + " OR ".join(f"contains({_Q}, '{p}')" for p in phrases) + ")"


_INTENT = f"""CASE WHEN {_any(qu.TOP_SKILL_PHRASES)} OR (contains({_Q}, 'top') AND contains({_Q}, 'skills')) THEN 'top_skills'
     WHEN {_any(qu.ANOMALY_PHRASES)} THEN 'salary_anomalies' WHEN contains({_Q}, 'salary') THEN 'salary_range'
     WHEN {_any(qu.PREDICT_PHRASES)} THEN 'predicted_roles' WHEN contains({_Q}, 'remote') THEN 'remote_summary'
     WHEN {_any(qu.COUNT_PHRASES)} THEN 'job_count' ELSE 'summary' END"""


@register("n1_n2_question_parse", f"""
WITH {QUESTIONS_CTE}
SELECT conv_id, turn, asked, {_INTENT} AS intent,
       CASE WHEN regexp_extract({_Q}, 'top\\s+(\\d+)', 1) <> '' THEN CAST(regexp_extract({_Q}, 'top\\s+(\\d+)', 1) AS INTEGER) ELSE 5 END AS top_n,
       array_to_string(list_transform(regexp_extract_all(text, '''[^'']+''|"[^"]+"', 0), lambda m: substr(m, 2, length(m) - 2)), '|') AS entities
FROM _questions""")
def n1_n2_question_parse(spark, sf_dir):
    c = questions(spark, sf_dir)
    return c.select("conv_id", "turn", "asked", qu.intent(F.col("text")).alias("intent"), qu.top_n(F.col("text")).alias("top_n"),
                    F.array_join(qu.entities(F.col("text")), "|").alias("entities"))


@register("n4_n6_route_and_job_id", "WITH " + QUESTIONS_CTE + """
SELECT conv_id, turn, asked,
       CASE WHEN contains(lower(text), 'salary') AND (contains(lower(text), 'anomal') OR contains(lower(text), 'outlier')
            OR contains(lower(text), 'flag')) THEN 'explain_salary_anomaly' ELSE 'general_market_question' END AS route,
       CASE WHEN len(regexp_extract_all(text, '''[^'']+''|"[^"]+"', 0)) > 0
            THEN substr(regexp_extract_all(text, '''[^'']+''|"[^"]+"', 0)[1], 2, length(regexp_extract_all(text, '''[^'']+''|"[^"]+"', 0)[1]) - 2)
            WHEN regexp_extract(text, '(?i)\\b(?:job[_\\s-]?id|id)\\s*[:=]?\\s*([A-Za-z0-9_-]+)', 1) <> ''
            THEN regexp_extract(text, '(?i)\\b(?:job[_\\s-]?id|id)\\s*[:=]?\\s*([A-Za-z0-9_-]+)', 1) END AS job_id
FROM _questions""")
def n4_n6_route_and_job_id(spark, sf_dir):
    c = questions(spark, sf_dir)
    return c.select("conv_id", "turn", "asked", qu.route(F.col("text")).alias("route"), qu.job_id(F.col("text")).alias("job_id"))


def _n3_sql() -> str:
    from jobsieve.plans import salary_plans, skill_plans  # noqa: F401  (register the SQL used below)
    from jobsieve.plans.oracle_base import with_postings
    from jobsieve.plans.registry import ORACLE

    def money(c):
        return f"printf('%,d', CAST(round_even({c}, 0) AS BIGINT)) || ' EUR'"
    return with_postings(f"""
SELECT conv_id, turn, asked, intent, CASE
    WHEN intent = 'salary_range' AND hit.role IS NOT NULL THEN hit.role || ' currently ranges from ' || {money('hit.lo')} || ' to '
         || {money('hit.hi')} || ', with a median of ' || {money('hit.med')} || '.'
    WHEN intent = 'salary_range' AND coalesce(entity, '') <> '' THEN '{qu.NO_ROLE_TEXT}'
    WHEN intent = 'predicted_roles' THEN 'Projected in-demand roles: ' || (SELECT string_agg(role || ' (' || printf('%.1f', idx) || ')', ', ' ORDER BY idx DESC, role)
         FROM _ahead WHERE rn <= top_n) || '.'
    WHEN intent = 'top_skills' THEN 'Top skills right now: ' || (SELECT string_agg(skill || ' (' || demand || ')', ', ' ORDER BY demand DESC, skill)
         FROM _ranked WHERE rn <= top_n) || '.'
    WHEN intent = 'salary_anomalies' THEN (SELECT CASE WHEN count(*) = 0 THEN 'No salary anomalies were detected in the current dataset.'
         ELSE 'I found ' || count(*) || ' salary anomalies in the current dataset.' END FROM ({ORACLE["j6_anomalies_events"]}))
    WHEN intent = 'remote_summary' THEN 'There are ' || (SELECT count(*) FROM postings WHERE lower(remote_status) = 'remote') || ' remote jobs out of '
         || (SELECT count(*) FROM postings) || ' jobs in the current dataset.'
    WHEN intent = 'job_count' THEN 'The current dataset contains ' || (SELECT count(*) FROM postings) || ' jobs.'
    ELSE '{qu.SUMMARY_TEXT}' END AS answer
FROM _asked LEFT JOIN _hit hit USING (entity)""", f"""{QUESTIONS_CTE},
_asked AS (SELECT conv_id, turn, asked, {_INTENT} AS intent,
    CASE WHEN regexp_extract({_Q}, 'top\\s+(\\d+)', 1) <> '' THEN CAST(regexp_extract({_Q}, 'top\\s+(\\d+)', 1) AS INTEGER) ELSE 5 END AS top_n,
    list_transform(regexp_extract_all(text, '''[^'']+''|"[^"]+"', 0), lambda m: substr(m, 2, length(m) - 2))[1] AS entity FROM _questions),
_roles AS (SELECT coalesce(title, 'Unknown Role') AS role, min(v) AS lo, max(v) AS hi, median(v) AS med
    FROM (SELECT title, (salary_min + salary_max) / 2 AS v FROM postings) WHERE v IS NOT NULL GROUP BY 1),
_hit AS (SELECT entity, role, lo, hi, med FROM (SELECT entity, min(role) AS role FROM (SELECT DISTINCT entity FROM _asked WHERE intent = 'salary_range' AND entity <> '') a
    JOIN _roles ON contains(lower(role), lower(entity)) GROUP BY entity) JOIN _roles USING (role)),
_ahead AS (SELECT role, idx, row_number() OVER (ORDER BY idx DESC, role) AS rn FROM (SELECT role_type AS role, count(*) * 1.08::DOUBLE AS idx FROM postings GROUP BY 1)
    ORDER BY idx DESC, role LIMIT 10),
_ranked AS (SELECT skill, demand, row_number() OVER (ORDER BY demand DESC, skill) AS rn FROM ({ORACLE["a2_top_skills"]}))""")


@register("n3_answers", _n3_sql())
def n3_answers(spark, sf_dir):
    p = postings(spark, sf_dir)
    ev = table(spark, sf_dir, "events")
    anomalies = sal.salary_anomalies(ev, "event_id", F.col("event_type"), F.col("value"))
    n_anom = anomalies.select(F.count(F.lit(1))).scalar()
    counts = p.agg(F.struct(F.count_if(F.lower("remote_status") == "remote").alias("remote"), F.count(F.lit(1)).alias("total"))).scalar()
    roles = sal.role_salaries(p)
    ahead = ml.forecast(p.withColumn("confidence", F.lit(1.0)), "role_type")
    a = qu.answers(questions(spark, sf_dir), "text", sk.top_skills(p, 20), n_anom, counts, roles, ahead)
    return a.select("conv_id", "turn", "asked", "intent", "answer")


def _j11_sql() -> str:
    from jobsieve.plans import salary_plans  # noqa: F401  (registers the J6 and A19 oracle SQL used below)
    from jobsieve.plans.oracle_base import with_postings
    from jobsieve.plans.registry import ORACLE

    def money(c):
        return f"'$' || printf('%,d', CAST(round_even({c}, 0) AS BIGINT))"
    title, company = "coalesce(p.title, 'this role')", "coalesce(p.company, 'the company')"
    pct = "c.percent_difference_from_median"
    comparison = (f"CASE WHEN c.dataset_median_salary IS NOT NULL AND {pct} IS NOT NULL THEN ' Its midpoint salary is ' || "
                  f"{money('c.target_salary')} || ', which is ' || printf('%.1f', round_even(abs({pct}), 1)) || '% ' || "
                  f"CASE WHEN {pct} >= 0 THEN 'above' ELSE 'below' END || ' the dataset median of ' || "
                  f"{money('c.dataset_median_salary')} || '.' ELSE '' END")
    return with_postings(f"""
SELECT p.id AS job_id, a.job_id IS NOT NULL AS is_flagged,
       CASE WHEN c.target_salary IS NULL THEN 'I cannot explain a salary anomaly for ' || {title} || ' at ' || {company}
                 || ' because the posting does not include both salary bounds.'
            WHEN a.job_id IS NULL THEN {title} || ' at ' || {company}
                 || ' was not flagged as a salary anomaly by the current detector.' || {comparison}
            ELSE 'The salary for ' || {title} || ' at ' || {company} || ' was flagged because it matched the detector reason(s): '
                 || replace(a.reasons, ',', ', ') || '.' || {comparison}
                 || ' The expected interquartile range for the relevant comparison group is roughly '
                 || {money('a.expected_min')} || ' to ' || {money('a.expected_max')} || '.' END AS answer
FROM postings p LEFT JOIN ({ORACLE["j6_anomalies_postings"]}) a ON p.id = a.job_id
LEFT JOIN ({ORACLE["a19_salary_context"]}) c ON p.id = c.job_id""")


@register("j11_n5_salary_explanations", _j11_sql())
def j11_n5_salary_explanations(spark, sf_dir):
    p = postings(spark, sf_dir)
    an = sal.salary_anomalies(p, "id", F.coalesce("title", F.lit("Unknown Role")), midpoint())
    ctx = sal.salary_context(p)
    return qu.explain_salaries(p, an, ctx)
