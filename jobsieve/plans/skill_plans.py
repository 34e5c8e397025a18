"""Skill analytics over the posting view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobsieve.operators import skills as sk
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import register
from jobsieve.session import scratch_path
from jobsieve.sources.files import write_csv
from jobsieve.sources.tables import AS_OF, postings

MID_NZ = ("CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_min <> 0 AND salary_max <> 0 "
          "THEN (salary_min + salary_max) / 2 END")
MID = "CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END"

_M = f"_m AS (SELECT unnest(required_skills) AS skill, {MID_NZ} AS salary FROM postings)"
_STATS = _M + """,
_s AS (
  SELECT skill, count(*) AS occurrences,
         round(count(*) / (SELECT count(*) FROM _m) * 100, 6) AS percentage,
         count(salary) AS salary_count, min(salary) AS salary_min, max(salary) AS salary_max,
         round(avg(salary), 6) AS salary_mean, round(median(salary), 6) AS salary_median,
         round(CASE WHEN count(salary) = 1 THEN 0.0 ELSE stddev_samp(salary) END, 6) AS salary_stdev,
         avg(salary) AS raw_mean
  FROM _m GROUP BY skill
)"""
_TOP = """_top AS (
  SELECT skill, occurrences AS demand, percentage AS demand_percentage, salary_mean AS average_salary,
         salary_min, salary_max
  FROM _s ORDER BY occurrences DESC, skill ASC LIMIT {n}
)"""


@register("a1_skill_stats", with_postings(
    "SELECT skill, occurrences, percentage, salary_count, salary_min, salary_max, salary_mean, salary_median, "
    "salary_stdev FROM _s", _STATS))
def a1_skill_stats(spark, sf_dir):
    return sk.skill_stats(postings(spark, sf_dir))


@register("a2_top_skills", with_postings("SELECT * FROM _top", _STATS + "," + _TOP.format(n=20)))
def a2_top_skills(spark, sf_dir):
    return sk.top_skills(postings(spark, sf_dir), top_n=20)


@register("s23_skill_report_export", with_postings("SELECT * FROM _top", _STATS + "," + _TOP.format(n=20)))
def s23_skill_report_export(spark, sf_dir):
    """The flat report as CSV, read back."""
    top, path = sk.top_skills(postings(spark, sf_dir), top_n=20), scratch_path(spark, "skill-report")
    write_csv(top, path)
    return spark.read.schema(top.schema).option("header", True).option("escape", '"').csv(path)


@register("a3_skill_categories", with_postings(
    """SELECT c.category, d.skill
       FROM (SELECT DISTINCT unnest(required_skills) AS skill FROM postings) d
       JOIN _cats c ON contains(lower(d.skill), c.kw)
       GROUP BY c.category, d.skill""",
    "_cats AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{name}', '{k.lower()}')" for name, kws in sk.SKILL_CATEGORIES for k in kws) + ") t(category, kw))"))
def a3_skill_categories(spark, sf_dir):
    return sk.skill_categories(postings(spark, sf_dir))


@register("a4_salary_premium", with_postings(
    """SELECT skill, round((SELECT avg(raw_mean) FROM _s WHERE raw_mean IS NOT NULL), 6) AS base_salary,
              round(raw_mean, 6) AS skill_salary,
              round((raw_mean - (SELECT avg(raw_mean) FROM _s WHERE raw_mean IS NOT NULL))
                    / (SELECT avg(raw_mean) FROM _s WHERE raw_mean IS NOT NULL) * 100, 6) AS premium_percentage,
              round(raw_mean - (SELECT avg(raw_mean) FROM _s WHERE raw_mean IS NOT NULL), 6) AS premium_amount
       FROM _s WHERE raw_mean IS NOT NULL""", _STATS))
def a4_salary_premium(spark, sf_dir):
    return sk.salary_premium(postings(spark, sf_dir))


@register("a5_trending_skills", with_postings(
    "SELECT * FROM _top WHERE demand >= 5 ORDER BY demand DESC, skill LIMIT 10", _STATS + "," + _TOP.format(n=20)))
def a5_trending_skills(spark, sf_dir):
    return sk.trending_skills(postings(spark, sf_dir), min_occurrences=5, top_n=10)


@register("a6_skill_totals", with_postings(
    "SELECT (SELECT count(*) FROM postings) AS total_jobs, "
    "(SELECT count(DISTINCT s) FROM (SELECT unnest(required_skills) AS s FROM postings)) AS unique_skills"))
def a6_skill_totals(spark, sf_dir):
    return sk.totals(postings(spark, sf_dir))


def _a7_sql() -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'"
    rule, dash = "=" * 60, "-" * 60
    head = [rule, "SKILL DEMAND ANALYSIS REPORT", rule, "", "SUMMARY", dash, None, None,
            f"Report Generated: {AS_OF.isoformat()}", "", "TOP 10 SKILLS BY DEMAND", dash]
    head_sql = " UNION ALL ".join(
        f"SELECT {i + 1} AS line_no, " + (lit(v) if v is not None else
                                          ("printf('Total Jobs Analyzed: %d', total_jobs)" if i == 6 else
                                           "printf('Unique Skills Found: %d', unique_skills)")) + " AS line FROM _tot"
        for i, v in enumerate(head))
    return with_postings(f"""
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  {head_sql}
  UNION ALL
  SELECT r + 12, printf('%2d. %-30s | Demand: %4d (%5.1f%%)', r, skill, demand, round_even(demand_percentage, 1))
         || CASE WHEN average_salary IS NOT NULL AND average_salary <> 0
                 THEN ' | Avg Salary: $' || printf('%,d', CAST(round_even(average_salary, 0) AS BIGINT)) ELSE '' END
  FROM (SELECT *, row_number() OVER (ORDER BY demand DESC, skill) AS r FROM _top)
  UNION ALL
  SELECT 12 + (SELECT count(*) FROM _top) + row_number() OVER (ORDER BY sec, c, part), line FROM (
    SELECT 0 AS sec, 0 AS c, 0 AS part, '' AS line
    UNION ALL SELECT 1, 0, 0, 'SKILL CATEGORIES' FROM (SELECT 1 FROM _found LIMIT 1) UNION ALL SELECT 1, 0, 1, '{dash}' FROM (SELECT 1 FROM _found LIMIT 1)
    UNION ALL SELECT 2, c, 0, category || ': ' || string_agg(skill, ', ' ORDER BY skill) FROM _found WHERE rn <= 5 GROUP BY c, category
    UNION ALL SELECT 2, c, 1, '  ... and ' || (count(*) - 5) || ' more' FROM _found GROUP BY c HAVING count(*) > 5
    UNION ALL SELECT 3, 0, 0, '' FROM (SELECT 1 FROM _found LIMIT 1)
    UNION ALL SELECT 4, 0, 0, '{rule}'))""",
        _STATS + "," + _TOP.format(n=10) + ",_cats AS (SELECT * FROM (VALUES " + ", ".join(
            f"({i}, '{name}', '{k.lower()}')" for i, (name, kws) in enumerate(sk.SKILL_CATEGORIES) for k in kws) + """) t(c, category, kw)),
_found AS (SELECT c, category, skill, row_number() OVER (PARTITION BY c ORDER BY skill) AS rn FROM (SELECT DISTINCT c, category, skill
    FROM (SELECT DISTINCT unnest(required_skills) AS skill FROM postings) d JOIN _cats ON contains(lower(skill), kw))),""" + """
_tot AS (SELECT (SELECT count(*) FROM postings) AS total_jobs,
                (SELECT count(DISTINCT s) FROM (SELECT unnest(required_skills) AS s FROM postings)) AS unique_skills)""")


@register("a7_skill_report", _a7_sql())
def a7_skill_report(spark, sf_dir):
    return sk.skill_report_lines(postings(spark, sf_dir), as_of=AS_OF.isoformat())


@register("a8_load_statistics", with_postings(
    f"""SELECT count(*) AS total_jobs, count(DISTINCT location) AS locations, count(DISTINCT company) AS companies,
              (SELECT count(DISTINCT s) FROM (SELECT unnest(required_skills) AS s FROM postings)) AS unique_skills,
              count({MID}) AS salary_count, round(avg({MID}), 6) AS salary_mean,
              round(median({MID}), 6) AS salary_median, min({MID}) AS salary_min, max({MID}) AS salary_max
       FROM postings"""))
def a8_load_statistics(spark, sf_dir):
    return sk.load_statistics(postings(spark, sf_dir))


@register("a8_source_counts", with_postings(
    "SELECT source, count(*) AS count FROM postings WHERE source IS NOT NULL GROUP BY source"))
def a8_source_counts(spark, sf_dir):
    return sk.count_by(postings(spark, sf_dir), "source")


@register("a8_top10_skills", with_postings(
    "SELECT skill, count(*) AS count FROM (SELECT unnest(required_skills) AS skill FROM postings) "
    "GROUP BY skill ORDER BY count DESC, skill LIMIT 10"))
def a8_top10_skills(spark, sf_dir):
    p = postings(spark, sf_dir)
    return sk.most_common(p.select(F.explode("required_skills").alias("skill")), "skill", 10)


# Related skills of the most demanded skill (chosen from the data, ties by name).
_TOP1 = "(SELECT skill FROM _s ORDER BY occurrences DESC, skill LIMIT 1)"


@register("j4_related_skills", with_postings(
    f"""SELECT skill, count(*) AS co_occurrences
        FROM (SELECT unnest(required_skills) AS skill FROM postings WHERE list_contains(required_skills, {_TOP1}))
        WHERE skill <> {_TOP1}
        GROUP BY skill HAVING count(*) >= 2""", _STATS))
def j4_related_skills(spark, sf_dir):
    p = postings(spark, sf_dir)
    top1 = (
        p.select(F.explode("required_skills").alias("skill")).groupBy("skill").count()
        .orderBy(F.col("count").desc(), F.col("skill")).limit(1).select("skill").scalar()
    )
    return sk.related_skills(p, top1, threshold=2)


# Growth between two consecutive one-year periods ending at the as-of instant.
_P1 = (dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1))
_P0 = (dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1))


def _period_sql(lo, hi):
    return f"posted_date >= TIMESTAMP '{lo:%Y-%m-%d %H:%M:%S}' AND posted_date < TIMESTAMP '{hi:%Y-%m-%d %H:%M:%S}'"


@register("j5_skill_growth", with_postings(
    f"""SELECT c.skill, c.current_count, p.previous_count,
               round((c.current_count - p.previous_count) / p.previous_count * 100, 6) AS growth_pct
        FROM (SELECT skill, count(*) AS current_count FROM
                (SELECT unnest(required_skills) AS skill FROM postings WHERE {_period_sql(*_P1)}) GROUP BY skill) c
        JOIN (SELECT skill, count(*) AS previous_count FROM
                (SELECT unnest(required_skills) AS skill FROM postings WHERE {_period_sql(*_P0)}) GROUP BY skill) p
        ON c.skill = p.skill"""))
def j5_skill_growth(spark, sf_dir):
    p = postings(spark, sf_dir)
    ts = F.col("posted_date")
    cur = p.where((ts >= F.lit(_P1[0])) & (ts < F.lit(_P1[1])))
    prev = p.where((ts >= F.lit(_P0[0])) & (ts < F.lit(_P0[1])))
    return sk.skill_growth(cur, prev)
