"""Filter, lookup, facet, paging and similarity plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.operators import search as se
from jobsieve.operators import similar as si
from jobsieve.operators.maintain import expire
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import register
from jobsieve.sources.tables import AS_OF, postings

_ASOF = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
# postings after the expiry sweep at the as-of instant
_SWEPT = f"""_swept AS (
  SELECT * EXCLUDE (is_expired),
         (is_expired OR (expires_at IS NOT NULL AND expires_at < {_ASOF})) AS is_expired
  FROM postings)"""


def _swept(spark, sf_dir):
    return expire(postings(spark, sf_dir), AS_OF)


@register("f1_structured_filter", with_postings(
    """SELECT id, title, company, location, remote_status FROM postings
       WHERE contains(lower(coalesce(location, '')), 'nation_1') AND lower(coalesce(remote_status, '')) = 'remote'
         AND contains(lower(coalesce(role_type, '')), 'build')"""))
def f1_structured_filter(spark, sf_dir):
    p = postings(spark, sf_dir)
    return se.filter_jobs(p, location="NATION_1", work_mode="remote", role_type="build") \
        .select("id", "title", "company", "location", "remote_status")


def _pd(c="posted_date"):
    return c


@register("f3_repository_query", with_postings(
    """SELECT id, title, CAST(posted_date AS VARCHAR) AS posted_date FROM _swept
       WHERE NOT is_expired
         AND (contains(lower(coalesce(location, '')), 'nation_2') OR contains(lower(coalesce(city, '')), 'nation_2')
              OR contains(lower(coalesce(federal_state, '')), 'nation_2'))
         AND (contains(lower(coalesce(title, '')), 'ring') OR contains(lower(coalesce(company, '')), 'ring')
              OR contains(lower(coalesce(location, '')), 'ring') OR contains(lower(coalesce(description, '')), 'ring')
              OR contains(lower(coalesce(role_type, '')), 'ring') OR contains(lower(coalesce(job_type, '')), 'ring')
              OR contains(lower(coalesce(CASE WHEN len(required_skills) > 0
                     THEN '["' || array_to_string(required_skills, '", "') || '"]' END, '')), 'ring'))
       ORDER BY posted_date DESC NULLS LAST, title ASC NULLS FIRST, id LIMIT 50""", _SWEPT))
def f3_repository_query(spark, sf_dir):
    r = se.repository_query(_swept(spark, sf_dir), query="ring", location="NATION_2", limit=50)
    return r.select("id", "title", F.col("posted_date").cast("string").alias("posted_date"))


@register("f4_active_postings", with_postings(
    "SELECT id, CAST(expires_at AS VARCHAR) AS expires_at FROM _swept WHERE NOT is_expired", _SWEPT))
def f4_active_postings(spark, sf_dir):
    return se.active(_swept(spark, sf_dir)).select("id", F.col("expires_at").cast("string").alias("expires_at"))


@register("f5_lookup_by_id", with_postings(
    "SELECT id, title, company, location FROM postings WHERE id = '4242'"))
def f5_lookup_by_id(spark, sf_dir):
    return se.lookup(postings(spark, sf_dir), "4242", include_expired=True).select("id", "title", "company", "location")


@register("f6_recent_postings", with_postings(
    f"""SELECT id, CAST(posted_date AS VARCHAR) AS posted_date FROM postings
        WHERE posted_date >= {_ASOF} - INTERVAL 90 DAY ORDER BY posted_date DESC, id LIMIT 100"""))
def f6_recent_postings(spark, sf_dir):
    r = se.recent(postings(spark, sf_dir), AS_OF, days=90, limit=100)
    return r.select("id", F.col("posted_date").cast("string").alias("posted_date"))


@register("f7_title_contains", with_postings(
    "SELECT id, title FROM postings WHERE contains(lower(title), 'small') ORDER BY id LIMIT 50"))
def f7_title_contains(spark, sf_dir):
    return se.by_title(postings(spark, sf_dir), "Small", 50).select("id", "title")


@register("a11_facets", with_postings(
    """SELECT facet, value, count(*) AS count FROM (
         SELECT 'locations' AS facet, location AS value FROM _swept WHERE NOT is_expired
         UNION ALL SELECT 'role_types', role_type FROM _swept WHERE NOT is_expired
         UNION ALL SELECT 'companies', company FROM _swept WHERE NOT is_expired
         UNION ALL SELECT 'work_modes', remote_status FROM _swept WHERE NOT is_expired
         UNION ALL SELECT 'job_types', job_type FROM _swept WHERE NOT is_expired)
       WHERE value IS NOT NULL AND value <> '' GROUP BY facet, value""", _SWEPT))
def a11_facets(spark, sf_dir):
    return se.facets(se.active(_swept(spark, sf_dir)))


@register("a11_facet_totals", with_postings(
    """SELECT count(*) AS total_jobs,
              min(CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END) AS salary_min,
              max(CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END) AS salary_max
       FROM _swept WHERE NOT is_expired""", _SWEPT))
def a11_facet_totals(spark, sf_dir):
    return se.facet_totals(se.active(_swept(spark, sf_dir)))


@register("a16_count_by_location", with_postings(
    "SELECT location, count(id) AS count FROM postings GROUP BY location"))
def a16_count_by_location(spark, sf_dir):
    return se.count_by_location(postings(spark, sf_dir))


@register("w7_page_info", with_postings(
    """SELECT count(*) AS total, 3 AS page, 25 AS per_page,
              CAST(CASE WHEN count(*) > 0 THEN ceil(count(*) / 25) ELSE 0 END AS BIGINT) AS total_pages
       FROM postings WHERE contains(lower(location), 'nation_3')"""))
def w7_page_info(spark, sf_dir):
    return se.page_info(se.filter_jobs(postings(spark, sf_dir), location="NATION_3"), 3, 25)


@register("w6_w7_sorted_page", with_postings(
    """SELECT id, company, CAST(posted_date AS VARCHAR) AS posted_date FROM postings
       ORDER BY coalesce(company, '') ASC, coalesce(CAST(posted_date AS VARCHAR), '') ASC, coalesce(title, '') ASC, id ASC
       LIMIT 25 OFFSET 50"""))
def w6_w7_sorted_page(spark, sf_dir):
    o = se.order_results(postings(spark, sf_dir), "company")
    return se.page(o, 3, 25).select("id", "company", F.col("posted_date").cast("string").alias("posted_date"))


_TARGETS = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"]


def _similar_sql(extra_terms: str | None = None) -> str:
    ids = ", ".join(f"'{t}'" for t in _TARGETS)
    parts = [f"CASE WHEN t.{k} IS NOT NULL AND CAST(t.{k} AS VARCHAR) <> '' AND t.{k} = c.{k} THEN {p} ELSE 0 END"
             for k, p in si.POINTS]
    parts.append("len(list_intersect(list_distinct(list_transform(t.required_skills, lambda x: lower(x))), "
                 "list_distinct(list_transform(c.required_skills, lambda x: lower(x)))))")
    if extra_terms:
        parts.append(f"len(list_intersect(list_distinct(list_transform(t.{extra_terms}, lambda x: lower(x))), "
                     f"list_distinct(list_transform(c.{extra_terms}, lambda x: lower(x)))))")
    return f"""SELECT target_id, rank, id, title, score FROM (
      SELECT target_id, cand_id AS id, title, score,
             CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, coalesce(title, ''), cand_id) AS INTEGER) AS rank
      FROM (SELECT t.id AS target_id, c.id AS cand_id, c.title, CAST({' + '.join(parts)} AS BIGINT) AS score
            FROM (SELECT * FROM _cand WHERE id IN ({ids})) t, _cand c WHERE t.id <> c.id)
      WHERE score > 0) WHERE rank <= 5"""


@register("j3_similar_jobs", with_postings(_similar_sql(), "_cand AS (SELECT * FROM postings)"))
def j3_similar_jobs(spark, sf_dir):
    # the target ids are the request parameter; the candidate scan is the whole table
    return si.similar_jobs(postings(spark, sf_dir), _TARGETS, limit=5)


@register("j8_market_context", with_postings(
    """SELECT p.id, p.role_type, coalesce(r.n, 0) AS same_role_count, coalesce(l.n, 0) AS same_location_count,
              r.avg_mid AS role_average_salary, '/jobs/' || p.id || '/similar' AS similar_jobs_endpoint
       FROM postings p
       LEFT JOIN (SELECT role_type, count(*) AS n,
                         round(avg(CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL
                                        THEN (salary_min + salary_max) / 2 END), 2) AS avg_mid
                  FROM postings WHERE role_type IS NOT NULL AND role_type <> '' GROUP BY role_type) r
         ON p.role_type = r.role_type
       LEFT JOIN (SELECT location, count(*) AS n FROM postings GROUP BY location) l
         ON p.location IS NOT DISTINCT FROM l.location"""))
def j8_market_context(spark, sf_dir):
    return si.market_context(postings(spark, sf_dir))
