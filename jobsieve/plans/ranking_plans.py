"""Ranked search, suggestions, result summaries and detail projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint
from jobsieve.operators import governance as gv
from jobsieve.operators import ranking as rk
from jobsieve.operators import salary as sal
from jobsieve.operators import search as se
from jobsieve.operators import similar as si
from jobsieve.operators import taxonomy as tx
from jobsieve.operators.maintain import expire
from jobsieve.plans.oracle_base import POSTINGS_CTE, with_postings
from jobsieve.plans.registry import register
from jobsieve.session import cut_lineage
from jobsieve.sources.tables import AS_OF, postings

QUERY = "small ring"


def _active(spark, sf_dir):
    return se.active(expire(postings(spark, sf_dir), AS_OF))


_APPLY_URL_SQL = """coalesce(CASE WHEN application_url <> '' THEN application_url END, CASE WHEN url <> '' THEN url END,
         'https://www.arbeitsagentur.de/jobsuche/suche?was=' || replace(url_encode(coalesce(title, '')), '%20', '+')
         || '&wo=' || replace(url_encode(replace(coalesce(location, 'Germany'), ', Germany', '')), '%20', '+'))"""


def _score_sql(query: str) -> str:
    from jobsieve.plans import sql_text as st
    from jobsieve.plans.taxonomy_plans import ENRICH_SELECT
    q = st.q(query)
    fields = {k: f"lower(coalesce(CAST({k} AS VARCHAR), 'None'))" for k in ("title", "role_type", "occupation_group", "company", "description")}
    hits = [f"contains({fields['title']}, t)",
            f"(contains({fields['role_type']}, t) OR contains({fields['occupation_group']}, t))",
            "contains(lower(array_to_string(required_skills, ' ')), t)",
            "contains(lower(array_to_string(coalesce(st_list, []), ' ')), t)",
            f"contains({fields['company']}, t)", f"contains({fields['description']}, t)"]
    pts = [8, 5, 4, 3, 2, 1]
    term_score = " + ".join(f"CASE WHEN {h} THEN {p}.0 ELSE 0.0 END" for h, p in zip(hits, pts))
    chain = " ".join(f"WHEN {h} AND NOT list_contains(acc, '{r}') THEN list_append(acc, '{r}')"
                     for h, r in zip(hits, rk.REASONS))
    nq = query.strip().lower().replace("'", "''")
    return f"""WITH {st.taxonomy_ctes()}, {POSTINGS_CTE.strip()},
_enr AS ({ENRICH_SELECT}),
_q AS (SELECT {q} AS q, {st.fold(q)} AS nt),
_m AS (SELECT DISTINCT _tn.ordinal FROM _q JOIN _tn ON {st.hit('_q.nt', st.folded_tokens('_q.nt'))}),
_all AS (
  SELECT unnest(string_split_regex(lower({st.strip('q')}), '\\s+')) AS t FROM _q
  UNION ALL SELECT q FROM _q
  UNION ALL SELECT unnest({st.folded_tokens('nt')}) FROM _q
  UNION ALL SELECT unnest(c.all_terms) FROM _m JOIN _concepts c USING (ordinal)
  UNION ALL SELECT c.broader_group FROM _m JOIN _concepts c USING (ordinal)),
_qterms AS (SELECT list_sort(list_distinct(list(lower({st.strip('t')})) FILTER (WHERE t IS NOT NULL AND lower({st.strip('t')}) <> ''))) AS terms FROM _all),
_s AS (
  SELECT p.id, p.title,
         list_reduce(terms, lambda acc, t: acc + ({term_score}), 0.0) AS score,
         list_reduce(terms, lambda acc, t: CASE WHEN ({term_score}) > 0 THEN (CASE {chain} ELSE acc END) ELSE acc END,
                     CAST([] AS VARCHAR[])) AS reasons
  FROM postings p JOIN _enr e ON p.id = e.id, _qterms)
SELECT id,
       round(CAST(CASE WHEN contains(lower(coalesce(title, 'None')), '{nq}') THEN score + 20 ELSE score END AS DOUBLE), 2)
         AS relevance_score,
       array_to_string(CASE WHEN contains(lower(coalesce(title, 'None')), '{nq}')
                            THEN list_prepend('title match', list_filter(reasons, lambda r: r <> 'title match'))
                            ELSE reasons END, '|') AS match_reasons
FROM _s"""


@register("q3_q4_q5_scored_postings", _score_sql(QUERY))
def q3_q4_q5_scored_postings(spark, sf_dir):
    p = postings(spark, sf_dir)
    e = tx.enrich_postings(p, tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    terms = sorted(set([t.lower() for t in QUERY.split()] + rk.expanded_terms(spark, QUERY)))
    s = rk.score(e, terms, QUERY)
    return s.select("id", "relevance_score", F.array_join("match_reasons", "|").alias("match_reasons"))


def _ranked_ctes() -> str:
    """``_ranked``: every active posting matching QUERY with its score, reasons and salary block
    (peers = the active table), as in ``ranked_search(active, QUERY, reference=active)``."""
    from jobsieve.plans.salary_plans import _estimate_sql
    from jobsieve.plans.search_plans import _SWEPT
    return _SWEPT + f""", _act AS (SELECT * FROM _swept WHERE NOT is_expired),
_ranked AS (
  SELECT a.*, s.relevance_score, s.match_reasons, e.salary_midpoint, e.salary_label, e.salary_type,
         {_APPLY_URL_SQL} AS apply_url
  FROM _act a JOIN ({_estimate_sql("_act")}) e ON a.id = e.id JOIN ({_score_sql(QUERY)}) s ON a.id = s.id
  WHERE s.relevance_score <> 0)"""


def _q6_sql() -> str:
    return with_postings(f"""
SELECT id, title, relevance_score, match_reasons, salary_midpoint, salary_label, salary_type, apply_url FROM _ranked
ORDER BY relevance_score DESC, coalesce(CAST(posted_date AS VARCHAR), '') DESC, coalesce(title, '') DESC, id DESC
LIMIT 25""", _ranked_ctes())


@register("q6_ranked_search_page", _q6_sql())
def q6_ranked_search_page(spark, sf_dir):
    act = _active(spark, sf_dir)
    ranked = rk.ranked_search(act, QUERY, work_mode="any", sort="relevance", reference=act)
    page = se.page(rk.job_results(ranked), 1, 25)
    return page.select("id", "title", "relevance_score", F.array_join("match_reasons", "|").alias("match_reasons"),
                       "salary_midpoint", "salary_label", "salary_type", "apply_url")


@register("a12_search_summary", with_postings("""
SELECT round(avg(salary_midpoint), 2) AS average_salary, count(salary_midpoint) AS salary_sample_size,
       count(*) FILTER (WHERE salary_type = 'listed') AS listed_salary_sample_size,
       count(*) FILTER (WHERE salary_type = 'estimated') AS estimated_salary_sample_size,
       count(*) FILTER (WHERE apply_url IS NOT NULL AND apply_url <> '') AS apply_links_available, count(*) AS total
FROM _ranked""", _ranked_ctes()))
def a12_search_summary(spark, sf_dir):
    act = _active(spark, sf_dir)
    ranked = rk.ranked_search(act, QUERY, reference=act)
    return se.result_summary(ranked)


@register("a12_search_top_facets", with_postings("""
SELECT facet, value, count, rank FROM (
  SELECT facet, value, count, CAST(row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS INTEGER) AS rank FROM (
    SELECT facet, value, count(*) AS count FROM (
      SELECT 'top_companies' AS facet, CAST(company AS VARCHAR) AS value FROM _ranked
      UNION ALL SELECT 'top_locations', CAST(location AS VARCHAR) FROM _ranked
      UNION ALL SELECT 'role_types', CAST(role_type AS VARCHAR) FROM _ranked)
    WHERE value IS NOT NULL AND value <> '' GROUP BY facet, value))
WHERE rank <= 5""", _ranked_ctes()))
def a12_search_top_facets(spark, sf_dir):
    act = _active(spark, sf_dir)
    return se.result_top_facets(rk.ranked_search(act, QUERY, reference=act))


def _q7_sql(query: str, limit: int) -> str:
    from jobsieve.plans import sql_text as st
    from jobsieve.plans.search_plans import _SWEPT
    nq = query.strip().lower().replace("'", "''")

    def case(mapping):
        return "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"
    corder = case({c: i for i, c in enumerate(rk.CATEGORY_ORDER)})
    prio = case(rk.SUGGESTION_PRIORITY)
    label = case({k: f"'{v}'" for k, v in rk.SUGGESTION_LABELS.items()})
    return f"""WITH {st.taxonomy_ctes()}, {POSTINGS_CTE.strip()}, {_SWEPT}, _act AS (SELECT * FROM _swept WHERE NOT is_expired),
_q AS (SELECT {st.fold(st.q(query))} AS nt),
_qm AS (SELECT DISTINCT _tn.ordinal FROM _q JOIN _tn ON {st.hit('_q.nt', st.folded_tokens('_q.nt'))}),
_qc AS (SELECT c.* FROM _qm JOIN _concepts c USING (ordinal)),
_f AS (
  SELECT 'title' AS category, CAST(title AS VARCHAR) AS value FROM _act
  UNION ALL SELECT 'company', CAST(company AS VARCHAR) FROM _act
  UNION ALL SELECT 'location', CAST(coalesce(CASE WHEN city <> '' THEN city END, location) AS VARCHAR) FROM _act
  UNION ALL SELECT 'occupation', CAST(occupation_group AS VARCHAR) FROM _act
  UNION ALL SELECT 'role_type', CAST(role_type AS VARCHAR) FROM _act),
_c AS (
  SELECT category, value, count(*) AS count FROM (
    SELECT * FROM _f WHERE value IS NOT NULL AND value <> '' AND contains(lower(value), '{nq}')
    UNION ALL SELECT 'skill', s FROM (SELECT unnest(required_skills) AS s FROM _act) WHERE s IS NOT NULL AND contains(lower(s), '{nq}'))
  GROUP BY category, value),
_b AS (
  SELECT 'title' AS category, preferred_label AS value, 3 AS count FROM _qc WHERE concept_type = 'occupation'
  UNION ALL SELECT 'occupation', a, 1 FROM (SELECT unnest(all_terms[2:]) AS a FROM _qc WHERE concept_type = 'occupation')
            WHERE contains(lower(a), '{nq}')
  UNION ALL SELECT 'skill', preferred_label, 2 FROM _qc WHERE concept_type = 'skill'),
_all AS (SELECT category, value, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM _c UNION ALL SELECT * FROM _b)
         GROUP BY category, value),
_first AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY {corder}, value) AS rn FROM _all)
SELECT value, value || ' · ' || {label} AS label, category, count FROM _first WHERE rn = 1
ORDER BY CASE WHEN lower(value) = '{nq}' THEN 0 WHEN starts_with(lower(value), '{nq}') THEN 1 ELSE 2 END, {prio},
         count DESC, lower(value), value
LIMIT {limit}"""


@register("q7_taxonomy_suggestions", _q7_sql("nurse", 12))
def q7_taxonomy_suggestions(spark, sf_dir):
    """A query that meets a taxonomy concept: its label and aliases add to the counts."""
    return rk.suggestions(_active(spark, sf_dir), "nurse", limit=12)


def _j12_sql() -> str:
    from jobsieve.plans.salary_plans import _estimate_sql
    from jobsieve.plans.search_plans import _SWEPT
    return with_postings(f"""
SELECT e.id, e.eff_salary_min, e.eff_salary_max, e.salary_midpoint, e.salary_estimation_basis FROM ({_estimate_sql("_act")}) e JOIN _act a ON a.id = e.id
WHERE contains(lower(coalesce(a.location, '')), 'germany')""", _SWEPT + ", _act AS (SELECT * FROM _swept WHERE NOT is_expired)")


@register("j12_peers_of_the_whole_table", _j12_sql())
def j12_peers_of_the_whole_table(spark, sf_dir):
    """Only the postings in Germany are asked for; their salary peers are all active postings."""
    act = _active(spark, sf_dir)
    asked = act.where(F.lower(F.coalesce("location", F.lit(""))).contains("germany"))
    e = sal.estimate_salaries(asked, reference=act)
    return e.select("id", "eff_salary_min", "eff_salary_max", "salary_midpoint", "salary_estimation_basis")


_SORTS = {"relevance": ("relevance_score", "DESC"), "salary_desc": ("coalesce(salary_midpoint, -1.0)", "DESC"), "salary_asc": ("coalesce(salary_midpoint, -1.0)", "ASC"),
          "posted_desc": ("coalesce(CAST(posted_date AS VARCHAR), '')", "DESC"), "posted_asc": ("coalesce(CAST(posted_date AS VARCHAR), '')", "ASC"),
          "company": ("coalesce(company, '')", "ASC"), "title": ("coalesce(title, '')", "ASC"), "no such mode": ("relevance_score", "DESC")}


@register("w6_sort_modes", with_postings(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{mode}' AS mode, id, CAST(row_number() OVER (ORDER BY {key} {way}, coalesce(CAST(posted_date AS VARCHAR), '') {way}, coalesce(title, '') {way}, id {way}) AS BIGINT) AS place
        FROM _ranked) WHERE place BETWEEN 11 AND 20""" for mode, (key, way) in _SORTS.items()), _ranked_ctes()))
def w6_sort_modes(spark, sf_dir):
    """The second page of ten under every sort mode, with places."""
    from pyspark.sql import Window
    act = _active(spark, sf_dir)
    found = rk.ranked_search(act, QUERY, reference=act).select("id", "title", "company", "posted_date", "salary_midpoint", "relevance_score")
    found = cut_lineage(found.repartition("id"))  # stored in no order, so its own sort, which would search twice, is dropped
    out = None
    for mode in _SORTS:
        rows = se.page(se.order_results(found, mode), 2, 10)
        # ten rows in page order get their places
        numbered = rows.agg(F.collect_list("id").alias("ids")).select(F.lit(mode).alias("mode"), F.posexplode("ids").alias("at", "id"))
        part = numbered.select("mode", "id", (F.col("at") + 11).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def _p8_sql() -> str:
    from jobsieve.plans.salary_plans import _estimate_sql
    return with_postings("""
SELECT id, title, company, location, job_type, remote_status, role_type, md5(description) AS description_md5, array_to_string(required_skills, '|') AS skills,
  CAST(posted_date AS VARCHAR) AS posted_date, source, source_legal_basis, source_posting_id, apply_url, '/jobs/' || id || '/apply' AS apply_endpoint, application_url,
  company_career_url, country, city, federal_state, occupation_group, experience_level, employment_type, salary_period, eff_salary_is_estimated AS salary_is_estimated,
  eff_salary_confidence AS salary_confidence, salary_estimation_basis, CAST(expires_at AS VARCHAR) AS expires_at, CAST(last_seen_at AS VARCHAR) AS last_seen_at, is_expired,
  relevance_score, match_reasons, eff_salary_min AS salary_min, eff_salary_max AS salary_max, salary_midpoint, salary_label, salary_type FROM _ranked8""", _ranked_ctes() + f""", _ranked8 AS (SELECT r.*, e.eff_salary_is_estimated, e.eff_salary_confidence, e.salary_estimation_basis, e.eff_salary_min, e.eff_salary_max
  FROM _ranked r JOIN ({_estimate_sql("_act")}) e ON e.id = r.id)""")


@register("p8_public_results", _p8_sql())
def p8_public_results(spark, sf_dir):
    """All keys of the public result, of every match."""
    act = _active(spark, sf_dir)
    r = rk.job_results(rk.ranked_search(act, QUERY, reference=act))
    return r.select(*[c for c in r.columns if c not in ("description", "required_skills", "match_reasons", "posted_date", "expires_at", "last_seen_at")],
                    F.md5("description").alias("description_md5"), F.array_join("required_skills", "|").alias("skills"), F.array_join("match_reasons", "|").alias("match_reasons"),
                    *[F.col(c).cast("string").alias(c) for c in ("posted_date", "expires_at", "last_seen_at")])


@register("q7_suggestions", _q7_sql("ring", 8))
def q7_suggestions(spark, sf_dir):
    return rk.suggestions(_active(spark, sf_dir), "ring", limit=8)





@register("p6_apply_urls", with_postings(
    f"SELECT id, {_APPLY_URL_SQL} AS apply_url FROM postings"))
def p6_apply_urls(spark, sf_dir):
    return postings(spark, sf_dir).select("id", se.apply_url().alias("apply_url"))


def _p7_sql() -> str:
    from jobsieve.plans.governance_plans import _DECISION, _registry_cte
    return with_postings(f"""
SELECT id AS job_id, title, company, location, {_APPLY_URL_SQL} AS apply_url,
       coalesce(CASE WHEN application_url <> '' THEN application_url END, {_APPLY_URL_SQL}) AS application_url,
       'external_redirect' AS apply_method, source, allowed AS source_allowed, source_legal_basis FROM (
  SELECT {_DECISION}
  FROM (SELECT *, lower(trim(coalesce(source, ''))) AS sk, lower(trim(coalesce(source_legal_basis, ''))) AS lb FROM postings) s
  LEFT JOIN _reg ON s.sk = _reg.rk)""", _registry_cte())


@register("p7_apply_handoff", _p7_sql())
def p7_apply_handoff(spark, sf_dir):
    p = gv.evaluate_sources(postings(spark, sf_dir))
    u = se.apply_url()
    return p.select(F.col("id").alias("job_id"), "title", "company", "location", u.alias("apply_url"),
                    F.coalesce(F.nullif(F.col("application_url"), F.lit("")), u).alias("application_url"),
                    F.lit("external_redirect").alias("apply_method"), "source", F.col("allowed").alias("source_allowed"),
                    "source_legal_basis")


def _p9_sql() -> str:
    from jobsieve.plans import search_plans  # noqa: F401  (registers the J8 SQL used below)
    from jobsieve.plans.registry import ORACLE
    from jobsieve.plans.salary_plans import ESTIMATE_SQL
    return with_postings(f"""
SELECT p.id, p.title, p.company, p.location, p.job_type, p.remote_status, p.role_type, p.description AS full_description,
       p.country, p.city, p.occupation_group, p.experience_level, p.employment_type, p.salary_period, p.source, p.source_legal_basis,
       '/jobs/' || p.id || '/apply' AS apply_endpoint, 'EUR' AS salary_currency, e.eff_salary_min AS salary_min, e.eff_salary_max AS salary_max,
       e.salary_midpoint, e.salary_label, e.salary_type, e.eff_salary_is_estimated AS salary_is_estimated,
       e.eff_salary_confidence AS salary_confidence, e.salary_estimation_basis,
       '/jobs/search?q=' || replace(replace(p.company, '#', '%23'), ' ', '+') AS current_open_jobs_endpoint,
       h.apply_url, h.application_url, h.apply_method, h.source_allowed,
       c.same_role_count, c.same_location_count, c.role_average_salary, c.similar_jobs_endpoint
FROM postings p JOIN ({ESTIMATE_SQL}) e USING (id) JOIN ({ORACLE["p7_apply_handoff"]}) h ON h.job_id = p.id
JOIN ({ORACLE["j8_market_context"]}) c ON c.id = p.id""")


@register("p9_job_detail", _p9_sql())
def p9_job_detail(spark, sf_dir):
    return rk.job_detail(postings(spark, sf_dir))


def _j3b_sql() -> str:
    from jobsieve.plans import sql_text as st
    from jobsieve.plans.search_plans import _similar_sql
    from jobsieve.plans.taxonomy_plans import ENRICH_SELECT
    return f"""WITH {st.taxonomy_ctes()}, {POSTINGS_CTE.strip()},
_cand AS (SELECT p.*, coalesce(e.st_list, []) AS st_list FROM postings p JOIN ({ENRICH_SELECT}) e ON p.id = e.id)
{_similar_sql("st_list")}"""


@register("j3b_similar_jobs_with_taxonomy", _j3b_sql())
def j3b_similar_jobs_with_taxonomy(spark, sf_dir):
    p = postings(spark, sf_dir)
    e = tx.enrich_postings(p, tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    return si.similar_jobs(e, [str(i) for i in range(1, 11)], limit=5, term_column="search_terms")


@register("p1_p2_salary_flags", with_postings(
    """SELECT id, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END AS salary_midpoint,
              (salary_min IS NOT NULL AND salary_max IS NOT NULL AND NOT coalesce(salary_is_estimated, FALSE)) AS is_listed,
              CAST(CASE WHEN lower(coalesce(experience_level, '')) IN ('entry', 'junior', 'trainee') THEN 0.9
                   WHEN lower(coalesce(experience_level, '')) IN ('senior', 'lead', 'manager') THEN 1.12 ELSE 1.0 END AS DOUBLE) AS experience_multiplier,
              CAST(CASE WHEN contains(lower(coalesce(location, '')), 'munich') OR contains(lower(coalesce(location, '')), 'frankfurt')
                        OR contains(lower(coalesce(location, '')), 'stuttgart') OR contains(lower(coalesce(location, '')), 'hamburg') THEN 1.05
                   WHEN contains(lower(coalesce(location, '')), 'leipzig') OR contains(lower(coalesce(location, '')), 'dresden')
                        OR contains(lower(coalesce(location, '')), 'bremen') OR contains(lower(coalesce(location, '')), 'hannover') THEN 0.95
                   ELSE 1.0 END AS DOUBLE) AS location_multiplier
       FROM postings"""))
def p1_p2_salary_flags(spark, sf_dir):
    from jobsieve.functions import salary as S
    p = postings(spark, sf_dir)
    return p.select("id", midpoint().alias("salary_midpoint"), S.is_listed().alias("is_listed"),
                    S.experience_multiplier().alias("experience_multiplier"), S.location_multiplier().alias("location_multiplier"))
