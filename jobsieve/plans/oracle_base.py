"""DuckDB SQL twin of ``jobsieve.sources.tables.postings`` (used only by the oracle check)."""

from jobsieve.sources.tables import (
    CITIES, ESTIMATED_EVERY, EXTRA_SKILLS, LEVELS, OUTLIER_EVERY, OUTLIER_FACTOR, QUESTION_BUCKETS, QUESTION_ROLES, SEEN_EVERY,
    SOURCE_BY_BUCKET, TITLE_WORDS, WORK_MODE_BY_STATUS)


def _sql_str(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_SRC = " ".join(f"WHEN {i} THEN {_sql_str(s)}" for i, (s, _) in enumerate(SOURCE_BY_BUCKET))
_BASIS = " ".join(f"WHEN {i} THEN {_sql_str(b)}" for i, (_, b) in enumerate(SOURCE_BY_BUCKET))
_MODE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORK_MODE_BY_STATUS.items())


def _dealt(spec, otherwise):
    every, values = spec
    return f"CASE WHEN o_orderkey % {every} = 0 THEN ([{', '.join(map(_sql_str, values))}])[1 + (o_orderkey // {every}) % {len(values)}] ELSE {otherwise} END"


def _pick(values, by):
    return f"([{', '.join(map(_sql_str, values))}])[1 + ({by}) % {len(values)}]"


QUESTIONS_CTE = f"""
_questions AS (SELECT conv_id, turn, FALSE AS asked, text FROM conversations
  UNION ALL SELECT conv_id, turn, TRUE, CASE (conv_id * 7 + turn) % {QUESTION_BUCKETS}
    WHEN 0 THEN 'What are the top ' || (conv_id % 9 + 1) || ' skills?'
    WHEN 1 THEN 'Is there any salary outlier in the data?'
    WHEN 2 THEN 'What is the salary for ''' || {_pick(QUESTION_ROLES, 'conv_id')} || '''?'
    WHEN 3 THEN 'Which in-demand roles come next quarter?'
    WHEN 4 THEN 'How many remote jobs are there?'
    WHEN 5 THEN 'How many jobs are listed?'
    WHEN 6 THEN 'Why was the salary of "' || conv_id || '" flagged?'
    WHEN 7 THEN 'Explain the salary anomaly of job id: ' || conv_id
    WHEN 8 THEN 'Openings for ' || {_pick(TITLE_WORDS[1], 'conv_id')} || ' with ' || {_pick(EXTRA_SKILLS[1], 'conv_id + turn')} || ' experience' END
  FROM conversations WHERE role = 'user' AND (conv_id * 7 + turn) % {QUESTION_BUCKETS} < 9)"""


POSTINGS_CTE = f"""
_lines AS (
  SELECT l.l_orderkey,
         list(p.p_name ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS skills,
         (list(p.p_type ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey))[1] AS first_type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey
),
_base AS (
  SELECT o.*, c.c_name, c.c_mktsegment, n.n_nationkey, n.n_name, r.r_name,
         list_concat(COALESCE(_lines.skills, CAST([] AS VARCHAR[])),
           list_filter([{_dealt(EXTRA_SKILLS, "NULL")}], lambda x: x IS NOT NULL)) AS skills, _lines.first_type,
         {_dealt(TITLE_WORDS, "_lines.first_type")} AS lead, {_dealt(CITIES, "n.n_name")} AS city,
         CASE WHEN o_orderkey % {CITIES[0]} = 0 THEN 'Germany' ELSE r.r_name END AS country,
         CAST(floor(o_totalprice) AS DOUBLE) * CASE WHEN o_orderkey % {OUTLIER_EVERY} = 1 THEN {OUTLIER_FACTOR} ELSE 1 END AS smin,
         (o.o_orderkey % 7 = 0 OR c.c_mktsegment = 'HOUSEHOLD' OR n.n_nationkey = 24
          OR (n.n_nationkey < 5 AND o.o_orderpriority = '5-LOW')
          OR (c.c_mktsegment = 'MACHINERY' AND o.o_orderpriority = '2-HIGH')) AS no_salary
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN _lines ON o.o_orderkey = _lines.l_orderkey
),
postings AS (
  SELECT
    CAST(o_orderkey AS VARCHAR) AS id,
    CAST(o_custkey AS VARCHAR) AS source_posting_id,
    CASE o_orderkey % 5 {_SRC} END AS source,
    CASE o_orderkey % 5 {_BASIS} END AS source_legal_basis,
    CASE WHEN lead IS NULL THEN c_mktsegment ELSE lead || ' ' || c_mktsegment END AS title,
    c_name AS company,
    city || ', ' || country AS location,
    city,
    country,
    CAST(NULL AS VARCHAR) AS federal_state,
    'Role in ' || n_name || ' requiring ' || array_to_string(skills, ', ') AS description,
    'Full-time' AS job_type,
    'permanent' AS employment_type,
    CASE WHEN NOT no_salary THEN smin END AS salary_min,
    CASE WHEN NOT no_salary THEN smin + CAST((o_orderkey % 20) * 1000 AS DOUBLE) END AS salary_max,
    'yearly' AS salary_period,
    o_orderkey % {ESTIMATED_EVERY} = 5 AS salary_is_estimated,
    CASE WHEN o_orderkey % {ESTIMATED_EVERY} = 5 THEN CAST(o_orderkey % 7 AS DOUBLE) / 10 END AS salary_confidence,
    'EUR' AS currency,
    skills AS required_skills,
    o_orderdate AS posted_date,
    o_orderdate AS posted_at,
    o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) AS expires_at,
    CASE WHEN o_orderkey % {SEEN_EVERY} = 0 THEN o_orderdate END AS last_seen_at,
    FALSE AS is_expired,
    CASE WHEN o_orderkey % 3 = 0 THEN 'https://jobs.example.org/postings/' || CAST(o_orderkey AS VARCHAR) END AS url,
    CASE WHEN o_orderkey % 11 = 0 THEN 'https://apply.example.org/' || CAST(o_orderkey AS VARCHAR) END AS application_url,
    CAST(NULL AS VARCHAR) AS company_career_url,
    CASE o_orderstatus {_MODE} END AS remote_status,
    c_mktsegment AS role_type,
    first_type AS occupation_group,
    {_dealt(LEVELS, 'o_orderpriority')} AS experience_level,
    CAST(NULL AS VARCHAR) AS ingestion_batch_id
  FROM _base
)"""


def with_postings(body: str, extra_ctes: str = "") -> str:
    """``WITH <postings view>[, extra] <body>``."""
    ctes = POSTINGS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
