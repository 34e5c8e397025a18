"""Table maintenance, medallion layers, facts and features (U1-U6, J7, P12, P13, S21, W1, A13-A15,
W3-W5, F9, F10, U5, J9, J10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobsieve.functions.text import decode_skills
from jobsieve.operators import features as fe
from jobsieve.operators import maintain as mt
from jobsieve.operators import medallion as md
from jobsieve.operators.search import skills_json_text
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import ORACLE, register
from jobsieve.session import scratch_path
from jobsieve.sources.posting_table import PostingTable
from jobsieve.sources.tables import AS_OF, postings, table

_ASOF = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
_B0_END = dt.datetime(1998, 1, 1)
_B1_START = dt.datetime(1997, 7, 1)


def _batches(spark, sf_dir):
    """Two overlapping ingest batches cut from the posting view by posting date; batch order is
    (posted_date, numeric id)."""
    p = postings(spark, sf_dir).withColumn("_ord", F.struct(F.col("posted_date"), F.col("id").cast("long")))
    b0 = p.where(F.col("posted_date") < F.lit(_B0_END))
    b1 = p.where(F.col("posted_date") >= F.lit(_B1_START)).withColumn("title", F.concat(F.col("title"), F.lit(" (refreshed)")))
    return p.drop("_ord").limit(0), b0, b1


def _table_after_two_loads(spark, sf_dir):
    empty, b0, b1 = _batches(spark, sf_dir)
    t0 = mt.upsert(empty, b0, order="_ord", batch_id="b0")
    return mt.upsert(t0, b1, order="_ord", batch_id="b1")


_UPSERT_SQL = with_postings(
    "SELECT id, source, source_posting_id, title, CAST(posted_date AS VARCHAR) AS posted_date FROM _t1",
    f"""_b0 AS (SELECT * FROM postings WHERE posted_date < TIMESTAMP '{_B0_END:%Y-%m-%d %H:%M:%S}'),
_b1 AS (SELECT * REPLACE (title || ' (refreshed)' AS title) FROM postings
        WHERE posted_date >= TIMESTAMP '{_B1_START:%Y-%m-%d %H:%M:%S}'),
_t0 AS (SELECT * EXCLUDE (rn, id, first_id), first_id AS id FROM (SELECT *,
         row_number() OVER (PARTITION BY source, source_posting_id ORDER BY posted_date DESC, CAST(id AS BIGINT) DESC) AS rn,
         first_value(id) OVER (PARTITION BY source, source_posting_id ORDER BY posted_date, CAST(id AS BIGINT)) AS first_id FROM _b0) WHERE rn = 1),
_k1 AS (SELECT b.*, k.id AS kid FROM _b1 b LEFT JOIN _t0 k ON b.source = k.source AND b.source_posting_id = k.source_posting_id),
_r1 AS (SELECT *, coalesce(kid, first_value(id) OVER (PARTITION BY source, source_posting_id
         ORDER BY posted_date, CAST(id AS BIGINT))) AS tid FROM _k1),
_m AS (SELECT * EXCLUDE (rn, kid) FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY posted_date DESC, CAST(id AS BIGINT) DESC) AS rn
         FROM _r1) WHERE rn = 1),
_t1 AS (SELECT * FROM _t0 WHERE id NOT IN (SELECT tid FROM _m)
  UNION ALL BY NAME SELECT * EXCLUDE (id, tid), tid AS id FROM _m)""")


@register("u1_upsert_two_batches", _UPSERT_SQL)
def u1_upsert_two_batches(spark, sf_dir):
    t = _table_after_two_loads(spark, sf_dir)
    return t.select("id", "source", "source_posting_id", "title", F.col("posted_date").cast("string").alias("posted_date"))


@register("u1_posting_table", _UPSERT_SQL)
def u1_posting_table(spark, sf_dir):
    """The same two loads into a stored table, as commits of their changed rows; some buckets folded into new base files."""
    empty, b0, b1 = _batches(spark, sf_dir)
    table = PostingTable(spark, scratch_path(spark, "posting-table"), buckets=8)
    table.commit(mt.changed_rows(empty, b0, "_ord", "b0"), "b0")
    table.commit(mt.changed_rows(table.current(), b1, "_ord", "b1"), "b1")
    table.compact(share=0.5)
    return table.current().select("id", "source", "source_posting_id", "title", F.col("posted_date").cast("string").alias("posted_date"))


@register("j7_upsert_matches", with_postings(
    "SELECT tid AS target_id, title, tid IN (SELECT id FROM _t0) AS matched FROM _m",
    _UPSERT_SQL[_UPSERT_SQL.index("_b0 AS ("):_UPSERT_SQL.index(",\n_t1 AS (")]))
def j7_upsert_matches(spark, sf_dir):
    empty, b0, b1 = _batches(spark, sf_dir)
    t0 = mt.upsert(empty, b0, order="_ord", batch_id="b0")
    r = mt.resolve_batch(t0, b1, "_ord", "b1")
    known = t0.select(F.col("id").alias("_known"))
    return r.join(known, r["_tid"] == known["_known"], "left").select(F.col("_tid").alias("target_id"), "title", F.col("_known").isNotNull().alias("matched"))


@register("u2_expiry_sweep", with_postings(
    f"SELECT count(*) FILTER (WHERE expires_at IS NOT NULL AND expires_at < {_ASOF} AND NOT is_expired) AS expired FROM postings"))
def u2_expiry_sweep(spark, sf_dir):
    return mt.newly_expired_count(postings(spark, sf_dir), AS_OF)


@register("u4_stamp_batch", with_postings(
    f"SELECT id, 'batch-1' AS ingestion_batch_id, CAST(coalesce(last_seen_at, {_ASOF}) AS VARCHAR) AS last_seen_at, "
    "FALSE AS is_expired FROM postings"))
def u4_stamp_batch(spark, sf_dir):
    s = mt.stamp_batch(postings(spark, sf_dir), "batch-1", AS_OF)
    return s.select("id", "ingestion_batch_id", F.col("last_seen_at").cast("string").alias("last_seen_at"), "is_expired")


@register("u6_skill_dimension", with_postings(
    "SELECT substr(sha256(name), 1, 32) AS id, name FROM (SELECT DISTINCT unnest(required_skills) AS name FROM postings)"))
def u6_skill_dimension(spark, sf_dir):
    existing = spark.createDataFrame([], "id string, name string, category string")
    names = postings(spark, sf_dir).select(F.explode("required_skills").alias("skill"))
    return mt.skill_dimension(existing, names).select("id", "name")


@register("p12_p13_record_roundtrip", with_postings(
    """SELECT id, CAST(trunc(salary_min) AS BIGINT) AS salary_min, coalesce(nullif(country, ''), 'Germany') AS country,
              CASE WHEN len(required_skills) > 0 THEN '["' || array_to_string(required_skills, '", "') || '"]' END AS skills_text,
              CAST(len(required_skills) AS INTEGER) AS n_skills
       FROM postings"""))
def p12_p13_record_roundtrip(spark, sf_dir):
    n = mt.normalize_record(postings(spark, sf_dir), AS_OF).withColumn("skills_text", skills_json_text())
    back = n.withColumn("decoded", decode_skills("skills_text"))
    return back.select("id", "salary_min", "country", "skills_text", F.size("decoded").alias("n_skills"))


_API_TEXT = {"posted_date", "posted_at", "expires_at", "last_seen_at", "created_at", "updated_at"}


@register("p13_api_rows", with_postings("SELECT " + ", ".join(
    {"required_skills": "array_to_string(required_skills, '|') AS required_skills", "salary_is_estimated": "coalesce(salary_is_estimated, FALSE) AS salary_is_estimated",
     "is_expired": "FALSE AS is_expired", "created_at": "CAST(posted_date AS VARCHAR) AS created_at", "updated_at": "CAST(last_seen_at AS VARCHAR) AS updated_at",
     "description": "md5(description) AS description"}.get(c, f"CAST({c} AS VARCHAR) AS {c}" if c in _API_TEXT else c) for c in mt.API_KEYS) + " FROM postings"))
def p13_api_rows(spark, sf_dir):
    """Stored rows (skills as JSON text, some flags null) in the API's shape."""
    stored = postings(spark, sf_dir).withColumn("required_skills", skills_json_text()).withColumns(
        {"created_at": F.col("posted_date"), "updated_at": F.col("last_seen_at"), "is_expired": F.when(F.col("id").cast("long") % 2 == 0, F.col("is_expired"))})
    r = mt.to_api_rows(stored).withColumns({"required_skills": F.array_join("required_skills", "|"), "description": F.md5("description")})
    return r.select(*[F.col(c).cast("string").alias(c) if c in _API_TEXT else c for c in mt.API_KEYS])


def _bronze(spark, sf_dir):
    p = postings(spark, sf_dir)
    ing = F.col("posted_date") + F.make_dt_interval(days=(F.col("id").cast("long") % 30).cast("int"))
    return p.select(*[c for c in md.BRONZE_COLUMNS if c != "ingested_at"], ing.alias("ingested_at"))


_BRONZE = "_bronze AS (SELECT id, title, company, location, description, source, salary_min, salary_max, required_skills, " \
          "posted_date, posted_date + to_days(CAST(CAST(id AS BIGINT) % 30 AS INTEGER)) AS ingested_at FROM postings)"
_SILVER = _BRONZE + """,
_clean AS (
  SELECT id, lower(trim(title)) AS title, lower(trim(company)) AS company, lower(trim(location)) AS location, description,
         CASE WHEN salary_min > 0 AND salary_max > 0 AND salary_min <= salary_max THEN salary_min END AS salary_min,
         CASE WHEN salary_min > 0 AND salary_max > 0 AND salary_min <= salary_max THEN salary_max END AS salary_max,
         list_transform(list_filter(required_skills, lambda s: trim(s) <> ''), lambda s: lower(trim(s))) AS required_skills,
         posted_date, source, ingested_at
  FROM _bronze WHERE title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL),
_silver AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title, company, location
            ORDER BY ingested_at DESC, id DESC) AS rn FROM _clean) WHERE rn = 1)"""


@register("s21_staging_rows", with_postings(
    "SELECT id, title, company, location, md5(description) AS description_md5, source, salary_min, salary_max, array_to_string(required_skills, '|') AS skills, "
    "CAST(posted_date AS VARCHAR) AS posted_date, CAST(ingested_at AS VARCHAR) AS ingested_at FROM _bronze", _BRONZE))
def s21_staging_rows(spark, sf_dir):
    s = md.staging(_bronze(spark, sf_dir).withColumn("extra", F.lit(1)))
    return s.select("id", "title", "company", "location", F.md5("description").alias("description_md5"), "source", "salary_min", "salary_max",
                    F.array_join("required_skills", "|").alias("skills"), F.col("posted_date").cast("string").alias("posted_date"), F.col("ingested_at").cast("string").alias("ingested_at"))


@register("w1_silver_dedupe", with_postings(
    "SELECT id, title, company, location, salary_min, salary_max, CAST(ingested_at AS VARCHAR) AS ingested_at FROM _silver",
    _SILVER))
def w1_silver_dedupe(spark, sf_dir):
    s = md.silver(_bronze(spark, sf_dir))
    return s.select("id", "title", "company", "location", "salary_min", "salary_max",
                    F.col("ingested_at").cast("string").alias("ingested_at"))


@register("a13_skill_month_mart", with_postings(
    """SELECT skill, CAST(month AS VARCHAR) AS month, count(DISTINCT job_id) AS job_count,
              count(DISTINCT company) AS company_count, round(avg(mid), 6) AS avg_salary,
              array_to_string(list_sort(list(DISTINCT location))[1:10], '|') AS top_locations
       FROM (SELECT id AS job_id, unnest(required_skills) AS skill, CAST(date_trunc('month', posted_date) AS DATE) AS month,
                    location, company, (salary_min + salary_max) / 2 AS mid FROM _silver WHERE posted_date IS NOT NULL)
       GROUP BY skill, month""", _SILVER))
def a13_skill_month_mart(spark, sf_dir):
    m = md.skill_month_mart(md.silver(_bronze(spark, sf_dir)))
    return m.select("skill", F.col("month").cast("string").alias("month"), "job_count", "company_count",
                    F.round("avg_salary", 6).alias("avg_salary"), F.array_join("top_locations", "|").alias("top_locations"))


def _layers(spark, sf_dir):
    """Layer tables after two batches: postings by parity, the second with changed titles for some so that rows move and are replaced."""
    root = scratch_path(spark, "layers")
    b = _bronze(spark, sf_dir)
    first, second = b.where(F.col("id").cast("long") % 2 == 0), b.where(F.col("id").cast("long") % 2 == 1)
    md.refresh_layers(root, first, "0001")
    md.refresh_layers(root, second, "0002")
    md.refresh_layers(root, second, "0002")  # a repeated batch changes nothing
    return root


@register("s22_silver_table", with_postings(
    "SELECT id, title, company, location, salary_min, CAST(CAST(date_trunc('month', posted_date) AS DATE) AS VARCHAR) AS month FROM _silver", _SILVER))
def s22_silver_table(spark, sf_dir):
    t = spark.read.parquet(f"{_layers(spark, sf_dir)}/silver")
    return t.select("id", "title", "company", "location", "salary_min", F.col("month").cast("string").alias("month"))


@register("s22_gold_table", ORACLE["a13_skill_month_mart"])
def s22_gold_table(spark, sf_dir):
    m = spark.read.parquet(f"{_layers(spark, sf_dir)}/gold")
    return m.select("skill", F.col("month").cast("string").alias("month"), "job_count", "company_count",
                    F.round("avg_salary", 6).alias("avg_salary"), F.array_join("top_locations", "|").alias("top_locations"))


_TREND = """_ex AS (SELECT unnest(required_skills) AS skill, CAST(date_trunc('month', posted_date) AS DATE) AS month,
                 CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END AS mid
          FROM postings WHERE posted_date IS NOT NULL),
_g AS (SELECT skill, month, count(*) AS occurrences, avg(mid) AS mean FROM _ex GROUP BY skill, month),
_mo AS (SELECT month, sum(occurrences) AS tot, avg(mean) AS base FROM _g GROUP BY month),
_trend AS (
  SELECT skill, month, occurrences, round(occurrences / tot * 100, 6) AS percentage,
         round((mean - base) / base * 100, 6) AS salary_premium,
         round(CASE WHEN lag(occurrences) OVER (PARTITION BY skill ORDER BY month) > 0 THEN
           (occurrences - lag(occurrences) OVER (PARTITION BY skill ORDER BY month))
           / lag(occurrences) OVER (PARTITION BY skill ORDER BY month) * 100 END, 6) AS growth_percentage
  FROM _g JOIN _mo USING (month))"""


def _trends(spark, sf_dir):
    return md.skill_trend_fact(postings(spark, sf_dir))


@register("a14_skill_trend_fact", with_postings(
    "SELECT skill, CAST(month AS VARCHAR) AS month, occurrences, percentage, salary_premium, growth_percentage FROM _trend",
    _TREND))
def a14_skill_trend_fact(spark, sf_dir):
    return _trends(spark, sf_dir).withColumn("month", F.col("month").cast("string"))


@register("w3_top_skills_latest_month", with_postings(
    """SELECT skill, CAST(month AS VARCHAR) AS month, occurrences FROM _trend
       WHERE month = (SELECT max(month) FROM _trend) ORDER BY occurrences DESC, skill LIMIT 10""", _TREND))
def w3_top_skills_latest_month(spark, sf_dir):
    t = md.top_trending_of_month(_trends(spark, sf_dir))
    return t.select("skill", F.col("month").cast("string").alias("month"), "occurrences")


@register("w4_trend_history", with_postings(
    """SELECT skill, CAST(month AS VARCHAR) AS month, occurrences, rank FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY skill ORDER BY month DESC) AS INTEGER) AS rank FROM _trend) WHERE rank <= 12""",
    _TREND))
def w4_trend_history(spark, sf_dir):
    h = md.trend_history(_trends(spark, sf_dir))
    return h.select("skill", F.col("month").cast("string").alias("month"), "occurrences", "rank")


@register("f9_trend_lookup", with_postings(
    "SELECT skill, CAST(month AS VARCHAR) AS month, occurrences FROM _trend WHERE skill = 'small ring' "
    "AND month = DATE '1998-03-01'", _TREND))
def f9_trend_lookup(spark, sf_dir):
    t = md.trend_lookup(_trends(spark, sf_dir), "small ring", dt.date(1998, 3, 1))
    return t.select("skill", F.col("month").cast("string").alias("month"), "occurrences")


_MID = "CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2 END"
_FACT = f"""_fact AS (
  SELECT title AS role, location, min(salary_min) AS min_salary, max(salary_max) AS max_salary,
         median({_MID}) AS median_salary, count(*) AS sample_size,
         round(coalesce(stddev_samp({_MID}), 0.0), 6) AS std_dev, (min(salary_min) + max(salary_max)) / 2 AS mean_salary
  FROM postings WHERE {_MID} IS NOT NULL GROUP BY title, location)"""


@register("a15_salary_fact", with_postings("SELECT * FROM _fact", _FACT))
def a15_salary_fact(spark, sf_dir):
    f = md.salary_fact(postings(spark, sf_dir))
    return f.select("role", "location", "min_salary", "max_salary", "median_salary", "sample_size", "std_dev", "mean_salary")


@register("w5_top_paid_roles", with_postings(
    "SELECT role, location, median_salary FROM _fact ORDER BY median_salary DESC, role, location LIMIT 10", _FACT))
def w5_top_paid_roles(spark, sf_dir):
    return md.top_paid_roles(md.salary_fact(postings(spark, sf_dir))).select("role", "location", "median_salary")


@register("f10_salary_fact_lookup", with_postings(
    "SELECT role, location, median_salary FROM _fact WHERE role = 'ECONOMY BUILDING' ORDER BY location LIMIT 1", _FACT))
def f10_salary_fact_lookup(spark, sf_dir):
    return md.salary_lookup(md.salary_fact(postings(spark, sf_dir)), "ECONOMY BUILDING").select("role", "location", "median_salary")


# Features over events: 'view' events carry the feature (value), 'purchase' events are the entity rows.
_START, _END = dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31, 23, 59, 59)


@register("u5_materialize_latest_features", f"""
SELECT user_id, CAST(ts AS VARCHAR) AS ts, value FROM (
  SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{_START:%Y-%m-%d %H:%M:%S}' AND ts <= TIMESTAMP '{_END:%Y-%m-%d %H:%M:%S}')
WHERE rn = 1""")
def u5_materialize_latest_features(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "view").select("user_id", "ts", "value", "event_id")
    m = fe.materialize_latest(ev, "user_id", "ts", _START, _END)
    return m.select("user_id", F.col("ts").cast("string").alias("ts"), "value")


@register("j9_point_in_time_features", """
SELECT p.event_id AS row_id, p.user_id, CAST(p.ts AS VARCHAR) AS ts,
       CASE WHEN f.ts >= p.ts - INTERVAL 365 DAY THEN CAST(f.ts AS VARCHAR) END AS feature_ts,
       CASE WHEN f.ts >= p.ts - INTERVAL 365 DAY THEN f.value END AS value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') f
  ON p.user_id = f.user_id AND p.ts >= f.ts""")
def j9_point_in_time_features(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ent = ev.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("row_id"), "user_id", "ts")
    feat = ev.where(F.col("event_type") == "view").select("user_id", "ts", "value")
    r = fe.point_in_time(ent, feat, "user_id", "ts", ["value"])
    return r.select("row_id", "user_id", F.col("ts").cast("string").alias("ts"),
                    F.col("feature_ts").cast("string").alias("feature_ts"), "value")


@register("j10_online_lookup", f"""
SELECT k.user_id, CAST(l.ts AS VARCHAR) AS ts, l.value FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') k
LEFT JOIN (SELECT * FROM (
  SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{_START:%Y-%m-%d %H:%M:%S}' AND ts <= TIMESTAMP '{_END:%Y-%m-%d %H:%M:%S}')
  WHERE rn = 1) l ON k.user_id = l.user_id""")
def j10_online_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    latest = fe.materialize_latest(ev.where(F.col("event_type") == "view").select("user_id", "ts", "value", "event_id"),
                                   "user_id", "ts", _START, _END)
    keys = ev.where(F.col("event_type") == "signup").select("user_id").distinct()
    return fe.online_lookup(latest, keys, "user_id").select("user_id", F.col("ts").cast("string").alias("ts"), "value")
