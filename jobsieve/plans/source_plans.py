"""File sources/sinks and ingestion plans.

Each plan writes the posting view (or a shape of it) to a fresh scratch folder under the
session's checkpoint folder, reads it back through the reader under test and returns the result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobsieve.operators import governance as gv
from jobsieve.operators import ingest as ig
from jobsieve.operators import maintain as mt
from jobsieve.operators import validation as va
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import register
from jobsieve.session import scratch_path
from jobsieve.sources import files as fl
from jobsieve.sources.posting_table import PostingTable
from jobsieve.sources.tables import AS_OF, postings

_CSV_COLS = ["id", "title", "company", "location", "description", "salary_min", "salary_max", "required_skills",
             "posted_date", "source", "remote_status", "role_type"]


def _csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    fl.write_csv(postings(spark, sf_dir).select(*_CSV_COLS), path)
    return fl.normalize_raw(fl.read_csv_text(spark, path), "local_csv", "Local legal seed data for development.")


_RT_SQL = with_postings(
    """SELECT id, title, city, country, CAST(len(required_skills) AS INTEGER) AS n_skills, CAST(posted_date AS VARCHAR) AS posted_date,
              salary_min, source, coalesce(role_type, '') AS occupation_group, 'yearly' AS salary_period
       FROM postings""")


@register("s1_s16_csv_roundtrip", _RT_SQL)
def s1_s16_csv_roundtrip(spark, sf_dir):
    r = _csv_roundtrip(spark, sf_dir)
    return r.select("id", "title", "city", "country", F.size("required_skills").alias("n_skills"),
                    F.col("posted_date").cast("string").alias("posted_date"), "salary_min", "source",
                    F.coalesce("occupation_group", F.lit("")).alias("occupation_group"), "salary_period")


@register("s2_normalized_rows", with_postings("""
SELECT id, title, company, location, salary_min, salary_max, 'yearly' AS salary_period, FALSE AS salary_is_estimated, CAST(NULL AS DOUBLE) AS salary_confidence, 'Full-time' AS job_type,
  'permanent' AS employment_type, md5(description) AS description, array_to_string(required_skills, '|') AS required_skills, CAST(posted_date AS VARCHAR) AS posted_date,
  CAST(posted_date AS VARCHAR) AS posted_at, CAST(NULL AS VARCHAR) AS expires_at, CAST(posted_date AS VARCHAR) AS last_seen_at, source, id AS source_posting_id, CAST(NULL AS VARCHAR) AS url,
  CAST(NULL AS VARCHAR) AS application_url, CAST(NULL AS VARCHAR) AS company_career_url, trim(split_part(location, ',', -1)) AS country, trim(split_part(location, ',', 1)) AS city,
  CAST(NULL AS VARCHAR) AS federal_state, remote_status, role_type, role_type AS occupation_group, CAST(NULL AS VARCHAR) AS experience_level,
  'Local legal seed data for development.' AS source_legal_basis, CAST(NULL AS VARCHAR) AS ingestion_batch_id, 'EUR' AS currency FROM postings"""))
def s2_normalized_rows(spark, sf_dir):
    """Every column of the canonical posting, from a file that holds twelve of them."""
    r = _csv_roundtrip(spark, sf_dir)
    dates = ("posted_date", "posted_at", "expires_at", "last_seen_at")
    return r.withColumns({"description": F.md5("description"), "required_skills": F.array_join("required_skills", "|"), **{c: F.col(c).cast("string") for c in dates}})


@register("s17_json_roundtrip", with_postings(
    "SELECT id, title, CAST(len(required_skills) AS INTEGER) AS n_skills, salary_max FROM postings"))
def s17_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json")
    fl.write_json(postings(spark, sf_dir).select("id", "title", "required_skills", "salary_max"), path)
    back = spark.read.schema("id string, title string, required_skills array<string>, salary_max double").json(path)
    return back.select("id", "title", F.size(F.coalesce("required_skills", F.array())).alias("n_skills"), "salary_max")


@register("s8_keyword_fetch", with_postings(
    """SELECT id FROM postings WHERE contains(lower(location), 'nation_4') AND (
         contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''),
             coalesce(description, ''), coalesce(role_type, ''), coalesce(remote_status, ''),
             array_to_string(required_skills, ' '))), 'gizmo')
         OR contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''),
             coalesce(description, ''), coalesce(role_type, ''), coalesce(remote_status, ''),
             array_to_string(required_skills, ' '))), 'anvil'))"""))
def s8_keyword_fetch(spark, sf_dir):
    return fl.keyword_filter(postings(spark, sf_dir), ["gizmo", "anvil"], location="NATION_4").select("id")


_BLOB = "lower(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''), coalesce(description, ''), coalesce(role_type, ''), coalesce(remote_status, ''), array_to_string(required_skills, ' ')))"


@register("s8_fetch_limit", with_postings(f"""
SELECT id, title FROM postings WHERE contains({_BLOB}, 'gizmo') AND lower(coalesce(remote_status, '')) = 'onsite' ORDER BY id LIMIT 75"""))
def s8_fetch_limit(spark, sf_dir):
    return fl.fetch(postings(spark, sf_dir), ["gizmo"], 75, work_mode="onsite").select("id", "title")


def _feeds(spark, sf_dir):
    p = postings(spark, sf_dir)
    return [fl.Feed(n, p.where(F.col("source") == n).drop(*drop), basis) for n, basis, drop in (
        ("legal_demo_csv", "Seed basis.", ()), ("company_feed", "Feed basis.", ("source", "source_legal_basis", "url")))]


@register("s9_feed_source", with_postings(f"""
SELECT id, 'company_feed' AS source, 'Feed basis.' AS source_legal_basis FROM postings
WHERE source = 'company_feed' AND (contains({_BLOB}, 'gizmo') OR contains({_BLOB}, 'nurse')) ORDER BY id LIMIT 100"""))
def s9_feed_source(spark, sf_dir):
    """A feed without source and legal basis columns gets its own."""
    return _feeds(spark, sf_dir)[1].fetch(["gizmo nurse"], 100).select("id", "source", "source_legal_basis")


@register("s11_limit_per_source", with_postings(f"""
SELECT _provider, id, source_legal_basis FROM (
  SELECT source AS _provider, id, CASE source WHEN 'company_feed' THEN 'Feed basis.' ELSE source_legal_basis END AS source_legal_basis,
         row_number() OVER (PARTITION BY source ORDER BY id) AS rn
  FROM postings WHERE source IN ('legal_demo_csv', 'company_feed') AND contains({_BLOB}, 'ring')) WHERE rn <= 60"""))
def s11_limit_per_source(spark, sf_dir):
    u = fl.run_sources(_feeds(spark, sf_dir), ["legal_demo_csv", "company_feed"], ["ring"], 60)
    return u.select("_provider", "id", "source_legal_basis")


def _damaged(spark, sf_dir):
    """Postings as raw text, some with values that break a rule."""
    p, key = postings(spark, sf_dir), F.col("id").cast("long")
    conf = F.when(key % 17 == 0, "1.5").when(key % 19 == 0, "-0.1").when(key % 23 == 0, "high").otherwise(F.col("salary_confidence").cast("string"))
    flag = F.when(key % 13 == 0, "perhaps").otherwise(F.col("salary_is_estimated").cast("string"))
    return p.withColumns({"salary_confidence": conf, "salary_is_estimated": flag, "salary_max": F.when(key % 29 == 0, F.col("salary_min") - 1).otherwise(F.col("salary_max"))})


_DAMAGED_RULES = """
_bad AS (SELECT id, title, salary_min, salary_max, list_filter([
    CASE WHEN CAST(id AS BIGINT) % 23 = 0 AND CAST(id AS BIGINT) % 17 <> 0 AND CAST(id AS BIGINT) % 19 <> 0 THEN 'coerce_float:salary_confidence' END,
    CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'coerce_bool:salary_is_estimated' END,
    CASE WHEN smax IS NOT NULL AND NOT smax > 0 THEN 'greater_than_0:salary_max' END,
    CASE WHEN CAST(id AS BIGINT) % 17 = 0 OR CAST(id AS BIGINT) % 19 = 0 THEN 'in_range_0_1:salary_confidence' END,
    CASE WHEN salary_min IS NOT NULL AND smax IS NOT NULL AND smax < salary_min THEN 'salary_bounds_are_valid' END], lambda x: x IS NOT NULL) AS failures
  FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 29 = 0 THEN salary_min - 1 ELSE salary_max END AS smax FROM postings))"""


@register("v3_v5_v7_failing_rows", with_postings("SELECT id, array_to_string(failures, '|') AS failures FROM _bad WHERE len(failures) > 0", _DAMAGED_RULES))
def v3_v5_v7_failing_rows(spark, sf_dir):
    """Rows with confidences out of range or not a number, flags that are no booleans, and bounds the wrong way round."""
    f = va.with_failures(_damaged(spark, sf_dir), INGEST_AS_OF).where(F.size("failures") > 0)
    return f.select("id", F.array_join("failures", "|").alias("failures"))


@register("s16_s17_validated_sinks", with_postings("""
SELECT 'csv' AS kind, 'valid' AS rule, count(*) AS rows, count(*) AS read_back FROM _bad WHERE len(failures) = 0
UNION ALL SELECT 'json', 'valid', count(*), count(*) FROM _bad WHERE len(failures) = 0
UNION ALL SELECT kind, rule, count(*), any_value((SELECT count(*) FROM _bad WHERE len(failures) > 0))
  FROM (SELECT unnest(failures) AS rule FROM _bad), (VALUES ('csv'), ('json')) k(kind) GROUP BY kind, rule""", _DAMAGED_RULES))
def s16_s17_validated_sinks(spark, sf_dir):
    """Per sink and rule the rows counted, beside what stands in the files of good and of rejected rows."""
    out = None
    for kind in ("csv", "json"):
        path = scratch_path(spark, f"sink-{kind}")
        counts = fl.save_valid(_damaged(spark, sf_dir), path, INGEST_AS_OF, kind)
        good = fl.read_csv_text(spark, path) if kind == "csv" else spark.read.schema("id string").json(path)
        rejected = spark.read.schema("id string").json(f"{path}_rejected")
        n = F.when(F.col("rule") == "valid", good.select(F.count(F.lit(1))).scalar()).otherwise(rejected.select(F.count(F.lit(1))).scalar())
        part = counts.select(F.lit(kind).alias("kind"), "rule", "rows", n.alias("read_back"))
        out = part if out is None else out.unionByName(part)
    return out


@register("s13_csv_dir_report", with_postings("""
SELECT 'good' AS file, 'read' AS status, count(*) AS rows, CAST(0 AS BIGINT) AS corrupt_rows FROM postings WHERE CAST(id AS BIGINT) % 3 = 0
UNION ALL SELECT 'short', 'read', count(*) FILTER (WHERE CAST(id AS BIGINT) % 2 = 0), count(*) FILTER (WHERE CAST(id AS BIGINT) % 2 = 1) FROM postings WHERE CAST(id AS BIGINT) % 3 = 1
UNION ALL SELECT 'strange', 'unknown_layout', 0, 0
UNION ALL SELECT 'torn', 'unreadable', 0, 0"""))
def s13_csv_dir_report(spark, sf_dir):
    """A folder with a sound file, one whose records are partly too long, one of an unknown layout, and one that cannot be read."""
    p, root = postings(spark, sf_dir), scratch_path(spark, "csv-folder")
    key = F.col("id").cast("long")
    for part, rows in (("good", p.where(key % 3 == 0).select(F.concat_ws(",", "id", "company").alias("value"))),
                       ("short", p.where(key % 3 == 1).select(F.concat(F.concat_ws(",", "id", "company"), F.when(key % 2 == 1, ",x,y").otherwise("")).alias("value"))),
                       ("strange", p.where(key % 3 == 2).select("id"))):
        head = spark.createDataFrame([("0", "id,company_name" if part != "strange" else "what")], "k string, value string")
        lines = head.unionByName(rows.select(F.lit("1").alias("k"), F.col(rows.columns[-1]).alias("value"))).coalesce(1).sortWithinPartitions("k")
        lines.select("value").write.mode("append").text(f"{root}/{part}")
    torn = spark.createDataFrame([(bytearray(b"\x1f\x8b\x08 no gzip"),)], "value binary")
    _write_bytes(spark, f"{root}/torn/part.csv.gz", torn.first()[0])
    r = fl.csv_dir_report(spark, f"{root}/*", multi_line=False)
    which = F.when(F.col("status") == "unreadable", "torn").when(F.col("status") == "unknown_layout", "strange").when(F.col("corrupt_rows") > 0, "short").otherwise("good")
    return r.select(which.alias("file"), "status", "rows", "corrupt_rows")


def _write_bytes(spark, path, data):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


@register("s10_per_keyword_fetch", with_postings("""
SELECT id, title FROM (
  SELECT p.id, p.title, k.pos, row_number() OVER (PARTITION BY k.pos ORDER BY p.id) AS rn
  FROM postings p JOIN (VALUES (0, 'gizmo'), (1, 'anvil')) k(pos, kw)
    ON contains(lower(concat_ws(' ', p.title, p.company, p.location, p.description)), k.kw))
WHERE rn <= 200 ORDER BY pos, id LIMIT 200"""))
def s10_per_keyword_fetch(spark, sf_dir):
    return fl.per_keyword_fetch(postings(spark, sf_dir), ["gizmo", "anvil"], limit=200).select("id", "title")


@register("s11_multi_source_union", with_postings(
    """SELECT _provider, count(*) AS rows FROM (
         SELECT 'legal_demo_csv' AS _provider, * FROM postings WHERE source = 'legal_demo_csv'
         UNION ALL BY NAME SELECT 'company_feed' AS _provider, * FROM postings WHERE source = 'company_feed')
       GROUP BY _provider"""))
def s11_multi_source_union(spark, sf_dir):
    p = postings(spark, sf_dir)
    u = fl.union_sources({"legal_demo_csv": p.where(F.col("source") == "legal_demo_csv"),
                          "company_feed": p.where(F.col("source") == "company_feed").drop("url")})
    return u.groupBy("_provider").agg(F.count(F.lit(1)).alias("rows"))


@register("s12_nested_json_records", with_postings(
    """SELECT id, company, salary_min, CAST(posted_date AS VARCHAR) AS posted_date FROM (
         SELECT id, company, salary_min, posted_date FROM postings)"""))
def s12_nested_json_records(spark, sf_dir):
    p = postings(spark, sf_dir)
    msgs = p.select(F.to_json(F.struct(
        "id", "title", F.struct(F.col("company").alias("name")).alias("company"), "location",
        F.struct(F.col("salary_min").alias("minimum"), F.col("salary_max").alias("maximum")).alias("salary"),
        F.col("job_type").alias("jobType"), "description",
        F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss").alias("postedDate"), "url")).alias("value"))
    bad = spark.createDataFrame([("{not json",), ('{"id": "x", "postedDate": "yesterday"}',)], "value string")
    r = fl.parse_nested_json(msgs.unionByName(bad))
    return r.select("id", "company", "salary_min", F.col("posted_date").cast("string").alias("posted_date"))


@register("s13_s14_alternate_csv_dir", with_postings(
    """SELECT id, title, company, CASE WHEN salary_min > 0 THEN salary_min END AS salary_min FROM postings"""))
def s13_s14_alternate_csv_dir(spark, sf_dir):
    """One folder that holds both layouts, in different column orders."""
    p = postings(spark, sf_dir)
    root = scratch_path(spark, "altcsv")
    even = (F.col("id").cast("long") % 2) == 0
    p.where(even).select("id", "title", "company", "location", "description", "salary_min", "salary_max") \
        .write.option("header", True).csv(root)
    p.where(~even).select(F.coalesce("salary_max", F.lit(0.0)).alias("max_salary"), "location",
                          F.col("description").alias("job_description"), F.col("company").alias("company_name"),
                          F.coalesce("salary_min", F.lit(0.0)).alias("min_salary"), F.col("title").alias("job_title"), "id") \
        .write.mode("append").option("header", True).csv(root)
    return fl.read_alternate_csv_dir(spark, root).select("id", "title", "company", "salary_min")


@register("s18_publish_messages", with_postings("SELECT id AS key, title, salary_min, CAST(len(required_skills) AS INTEGER) AS n_skills FROM postings"))
def s18_publish_messages(spark, sf_dir):
    m = fl.to_messages(postings(spark, sf_dir))
    path = scratch_path(spark, "topic")
    m.write.json(path)  # the file stand-in for the topic (no Kafka connector in this environment)
    body = F.from_json("value", "id string, title string, salary_min double, required_skills array<string>")
    sent = spark.read.schema("key string, value string").json(path).select("key", body.alias("m"))
    return sent.where(F.col("m.id") == F.col("key")).select("key", "m.title", "m.salary_min", F.size("m.required_skills").alias("n_skills"))


# ingestion runs after the last posting date, so that strict validation passes; at AS_OF it rejects the batch
INGEST_AS_OF = dt.datetime(2002, 1, 1)
_ASOF = f"TIMESTAMP '{INGEST_AS_OF:%Y-%m-%d %H:%M:%S}'"
_INGEST_SQL = """_in AS (SELECT * FROM postings WHERE source IN ('legal_demo_csv', 'company_feed')),
_final AS (SELECT * EXCLUDE (rn, id, first_id), first_id AS id FROM (SELECT *,
    row_number() OVER (PARTITION BY source, source_posting_id ORDER BY posted_date DESC, CAST(id AS BIGINT) DESC) AS rn,
    first_value(id) OVER (PARTITION BY source, source_posting_id ORDER BY posted_date, CAST(id AS BIGINT)) AS first_id FROM _in) WHERE rn = 1)"""


def _ingest(spark, sf_dir, dry_run=False, as_of=INGEST_AS_OF):
    p = postings(spark, sf_dir)
    root = scratch_path(spark, "table")
    srcs = {"legal_demo_csv": p.where(F.col("source") == "legal_demo_csv"),
            "company_feed": p.where(F.col("source") == "company_feed")}
    # arrival order is a parameter of the feed: by posting date, then id
    srcs = {k: v.orderBy("posted_date", F.col("id").cast("long")) for k, v in srcs.items()}
    summary = ig.ingest(spark, srcs, root, "batch-0001", as_of, dry_run=dry_run)
    return summary, root


@register("u7_ingest_summary", with_postings(
    f"""SELECT source AS provider, count(*) AS fetched, count(*) AS saved, min(source_legal_basis) AS legal_basis,
               (SELECT count(*) FROM _final WHERE expires_at < {_ASOF}) AS expired,
               (SELECT count(*) FROM _final WHERE expires_at IS NULL OR expires_at >= {_ASOF}) AS active_after
        FROM _in GROUP BY source""", _INGEST_SQL))
def u7_ingest_summary(spark, sf_dir):
    s, _ = _ingest(spark, sf_dir)
    return s.select("provider", "fetched", "saved", "legal_basis", "expired", "active_after")


@register("u7_dry_run", with_postings(
    "SELECT source AS provider, count(*) AS fetched, CAST(0 AS BIGINT) AS saved, CAST(0 AS BIGINT) AS expired, CAST(0 AS BIGINT) AS active_after FROM _in GROUP BY source",
    _INGEST_SQL))
def u7_dry_run(spark, sf_dir):
    s, _ = _ingest(spark, sf_dir, dry_run=True)
    return s.select("provider", "fetched", "saved", "expired", "active_after")


@register("u7_ingested_table", with_postings(
    f"SELECT id, source, source_posting_id, title, expires_at < {_ASOF} AS is_expired FROM _final", _INGEST_SQL))
def u7_ingested_table(spark, sf_dir):
    _, root = _ingest(spark, sf_dir)
    return PostingTable(spark, root).current().select("id", "source", "source_posting_id", "title", "is_expired")


@register("u7_rejected_batch", with_postings(
    f"""SELECT 'failed' AS status, 'validation failed: not_in_future:posted_date (' || count(*) || ')' AS error, FALSE AS published
        FROM _in WHERE posted_date > TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'""", _INGEST_SQL))
def u7_rejected_batch(spark, sf_dir):
    """Postings dated after the as-of instant: strict validation rejects the whole batch and nothing is published."""
    p = postings(spark, sf_dir)
    root = scratch_path(spark, "table")
    try:
        ig.ingest(spark, {k: p.where(F.col("source") == k) for k in ("legal_demo_csv", "company_feed")}, root, "batch-0001", AS_OF)
    except ValueError:
        pass
    state = mt.latest_batches(spark.read.parquet(f"{root}/_audit"))
    return state.select("status", "error", F.lit(PostingTable(spark, root).current() is not None).alias("published"))


@register("u3_w9_audit_batches", with_postings(
    f"""SELECT 'batch-0001' AS batch_id, 'completed' AS status, '["legal_demo_csv", "company_feed"]' AS sources, count(*) AS fetched,
               count(*) AS saved, (SELECT count(*) FROM _final WHERE expires_at < {_ASOF}) AS expired FROM _in
        UNION ALL SELECT 'batch-0002', 'failed', '["linkedin"]', 0, 0, 0""", _INGEST_SQL))
def u3_w9_audit_batches(spark, sf_dir):
    _, root = _ingest(spark, sf_dir)
    try:
        _ingest_blocked(spark, sf_dir, root)
    except ValueError:
        pass
    audit = spark.read.parquet(f"{root}/_audit")
    return mt.latest_batches(audit).select("batch_id", "status", "sources", "fetched", "saved", "expired")


def _ingest_blocked(spark, sf_dir, root):
    p = postings(spark, sf_dir)
    return ig.ingest(spark, {"linkedin": p.where(F.col("source") == "linkedin")}, root, "batch-0002", AS_OF)


@register("g5_gate_blocked_sources", with_postings(
    "SELECT DISTINCT source FROM postings WHERE source IN ('linkedin', 'scraper', 'partner_portal')"))
def g5_gate_blocked_sources(spark, sf_dir):
    p = postings(spark, sf_dir)
    req = p.select("source").distinct()
    return gv.evaluate_sources(req, legal_basis=None).where(~F.col("allowed")).select("source")


@register("s3_s7_parse_text_fields", with_postings(
    """SELECT id, CAST(len(list_filter(list_transform(string_split(array_to_string(required_skills, ' ; ') || ';  ', ';'),
                                                lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_skills,
              CAST(posted_date AS VARCHAR) AS posted_ts,
              (lower(trim(o_status)) IN ('1', 'true', 'yes', 'y')) AS flag,
              nullif(trim(split_part(location, ',', 1)), '') AS city,
              CASE WHEN contains(location, ',') AND trim(split_part(location, ',', -1)) <> ''
                   THEN trim(split_part(location, ',', -1)) ELSE 'Germany' END AS country
       FROM (SELECT *, CASE remote_status WHEN 'remote' THEN 'Yes' WHEN 'onsite' THEN ' n ' ELSE '1' END AS o_status FROM postings)"""))
def s3_s7_parse_text_fields(spark, sf_dir):
    from jobsieve.functions.text import decode_skills, infer_city, infer_country, parse_bool, parse_timestamp
    p = postings(spark, sf_dir)
    t = p.select("id", "location",
                 F.concat(F.array_join("required_skills", " ; "), F.lit(";  ")).alias("skills_text"),
                 F.concat(F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts_text"),
                 F.when(F.col("remote_status") == "remote", "Yes").when(F.col("remote_status") == "onsite", " n ")
                 .otherwise("1").alias("flag_text"))
    return t.select("id", F.size(decode_skills("skills_text")).alias("n_skills"),
                    parse_timestamp(F.col("ts_text")).cast("timestamp_ntz").cast("string").alias("posted_ts"),
                    parse_bool(F.col("flag_text"), False).alias("flag"),
                    infer_city("location").alias("city"), infer_country("location").alias("country"))
