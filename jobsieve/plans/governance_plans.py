"""Governance and validation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.operators import governance as gv
from jobsieve.operators import validation as va
from jobsieve.plans.oracle_base import with_postings
from jobsieve.plans.registry import register
from jobsieve.session import scratch_path
from jobsieve.sources.registry import APPROVED_LEGAL_BASIS_TERMS, REGISTRY_JSON, load_registry
from jobsieve.sources.tables import AS_OF, postings, table

import json as _json


def _registry_cte() -> str:
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(
        f"({q(e['source_id'].lower())}, {q(e['allowed'])}, {q(e.get('required_action'))}, {q(e.get('approval_status'))}, "
        f"{q(e.get('source_type'))}, {q(bool(e.get('can_store_listings')))}, {q(bool(e.get('can_display_listings')))}, "
        f"{q(bool(e.get('can_link_apply')))})" for e in _json.loads(REGISTRY_JSON))
    return (f"_reg AS (SELECT * FROM (VALUES {rows}) v(rk, ra, rq, rs, rt, r1, r2, r3))")


_PHRASE = "(" + " OR ".join(f"contains(lb, '{t}')" for t in APPROVED_LEGAL_BASIS_TERMS) + ")"
_DECISION = f"""
  s.*, CASE WHEN rk IS NOT NULL THEN ra ELSE {_PHRASE} END AS allowed,
  CASE WHEN rk IS NOT NULL AND ra THEN '{gv.REASON_REGISTRY_ALLOWED}' WHEN rk IS NOT NULL THEN '{gv.REASON_NOT_APPROVED}'
       WHEN {_PHRASE} THEN '{gv.REASON_LEGAL_BASIS}' ELSE '{gv.REASON_NO_BASIS}' END AS reason,
  CASE WHEN rk IS NOT NULL THEN rq WHEN {_PHRASE} THEN NULL ELSE '{gv.ACTION_ATTACH_BASIS}' END AS required_action,
  CASE WHEN rk IS NOT NULL THEN rs WHEN {_PHRASE} THEN 'approved_by_legal_basis' END AS approval_status,
  CASE WHEN rk IS NOT NULL THEN rt WHEN {_PHRASE} THEN 'custom' END AS source_type,
  CASE WHEN rk IS NOT NULL THEN r1 ELSE {_PHRASE} END AS can_store_listings"""


@register("g1_source_decisions", with_postings(f"""
SELECT id, source, allowed, reason, required_action, approval_status, source_type, can_store_listings FROM (
  SELECT {_DECISION}
  FROM (SELECT *, lower(trim(coalesce(source, ''))) AS sk, lower(trim(coalesce(source_legal_basis, ''))) AS lb FROM postings) s
  LEFT JOIN _reg ON s.sk = _reg.rk)""", _registry_cte()))
def g1_source_decisions(spark, sf_dir):
    d = gv.evaluate_sources(postings(spark, sf_dir))
    return d.select("id", "source", "allowed", "reason", "required_action", "approval_status", "source_type", "can_store_listings")


@register("g2_blocked_postings", with_postings(f"""
SELECT id, source, reason FROM (
  SELECT {_DECISION}
  FROM (SELECT *, lower(trim(coalesce(source, ''))) AS sk, lower(trim(coalesce(source_legal_basis, ''))) AS lb FROM postings) s
  LEFT JOIN _reg ON s.sk = _reg.rk) WHERE NOT allowed""", _registry_cte()))
def g2_blocked_postings(spark, sf_dir):
    return gv.blocked(postings(spark, sf_dir)).select("id", "source", "reason")


@register("g3_governance_report", with_postings(f"""
SELECT source, legal_basis, allowed, reason, required_action, approval_status, source_type, can_store_listings,
       bool_and(allowed) OVER () AS approved_for_current_stage FROM (
  SELECT {_DECISION}
  FROM (SELECT source, legal_basis, lower(trim(coalesce(source, ''))) AS sk, lower(trim(coalesce(legal_basis, ''))) AS lb
        FROM (SELECT coalesce(source, 'unknown') AS source,
                     arg_min(source_legal_basis, (-epoch_us(posted_date), coalesce(title, ''), id)) AS legal_basis
              FROM postings GROUP BY 1)) s
  LEFT JOIN _reg ON s.sk = _reg.rk)""", _registry_cte()))
def g3_governance_report(spark, sf_dir):
    r = gv.governance_report(postings(spark, sf_dir))
    return r.select("source", "legal_basis", "allowed", "reason", "required_action", "approval_status", "source_type",
                    "can_store_listings", "approved_for_current_stage")


def _registry_ids() -> str:
    rows = ", ".join("({}, {}, {}, {})".format(*[("NULL" if v is None else "'" + str(v).replace("'", "''") + "'")
                                                   for v in (e["source_id"], e.get("approval_status"), e.get("required_action"))],
                                                 "TRUE" if e["allowed"] else "FALSE")
                     for e in _json.loads(REGISTRY_JSON))
    return f"(SELECT * FROM (VALUES {rows}) v(source_id, approval_status, required_action, allowed))"


@register("g4_registry_blocked", with_postings(f"""
SELECT source_id, approval_status, required_action FROM {_registry_ids()} r
WHERE NOT allowed AND lower(source_id) IN (SELECT lower(source) FROM postings WHERE source IS NOT NULL)"""))
def g4_registry_blocked(spark, sf_dir):
    # registry entries that are blocked, restricted to the sources the posting table actually uses
    used = postings(spark, sf_dir).select(F.lower("source").alias("key")).distinct()
    return gv.registry_listing(spark, blocked_only=True).join(used, "key").select("source_id", "approval_status", "required_action")


@register("s19_registry_file", """
SELECT s_name AS source_id, lower(s_name) AS key, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS ordinal, s_suppkey % 3 <> 0 AS allowed,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'approved' ELSE 'blocked' END AS approval_status, coalesce(CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 2 = 0 END, FALSE) AS can_store_listings
FROM supplier""")
def s19_registry_file(spark, sf_dir):
    """A registry document made from the suppliers (a list in key order; some entries leave a right out), read by its path."""
    k = F.col("s_suppkey")
    entry = F.struct(k, F.col("s_name").alias("source_id"), (k % 3 != 0).alias("allowed"), F.when(k % 3 != 0, "approved").otherwise("blocked").alias("approval_status"),
                     F.when(k % 5 > 0, k % 2 == 0).alias("can_store_listings"))
    path = scratch_path(spark, "registry")
    table(spark, sf_dir, "supplier").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return load_registry(spark, path).select("source_id", "key", "ordinal", "allowed", "approval_status", "can_store_listings")


_RULE_SQL = f"""
_v AS (
  SELECT id, list_filter([
    CASE WHEN id IS NULL THEN 'not_null:id' END, CASE WHEN title IS NULL THEN 'not_null:title' END,
    CASE WHEN company IS NULL THEN 'not_null:company' END, CASE WHEN location IS NULL THEN 'not_null:location' END,
    CASE WHEN currency IS NULL THEN 'not_null:currency' END, CASE WHEN job_type IS NULL THEN 'not_null:job_type' END,
    CASE WHEN description IS NULL THEN 'not_null:description' END,
    CASE WHEN required_skills IS NULL THEN 'not_null:required_skills' END,
    CASE WHEN posted_date IS NULL THEN 'not_null:posted_date' END, CASE WHEN source IS NULL THEN 'not_null:source' END,
    CASE WHEN salary_min IS NOT NULL AND NOT (salary_min > 0) THEN 'greater_than_0:salary_min' END,
    CASE WHEN salary_max IS NOT NULL AND NOT (salary_max > 0) THEN 'greater_than_0:salary_max' END,
    CASE WHEN salary_confidence IS NOT NULL AND (salary_confidence < 0 OR salary_confidence > 1) THEN 'in_range_0_1:salary_confidence' END,
    CASE WHEN posted_date IS NOT NULL AND posted_date > TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}' THEN 'not_in_future:posted_date' END,
    CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL AND salary_max < salary_min THEN 'salary_bounds_are_valid' END
  ], lambda x: x IS NOT NULL) AS failures
  FROM postings)"""


@register("v8_rule_counts", with_postings(
    "SELECT rule, count(*) AS failures FROM (SELECT unnest(failures) AS rule FROM _v) GROUP BY rule", _RULE_SQL))
def v8_rule_counts(spark, sf_dir):
    return va.rule_counts(postings(spark, sf_dir), AS_OF)


@register("v8_quarantine", with_postings(
    "SELECT id, array_to_string(failures, '|') AS failures FROM _v WHERE len(failures) > 0", _RULE_SQL))
def v8_quarantine(spark, sf_dir):
    _, bad = va.split_valid(postings(spark, sf_dir), AS_OF)
    return bad.select("id", F.array_join("failures", "|").alias("failures"))


@register("v8_batch_verdict", with_postings(
    "SELECT count(*) AS rows, count(*) FILTER (WHERE len(failures) > 0) AS invalid_rows, "
    "count(*) FILTER (WHERE len(failures) > 0) = 0 AS accepted FROM _v", _RULE_SQL))
def v8_batch_verdict(spark, sf_dir):
    return va.batch_verdict(postings(spark, sf_dir), AS_OF)


@register("v1_v3_coercion_rules_events", """
SELECT count(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS DOUBLE) IS NULL) AS bad_salary_min,
       count(*) FILTER (WHERE value IS NOT NULL AND NOT (value > 0)) AS non_positive_salary_max
FROM events""")
def v1_v3_coercion_rules_events(spark, sf_dir):
    # events shaped as a raw text batch: props (JSON text) as salary_min must fail coercion
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("salary_min"), F.col("value").alias("salary_max"),
        F.col("ts").alias("posted_date"))
    f = va.with_failures(ev, AS_OF)
    return f.agg(F.count_if(F.array_contains("failures", "coerce_float:salary_min")).alias("bad_salary_min"),
                 F.count_if(F.array_contains("failures", "greater_than_0:salary_max")).alias("non_positive_salary_max"))
