"""Source registry (S19): onboarding status of every known listing source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference: the source registry entries, in file order.
REGISTRY_JSON = r"""
[
  {
    "source_id": "legal_demo_csv",
    "display_name": "Legal seed listing dataset",
    "source_type": "local_seed",
    "allowed": true,
    "approval_status": "approved",
    "legal_basis": "Local legal seed data created for portfolio use.",
    "required_action": null,
    "can_store_listings": true,
    "can_display_listings": true,
    "can_link_apply": true,
    "requires_contract": false,
    "refresh_policy": "static seed refreshed by repository commits",
    "dedupe_key": "source + source_posting_id",
    "expiry_policy": "expires_at or repository expiry sweep",
    "use_case": "portfolio seed listings"
  },
  {
    "source_id": "local_csv",
    "display_name": "Local development CSV",
    "source_type": "local_seed",
    "allowed": true,
    "approval_status": "approved",
    "legal_basis": "Local legal seed data for development.",
    "required_action": null,
    "can_store_listings": true,
    "can_display_listings": true,
    "can_link_apply": true,
    "requires_contract": false,
    "refresh_policy": "developer controlled local file",
    "dedupe_key": "source + source_posting_id",
    "expiry_policy": "expires_at or repository expiry sweep",
    "use_case": "local development and tests"
  },
  {
    "source_id": "company_feed",
    "display_name": "Company career feed",
    "source_type": "employer_feed",
    "allowed": true,
    "approval_status": "approved_when_permission_explicit",
    "legal_basis": "Company feed with explicit permission from the employer.",
    "required_action": "Store permission evidence before enabling a real company feed.",
    "can_store_listings": true,
    "can_display_listings": true,
    "can_link_apply": true,
    "requires_contract": true,
    "refresh_policy": "provider-defined feed schedule",
    "dedupe_key": "source + source_posting_id",
    "expiry_policy": "expires_at, feed removal, or last_seen_at stale sweep",
    "use_case": "direct employer postings with apply URLs"
  },
  {
    "source_id": "licensed_provider",
    "display_name": "Licensed job data provider",
    "source_type": "licensed_provider",
    "allowed": true,
    "approval_status": "approved_with_contract",
    "legal_basis": "Provider contract must allow storing, searching, displaying, and linking listings.",
    "required_action": "Attach provider contract and permitted-use summary before production ingestion.",
    "can_store_listings": true,
    "can_display_listings": true,
    "can_link_apply": true,
    "requires_contract": true,
    "refresh_policy": "contract/provider SLA",
    "dedupe_key": "source + source_posting_id",
    "expiry_policy": "provider expiry field, feed removal, or last_seen_at stale sweep",
    "use_case": "production-grade normalized job listings"
  },
  {
    "source_id": "official_api",
    "display_name": "Official job-listing API",
    "source_type": "official_api",
    "allowed": true,
    "approval_status": "approved_when_terms_allow_listing_use",
    "legal_basis": "Official API terms must allow the intended listing use.",
    "required_action": "Document terms allowing storage, search, display, and apply-link handoff.",
    "can_store_listings": true,
    "can_display_listings": true,
    "can_link_apply": true,
    "requires_contract": false,
    "refresh_policy": "official API terms and rate limits",
    "dedupe_key": "source + source_posting_id",
    "expiry_policy": "official expiry field or last_seen_at stale sweep",
    "use_case": "officially permitted listing ingestion"
  },
  {
    "source_id": "linkedin",
    "display_name": "LinkedIn",
    "source_type": "commercial_job_board",
    "allowed": false,
    "approval_status": "blocked_pending_official_access",
    "legal_basis": null,
    "required_action": "Use official partner/API access or written permission that allows this platform use case.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": true,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "stepstone",
    "display_name": "StepStone",
    "source_type": "commercial_job_board",
    "allowed": false,
    "approval_status": "blocked_pending_official_access",
    "legal_basis": null,
    "required_action": "Use official partner/API access or written permission that allows this platform use case.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": true,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "indeed",
    "display_name": "Indeed",
    "source_type": "commercial_job_board",
    "allowed": false,
    "approval_status": "blocked_pending_official_access",
    "legal_basis": null,
    "required_action": "Use official partner/API access or written permission that allows this platform use case.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": true,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "glassdoor",
    "display_name": "Glassdoor",
    "source_type": "commercial_job_board",
    "allowed": false,
    "approval_status": "blocked_pending_official_access",
    "legal_basis": null,
    "required_action": "Use official partner/API access or written permission that allows this platform use case.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": true,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "kaggle",
    "display_name": "Generic Kaggle dataset",
    "source_type": "third_party_dataset",
    "allowed": false,
    "approval_status": "blocked_pending_license_review",
    "legal_basis": null,
    "required_action": "Approve only a specific dataset with license, redistribution rights, and apply-link rules documented.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": false,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "scraper",
    "display_name": "Unapproved scraper",
    "source_type": "scraping",
    "allowed": false,
    "approval_status": "blocked",
    "legal_basis": null,
    "required_action": "Replace with official API, licensed provider, or company feed with explicit permission.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": false,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "web_scraping",
    "display_name": "Unapproved web scraping",
    "source_type": "scraping",
    "allowed": false,
    "approval_status": "blocked",
    "legal_basis": null,
    "required_action": "Replace with official API, licensed provider, or company feed with explicit permission.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": false,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  },
  {
    "source_id": "unapproved_api",
    "display_name": "Unapproved API",
    "source_type": "unknown_api",
    "allowed": false,
    "approval_status": "blocked_pending_terms_review",
    "legal_basis": null,
    "required_action": "Document official terms and permitted use before ingestion.",
    "can_store_listings": false,
    "can_display_listings": false,
    "can_link_apply": false,
    "requires_contract": false,
    "refresh_policy": null,
    "dedupe_key": null,
    "expiry_policy": null,
    "use_case": "not enabled"
  }
]
"""

# Fixed values that must equal the reference: legal-basis phrases that approve an unknown source (G1).
APPROVED_LEGAL_BASIS_TERMS = [
    "local legal demo",
    "local legal seed",
    "licensed",
    "official api",
    "company feed",
    "explicit permission",
    "provider contract",
]

REGISTRY_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("approval_status", T.StringType()),
    T.StructField("legal_basis", T.StringType()),
    T.StructField("required_action", T.StringType()),
    T.StructField("can_store_listings", T.BooleanType()),
    T.StructField("can_display_listings", T.BooleanType()),
    T.StructField("can_link_apply", T.BooleanType()),
    T.StructField("requires_contract", T.BooleanType()),
    T.StructField("refresh_policy", T.StringType()),
    T.StructField("dedupe_key", T.StringType()),
    T.StructField("expiry_policy", T.StringType()),
    T.StructField("use_case", T.StringType()),
])


def load_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Registry entries with ``key`` = lower-cased source id and ``ordinal`` = file order."""
    if path is None:
        entries = json.loads(REGISTRY_JSON)
        rows = [tuple(e.get(f.name) for f in REGISTRY_SCHEMA.fields) + (i,) for i, e in enumerate(entries)]
        df = spark.createDataFrame(rows, T.StructType([*REGISTRY_SCHEMA.fields, T.StructField("ordinal", T.IntegerType())]))
    else:
        # one JSON document: a list whose order is the ordinal
        listed = F.from_json("value", T.ArrayType(REGISTRY_SCHEMA))
        df = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("ordinal", "e")).select("e.*", "ordinal")
    for b in ("can_store_listings", "can_display_listings", "can_link_apply", "requires_contract"):
        df = df.withColumn(b, F.coalesce(F.col(b), F.lit(False)))
    return df.withColumn("key", F.lower(F.col("source_id")))
