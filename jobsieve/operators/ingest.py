"""End-to-end ingestion (U7) with governance gate (G5), stamping (U4), validation (V8),
upsert (U1), expiry (U2), batch summary (A20) and audit rows (U3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators import governance as gv
from jobsieve.operators import maintain as mt
from jobsieve.operators import validation as va
from jobsieve.session import cut_lineage
from jobsieve.sources import files as fl
from jobsieve.sources.posting_table import PostingTable

# Fixed values that must equal the reference: reasons of the provider results.
REASON_SAVED = "Source passed governance, validation, and repository persistence."
REASON_DRY = "Source passed governance and validation; repository write skipped for dry run."


def ingest(spark: SparkSession, sources: dict[str, DataFrame], table_root: str, batch_id: str, as_of: dt.datetime,
           keywords: list[str] | None = None, limit_per_source: int | None = None, dry_run: bool = False,
           order: str = "id", mark_expired: bool = True) -> DataFrame:
    """Run one ingestion batch; one summary row per provider (fetched, saved, legal basis, reason) with the totals.

    A ``running`` audit row is written first, then ``completed`` or ``failed`` (the latest row is the batch's state), so
    a killed job leaves a trace. The batch is written once in arrival order (provider order, then row order); after every
    source passed, one commit publishes the changed rows and counts them (A20). A failure leaves the
    table untouched; a batch id that was committed before changes nothing. A dry run writes nothing and reports saved 0,
    expired 0 and the current number of active postings."""
    if not sources:
        raise ValueError("at least one source is required")
    now = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    started, names = now(), list(sources)
    table = PostingTable(spark, table_root)
    audit_root = f"{table_root.rstrip('/')}/_audit"

    def audit(status: str, **kw) -> None:
        if not dry_run:
            mt.audit_row(spark, batch_id, status, names, started, **kw).write.mode("append").parquet(audit_root)

    audit("running")
    try:
        gv.require_approved(spark, names)                                     # G5
        fetched = fl.union_sources({n: fl.keyword_filter(df, keywords or []) for n, df in sources.items()},
                                   limit_per_source, order)                   # S8-S11
        stamped = mt.stamp_batch(fetched, batch_id, as_of).withColumn("_ord", F.monotonically_increasing_id())
        stamped = cut_lineage(stamped)                                        # batch-sized; fixes the arrival order
        va.validate_strict(stamped.drop("_provider", "_ord"), as_of)          # V8 (raises)
        per = stamped.groupBy(F.col("_provider").alias("provider")).agg(
            F.count(F.lit(1)).alias("fetched"), F.min("source_legal_basis").alias("legal_basis"))
        n_fetched = stamped.count()
        state, expired = table.manifest(), 0
        if not dry_run:
            existing = table.current()
            if existing is None:
                existing = stamped.drop("_ord", "_provider").limit(0)
            changes = mt.changed_rows(existing, stamped.select(*existing.columns, "_ord"), "_ord", batch_id, as_of if mark_expired else None)
            state = table.commit(changes, batch_id)                           # U1 + U2: the one write
            expired = state.commit["expired"]
        active_after = state.active
        saved = 0 if dry_run else n_fetched
        audit("completed", finished=now(), fetched=n_fetched, saved=saved, expired=expired)
        reason = REASON_DRY if dry_run else REASON_SAVED
        return per.select("provider", "fetched", (F.lit(0).cast("long") if dry_run else F.col("fetched")).alias("saved"), "legal_basis",
                          F.lit(reason).alias("reason"), F.lit(n_fetched).cast("long").alias("total_fetched"),
                          F.lit(saved).cast("long").alias("total_saved"), F.lit(expired).cast("long").alias("expired"),
                          F.lit(active_after).cast("long").alias("active_after"), F.lit(dry_run).alias("dry_run"))
    except Exception as e:
        audit("failed", finished=now(), error=str(e))
        raise
