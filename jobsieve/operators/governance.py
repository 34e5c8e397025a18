"""Source governance (G1-G5): decide per source whether it may be ingested or served.

The library's own registry is broadcast (a few entries that would else deal all rows out over as many keys as there are
sources); one that is given joins as Spark picks by its size. The legal-basis test is a row-local ``exists`` over a literal phrase list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.sources.registry import APPROVED_LEGAL_BASIS_TERMS, load_registry

# Fixed values that must equal the reference: decision reasons and actions.
REASON_REGISTRY_ALLOWED = "Source is approved by the source onboarding registry."
REASON_NOT_APPROVED = "Source is not approved for production ingestion."
REASON_LEGAL_BASIS = "Source includes an acceptable legal basis."
REASON_NO_BASIS = "Source has no approved legal basis attached."
ACTION_ATTACH_BASIS = "Attach source_legal_basis before ingestion or serving."


def _registry(spark: SparkSession, registry: DataFrame | None) -> DataFrame:
    return registry if registry is not None else F.broadcast(load_registry(spark))  # a list in the code: Spark does not know its size


def evaluate_sources(df: DataFrame, source: str = "source", legal_basis: str | None = "source_legal_basis",
                     registry: DataFrame | None = None) -> DataFrame:
    """G1: add the decision columns (allowed, reason, required_action, approval_status, source_type,
    can_store_listings, can_display_listings, can_link_apply) to every row."""
    reg = _registry(df.sparkSession, registry).select(
        F.col("key").alias("_rk"), F.col("allowed").alias("_ra"), F.col("required_action").alias("_rq"),
        F.col("approval_status").alias("_rs"), F.col("source_type").alias("_rt"),
        F.col("can_store_listings").alias("_r1"), F.col("can_display_listings").alias("_r2"),
        F.col("can_link_apply").alias("_r3"))
    key = F.lower(F.trim(F.coalesce(F.col(source).cast("string"), F.lit(""))))
    basis = F.lower(F.trim(F.coalesce(F.col(legal_basis).cast("string"), F.lit("")))) if legal_basis else F.lit("")
    d = df.withColumn("_sk", key).withColumn("_lb", basis).join(reg, F.col("_sk") == F.col("_rk"), "left")
    known = F.col("_rk").isNotNull()
    phrase = F.exists(F.array(*[F.lit(t) for t in APPROVED_LEGAL_BASIS_TERMS]), lambda t: F.col("_lb").contains(t))
    allowed = F.when(known, F.col("_ra")).otherwise(phrase)
    out = d.withColumns({
        "allowed": allowed,
        "reason": F.when(known & F.col("_ra"), F.lit(REASON_REGISTRY_ALLOWED)).when(known, F.lit(REASON_NOT_APPROVED))
                   .when(phrase, F.lit(REASON_LEGAL_BASIS)).otherwise(F.lit(REASON_NO_BASIS)),
        "required_action": F.when(known, F.col("_rq")).when(phrase, F.lit(None)).otherwise(F.lit(ACTION_ATTACH_BASIS)),
        "approval_status": F.when(known, F.col("_rs")).when(phrase, F.lit("approved_by_legal_basis")),
        "source_type": F.when(known, F.col("_rt")).when(phrase, F.lit("custom")),
        "can_store_listings": F.when(known, F.col("_r1")).otherwise(phrase),
        "can_display_listings": F.when(known, F.col("_r2")).otherwise(phrase),
        "can_link_apply": F.when(known, F.col("_r3")).otherwise(phrase),
    })
    return out.drop("_sk", "_lb", "_rk", "_ra", "_rq", "_rs", "_rt", "_r1", "_r2", "_r3")


def blocked(df: DataFrame, **kw) -> DataFrame:
    """Rows whose source is not allowed."""
    return evaluate_sources(df, **kw).where(~F.col("allowed"))


def require_approved(spark: SparkSession, sources: list[str]) -> None:
    """Raise before any read when a requested source is blocked (tiny, bounded check)."""
    req = spark.createDataFrame([(s,) for s in sources], "source string")
    bad = evaluate_sources(req, legal_basis=None).where(~F.col("allowed")).select("source", "reason").collect()
    if bad:
        details = "; ".join(f"{r['source']}: {r['reason']}" for r in bad)
        raise ValueError(f"Unapproved data source requested: {details}")


def governance_report(postings: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per distinct source with its first-seen legal basis (``order``: the listing
    order, default newest first then title then id) and its decision; plus ``approved_for_current_stage``
    (all sources allowed) on every row."""
    o = order if order is not None else F.struct(
        (-F.unix_micros(F.col("posted_date").cast("timestamp"))).alias("a"), F.coalesce("title", F.lit("")).alias("b"),
        F.col("id").alias("c"))
    firsts = postings.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source")) \
        .agg(F.min_by("source_legal_basis", o).alias("legal_basis"))
    dec = evaluate_sources(firsts, legal_basis="legal_basis")
    overall = dec.select(F.bool_and("allowed")).scalar()
    return dec.withColumn("approved_for_current_stage", overall)


def registry_listing(spark: SparkSession, source: str | None = None, approved_only: bool = False,
                     blocked_only: bool = False, registry: DataFrame | None = None) -> DataFrame:
    """Registry entries filtered by source id, approved-only or blocked-only."""
    reg = registry if registry is not None else load_registry(spark)
    if source:
        reg = reg.where(F.col("key") == source.strip().lower())
    if approved_only:
        reg = reg.where(F.col("allowed"))
    if blocked_only:
        reg = reg.where(~F.col("allowed"))
    return reg
