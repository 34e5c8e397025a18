"""Table maintenance: expiry sweep, batch stamping, upsert, audit, skill dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.text import decode_skills
from jobsieve.session import cut_lineage


def expire(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows with ``expires_at < as_of`` (strictly) become expired; others keep their flag."""
    due = F.col("expires_at").isNotNull() & (F.col("expires_at") < F.lit(as_of))
    return df.withColumn("is_expired", F.coalesce(F.col("is_expired"), F.lit(False)) | due)


def newly_expired_count(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """U2 return value: rows the sweep flips (one-row frame)."""
    due = F.col("expires_at").isNotNull() & (F.col("expires_at") < F.lit(as_of)) & ~F.coalesce(F.col("is_expired"), F.lit(False))
    return df.agg(F.count_if(due).alias("expired"))


# Fixed values that must equal the reference: fields a re-ingested posting may overwrite.
WRITABLE_FIELDS = [
    "title", "company", "location", "country", "city", "federal_state", "salary_min", "salary_max",
    "salary_period", "salary_is_estimated", "salary_confidence", "job_type", "employment_type", "description",
    "required_skills", "source", "source_posting_id", "url", "application_url", "company_career_url",
    "remote_status", "role_type", "occupation_group", "experience_level", "source_legal_basis",
    "ingestion_batch_id", "posted_date", "posted_at", "expires_at", "last_seen_at", "is_expired",
]


def stamp_batch(df: DataFrame, batch_id: str, as_of: dt.datetime) -> DataFrame:
    """U4: batch id, ``last_seen_at`` defaulted to ``as_of``, ``is_expired`` = false (re-activates)."""
    last_seen = F.coalesce(F.col("last_seen_at"), F.lit(as_of)) if "last_seen_at" in df.columns else F.lit(as_of)
    return df.withColumns({"ingestion_batch_id": F.lit(batch_id), "last_seen_at": last_seen.cast("timestamp_ntz"),
                           "is_expired": F.lit(False)})


def normalize_record(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Integer salaries (truncated), country default Germany, posted_date default ``as_of``,
    is_expired default false."""
    d = df
    for c in ("salary_min", "salary_max"):
        if c in d.columns:
            d = d.withColumn(c, F.col(c).cast("double").cast("long"))
    d = d.withColumn("country", F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Germany"))
                     if "country" in d.columns else F.lit("Germany"))
    d = d.withColumn("posted_date", F.coalesce(F.col("posted_date"), F.lit(as_of)) if "posted_date" in d.columns else F.lit(as_of))
    d = d.withColumn("is_expired", F.coalesce(F.col("is_expired"), F.lit(False)) if "is_expired" in d.columns else F.lit(False))
    return d


# Fixed values that must equal the reference: keys of a table row in the API, in order.
API_KEYS = ["id", "title", "company", "location", "country", "city", "federal_state", "salary_min", "salary_max", "salary_period", "salary_is_estimated",
            "salary_confidence", "job_type", "employment_type", "description", "required_skills", "source", "source_posting_id", "url", "application_url",
            "company_career_url", "remote_status", "role_type", "occupation_group", "experience_level", "source_legal_basis", "ingestion_batch_id", "posted_date",
            "posted_at", "expires_at", "last_seen_at", "is_expired", "created_at", "updated_at"]


def to_api_rows(df: DataFrame) -> DataFrame:
    """Table rows in the API's shape: every key, skills as a list (S4, also from their JSON text), flags never null."""
    kind = df.schema["required_skills"].dataType.simpleString() if "required_skills" in df.columns else "missing"
    special = {"required_skills": decode_skills("required_skills") if kind == "string" else
               F.coalesce("required_skills", F.array().cast("array<string>")) if kind != "missing" else F.array().cast("array<string>")}
    for c in ("salary_is_estimated", "is_expired"):
        special[c] = F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in df.columns else F.lit(False)
    return df.select(*[(special[c] if c in special else F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in API_KEYS])


def generated_id(batch_id: str, *parts: Column) -> Column:
    """Deterministic id of an inserted row (stable under task retries)."""
    marked = [x for p in parts for x in (p.isNull().cast("string"), F.coalesce(p.cast("string"), F.lit("")))]
    return F.substring(F.sha2(F.to_json(F.array(F.lit(batch_id), *marked)), 256), 1, 32)


def resolve_batch(existing: DataFrame, batch: DataFrame, order: str, batch_id: str = "batch") -> DataFrame:
    """One row per target of a batch: its last row by ``order`` with ``_tid``, the id it is stored under.

    A row's target is the existing posting with its (source, source_posting_id). Rows of an identity that the table
    does not hold go where the first of them goes: to the existing posting with its id, else to a new one under that
    id (or one made from the identity). Rows without identity go by their id, and a row with neither is a posting of
    its own. An identity needs both parts non-empty. So ids stay unique, an inserted duplicate keeps the first id, and
    no row is lost but those replaced by a later one."""
    b = batch if "id" in batch.columns else batch.withColumn("id", F.lit(None).cast("string"))
    given = F.nullif(F.col("id"), F.lit(""))
    identity = (F.coalesce(F.col("source"), F.lit("")) != "") & (F.coalesce(F.col("source_posting_id"), F.lit("")) != "")
    key = F.when(identity, F.to_json(F.array("source", "source_posting_id")))
    b = b.withColumns({"_key": key, "_given": given})
    e = existing.select(F.col("id").alias("_eid"), F.when(identity, F.to_json(F.array("source", "source_posting_id"))).alias("_ekey"))
    by_key = e.where("_ekey is not null").groupBy("_ekey").agg(F.min("_eid").alias("_kid"))
    b = b.join(by_key, b["_key"] == by_key["_ekey"], "left").drop("_ekey")
    first = b.where("_kid is null and _key is not null").groupBy(F.col("_key").alias("_fkey")).agg(
        F.min_by(F.struct("_given"), F.col(order)).alias("_f")).select("_fkey", F.col("_f._given").alias("_first"))
    b = b.join(first, b["_key"] == F.col("_fkey"), "left").drop("_fkey")
    # rows with neither identity nor id: equal rows are told apart by their number among themselves
    content = F.xxhash64(*[F.col(c) for c in batch.columns if c != order and not dict(batch.dtypes)[c].startswith("map")])
    alone = F.col("_key").isNull() & F.col("_given").isNull()
    lone = b.where(alone).withColumn("_h", content)
    lone = lone.withColumn("_tid", generated_id(batch_id, F.col("_h"), F.row_number().over(Window.partitionBy("_h").orderBy(order)))).drop("_h")
    rest = b.where(~alone).withColumn("_tid", F.coalesce(
        "_kid", F.when(F.col("_key").isNotNull(), F.coalesce("_first", generated_id(batch_id, F.col("_key")))), "_given"))
    drop = ["_key", "_given", "_kid", "_first"]
    cols = [c for c in b.columns if c not in drop]
    last = rest.groupBy("_tid").agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select("_tid", "_r.*")
    return last.unionByName(lone.select("_tid", *cols))


def upsert(existing: DataFrame, batch: DataFrame, order: str, batch_id: str = "batch") -> DataFrame:
    """U1 + J7: merge a batch into the posting table; ``order`` ranks the batch's rows (the last one wins).

    The batch is resolved to one row per target first and written once (batch-sized); the table then meets it in one
    full outer join on id. Matched rows take the batch's writable fields and keep their id, new rows are inserted.
    Returns the whole table after the merge; a stored table takes ``changed_rows`` instead."""
    r = cut_lineage(resolve_batch(existing, batch, order, batch_id))
    return _merge(existing, r, "full_outer").select(*existing.columns)


def _merge(existing: DataFrame, r: DataFrame, how: str) -> DataFrame:
    """Resolved rows met with the table: its columns, and whether the row was there and active (null: new)."""
    cols = existing.columns
    m = r.select(F.col("_tid"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_b_{c}") for c in r.columns if c in cols])
    e = existing.withColumn("_old", F.lit(True))
    j = e.join(m, e["id"] == m["_tid"], how)

    def merged(c: str) -> Column:
        if c == "id":
            return F.coalesce("id", "_tid")
        if c not in r.columns:
            return F.col(c)
        new = F.col(f"_b_{c}")
        return F.when(F.col("_old").isNull(), new).when(F.col("_hit") & F.lit(c in WRITABLE_FIELDS), new).otherwise(F.col(c))

    was = F.when(F.col("_old"), ~F.coalesce(F.col("is_expired"), F.lit(False))) if "is_expired" in cols else F.lit(None).cast("boolean")
    return j.select(*[merged(c).cast(existing.schema[c].dataType).alias(c) for c in cols], was.alias("_was_active"))


def changed_rows(existing: DataFrame, batch: DataFrame, order: str, batch_id: str = "batch", as_of: dt.datetime | None = None) -> DataFrame:
    """U1 + U2 as a change set for ``PostingTable.commit``: the rows of the table that a batch inserts or overwrites and, with
    ``as_of``, those that the expiry sweep flips. All other rows of the table are neither shuffled nor written."""
    r = cut_lineage(resolve_batch(existing, batch, order, batch_id))
    touched = existing.join(r.select(F.col("_tid").alias("id")), "id", "left_semi")
    rows = _merge(touched, r, "right_outer").withColumn("_swept", F.lit(False))
    if as_of is None:
        return rows
    before = F.coalesce(F.col("is_expired"), F.lit(False))
    due = F.col("expires_at").isNotNull() & (F.col("expires_at") < F.lit(as_of))
    rows = rows.withColumn("_swept", due & ~before).withColumn("is_expired", before | due)
    flips = (existing.where(due & ~before).join(r.select(F.col("_tid").alias("id")), "id", "left_anti").select(*existing.columns)
             .withColumns({"is_expired": F.lit(True), "_was_active": F.lit(True), "_swept": F.lit(True)}))
    return rows.unionByName(flips)


def skill_dimension(existing: DataFrame, names: DataFrame, name: str = "skill") -> DataFrame:
    """Get-or-create skills by name; new ids are a hash of the name (stable)."""
    new = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct() \
        .join(existing.select("name"), "name", "left_anti")
    created = new.select(F.substring(F.sha2("name", 256), 1, 32).alias("id"), "name", F.lit(None).cast("string").alias("category"))
    return existing.select("id", "name", "category").unionByName(created)


AUDIT_COLUMNS = "batch_id string, status string, sources string, started_at timestamp_ntz, finished_at timestamp_ntz, " \
                "fetched long, saved long, expired long, error string"


def audit_row(spark, batch_id: str, status: str, sources: list[str], started: dt.datetime,
              finished: dt.datetime | None = None, fetched: int = 0, saved: int = 0, expired: int = 0,
              error: str | None = None) -> DataFrame:
    """One audit row (append it; the latest row per batch is its state; sources kept as JSON text)."""
    import json
    return spark.createDataFrame([(batch_id, status, json.dumps(sources), started, finished, fetched, saved, expired, error)],
                                 AUDIT_COLUMNS)


def latest_batches(audit: DataFrame, limit: int = 20) -> DataFrame:
    """Latest state per batch, newest first."""
    last = audit.groupBy("batch_id").agg(F.max_by(F.struct(*audit.columns), F.coalesce("finished_at", "started_at")).alias("r")).select("r.*")
    return last.orderBy(F.col("started_at").desc(), F.col("batch_id")).limit(limit)
