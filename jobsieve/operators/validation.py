"""Boundary validation (V1-V8) and silver cleaning.

All rules are column predicates evaluated in one projection; ``failures`` lists every rule a
row breaks (lazy validation). Outputs: valid rows, quarantined rows, per-rule counts, and a
batch verdict (a batch with any failure is rejected as a whole)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.functions.text import parse_timestamp

# Fixed values that must equal the reference: columns that must exist and be non-null.
REQUIRED_COLUMNS = ["id", "title", "company", "location", "currency", "job_type", "description",
                    "required_skills", "posted_date", "source"]
DOUBLE_COLUMNS = ["salary_min", "salary_max", "salary_confidence"]
TIMESTAMP_COLUMNS = ["posted_date", "posted_at", "expires_at", "last_seen_at"]
BOOLEAN_COLUMNS = ["salary_is_estimated", "is_expired"]


def add_missing_columns(df: DataFrame) -> DataFrame:
    """V1: required columns and both salary bounds exist (as nulls when absent)."""
    for c in REQUIRED_COLUMNS + ["salary_min", "salary_max"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def _as_double(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return F.col(c).cast("double")
    return F.col(c).cast("string").try_cast("double")


def _as_ts(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(c).cast("timestamp_ntz")
    return parse_timestamp(F.col(c)).cast("timestamp_ntz")


def rule_columns(df: DataFrame, as_of: dt.datetime) -> list[tuple[str, Column]]:
    """(rule name, failure predicate) for every rule applicable to ``df``'s columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rules: list[tuple[str, Column]] = []
    for c in REQUIRED_COLUMNS:  # V2
        rules.append((f"not_null:{c}", F.col(c).isNull()))
    for c in DOUBLE_COLUMNS:  # V3 (numeric coercion)
        if c in types:
            rules.append((f"coerce_float:{c}", F.col(c).isNotNull() & _as_double(c, types[c]).isNull()))
    for c in BOOLEAN_COLUMNS:  # V3 (boolean coercion)
        if c in types and not isinstance(types[c], T.BooleanType):
            rules.append((f"coerce_bool:{c}", F.col(c).isNotNull() & F.col(c).cast("string").try_cast("boolean").isNull()))
    for c in TIMESTAMP_COLUMNS:  # V3 (datetime coercion)
        if c in types and c != "posted_date":
            rules.append((f"coerce_datetime:{c}", F.col(c).isNotNull() & _as_ts(c, types[c]).isNull()))
    for c in ("salary_min", "salary_max"):  # V4
        v = _as_double(c, types[c])
        rules.append((f"greater_than_0:{c}", v.isNotNull() & ~(v > 0)))
    if "salary_confidence" in types:  # V5
        v = _as_double("salary_confidence", types["salary_confidence"])
        rules.append(("in_range_0_1:salary_confidence", v.isNotNull() & ((v < 0) | (v > 1))))
    pd_ = _as_ts("posted_date", types["posted_date"])  # V6 against the as-of parameter
    rules.append(("not_in_future:posted_date", F.col("posted_date").isNotNull() & (pd_.isNull() | (pd_ > F.lit(as_of)))))
    lo, hi = _as_double("salary_min", types["salary_min"]), _as_double("salary_max", types["salary_max"])  # V7
    rules.append(("salary_bounds_are_valid", lo.isNotNull() & hi.isNotNull() & (hi < lo)))
    return rules


def with_failures(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """V2-V8: add ``failures`` (array of broken rule names, empty when valid)."""
    d = add_missing_columns(df)
    rules = rule_columns(d, as_of)
    return d.withColumn("failures", F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in rules])))


def split_valid(df: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``failures``)."""
    f = with_failures(df, as_of)
    return f.where(F.size("failures") == 0).drop("failures"), f.where(F.size("failures") > 0)


def rule_counts(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per-rule failure counts (rules with no failure omitted)."""
    f = with_failures(df, as_of)
    return f.select(F.explode("failures").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("failures"))


def batch_verdict(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """V8 verdict: one row (rows, invalid_rows, accepted) — the batch is rejected if any row fails."""
    f = with_failures(df, as_of)
    return f.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("failures") > 0).alias("invalid_rows")) \
        .withColumn("accepted", F.col("invalid_rows") == 0)


def validate_strict(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Strict mode: raise with the failing rule names when any row fails; else return ``df``."""
    counts = rule_counts(df, as_of).orderBy("rule").collect()  # one row per rule: bounded
    if counts:
        raise ValueError("validation failed: " + ", ".join(f"{r['rule']} ({r['failures']})" for r in counts))
    return df


def clean_salary(df: DataFrame, lo: str = "salary_min", hi: str = "salary_max") -> DataFrame:
    """V9: keep both bounds only if both > 0 and min <= max, else null both."""
    ok = (F.col(lo) > 0) & (F.col(hi) > 0) & (F.col(lo) <= F.col(hi))
    return df.withColumn(lo, F.when(ok, F.col(lo))).withColumn(hi, F.when(ok, F.col(hi)))


def clean_text(df: DataFrame, skills: str = "required_skills") -> DataFrame:
    """lower+trim title/company/location, drop rows where any is null; skills lower+trim,
    blanks dropped."""
    d = df.where(F.col("title").isNotNull() & F.col("company").isNotNull() & F.col("location").isNotNull())
    for c in ("title", "company", "location"):
        d = d.withColumn(c, F.lower(F.trim(F.col(c))))
    return d.withColumn(skills, F.filter(F.transform(F.col(skills), lambda s: F.lower(F.trim(s))), lambda s: F.trim(s) != ""))
