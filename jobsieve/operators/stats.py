"""Descriptive statistics, hypothesis test and drift.

Everything is an aggregate over the data; only tiny aggregates (a handful of numbers) reach the
driver, e.g. for the Student-t tail probability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint_any
from jobsieve.operators.salary import floor_quantiles
from jobsieve.session import cut_lineage

WORK_MODES = ["remote", "onsite", "hybrid"]


def normalized_work_mode(c: str = "remote_status") -> Column:
    """remote/onsite/hybrid (case-insensitive), anything else -> unknown."""
    v = F.lower(F.col(c).cast("string"))
    return F.when(v.isin(*WORK_MODES), v).otherwise(F.lit("unknown"))


def file_overview(df: DataFrame) -> DataFrame:
    """A17 scalars: rows and mean/median/min/max over both salary columns pooled (one row)."""
    pooled = df.select(F.inline(F.array(F.struct(F.col("salary_min").cast("double").alias("v")),
                                        F.struct(F.col("salary_max").cast("double").alias("v")))))
    n = df.select(F.count(F.lit(1))).scalar()
    median = floor_quantiles(pooled, [], "v", {}, {"median": 0.5}).select("median").scalar()
    return pooled.where(F.col("v").isNotNull()).agg(
        n.alias("rows"), F.round(F.avg("v"), 6).alias("mean"), median.alias("median"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """A17 top locations / companies: value counts, top ``n`` (ties by value)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.col("count").desc(), F.col(column)).limit(n)


def distribution(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """A18 label / work-mode / source distributions and A23 value counts (nulls kept on request)."""
    d = df if keep_null else df.where(F.col(column).isNotNull())
    return d.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def describe(df: DataFrame, value: Column) -> DataFrame:
    """A18 ``describe()`` of a numeric column: count, mean, std, min, 25/50/75% (linear), max;
    missing statistics as 0 (one row)."""
    values = df.select(value.cast("double").alias("v"))
    # one distributed running total gives the three quantiles as one struct
    q = floor_quantiles(values, [], "v", {}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(F.struct("p25", "p50", "p75").alias("q")).select("q").scalar()
    one = values.agg(
        F.count("v").alias("count"), F.coalesce(F.round(F.avg("v"), 6), F.lit(0.0)).alias("mean"),
        F.coalesce(F.round(F.stddev_samp("v"), 6), F.lit(0.0)).alias("std"),
        F.coalesce(F.min("v"), F.lit(0.0)).alias("min"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("max")).withColumn("_q", q)
    return one.select("count", "mean", "std", "min", *[F.coalesce(F.round(F.col(f"_q.{p}"), 6), F.lit(0.0)).alias(p) for p in ("p25", "p50", "p75")], "max")


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A22 ``describe()`` of several numeric columns at once: (column, count, mean, std, min, p25, p50, p75, max), nulls where
    undefined; one unpivoted aggregate and one pass for all quartiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    q = floor_quantiles(long, ["column"], "v", {}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnRenamed("column", "_c")
    one = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std")]
    return one.join(q, F.col("column") == F.col("_c"), "left").select("column", "count", *rounded, "min", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


def group_summary(df: DataFrame, group: Column, value: Column, id_col: str = "id") -> DataFrame:
    """Per group count of ids, mean, median, sample std of ``value``."""
    rows = df.select(group.alias("group"), F.col(id_col).alias("_id"), value.alias("v"))
    stats = rows.groupBy("group").agg(F.count("_id").alias("count"), F.round(F.avg("v"), 6).alias("avg_salary"),
                                      F.round(F.stddev_samp("v"), 6).alias("salary_std"))
    med = floor_quantiles(rows, ["group"], "v", {}, {"median": 0.5}).select(F.col("group").alias("_g"), F.round("median", 6).alias("median_salary"))
    return stats.join(med, stats["group"].eqNullSafe(med["_g"]), "left").select("group", "count", "avg_salary", "median_salary", "salary_std")


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for every column — one pass, then a narrow unpivot of one row."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])))


def histogram(df: DataFrame, group: Column, value: Column, bins: int = 30) -> DataFrame:
    """A24 histogram data: ``bins`` equal-width bins over the common [min, max] of all groups;
    (group, bin, lower, upper, count). The max falls in the last bin."""
    b = df.select(group.alias("group"), value.alias("v")).where(F.col("v").isNotNull())
    lo = b.select(F.min("v")).scalar()
    hi = b.select(F.max("v")).scalar()
    width = (hi - lo) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).cast("int")
    g = b.groupBy("group", idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("group", "bin", F.round(lo + F.col("bin") * width, 6).alias("lower"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("upper"), "count")


def box_stats(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """A24 box-plot data per group: quartiles (linear), whiskers (most extreme values within
    1.5 IQR of the box) and the number of outliers beyond them."""
    b = df.select(group.alias("group"), value.alias("v")).where(F.col("v").isNotNull())
    q = floor_quantiles(b, ["group"], "v", {}, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("group", "_g")
    j = b.join(q, b["group"].eqNullSafe(q["_g"])).drop("_g")
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= lo_f) & (F.col("v") <= hi_f)
    return j.groupBy("group", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def canonical_text(df: DataFrame, c: str) -> Column:
    """A value as text that any engine can write: numbers with six decimals, timestamps to the microsecond."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.col(c).cast("decimal(38,6)").cast("string")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if kind in ("array", "map", "struct"):
        return F.to_json(c)
    return F.col(c).cast("string")


def fingerprint(df: DataFrame) -> DataFrame:
    """M12 (re-aimed): order-insensitive dataset fingerprint — row count and the exact sum of 60-bit row hashes (one
    row). Columns are hashed in their order with a null mark each, so (null, 'a') and ('a', null) differ."""
    marked = [F.coalesce(F.concat(F.lit("="), canonical_text(df, c)), F.lit("-")) for c in df.columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *marked)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def welch_t_test(df: DataFrame, group: Column, value: Column, a: str = "remote", b: str = "onsite",
                 alpha: float = 0.05) -> DataFrame:
    """Welch's unequal-variance t-test of ``value`` between groups ``a`` and ``b`` (two-sided).

    Means, variances and counts are one aggregate; the tail probability is the share of the integral of cos(x)^(dof-1)
    beyond atan(|t| / sqrt(dof)), by Simpson's rule on a fixed grid (``T_STEPS``) scaled to the integrand's width."""
    s = df.select(group.alias("g"), value.alias("v")).where(F.col("v").isNotNull() & F.col("g").isin(a, b))
    agg = s.agg(*[f(F.when(F.col("g") == k, F.col("v"))).alias(f"{n}_{k}")
                  for k in (a, b) for n, f in (("n", F.count), ("m", F.avg), ("s2", F.var_samp))])
    va, vb = F.try_divide(F.col(f"s2_{a}"), F.col(f"n_{a}")), F.try_divide(F.col(f"s2_{b}"), F.col(f"n_{b}"))
    # undefined (null) when both groups are constant or hold under two values
    t = F.try_divide(F.col(f"m_{a}") - F.col(f"m_{b}"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) ** 2, F.try_divide(va ** 2, F.col(f"n_{a}") - 1) + F.try_divide(vb ** 2, F.col(f"n_{b}") - 1))
    row = agg.select(F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b"), F.col(f"m_{a}").alias("mean_a"),
                     F.col(f"m_{b}").alias("mean_b"), t.alias("t_statistic"), dof.alias("dof"))
    p = F.when(F.col("dof") > 0, student_t_two_sided(F.col("t_statistic"), F.col("dof")))
    return row.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


T_STEPS, T_WIDTH = 2000, 40.0


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``dof`` degrees of freedom."""
    root = F.sqrt(dof)
    top = F.least(F.lit(math.pi / 2) * root, F.lit(T_WIDTH))
    low = F.least(F.atan(F.abs(t) / root) * root, top)

    def integral(start: Column) -> Column:
        h = (top - start) / T_STEPS

        def term(i: Column) -> Column:
            x = F.exp((dof - 1) * F.log(F.greatest(F.cos((start + h * i) / root), F.lit(1e-300))))
            return x * F.when((i == 0) | (i == T_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(T_STEPS)), F.lit(0.0), lambda acc, i: acc + term(i)) * h / 3

    return integral(low) / integral(F.lit(0.0))


def _value_counts(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature, v, k, ca, cb, pid): how often each value of each feature stands in both samples; v for numbers (present
    ones), k for categories (null as ``__null__``). Each sample is read once for all features. The rows are range-partitioned
    by (feature, value), and written once because partition numbers depend on sampled bounds."""
    def long(df: DataFrame, a: int, b: int) -> DataFrame:
        numbers = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"), F.lit(None).cast("string").alias("k")) for c in numeric]
        values = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("v"), F.coalesce(F.col(c).cast("string"), F.lit("__null__")).alias("k")) for c in categorical]
        return df.select(F.explode(F.array(*numbers, *values)).alias("x")).select("x.*", F.lit(a).alias("a"), F.lit(b).alias("b"))

    both = long(reference, 1, 0).unionByName(long(current, 0, 1)).where("v is not null or k is not null")
    counts = both.groupBy("feature", "v", "k").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(counts.repartitionByRange(parts, "feature", "v", "k").withColumn("pid", F.spark_partition_id()))


def _numeric_drift(counts: DataFrame) -> DataFrame:
    """(feature, ks_statistic, wasserstein_normed) from ``_value_counts``: running counts of both samples over the value
    order and the next value, local to a range partition, with what lies before and behind it from a (feature, partition) table."""
    c = counts.where("k is null")
    ends = c.groupBy("feature", "pid").agg(F.sum("ca").alias("sa"), F.sum("cb").alias("sb"), F.min("v").alias("low"), F.sum(F.col("ca") * F.col("v")).alias("sv"))
    order = Window.partitionBy("feature").orderBy("pid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    ends = ends.select(F.col("feature").alias("_f"), F.col("pid").alias("_p"), F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("ob"),
                       F.lead("low").over(order).alias("next_low"), F.sum("sa").over(whole).alias("na"), F.sum("sb").over(whole).alias("nb"),
                       F.try_divide(F.sum("sv").over(whole), F.sum("sa").over(whole)).alias("mean"))
    inside = Window.partitionBy("feature", "pid").orderBy("v")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = c.select("feature", "pid", "v", "ca", F.sum("ca").over(run).alias("xa"), F.sum("cb").over(run).alias("xb"), F.lead("v").over(inside).alias("next"))
    cdf = local.join(ends, (F.col("feature") == F.col("_f")) & (F.col("pid") == F.col("_p"))).select(
        "feature", "v", "ca", "mean", "na", F.try_divide(F.col("xa") + F.col("oa"), F.col("na")).alias("fa"), F.try_divide(F.col("xb") + F.col("ob"), F.col("nb")).alias("fb"),
        F.coalesce("next", "next_low").alias("nv"))
    gap = F.abs(F.col("fa") - F.col("fb"))
    sums = cdf.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.sum(gap * F.coalesce(F.col("nv") - F.col("v"), F.lit(0.0))).alias("area"),
        F.sqrt(F.try_divide(F.sum(F.col("ca") * (F.col("v") - F.col("mean")) ** 2), F.max("na") - 1)).alias("sd"))
    return sums.select("feature", F.round("ks", 6).alias("ks_statistic"), F.round(F.try_divide(F.col("area"), F.col("sd")), 6).alias("wasserstein_normed"))


def _categorical_drift(counts: DataFrame) -> DataFrame:
    """(feature, js_distance) from ``_value_counts``: Jensen-Shannon distance (natural log) of the value shares."""
    c = counts.where("k is not null")
    totals = c.groupBy("feature").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    g = c.join(totals, "feature")
    p, q = F.try_divide(F.col("ca"), F.col("na")), F.try_divide(F.col("cb"), F.col("nb"))  # null: no such sample
    m = (p + q) / 2
    kl = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    return g.groupBy("feature").agg(F.round(F.sqrt(F.greatest(F.lit(0.0), (F.sum(kl(p)) + F.sum(kl(q))) / 2)), 6).alias("js_distance"))


def ks_statistic(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """M14 numeric drift: two-sample Kolmogorov-Smirnov statistic and the Wasserstein-1 distance
    normalised by the reference standard deviation (one row; nulls where a sample is empty or constant)."""
    return _numeric_drift(_value_counts(reference, current, [value], [])).agg(F.max("ks_statistic").alias("ks_statistic"), F.max("wasserstein_normed").alias("wasserstein_normed"))


def js_distance(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """M14 categorical drift: Jensen-Shannon distance (natural log) between value shares (one row)."""
    return _categorical_drift(_value_counts(reference, current, [], [column])).agg(F.max("js_distance").alias("js_distance"))


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
                 numeric_threshold: float = 0.1, categorical_threshold: float = 0.1) -> DataFrame:
    """One row per feature (feature, method, score, drifted) and the share of drifted features; both samples are read once
    for all features. Thresholds are parameters (the reference relies on its drift library's defaults)."""
    counts = _value_counts(reference, current, numeric, categorical)
    asked = counts.sparkSession.createDataFrame(
        [(c, "wasserstein_normed", numeric_threshold) for c in numeric] + [(c, "jensen_shannon", categorical_threshold) for c in categorical],
        "feature string, method string, threshold double")
    scores = _numeric_drift(counts).select("feature", F.lit("wasserstein_normed").alias("method"), F.col("wasserstein_normed").alias("score")).unionByName(
        _categorical_drift(counts).select("feature", F.lit("jensen_shannon").alias("method"), F.col("js_distance").alias("score")))
    u = asked.join(scores, ["feature", "method"], "left").withColumn("drifted", F.col("score") >= F.col("threshold")).drop("threshold")
    # one row per feature (bounded by the feature lists)
    share = F.avg(F.col("drifted").cast("double")).over(Window.partitionBy())
    return u.withColumn("share_drifted", F.round(share, 6))
