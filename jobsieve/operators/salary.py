"""Salary statistics, anomalies and missing-salary estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions import keep_where
from jobsieve.functions import salary as S
from jobsieve.session import cut_lineage


def running_totals(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """Running sum of ``weight`` in ``order`` within each key group, without putting a whole group
    in one task: rows are range-partitioned by (keys, order); each partition computes local running
    sums; a tiny (partition, group) table supplies every partition's offset. Adds ``_cum`` (running
    total, inclusive) and ``_n`` (group total)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ``_pid`` depends on the sampled range bounds: it is materialised once (reliable checkpoint in
    # the shared folder), because the two consumers below may otherwise re-run the range shuffle
    # with differently pruned inputs, sample different bounds and disagree on a row's partition
    r = cut_lineage(df.repartitionByRange(parts, *keys, order).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_local", F.sum(weight).over(local))
    tot = r.groupBy("_pid", *keys).agg(F.sum(weight).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    off = tot.select("_pid", *keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                     F.sum("_t").over(whole).alias("_n"))
    o = off.select(F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o_{k}") for k in keys], "_off", "_n")
    same = r["_pid"] == o["_opid"]
    for k in keys:
        same = same & r[k].eqNullSafe(o[f"_o_{k}"])
    return r.join(o, same).drop("_opid", *[f"_o_{k}" for k in keys]).withColumn("_cum", F.col("_local") + F.col("_off")).drop("_local", "_off", "_pid")


def floor_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float],
                    linear: dict[str, float] | None = None) -> DataFrame:
    """Per group ``sorted(values)[int((n-1)*f)]`` (no interpolation), exactly; ``linear`` names quantiles that are
    interpolated between the two neighbouring ranks (0.5: the median), from the same pass.

    Values are first pre-aggregated to (key, value) -> count with map-side combine; the running
    count over the value order is then a distributed running total (``running_totals``), so
    neither a hot group nor the global case (no keys) is ordered in a single task."""
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    if not keys:
        vc = vc.withColumn("_all", F.lit(1))
    gk = keys or ["_all"]
    vc = running_totals(vc, gk, value, "_c")
    aggs = []
    for name, f in fractions.items():
        k = F.floor((F.col("_n") - 1) * F.lit(f))
        hit = (F.col("_cum") > k) & (F.col("_cum") - F.col("_c") <= k)
        aggs.append(F.max(F.when(hit, F.col(value))).alias(name))
    for name, f in (linear or {}).items():
        place = (F.col("_n") - 1) * F.lit(f)
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("_cum") > k) & (F.col("_cum") - F.col("_c") <= k)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    out = vc.groupBy(*gk).agg(*aggs)
    for name in linear or {}:
        lo, hi, part = (F.col(f"_{name}_{x}") for x in ("lo", "hi", "part"))
        out = out.withColumn(name, F.when(part == 0.5, (lo + hi) / 2).otherwise(lo + (hi - lo) * part)).drop(*[f"_{name}_{x}" for x in ("lo", "hi", "part")])
    return out.drop("_all") if not keys else out


def group_salary_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group min, max, median (interpolated), count, floor-index q1 and q3."""
    base = df.where(F.col(value).isNotNull())
    stats = base.groupBy(group).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("count"),
    )
    q = floor_quantiles(base, [group], value, {"q1": 0.25, "q3": 0.75}, {"median": 0.5}).withColumnRenamed(group, "_g")
    return stats.join(q, stats[group].eqNullSafe(q["_g"])).select(group, "min", "max", "median", "count", "q1", "q3")  # a null group is a group


def salary_anomalies(df: DataFrame, id_col: str, role: Column, value: Column,
                     keep: list[str] | None = None, default_iqr_pad: float = 15000.0) -> DataFrame:
    """Rows whose value lies outside the overall IQR fence (``overall_outlier``) or outside
    its role's fence when the role has >= 4 values (``role_outlier``).

    Fence = q1 - 1.5 IQR .. q3 + 1.5 IQR; an IQR of 0 pads by ``default_iqr_pad`` overall and by 0
    per role. Quantiles are floor-index (W2). The overall quantiles are scalar subqueries; the
    role table is one row per role and joins on the role key."""
    keep = keep or []
    base = df.select(F.col(id_col).alias("job_id"), role.alias("role"), value.alias("salary_avg"), *keep) \
             .where(F.col("salary_avg").isNotNull())
    overall = floor_quantiles(base.select("salary_avg"), [], "salary_avg", {"oq1": 0.25, "oq3": 0.75})
    oiqr = F.col("oq3") - F.col("oq1")
    opad = F.when(oiqr != 0, oiqr * 1.5).otherwise(F.lit(default_iqr_pad))
    # the overall fence is ONE scalar subquery (a struct) attached once as a column: referencing
    # separate oq1/oq3 subqueries in every comparison re-ran the global quantile plan per reference
    fence = overall.select(F.struct((F.col("oq1") - opad).alias("lo"), (F.col("oq3") + opad).alias("hi"))).scalar()
    roles = group_salary_stats(base, "role", "salary_avg").select("role", "count", "q1", "q3")
    j = base.join(roles, "role").withColumn("_fence", fence)
    riqr = F.col("q3") - F.col("q1")
    rpad = F.when(riqr != 0, riqr * 1.5).otherwise(F.lit(0.0))
    v = F.col("salary_avg")
    over = (v > F.col("_fence.hi")) | (v < F.col("_fence.lo"))
    rout = (F.col("count") >= 4) & ((v > F.col("q3") + rpad) | (v < F.col("q1") - rpad))
    reasons = F.array_compact(F.array(F.when(over, F.lit("overall_outlier")), F.when(rout, F.lit("role_outlier"))))
    out = j.select("job_id", F.col("role").alias("title"), *keep, "salary_avg",
                   F.col("q1").alias("expected_min"), F.col("q3").alias("expected_max"), reasons.alias("reasons"))
    # filter above the projection: a pushed-down filter would carry its own copy of the fence subquery
    return keep_where(out, F.size("reasons") > 0)


def role_salaries(df: DataFrame, group: str = "title", value: Column | None = None) -> DataFrame:
    """(role, min, max, median, count) of every role with a salary midpoint."""
    v = value if value is not None else S.midpoint()
    base = df.select(F.coalesce(F.col(group), F.lit("Unknown Role")).alias("role"), v.alias("v")).where(F.col("v").isNotNull())
    return group_salary_stats(base, "role", "v").select("role", "min", "max", "median", "count")


def salary_range_for(df: DataFrame, role_query: str, group: str = "title", value: Column | None = None) -> DataFrame:
    """A10: stats of the first role (alphabetically) whose name contains ``role_query``
    (case-insensitive); a zero row when none matches."""
    stats = role_salaries(df, group, value)
    hit = stats.where(F.lower("role").contains(role_query.lower())).orderBy("role").limit(1)
    zero = df.sparkSession.range(1).select(
        F.lit(role_query).alias("role"), F.lit(0.0).alias("min"), F.lit(0.0).alias("max"),
        F.lit(0.0).alias("median"), F.lit(0).cast("long").alias("count"))
    return hit.unionByName(zero.where(~hit.exists()))


def salary_context(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A19 for every posting: dataset midpoint count / mean / median and the posting's % difference
    from the median (null without both bounds)."""
    t = S.midpoint()
    mids = df.select(t.alias("m"))
    # each one-row result is one scalar subquery attached once; the median is a distributed running total
    whole = mids.agg(F.struct(F.count("m").alias("n"), F.avg("m").alias("mean")).alias("s")).select("s").scalar()
    middle = floor_quantiles(mids, [], "m", {}, {"median": 0.5}).select("median").scalar()
    df = df.withColumns({"_whole": whole, "_median": middle})
    n, mean, med = F.col("_whole.n"), F.col("_whole.mean"), F.col("_median")
    pct = F.when(t.isNull() | (n == 0), F.lit(None)).when(med != 0, (t - med) / med * 100).otherwise(F.lit(0.0))
    return df.select(
        F.col(id_col).alias("job_id"), t.alias("target_salary"), n.alias("dataset_salary_count"),
        F.when(t.isNotNull() & (n > 0), med).alias("dataset_median_salary"),
        F.when(t.isNotNull() & (n > 0), F.round(mean, 6)).alias("dataset_mean_salary"),
        F.round(pct, 6).alias("percent_difference_from_median"),
    )


# Fixed values that must equal the reference: estimate rungs (basis label, base confidence).
RUNGS = [
    ("role type + location + experience level", 0.86, ("role_type", "location", "experience_level")),
    ("role type + location", 0.78, ("role_type", "location")),
    ("role type + experience level", 0.7, ("role_type", "experience_level")),
    ("role type", 0.62, ("role_type",)),
    ("occupation group", 0.54, ("occupation_group",)),
]
MULTIPLIED_BASES = ("role type", "occupation group")


def _k(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def estimate_salaries(postings: DataFrame, reference: DataFrame | None = None, currency: str = "EUR") -> DataFrame:
    """J2 + P5: every posting with its effective salary block.

    Peers are listed rows of ``reference`` (default: the postings themselves; J12 passes the whole
    active table). One GROUPING SETS aggregate over peers gives (sum min, sum max, n) for all five rungs; the distinct key
    combinations of unlisted rows meet it in one join and take their first non-empty rung. Listed rows keep their bounds."""
    ref = reference if reference is not None else postings
    keycols = ["role_type", "location", "experience_level", "occupation_group"]
    peers = ref.where(S.is_listed()).select(*[_k(c).alias("k_" + c) for c in keycols],
                                            F.col("salary_min").cast("double").alias("lo"),
                                            F.col("salary_max").cast("double").alias("hi"))
    kcols = ["k_" + c for c in keycols]
    agg = peers.groupingSets([[F.col("k_" + c) for c in cols] for _, _, cols in RUNGS], *kcols).agg(
        F.grouping_id(*kcols).alias("gid"), F.sum("lo").alias("s_lo"), F.sum("hi").alias("s_hi"),
        F.count(F.lit(1)).alias("n"))
    # each key combination of an unlisted row looks up its five rungs in one join and keeps the first that has peers
    names = ["_k_" + c for c in keycols]
    out = postings.withColumns({"_k_" + c: _k(c) for c in keycols})
    rungs = []
    for i, (_, _, cols) in enumerate(RUNGS):
        gid = sum(1 << (len(keycols) - 1 - keycols.index(c)) for c in keycols if c not in cols)
        rungs.append(F.struct(F.lit(i).alias("rung"), F.lit(gid).alias("gid"), *[(F.col("_k_" + c) if c in cols else F.lit("")).alias("k_" + c) for c in keycols]))
    unlisted = out.where(S.midpoint().isNull() & ~S.is_listed())
    wanted = unlisted.select(*names).distinct().select(*names, F.explode(F.array(*rungs)).alias("r")).select(*names, "r.*")
    table = agg.select(F.col("gid").cast("int").alias("gid"), *[F.coalesce("k_" + c, F.lit("")).alias("k_" + c) for c in keycols], "s_lo", "s_hi", "n")
    first = wanted.join(table, ["gid", *kcols]).groupBy(*names).agg(F.min_by(F.struct("rung", "s_lo", "s_hi", "n"), "rung").alias("_peers"))
    out = out.join(first, names, "left")
    n_, rung = F.col("_peers.n"), F.col("_peers.rung")
    lo_, hi_ = F.col("_peers.s_lo") / n_, F.col("_peers.s_hi") / n_
    basis = F.coalesce(*[F.when(rung == i, F.lit(b)) for i, (b, _, _) in enumerate(RUNGS)])
    conf0 = F.coalesce(*[F.when(rung == i, F.lit(c)) for i, (_, c, _) in enumerate(RUNGS)])
    mult = F.when(basis.isin(*MULTIPLIED_BASES), S.experience_multiplier() * S.location_multiplier()).otherwise(F.lit(1.0))
    est_lo, est_hi = lo_ * mult, hi_ * mult
    conf = F.bround(F.least(conf0 + F.least(n_, F.lit(5)) * 0.02, F.lit(0.9)), 2)

    mid = S.midpoint()
    has_mid = mid.isNotNull()
    estimable = ~has_mid & ~S.is_listed() & n_.isNotNull()
    flagged = F.coalesce(F.col("salary_is_estimated").cast("boolean"), F.lit(False))
    e_lo, e_hi = F.bround(est_lo, -2), F.bround(est_hi, -2)
    sal_min = F.when(has_mid, F.col("salary_min").cast("double")).when(estimable, e_lo)
    sal_max = F.when(has_mid, F.col("salary_max").cast("double")).when(estimable, e_hi)
    drop = [c for c in out.columns if c.startswith("_")]
    return out.select(
        *[c for c in postings.columns],
        sal_min.alias("eff_salary_min"),
        sal_max.alias("eff_salary_max"),
        F.when(has_mid, mid).when(estimable, F.bround((est_lo + est_hi) / 2, 2)).alias("salary_midpoint"),
        F.when(has_mid, S.salary_label(F.col("salary_min"), F.col("salary_max"), flagged, currency))
         .when(estimable, S.salary_label(e_lo, e_hi, F.lit(True), currency))
         .otherwise(F.lit("Salary not listed")).alias("salary_label"),
        F.when(has_mid, F.when(flagged, F.lit("estimated")).otherwise(F.lit("listed")))
         .when(estimable, F.lit("estimated")).otherwise(F.lit("missing")).alias("salary_type"),
        F.when(has_mid, flagged).otherwise(estimable).alias("eff_salary_is_estimated"),
        F.when(has_mid, F.when(flagged, F.col("salary_confidence")).otherwise(F.lit(1.0)))
         .when(estimable, conf).alias("eff_salary_confidence"),
        F.when(has_mid, F.lit(None).cast("string")).when(estimable, basis).alias("salary_estimation_basis"),
    ).drop(*drop)


def salary_range_filter(estimated: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """keep rows whose effective midpoint lies in [lo, hi]; a missing midpoint passes only when
    neither bound is given."""
    m = F.col("salary_midpoint")
    if lo is None and hi is None:
        return estimated
    cond = m.isNotNull()
    if lo is not None:
        cond = cond & (m >= lo)
    if hi is not None:
        cond = cond & (m <= hi)
    return estimated.where(cond)
