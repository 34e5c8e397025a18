"""Bronze -> silver -> gold layers and the facts read from them."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint
from jobsieve.operators.validation import clean_salary, clean_text
from jobsieve.operators.salary import floor_quantiles
from jobsieve.session import cut_lineage

BRONZE_COLUMNS = ["id", "title", "company", "location", "description", "source", "salary_min", "salary_max",
                  "required_skills", "posted_date", "ingested_at"]


def staging(bronze: DataFrame) -> DataFrame:
    """The staging model is a projection of the bronze columns."""
    return bronze.select(*BRONZE_COLUMNS)


def silver(bronze: DataFrame) -> DataFrame:
    """V9 + V10 + W1: cleaned rows, newest ``ingested_at`` per (title, company, location); ties by id.

    ``max_by`` over the key is a partial aggregate (no window sort of a hot key's rows)."""
    c = clean_text(clean_salary(staging(bronze)))
    key = ["title", "company", "location"]
    rest = [x for x in c.columns if x not in key]
    return (c.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ingested_at", F.col("id"))).alias("r"))
            .select(*key, "r.*").select(*BRONZE_COLUMNS))


def skill_month_mart(silver_df: DataFrame, top_locations: int = 10) -> DataFrame:
    """Per (skill, month): distinct jobs, distinct companies, mean midpoint, first 10 distinct
    locations alphabetically."""
    ex = silver_df.where(F.col("posted_date").isNotNull()).select(
        F.col("id").alias("job_id"), F.explode("required_skills").alias("skill"),
        F.date_trunc("month", F.col("posted_date").cast("timestamp")).cast("date").alias("month"),
        "location", "company", ((F.col("salary_min") + F.col("salary_max")) / 2).alias("mid"))
    mart = ex.groupBy("skill", "month").agg(
        F.count_distinct("job_id").alias("job_count"), F.count_distinct("company").alias("company_count"),
        F.avg("mid").alias("avg_salary"))
    # at most ``top_locations`` rows per group are ever collected
    place = Window.partitionBy("skill", "month").orderBy("location")
    first = (ex.where(F.col("location").isNotNull()).select("skill", "month", "location").distinct()
             .withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= top_locations)
             .groupBy("skill", "month").agg(F.array_sort(F.collect_list("location")).alias("top_locations")))
    named = first.select(F.col("skill").alias("_s"), F.col("month").alias("_m"), "top_locations")
    out = mart.join(named, mart["skill"].eqNullSafe(named["_s"]) & (mart["month"] == named["_m"]), "left")
    return out.select("skill", "month", "job_count", "company_count", "avg_salary",
                      F.coalesce("top_locations", F.array().cast("array<string>")).alias("top_locations"))


def _month(c: str) -> Column:
    return F.date_trunc("month", F.col(c).cast("timestamp")).cast("date")


def refresh_layers(root: str, bronze: DataFrame, batch_id: str) -> dict[str, int]:
    """The layers as tables under ``root``, brought up to date with one batch of bronze rows: ``bronze`` (one folder per
    batch), ``silver`` and ``gold`` (the skill mart), both partitioned by the month of ``posted_date``.

    Only months that the batch touches are rewritten (dynamic partition overwrite): the months of its rows and those of the
    older rows that they replace in W1. Returns the number of months rewritten, of silver rows and of mart rows in them.
    Running a batch again gives the same tables."""
    spark = bronze.sparkSession
    paths = {n: f"{root.rstrip('/')}/{n}" for n in ("bronze", "silver", "gold")}
    staging(bronze).write.mode("overwrite").parquet(f"{paths['bronze']}/batch={batch_id}")
    new = cut_lineage(silver(spark.read.schema(staging(bronze).schema).parquet(f"{paths['bronze']}/batch={batch_id}")).withColumn("month", _month("posted_date")))  # batch-sized; read by every step below
    key = ["title", "company", "location"]
    try:
        old = spark.read.schema(new.schema).parquet(paths["silver"])
    except AnalysisException:
        old = new.limit(0)
    replaced = cut_lineage(old.join(new.select(*key).distinct(), key, "left_semi"))
    months = cut_lineage(new.select("month").unionByName(replaced.select("month")).distinct())
    # rows of the touched months that stay, and the newest row per key of the rest
    touched = old.join(months.withColumnRenamed("month", "_m"), F.col("month").eqNullSafe(F.col("_m")), "left_semi")
    stay = touched.join(new.select(*key).distinct(), key, "left_anti")
    rest = [c for c in BRONZE_COLUMNS if c not in key]
    best = new.select(*BRONZE_COLUMNS).unionByName(replaced.select(*BRONZE_COLUMNS)).groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct("ingested_at", F.col("id"))).alias("r")).select(*key, "r.*").withColumn("month", _month("posted_date"))
    rows = cut_lineage(stay.unionByName(best.select(*new.columns)))
    _replace_months(rows, months, paths["silver"])
    mart = cut_lineage(skill_month_mart(rows.drop("month")))
    _replace_months(mart, months, paths["gold"])
    return {"months": months.count(), "silver_rows": rows.count(), "gold_rows": mart.count()}


def _replace_months(rows: DataFrame, months: DataFrame, path: str) -> None:
    """Overwrite the partitions of ``months`` with ``rows``; a month without rows any more loses its folder."""
    spark = rows.sparkSession
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    gone = months.join(rows.select(F.col("month").alias("_m")).distinct(), F.col("month").eqNullSafe(F.col("_m")), "left_anti").collect()  # months
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in gone:
        folder = hadoop(f"{path}/month={r.month if r.month is not None else '__HIVE_DEFAULT_PARTITION__'}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def skill_trend_fact(postings: DataFrame) -> DataFrame:
    """Per (skill, month): occurrences, % of the month's mentions, salary premium vs the
    month's unweighted mean of skill means, month-over-month growth (lag over the skill's months)."""
    ex = postings.select(F.explode("required_skills").alias("skill"),
                         F.date_trunc("month", F.col("posted_date").cast("timestamp")).cast("date").alias("month"),
                         midpoint().alias("mid")).where(F.col("month").isNotNull())
    g = ex.groupBy("skill", "month").agg(F.count(F.lit(1)).alias("occurrences"), F.avg("mid").alias("mean"))
    m = g.groupBy("month").agg(F.sum("occurrences").alias("_tot"), F.avg("mean").alias("_base"))
    j = g.join(m, "month")
    w = Window.partitionBy("skill").orderBy("month")
    prev = F.lag("occurrences").over(w)
    return j.select(
        "skill", "month", "occurrences",
        F.round(F.col("occurrences") / F.col("_tot") * 100, 6).alias("percentage"),
        F.round((F.col("mean") - F.col("_base")) / F.col("_base") * 100, 6).alias("salary_premium"),
        F.round(F.when(prev > 0, (F.col("occurrences") - prev) / prev * 100), 6).alias("growth_percentage"))


def salary_fact(postings: DataFrame, role: str = "title") -> DataFrame:
    """Per (role, location): min of minimums, max of maximums, median and sample stdev of
    midpoints, mean = (min + max) / 2, sample size."""
    mid = midpoint()
    b = postings.where(mid.isNotNull()).select(F.col(role).alias("role"), "location", "salary_min", "salary_max", mid.alias("mid"))
    g = b.groupBy("role", "location").agg(
        F.min("salary_min").alias("min_salary"), F.max("salary_max").alias("max_salary"),
        F.count(F.lit(1)).alias("sample_size"), F.round(F.coalesce(F.stddev_samp("mid"), F.lit(0.0)), 6).alias("std_dev"))
    med = floor_quantiles(b, ["role", "location"], "mid", {}, {"median_salary": 0.5}).withColumnsRenamed({"role": "_r", "location": "_l"})
    g = g.join(med, g["role"].eqNullSafe(med["_r"]) & g["location"].eqNullSafe(med["_l"])).select(
        "role", "location", "min_salary", "max_salary", "median_salary", "sample_size", "std_dev")
    return g.withColumn("mean_salary", (F.col("min_salary") + F.col("max_salary")) / 2)


def top_paid_roles(fact: DataFrame, location: str | None = None, limit: int = 10) -> DataFrame:
    """Highest median salary first (ties by role, location)."""
    f = fact.where(F.col("location") == location) if location else fact
    return f.orderBy(F.col("median_salary").desc(), "role", "location").limit(limit)


def salary_lookup(fact: DataFrame, role: str, location: str | None = None) -> DataFrame:
    """first fact for role (and location), deterministic by location."""
    f = fact.where(F.col("role") == role)
    if location:
        f = f.where(F.col("location") == location)
    return f.orderBy("location").limit(1)


def top_trending_of_month(trends: DataFrame, month: dt.date | None = None, limit: int = 10) -> DataFrame:
    """Top skills by occurrences for ``month`` (default: the latest month, a scalar subquery)."""
    target = F.lit(month) if month else trends.select(F.max("month")).scalar()
    return trends.where(F.col("month") == target).orderBy(F.col("occurrences").desc(), "skill").limit(limit)


def trend_history(trends: DataFrame, months: int = 12) -> DataFrame:
    """The newest ``months`` rows of every skill (a per-skill top-k, partially limited map-side)."""
    w = Window.partitionBy("skill").orderBy(F.col("month").desc())
    return trends.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= months)


def trend_lookup(trends: DataFrame, skill: str, month: dt.date) -> DataFrame:
    """the (skill, month) point."""
    return trends.where((F.col("skill") == skill) & (F.col("month") == F.lit(month)))
