"""Similar postings (J3, J3b) and market context.

J3 reads the candidates once: the targets (a request parameter) are one array, every candidate is scored against all of
them inside its row, and a per-target top-k, which Spark begins in each task (WindowGroupLimit), leaves only the best rows
of a task to shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference: similarity points per shared field.
POINTS = [("role_type", 5), ("occupation_group", 4), ("location", 3), ("remote_status", 2)]


def _folded(c: str) -> Column:
    """Distinct lower-cased elements, nulls left out."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower), lambda s: s.isNotNull()))


def similar_jobs(candidates: DataFrame, target_ids: list[str], limit: int = 5,
                 term_column: str | None = None, skills: str = "required_skills") -> DataFrame:
    """J3 (and J3b when ``term_column`` names an array of taxonomy terms per posting).

    Returns (target_id, rank, id, title, score). Candidates with score 0 are never emitted.
    The target rows travel with the request as one array of a one-row subquery."""
    lists = [skills, *([term_column] if term_column else [])]
    rows = candidates.select("id", "title", *[k for k, _ in POINTS], *[_folded(c).alias(f"_{i}") for i, c in enumerate(lists)])
    fields = [F.col("id").alias("id"), *[F.col(k) for k, _ in POINTS], *[F.col(f"_{i}") for i in range(len(lists))]]
    targets = rows.where(F.col("id").isin([str(t) for t in target_ids])).agg(F.collect_list(F.struct(*fields))).scalar()

    def score(t: Column) -> Column:
        points = F.lit(0)
        for k, n in POINTS:
            points = points + F.when((t[k] == F.col(k)) & (t[k].cast("string") != ""), n).otherwise(0)
        for i in range(len(lists)):
            points = points + F.size(F.array_intersect(t[f"_{i}"], F.col(f"_{i}")))
        return F.struct(t["id"].alias("target_id"), points.cast("long").alias("score"))

    scored = rows.withColumn("_targets", targets).select("id", "title", F.explode(F.transform("_targets", score)).alias("s")).select("id", "title", "s.*")
    w = Window.partitionBy("target_id").orderBy(F.col("score").desc(), F.coalesce("title", F.lit("")), F.col("id"))
    return (scored.where((F.col("target_id") != F.col("id")) & (F.col("score") > 0))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("target_id", "rank", "id", "title", "score"))


def market_context(df: DataFrame) -> DataFrame:
    """J8 for every posting: same-role count, same-location count, role mean midpoint (2 dp).

    Two small aggregates (one row per role / per location) joined back by key."""
    from jobsieve.functions.salary import midpoint
    roles = (df.where(F.col("role_type").isNotNull() & (F.col("role_type") != ""))
             .groupBy("role_type").agg(F.count(F.lit(1)).alias("same_role_count"),
                                       F.round(F.avg(midpoint()), 2).alias("role_average_salary")))
    locs = df.groupBy("location").agg(F.count(F.lit(1)).alias("same_location_count"))
    return (df.select("id", "role_type", "location")
            .join(roles, "role_type", "left")
            .join(locs, df["location"].eqNullSafe(locs["location"]), "left")
            .select("id", "role_type",
                    F.coalesce("same_role_count", F.lit(0)).cast("long").alias("same_role_count"),
                    F.coalesce("same_location_count", F.lit(0)).cast("long").alias("same_location_count"),
                    "role_average_salary",
                    F.concat(F.lit("/jobs/"), F.col("id"), F.lit("/similar")).alias("similar_jobs_endpoint")))
