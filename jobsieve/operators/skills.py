"""Skill demand analytics.

Input: any DataFrame with a skills array column and salary bounds. Skills are exploded
(narrow) and aggregated by skill with map-side partial aggregation, so a hot skill is
pre-combined in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint, midpoint_nonzero
from jobsieve.operators.salary import floor_quantiles

# Fixed values that must equal the reference: skill categories and their keywords (A3).
SKILL_CATEGORIES = [
    ("Programming Languages", ["Python", "Java", "JavaScript", "Go", "Rust", "C++", "C#", "PHP", "Ruby", "TypeScript"]),
    ("Web Frameworks", ["Django", "FastAPI", "React", "Vue", "Angular", "Node.js", "Express", "Flask"]),
    ("Data & Analytics", ["SQL", "Machine Learning", "Data Science", "Analytics", "Pandas", "NumPy", "Spark"]),
    ("DevOps & Cloud", ["Docker", "Kubernetes", "AWS", "Azure", "GCP", "Jenkins", "Terraform", "CI/CD"]),
    ("Databases", ["PostgreSQL", "MongoDB", "Redis", "Elasticsearch", "MySQL", "DynamoDB"]),
]


def skill_mentions(postings: DataFrame, skills: str = "required_skills", lo: str = "salary_min",
                   hi: str = "salary_max", salary: Column | None = None) -> DataFrame:
    """One row per skill mention (a skill listed twice counts twice) with the posting's salary."""
    sal = salary if salary is not None else midpoint_nonzero(lo, hi)
    return postings.select(F.explode(F.col(skills)).alias("skill"), sal.alias("salary"))


def skill_stats(postings: DataFrame, skills: str = "required_skills", lo: str = "salary_min",
                hi: str = "salary_max", ndigits: int = 6, with_median: bool = True) -> DataFrame:
    """A1: per skill occurrences, share of all mentions (%), salary min/max/mean/median/stdev.

    Salary fields are null when no mention of the skill carries a (non-zero) salary;
    stdev is the sample deviation, 0 for a single value. The median comes from distributed running totals (a hot skill
    is never ordered in one task); ``with_median=False`` leaves that pass and the column out."""
    m = skill_mentions(postings, skills, lo, hi)
    total = m.select(F.count(F.lit(1))).scalar()
    g = m.groupBy("skill").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count("salary").alias("salary_count"),
        F.min("salary").alias("salary_min"),
        F.max("salary").alias("salary_max"),
        F.avg("salary").alias("salary_mean"),
        F.stddev_samp("salary").alias("sd"),
    )
    if with_median:
        med = floor_quantiles(m, ["skill"], "salary", {}, {"salary_median": 0.5}).withColumnRenamed("skill", "_s")
        g = g.join(med, g["skill"].eqNullSafe(med["_s"]), "left")
    return g.select(
        "skill",
        "occurrences",
        F.round(F.col("occurrences") / total * 100, ndigits).alias("percentage"),
        "salary_count",
        "salary_min",
        "salary_max",
        F.round("salary_mean", ndigits).alias("salary_mean"),
        *([F.round("salary_median", ndigits).alias("salary_median")] if with_median else []),
        F.round(F.when(F.col("salary_count") == 1, F.lit(0.0)).otherwise(F.col("sd")), ndigits).alias("salary_stdev"),
    )


def most_common(df: DataFrame, value: str, n: int | None, count: str = "count") -> DataFrame:
    """``Counter.most_common(n)`` over ``value`` (nulls dropped); ties by value ascending."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias(count))
    g = g.orderBy(F.col(count).desc(), F.col(value).asc())
    return g.limit(n) if n is not None else g


def top_skills(postings: DataFrame, top_n: int = 20, **kw) -> DataFrame:
    """A2 (and S23's flat report): top-N skills by demand with mean salary and range."""
    s = skill_stats(postings, with_median=False, **kw)
    return (
        s.orderBy(F.col("occurrences").desc(), F.col("skill").asc())
        .limit(top_n)
        .select(
            "skill",
            F.col("occurrences").alias("demand"),
            F.col("percentage").alias("demand_percentage"),
            F.col("salary_mean").alias("average_salary"),
            F.col("salary_min").alias("salary_min"),
            F.col("salary_max").alias("salary_max"),
        )
    )


def trending_skills(postings: DataFrame, min_occurrences: int = 5, top_n: int = 10, pool: int = 20, **kw) -> DataFrame:
    """A5: of the top-``pool`` skills keep those with at least ``min_occurrences``, first ``top_n``."""
    t = top_skills(postings, top_n=pool, **kw)
    return t.where(F.col("demand") >= min_occurrences).orderBy(F.col("demand").desc(), F.col("skill")).limit(top_n)


def skill_categories(postings: DataFrame, skills: str = "required_skills") -> DataFrame:
    """A3: (category, skill) for every distinct skill containing one of the category's keywords."""
    cats = F.array(*[
        F.struct(F.lit(name).alias("category"), F.array(*[F.lit(k.lower()) for k in kws]).alias("kw"))
        for name, kws in SKILL_CATEGORIES
    ])
    distinct = postings.select(F.explode(F.col(skills)).alias("skill")).distinct()
    matched = distinct.select(
        "skill",
        F.filter(cats, lambda c: F.exists(c["kw"], lambda k: F.lower(F.col("skill")).contains(k))).alias("cats"),
    )
    return matched.select(F.explode("cats").alias("c"), "skill").select(F.col("c.category").alias("category"), "skill")


def salary_premium(postings: DataFrame, **kw) -> DataFrame:
    """A4: skill mean salary vs the unweighted mean of all per-skill means; % and amount."""
    s = skill_stats(postings, ndigits=12, with_median=False, **kw).where(F.col("salary_mean").isNotNull())
    base = s.select(F.avg("salary_mean")).scalar()
    return s.select(
        "skill",
        F.round(base, 6).alias("base_salary"),
        F.round("salary_mean", 6).alias("skill_salary"),
        F.round((F.col("salary_mean") - base) / base * 100, 6).alias("premium_percentage"),
        F.round(F.col("salary_mean") - base, 6).alias("premium_amount"),
    )


def totals(postings: DataFrame, skills: str = "required_skills") -> DataFrame:
    """Number of postings and of distinct skills (one row)."""
    n = postings.select(F.count(F.lit(1))).scalar()
    return postings.select(F.explode(F.col(skills)).alias("skill")).agg(
        n.alias("total_jobs"), F.count_distinct("skill").alias("unique_skills")
    )


def related_skills(postings: DataFrame, skill: Column | str, threshold: int = 2, skills: str = "required_skills") -> DataFrame:
    """Over postings listing ``skill``, count every occurrence of the other skills; keep >= threshold.

    A filter + explode + aggregate: no self-join, no pairs."""
    target = F.lit(skill) if isinstance(skill, str) else skill
    hits = postings.where(F.array_contains(F.col(skills), target))
    return (
        hits.select(F.explode(F.col(skills)).alias("skill"))
        .where(F.col("skill") != target)
        .groupBy("skill")
        .agg(F.count(F.lit(1)).alias("co_occurrences"))
        .where(F.col("co_occurrences") >= threshold)
    )


def skill_growth(current: DataFrame, previous: DataFrame, skills: str = "required_skills") -> DataFrame:
    """Growth % of occurrences per skill; only skills with previous count > 0, driven by current."""
    cur = current.select(F.explode(F.col(skills)).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("current_count"))
    prev = previous.select(F.explode(F.col(skills)).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("previous_count"))
    j = cur.join(prev, "skill")
    return j.select(
        "skill", "current_count", "previous_count",
        F.round((F.col("current_count") - F.col("previous_count")) / F.col("previous_count") * 100, 6).alias("growth_pct"),
    )


def load_statistics(postings: DataFrame, skills: str = "required_skills") -> DataFrame:
    """A8 global part: totals, distinct locations/companies/skills, midpoint count/mean/median/min/max."""
    mid = midpoint()
    n_sk = postings.select(F.explode(F.col(skills)).alias("s")).select(F.count_distinct("s")).scalar()
    # the global median is a distributed running total, never one task's buffer
    median = floor_quantiles(postings.select(mid.alias("m")), [], "m", {}, {"median": 0.5}).select("median").scalar()
    return postings.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_distinct("location").alias("locations"),
        F.count_distinct("company").alias("companies"),
        n_sk.alias("unique_skills"),
        F.count(mid).alias("salary_count"),
        F.round(F.avg(mid), 6).alias("salary_mean"),
        F.round(median, 6).alias("salary_median"),
        F.min(mid).alias("salary_min"),
        F.max(mid).alias("salary_max"),
    )


def count_by(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """A8 per-source counts / A16 count by location: ``groupBy(column).count`` (null groups dropped)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def skill_report_lines(postings: DataFrame, as_of: str, currency_symbol: str = "$", **kw) -> DataFrame:
    """The text report as (line_no, line) rows: header, summary, top-10 table, the categories that have skills
    (their first five by name and the number of further ones), closing rule."""
    t = top_skills(postings, top_n=10, **kw)
    tot = totals(postings)
    rule = "=" * 60
    dash = "-" * 60
    head = tot.select(
        F.array(
            F.lit(rule), F.lit("SKILL DEMAND ANALYSIS REPORT"), F.lit(rule), F.lit(""),
            F.lit("SUMMARY"), F.lit(dash),
            F.format_string("Total Jobs Analyzed: %d", "total_jobs"),
            F.format_string("Unique Skills Found: %d", "unique_skills"),
            F.lit(f"Report Generated: {as_of}"), F.lit(""),
            F.lit("TOP 10 SKILLS BY DEMAND"), F.lit(dash),
        ).alias("lines")
    ).select(F.posexplode("lines").alias("pos", "line")).select((F.col("pos") + 1).alias("line_no"), "line")
    # ten rows at most: a global ordering here is bounded by top_n
    rank = F.row_number().over(Window.orderBy(F.col("demand").desc(), F.col("skill")))
    sal = F.when(
        F.col("average_salary").isNotNull() & (F.col("average_salary") != 0),
        F.concat(F.lit(f" | Avg Salary: {currency_symbol}"), F.format_string("%,.0f", F.bround("average_salary", 0))),
    ).otherwise(F.lit(""))
    body = t.select(rank.alias("r"), "*").select(
        (F.col("r") + 12).alias("line_no"),
        F.concat(
            F.format_string("%2d. %-30s | Demand: %4d (%5.1f%%)", "r", "skill", "demand", F.bround("demand_percentage", 1)),
            sal,
        ).alias("line"),
    )
    # categories: five rows each at most are collected, the rest is counted
    found = skill_categories(postings)
    by_name = Window.partitionBy("category").orderBy("skill")
    few = (found.withColumn("_rn", F.row_number().over(by_name)).where(F.col("_rn") <= 5).groupBy("category")
           .agg(F.array_join(F.array_sort(F.collect_list("skill")), ", ").alias("names")))
    names = [c for c, _ in SKILL_CATEGORIES]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int")
    listed = few.join(found.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category").select(order.alias("c"), F.array_compact(F.array(
        F.concat("category", F.lit(": "), "names"),
        F.when(F.col("n") > 5, F.concat(F.lit("  ... and "), (F.col("n") - 5).cast("string"), F.lit(" more"))))).alias("part"))
    cat = listed.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "part"))), lambda x: x["part"])).alias("rows"))  # five categories
    frame = lambda *v: F.array(*map(F.lit, v))
    tail = cat.select(F.posexplode(F.concat(
        frame(""), F.when(F.size("rows") > 0, F.concat(frame("SKILL CATEGORIES", dash), F.col("rows"), frame("")))
        .otherwise(F.array().cast("array<string>")), frame(rule))).alias("pos", "line"))
    shown = t.select(F.count(F.lit(1))).scalar()
    return head.unionByName(body).unionByName(tail.select((F.col("pos") + 13 + shown).cast("int").alias("line_no"), "line"))
