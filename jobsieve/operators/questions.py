"""Question routing and grounded answers (N1-N6, J11) over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.session import cut_lineage

# Fixed values that must equal the reference: intent keyword rules, in priority order.
TOP_SKILL_PHRASES = ["top skill", "top 3 skill", "most in-demand skill", "trending skill"]
ANOMALY_PHRASES = ["salary anomaly", "salary outlier", "anomalies"]
PREDICT_PHRASES = ["predict", "next quarter", "in-demand roles"]
COUNT_PHRASES = ["how many", "count", "total jobs"]
EXPLAIN_WORDS = ["anomal", "outlier", "flag"]
QUOTED_WHOLE = "'[^']+'|\"[^\"]+\""
JOB_ID = r"(?i)\b(?:job[_\s-]?id|id)\s*[:=]?\s*([A-Za-z0-9_-]+)"
TOP_N = r"top\s+(\d+)"
DEFAULT_TOP_N = 5
SUMMARY_TEXT = "I can summarize jobs, skills, salary anomalies, and role predictions once data is loaded."
NO_ROLE_TEXT = "I could not find salary data for that role in the current dataset."
GENERAL_TEXT = ("I can currently explain salary anomaly flags by retrieving the job posting, "
                "running the anomaly detector, and summarizing the evidence.")


def _any(v: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | v.contains(p)
    return out


def intent(q: Column) -> Column:
    """Ordered keyword rules over the lower-cased, stripped question."""
    v = F.lower(F.regexp_replace(q, r"^\s+|\s+$", ""))
    return (F.when(_any(v, TOP_SKILL_PHRASES) | (v.contains("top") & v.contains("skills")), "top_skills")
            .when(_any(v, ANOMALY_PHRASES), "salary_anomalies")
            .when(v.contains("salary"), "salary_range")
            .when(_any(v, PREDICT_PHRASES), "predicted_roles")
            .when(v.contains("remote"), "remote_summary")
            .when(_any(v, COUNT_PHRASES), "job_count")
            .otherwise("summary"))


def entities(q: Column) -> Column:
    """Quoted texts in order (single or double quotes)."""
    whole = F.regexp_extract_all(q, F.lit(QUOTED_WHOLE), F.lit(0))
    return F.transform(whole, lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def top_n(q: Column) -> Column:
    """``top <n>`` in the lower-cased question, default 5."""
    v = F.lower(F.regexp_replace(q, r"^\s+|\s+$", ""))
    n = F.regexp_extract(v, TOP_N, 1)
    return F.when(n != "", n.cast("int")).otherwise(F.lit(DEFAULT_TOP_N))


def job_id(q: Column) -> Column:
    """First quoted text, else the ``job id: X`` pattern (null when neither)."""
    e = entities(q)
    m = F.regexp_extract(q, JOB_ID, 1)
    return F.when(F.size(e) > 0, e[0]).when(m != "", m)


def route(q: Column) -> Column:
    """Salary + anomaly/outlier/flag -> explain, else general."""
    v = F.lower(q)
    return F.when(v.contains("salary") & _any(v, EXPLAIN_WORDS), "explain_salary_anomaly").otherwise("general_market_question")


def role_of_entity(questions: DataFrame, entity: str, roles: DataFrame, gram: int = 3) -> DataFrame:
    """(entity, role): the first role (alphabetically) whose name contains each distinct non-empty entity, without
    regard to case.

    No pairs: an entity is keyed by its first ``gram`` characters (all of them if it is shorter) and meets the role
    names that hold that gram."""
    low = F.lower(entity)
    e = questions.select(F.col(entity).alias("_e"), low.alias("_le"), F.substring(low, 1, gram).alias("_g")).where("_le <> ''").distinct()
    r = roles.select("role", F.lower("role").alias("_lr")).distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length("_lr"), F.lit(1))), lambda i: F.substring(F.col("_lr"), i, n))))
    held = r.select("role", "_lr", F.explode(F.array_distinct(grams)).alias("_g"))
    return e.join(held, "_g").where(F.contains("_lr", "_le")).groupBy("_e").agg(F.min("role").alias("role"))


def answers(questions: DataFrame, q: str, top_skills: DataFrame, anomaly_count: Column, counts: Column,
            role_stats: DataFrame, forecast: DataFrame, currency: str = "EUR") -> DataFrame:
    """The answer text per question from one row of statistics and one small join. ``anomaly_count`` and ``counts``
    (struct of remote and total jobs) are scalar subqueries.

    ``top_skills``: (skill, demand) ordered rows (the top-20 list) and ``forecast``: (role, projected_demand_index)
    rows, both sliced per question by its top n; ``role_stats``: (role, min, max, median), met by the first quoted
    entity of salary questions. A salary question without entity gets the summary."""
    tops = top_skills.select(F.sort_array(F.collect_list(F.struct(
        (-F.col("demand")).alias("k"), F.col("skill").alias("skill"), F.col("demand").alias("demand")))).alias("a")).scalar()
    ahead = forecast.select(F.sort_array(F.collect_list(F.struct(
        (-F.col("projected_demand_index")).alias("k"), F.col("role").alias("role")))).alias("a")).scalar()
    # all statistics are one written row, attached by one subquery that reads it
    row = cut_lineage(questions.sparkSession.range(1).select(F.struct(
        tops.alias("tops"), ahead.alias("ahead"), anomaly_count.alias("anom"), counts.alias("counts")).alias("s")))
    asked = questions.withColumns({"intent": intent(F.col(q)), "top_n": top_n(F.col(q)), "_entity": F.get(entities(F.col(q)), F.lit(0))})
    named = role_of_entity(asked.where("intent = 'salary_range'"), "_entity", role_stats).join(role_stats, "role")
    d = asked.join(named.withColumnRenamed("role", "_role"), (F.col("_entity") == F.col("_e")) & (F.col("intent") == "salary_range"), "left")
    d = d.withColumn("_s", row.scalar()).withColumns({"_tops": F.col("_s.tops"), "_ahead": F.col("_s.ahead")})
    anomaly_count, remote_jobs, total_jobs = F.col("_s.anom"), F.col("_s.counts.remote"), F.col("_s.counts.total")
    # slice first (outside any lambda), then format the slice
    d = d.withColumn("_sl", F.slice("_tops", 1, F.greatest(F.col("top_n"), F.lit(1))))
    d = d.withColumn("_sl", F.when(F.col("top_n") > 0, F.col("_sl")).otherwise(F.array().cast(d.schema["_sl"].dataType)))
    listed = F.array_join(F.transform("_sl",
                                      lambda s: F.concat(s["skill"], F.lit(" ("), s["demand"].cast("string"), F.lit(")"))), ", ")
    d = d.withColumn("_fl", F.when(F.col("top_n") > 0, F.slice("_ahead", 1, F.greatest(F.col("top_n"), F.lit(1)))))
    coming = F.array_join(F.transform("_fl", lambda r: F.concat(r["role"], F.lit(" ("), F.format_string("%.1f", -r["k"]), F.lit(")"))), ", ")
    money = lambda c: F.concat(F.format_string("%,.0f", F.bround(F.col(c), 0)), F.lit(f" {currency}"))
    text = (F.when((F.col("intent") == "salary_range") & F.col("_role").isNotNull(), F.concat(
                F.col("_role"), F.lit(" currently ranges from "), money("min"), F.lit(" to "), money("max"),
                F.lit(", with a median of "), money("median"), F.lit(".")))
            .when((F.col("intent") == "salary_range") & (F.coalesce("_entity", F.lit("")) != ""), F.lit(NO_ROLE_TEXT))
            .when((F.col("intent") == "predicted_roles") & (F.size("_ahead") > 0),
                  F.concat(F.lit("Projected in-demand roles: "), F.coalesce(coming, F.lit("")), F.lit(".")))
            .when((F.col("intent") == "top_skills") & (F.size("_tops") > 0), F.concat(F.lit("Top skills right now: "), listed, F.lit(".")))
            .when((F.col("intent") == "salary_anomalies") & (anomaly_count == 0),
                  F.lit("No salary anomalies were detected in the current dataset."))
            .when(F.col("intent") == "salary_anomalies",
                  F.concat(F.lit("I found "), anomaly_count.cast("string"), F.lit(" salary anomalies in the current dataset.")))
            .when(F.col("intent") == "remote_summary",
                  F.concat(F.lit("There are "), remote_jobs.cast("string"), F.lit(" remote jobs out of "),
                           total_jobs.cast("string"), F.lit(" jobs in the current dataset.")))
            .when(F.col("intent") == "job_count",
                  F.concat(F.lit("The current dataset contains "), total_jobs.cast("string"), F.lit(" jobs.")))
            .otherwise(F.lit(SUMMARY_TEXT)))
    return d.withColumn("answer", text).drop("_s", "_tops", "_sl", "_ahead", "_fl", "_entity", "_e", "_role", "min", "max", "median", "count")


def _money(c: Column, symbol: str) -> Column:
    return F.concat(F.lit(symbol), F.format_string("%,.0f", F.bround(c, 0)))


def explain_salaries(postings: DataFrame, anomalies: DataFrame, context: DataFrame, symbol: str = "$") -> DataFrame:
    """J11 + N5: for every posting, the narrative of whether its salary was flagged.

    ``anomalies``: J6 output (job_id, reasons array, expected_min, expected_max);
    ``context``: A19 output (job_id, target_salary, dataset_median_salary, percent_difference_from_median)."""
    j = (postings.select(F.col("id").alias("job_id"), "title", "company")
         .join(anomalies.select("job_id", "reasons", "expected_min", "expected_max"), "job_id", "left")
         .join(context.select("job_id", "target_salary", "dataset_median_salary", "percent_difference_from_median"), "job_id", "left"))
    title = F.coalesce(F.col("title"), F.lit("this role"))
    company = F.coalesce(F.col("company"), F.lit("the company"))
    pct = F.col("percent_difference_from_median")
    comparison = F.when(
        F.col("dataset_median_salary").isNotNull() & pct.isNotNull(),
        F.concat(F.lit(" Its midpoint salary is "), _money(F.col("target_salary"), symbol), F.lit(", which is "),
                 F.format_string("%.1f", F.bround(F.abs(pct), 1)), F.lit("% "),
                 F.when(pct >= 0, F.lit("above")).otherwise(F.lit("below")), F.lit(" the dataset median of "),
                 _money(F.col("dataset_median_salary"), symbol), F.lit("."))).otherwise(F.lit(""))
    flagged = F.col("reasons").isNotNull()
    text = (F.when(F.col("target_salary").isNull(),
                   F.concat(F.lit("I cannot explain a salary anomaly for "), title, F.lit(" at "), company,
                            F.lit(" because the posting does not include both salary bounds.")))
            .when(~flagged, F.concat(title, F.lit(" at "), company,
                                     F.lit(" was not flagged as a salary anomaly by the current detector."), comparison))
            .otherwise(F.concat(F.lit("The salary for "), title, F.lit(" at "), company,
                                F.lit(" was flagged because it matched the detector reason(s): "),
                                F.array_join("reasons", ", "), F.lit("."), comparison,
                                F.lit(" The expected interquartile range for the relevant comparison group is roughly "),
                                _money(F.col("expected_min"), symbol), F.lit(" to "), _money(F.col("expected_max"), symbol),
                                F.lit("."))))
    return j.select("job_id", flagged.alias("is_flagged"), text.alias("answer"))
