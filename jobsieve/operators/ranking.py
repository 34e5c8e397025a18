"""Ranked search (Q1 terms, Q3 score, Q4 reasons, Q5 boost, Q6 composition, Q7 suggestions, P7-P9).

The expanded term list of a request is a parameter: it is computed by Spark from the query and
the taxonomy (bounded by the taxonomy size), then passed as one array literal, so every posting
row is scored by a single ``aggregate`` fold — row-local, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsieve.functions import keep_where
from jobsieve.operators import salary as sal
from jobsieve.operators import search as se
from jobsieve.operators import taxonomy as tx

# Fixed values that must equal the reference: per-field points and reason labels (Q3, Q4).
TITLE_POINTS, OCCUPATION_POINTS, SKILL_POINTS, TAXONOMY_POINTS, COMPANY_POINTS, DESCRIPTION_POINTS = 8, 5, 4, 3, 2, 1
EXACT_TITLE_BOOST = 20
NO_QUERY_REASON = "No keyword query; included by active listing filters."
REASONS = ["title match", "occupation match", "skill match", "ESCO synonym match", "company match", "description match"]


def expanded_terms(spark: SparkSession, query: str) -> list[str]:
    """Q1 for one request: split terms plus the taxonomy expansion, sorted distinct."""
    one = spark.createDataFrame([(query,)], "q string")
    row = tx.expand_query(one, "q", tx.concept_set(spark)).select("expanded_terms").first()
    return list(row[0]) if row and row[0] else []


def _txt(c: str) -> Column:
    # the reference stringifies a missing value, so a null field reads as "none"
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("None")))


def score(df: DataFrame, terms: list[str], query: str, skills: str = "required_skills",
          taxonomy_terms: str = "search_terms") -> DataFrame:
    """Q3 + Q4 + Q5: ``relevance_score`` and ``match_reasons`` for every row."""
    title, role, group = _txt("title"), _txt("role_type"), _txt("occupation_group")
    company, desc = _txt("company"), _txt("description")
    skill_text = F.lower(F.array_join(F.coalesce(F.col(skills), F.array().cast("array<string>")), " "))
    tax_text = F.lower(F.array_join(F.coalesce(F.col(taxonomy_terms), F.array().cast("array<string>")), " "))
    d = df.withColumns({"_t": title, "_r": role, "_g": group, "_c": company, "_d": desc, "_s": skill_text, "_x": tax_text})
    if not terms:
        d = d.withColumn("relevance_score", F.lit(1.0)).withColumn("match_reasons", F.array(F.lit(NO_QUERY_REASON)))
    else:
        lit_terms = F.array(*[F.lit(t) for t in terms])

        def hits(t):
            return (F.col("_t").contains(t), F.col("_r").contains(t) | F.col("_g").contains(t), F.col("_s").contains(t),
                    F.col("_x").contains(t), F.col("_c").contains(t), F.col("_d").contains(t))

        pts = [TITLE_POINTS, OCCUPATION_POINTS, SKILL_POINTS, TAXONOMY_POINTS, COMPANY_POINTS, DESCRIPTION_POINTS]

        def term_score(t):
            out = F.lit(0.0)
            for h, p in zip(hits(t), pts):
                out = out + F.when(h, F.lit(float(p))).otherwise(F.lit(0.0))
            return out

        def step(acc, t):
            hs = hits(t)
            chain = None
            for h, reason in zip(hs, REASONS):
                cond = h & ~F.array_contains(acc, F.lit(reason))
                chain = F.when(cond, F.array_append(acc, F.lit(reason))) if chain is None else chain.when(cond, F.array_append(acc, F.lit(reason)))
            return F.when(term_score(t) > 0, chain.otherwise(acc)).otherwise(acc)

        d = d.withColumn("relevance_score", F.aggregate(lit_terms, F.lit(0.0), lambda acc, t: acc + term_score(t)))
        d = d.withColumn("match_reasons", F.aggregate(lit_terms, F.array().cast("array<string>"), step))
    nq = query.strip().lower()
    if nq:
        boost = F.col("_t").contains(F.lit(nq))
        d = d.withColumn("relevance_score", F.when(boost, F.col("relevance_score") + EXACT_TITLE_BOOST).otherwise(F.col("relevance_score")))
        d = d.withColumn("match_reasons", F.when(
            boost, F.array_prepend(F.array_remove("match_reasons", REASONS[0]), F.lit(REASONS[0]))).otherwise(F.col("match_reasons")))
    d = d.withColumn("relevance_score", F.round("relevance_score", 2))
    return d.drop("_t", "_r", "_g", "_c", "_d", "_s", "_x")


def ranked_search(jobs: DataFrame, query: str = "", location: str | None = None, work_mode: str | None = None,
                  company: str | None = None, role_type: str | None = None, salary_min: float | None = None,
                  salary_max: float | None = None, employment_type: str | None = None, sort: str = "relevance",
                  reference: DataFrame | None = None, currency: str = "EUR") -> DataFrame:
    """Q6: every match, scored and ordered (page it with ``search.page``; summarise with
    ``search.result_summary``). Salary estimates use ``reference`` (J12: the whole active table)."""
    spark = jobs.sparkSession
    terms = expanded_terms(spark, query) if query.strip() else []
    terms = sorted(set([t.strip().lower() for t in query.split() if t.strip()] + terms))
    est = sal.estimate_salaries(jobs, reference=reference, currency=currency)
    f = se.filter_jobs(est, location, work_mode, company, role_type, employment_type)
    f = sal.salary_range_filter(f, salary_min, salary_max)
    f = tx.enrich_postings(f, tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    s = score(f, terms, query)
    if terms:
        s = keep_where(s, F.col("relevance_score") != 0)
    s = s.withColumn("apply_url", se.apply_url())
    return se.order_results(s, sort)


# Fixed values that must equal the reference: suggestion categories, labels and priorities (Q7).
SUGGESTION_LABELS = {"title": "Job title", "company": "Company", "location": "Location", "skill": "Skill",
                     "occupation": "Occupation", "role_type": "Role group"}
SUGGESTION_PRIORITY = {"title": 0, "occupation": 1, "skill": 2, "role_type": 3, "company": 4, "location": 5}
CATEGORY_ORDER = ["title", "company", "location", "skill", "occupation", "role_type"]


def suggestions(jobs: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Q7: typeahead suggestions (value, label, category, count) ordered by exact/prefix/contains,
    category priority, count desc, value; the first category (in counter order) wins per
    lower-cased value."""
    spark = jobs.sparkSession
    nq = query.strip().lower()
    if not nq:
        return spark.createDataFrame([], "value string, label string, category string, count long")
    pairs = F.array(
        F.struct(F.lit("title").alias("category"), F.col("title").cast("string").alias("value")),
        F.struct(F.lit("company").alias("category"), F.col("company").cast("string").alias("value")),
        F.struct(F.lit("location").alias("category"),
                 F.coalesce(F.nullif(F.col("city"), F.lit("")), F.col("location")).cast("string").alias("value")),
        F.struct(F.lit("occupation").alias("category"), F.col("occupation_group").cast("string").alias("value")),
        F.struct(F.lit("role_type").alias("category"), F.col("role_type").cast("string").alias("value")),
    )
    fields = jobs.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != "")
                                               & F.lower("value").contains(nq))
    skills = jobs.select(F.lit("skill").alias("category"), F.explode("required_skills").alias("value")) \
        .where(F.col("value").isNotNull() & F.lower("value").contains(nq))
    counted = fields.unionByName(skills).groupBy("category", "value").agg(F.count(F.lit(1)).alias("count"))
    # taxonomy bonuses for the request (bounded by the taxonomy): +3 titles, +2 skills, +1 aliases
    one = spark.createDataFrame([(query,)], "q string")
    n = tx.normalize_query(one, "q", tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    occ = tx.match_concepts(one, F.col("q"), tx.concept_set(spark, "occupation"), "o").select(F.explode("o").alias("c"))
    bonus = (
        occ.select(F.lit("title").alias("category"), F.col("c.preferred_label").alias("value"), F.lit(3).cast("long").alias("count"))
        .unionByName(occ.select(F.lit("occupation").alias("category"), F.explode("c.aliases").alias("value"), F.lit(1).cast("long").alias("count"))
                     .where(F.lower("value").contains(nq)))
        .unionByName(n.select(F.lit("skill").alias("category"), F.explode("skills").alias("value"), F.lit(2).cast("long").alias("count")))
    )
    allc = counted.unionByName(bonus).groupBy("category", "value").agg(F.sum("count").cast("long").alias("count"))
    corder = F.element_at(F.create_map(*[x for i, c in enumerate(CATEGORY_ORDER) for x in (F.lit(c), F.lit(i))]), F.col("category"))
    w = Window.partitionBy(F.lower("value")).orderBy(corder, F.col("value"))
    first = allc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    lv = F.lower("value")
    rank = F.when(lv == nq, 0).when(lv.startswith(nq), 1).otherwise(2)
    prio = F.element_at(F.create_map(*[x for c, p in SUGGESTION_PRIORITY.items() for x in (F.lit(c), F.lit(p))]), F.col("category"))
    label = F.concat(F.col("value"), F.lit(" · "),
                     F.element_at(F.create_map(*[x for c, lab in SUGGESTION_LABELS.items() for x in (F.lit(c), F.lit(lab))]), F.col("category")))
    return (first.orderBy(rank, prio, F.col("count").desc(), lv, F.col("value")).limit(limit)
            .select("value", label.alias("label"), "category", "count"))


def job_results(ranked: DataFrame) -> DataFrame:
    """The public result projection (ranked rows already carry the salary block)."""
    return ranked.select(
        "id", "title", "company", "location", "job_type", "remote_status", "role_type", "description",
        "required_skills", "posted_date", "source", "source_legal_basis", "source_posting_id", "apply_url",
        F.concat(F.lit("/jobs/"), F.col("id"), F.lit("/apply")).alias("apply_endpoint"),
        "application_url", "company_career_url", "country", "city", "federal_state", "occupation_group",
        "experience_level", "employment_type", "salary_period",
        F.col("eff_salary_is_estimated").alias("salary_is_estimated"),
        F.col("eff_salary_confidence").alias("salary_confidence"), "salary_estimation_basis",
        "expires_at", "last_seen_at", "is_expired", "relevance_score", "match_reasons",
        F.col("eff_salary_min").alias("salary_min"), F.col("eff_salary_max").alias("salary_max"),
        "salary_midpoint", "salary_label", "salary_type",
    )


def job_detail(postings: DataFrame, currency: str = "EUR") -> DataFrame:
    """P9 for every posting: the result fields, the salary block (J2), the company's open-jobs endpoint, the application
    hand-off (P7, with the source decision) and the market context (J8)."""
    from jobsieve.functions.text import quote_plus
    from jobsieve.operators import governance as gv
    from jobsieve.operators import similar as si
    context = si.market_context(postings).drop("role_type").withColumnRenamed("id", "_cid")
    d = gv.evaluate_sources(sal.estimate_salaries(postings, currency=currency)).withColumn("apply_url", se.apply_url())
    d = d.join(context, F.col("id") == F.col("_cid"))
    return d.select(
        "id", "title", "company", "location", "job_type", "remote_status", "role_type", F.col("description").alias("full_description"),
        "country", "city", "occupation_group", "experience_level", "employment_type", "salary_period", "source", "source_legal_basis",
        F.concat(F.lit("/jobs/"), F.col("id"), F.lit("/apply")).alias("apply_endpoint"), F.lit(currency).alias("salary_currency"),
        F.col("eff_salary_min").alias("salary_min"), F.col("eff_salary_max").alias("salary_max"), "salary_midpoint", "salary_label", "salary_type",
        F.col("eff_salary_is_estimated").alias("salary_is_estimated"), F.col("eff_salary_confidence").alias("salary_confidence"),
        "salary_estimation_basis", F.concat(F.lit("/jobs/search?q="), quote_plus("company")).alias("current_open_jobs_endpoint"),
        "apply_url", F.coalesce(F.nullif(F.col("application_url"), F.lit("")), F.col("apply_url")).alias("application_url"),
        F.lit("external_redirect").alias("apply_method"), F.col("allowed").alias("source_allowed"),
        "same_role_count", "same_location_count", "role_average_salary", "similar_jobs_endpoint")
