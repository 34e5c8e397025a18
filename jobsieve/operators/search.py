"""Filters, lookups, facets, ordering and paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint
from jobsieve.functions.text import contains_ci, quote_plus

ALLOWED_SORTS = ("relevance", "salary_desc", "salary_asc", "posted_desc", "posted_asc", "company", "title")
DESCENDING_SORTS = ("relevance", "salary_desc", "posted_desc")
# Fixed value: the search URL used when a posting has no apply link.
SEARCH_URL = "https://www.arbeitsagentur.de/jobsuche/suche?was={title}&wo={location}"


def _s(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def filter_jobs(df: DataFrame, location: str | None = None, work_mode: str | None = None,
                company: str | None = None, role_type: str | None = None,
                employment_type: str | None = None) -> DataFrame:
    """case-insensitive contains on location/company/role_type/employment_type; work mode
    equality unless ``any``. Literal substrings (no LIKE wildcards)."""
    cond = F.lit(True)
    for value, column in ((location, "location"), (company, "company"), (role_type, "role_type"),
                          (employment_type, "employment_type")):
        if value:
            cond = cond & _s(column).contains(value.lower().strip())
    if work_mode and work_mode.lower().strip() != "any":
        cond = cond & (_s("remote_status") == work_mode.lower().strip())
    return df.where(cond)


def skills_json_text(skills: str = "required_skills") -> Column:
    """The stored JSON text of a skill list, in ``json.dumps`` layout (``["a", "b"]``), escaped element by element."""
    quoted = F.transform(skills, lambda s: F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1))
    return F.when(F.size(skills) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def repository_query(df: DataFrame, query: str = "", location: str | None = None, work_mode: str | None = None,
                     company: str | None = None, role_type: str | None = None,
                     employment_type: str | None = None, limit: int = 25, include_expired: bool = False) -> DataFrame:
    """the table query: location matches location, city or state; other filters contain;
    every query term must hit one of 7 columns; newest first, then title (then id); limit."""
    d = df if include_expired else active(df)
    if location:
        loc = location.strip().lower()
        d = d.where(_s("location").contains(loc) | _s("city").contains(loc) | _s("federal_state").contains(loc))
    if work_mode and work_mode.lower() != "any":
        d = d.where(_s("remote_status") == work_mode.strip().lower())
    for value, column in ((company, "company"), (role_type, "role_type"), (employment_type, "employment_type")):
        if value:
            d = d.where(_s(column).contains(value.strip().lower()))
    blob_cols = [_s(c) for c in ("title", "company", "location", "description", "role_type", "job_type")]
    blob_cols.append(F.lower(F.coalesce(skills_json_text(), F.lit(""))))
    for term in [t for t in query.strip().split() if t]:
        t = term.lower()
        hit = F.lit(False)
        for b in blob_cols:
            hit = hit | b.contains(t)
        d = d.where(hit)
    return d.orderBy(F.col("posted_date").desc_nulls_last(), F.col("title").asc_nulls_first(), F.col("id")).limit(limit)


def active(df: DataFrame) -> DataFrame:
    """active rows only."""
    return df.where(~F.coalesce(F.col("is_expired"), F.lit(False)))


def lookup(df: DataFrame, job_id: str, include_expired: bool = False) -> DataFrame:
    """one posting by id (optionally including expired rows)."""
    d = df if include_expired else active(df)
    return d.where(F.col("id") == F.lit(str(job_id)))


def recent(df: DataFrame, as_of: dt.datetime, days: int = 30, limit: int = 100) -> DataFrame:
    """posted within ``days`` before ``as_of``, newest first (id breaks ties), top ``limit``."""
    cutoff = as_of - dt.timedelta(days=days)
    return df.where(F.col("posted_date") >= F.lit(cutoff)).orderBy(F.col("posted_date").desc(), F.col("id")).limit(limit)


def by_title(df: DataFrame, title: str, limit: int = 50) -> DataFrame:
    """title contains (case-insensitive, literal); deterministic first ``limit`` by id."""
    return df.where(contains_ci("title", title)).orderBy("id").limit(limit)


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, count) for location, role_type, company, remote_status, job_type;
    blank/null values excluded. One unpivot + one aggregate with map-side combine."""
    cols = [("locations", "location"), ("role_types", "role_type"), ("companies", "company"),
            ("work_modes", "remote_status"), ("job_types", "job_type")]
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in cols])
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def facet_totals(df: DataFrame) -> DataFrame:
    """A11 scalars: total jobs and midpoint min/max (one row)."""
    m = midpoint()
    return df.agg(F.count(F.lit(1)).alias("total_jobs"), F.min(m).alias("salary_min"), F.max(m).alias("salary_max"))


def count_by_location(df: DataFrame) -> DataFrame:
    """``GROUP BY location`` count, the null location included as its own group."""
    return df.groupBy("location").agg(F.count("id").alias("count"))


def apply_url(title: str = "title", location: str = "location") -> Column:
    """application_url, else url, else the search URL with encoded title and location
    (", Germany" removed)."""
    loc = F.replace(F.coalesce(F.col(location).cast("string"), F.lit("Germany")), F.lit(", Germany"), F.lit(""))
    search = F.concat(
        F.lit(SEARCH_URL.split("{title}")[0]), quote_plus(F.coalesce(F.col(title).cast("string"), F.lit(""))),
        F.lit(SEARCH_URL.split("{title}")[1].split("{location}")[0]), quote_plus(loc))
    nz = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(nz("application_url"), nz("url"), search)


def sort_key(sort: str) -> Column:
    """The sort value of a mode; missing salary sorts as -1; unknown mode -> relevance."""
    if sort in ("salary_desc", "salary_asc"):
        return F.coalesce(F.col("salary_midpoint"), F.lit(-1.0))
    if sort in ("posted_desc", "posted_asc"):
        return F.coalesce(F.col("posted_date").cast("string"), F.lit(""))
    if sort == "company":
        return F.coalesce(F.col("company"), F.lit(""))
    if sort == "title":
        return F.coalesce(F.col("title"), F.lit(""))
    return F.coalesce(F.col("relevance_score"), F.lit(0.0))


def order_results(df: DataFrame, sort: str = "relevance") -> DataFrame:
    """Order by (sort value, posted date text, title); the whole key reversed for the
    descending modes (tie-breaks included); id closes every ordering."""
    sort = sort if sort in ALLOWED_SORTS else "relevance"
    keys = [sort_key(sort), F.coalesce(F.col("posted_date").cast("string"), F.lit("")),
            F.coalesce(F.col("title"), F.lit("")), F.col("id")]
    if sort in DESCENDING_SORTS:
        return df.orderBy(*[k.desc() for k in keys])
    return df.orderBy(*[k.asc() for k in keys])


def page(df: DataFrame, page_no: int = 1, per_page: int = 25) -> DataFrame:
    """Page ``page_no`` (1-based) of an ordered frame."""
    page_no = max(page_no, 1)
    return df.offset((page_no - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, page_no: int = 1, per_page: int = 25) -> DataFrame:
    """W7 totals: total rows and total pages = ceil(total / per_page) (one row)."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.lit(max(page_no, 1)).alias("page"), F.lit(per_page).alias("per_page"),
        F.when(total > 0, F.ceil(total / F.lit(per_page))).otherwise(F.lit(0)).cast("long").alias("total_pages"),
    )


def result_summary(results: DataFrame) -> DataFrame:
    """Mean effective salary (2 dp), sample sizes, apply-link count over a result set (one row)."""
    return results.agg(
        F.round(F.avg("salary_midpoint"), 2).alias("average_salary"),
        F.count("salary_midpoint").alias("salary_sample_size"),
        F.count_if(F.col("salary_type") == "listed").alias("listed_salary_sample_size"),
        F.count_if(F.col("salary_type") == "estimated").alias("estimated_salary_sample_size"),
        F.count_if(F.col("apply_url").isNotNull() & (F.col("apply_url") != "")).alias("apply_links_available"),
        F.count(F.lit(1)).alias("total"),
    )


def result_top_facets(results: DataFrame, n: int = 5) -> DataFrame:
    """A12 facets: top-``n`` companies, locations and role types of a result set
    as (facet, rank, value, count); ties by value."""
    from pyspark.sql import Window
    cols = [("top_companies", "company"), ("top_locations", "location"), ("role_types", "role_type")]
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in cols])
    # counted per combination first: an aggregate right above an ordered result lets Spark drop the sort
    combined = results.groupBy(*[c for _, c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    g = (combined.select("_n", F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != ""))
         .groupBy("facet", "value").agg(F.sum("_n").alias("count")))
    w = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
