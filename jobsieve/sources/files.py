"""Posting files and the versioned posting table.

Readers take every column as text and normalise with column expressions; writers go to shared
storage. The posting table is a directory of immutable versions (``v=00000001`` ...); a version
is visible once Spark's ``_SUCCESS`` marker is written, so readers never see a half-written
version and a rewrite never overwrites the files it reads."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsieve.functions.text import infer_city, infer_country, parse_bool, parse_timestamp, split_list
from jobsieve.operators.taxonomy import extract_skills

DATE_COLUMNS = ["posted_date", "posted_at", "expires_at", "last_seen_at"]
# Fixed values that must equal the reference: alternate column names accepted from CSV directories.
ALTERNATE_NAMES = {
    "title": ["title", "job_title"], "company": ["company", "company_name"], "location": ["location"],
    "description": ["description", "job_description"], "job_type": ["job_type"],
    "salary_min": ["salary_min", "min_salary"], "salary_max": ["salary_max", "max_salary"], "id": ["id"],
}


def read_csv_text(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Header-first CSV read, every column as text (no inference). Quoted fields may hold line breaks;
    ``multi_line=False`` is for large files without any, which are then split over tasks."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def _get(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def _nz(c: Column) -> Column:
    return F.when(F.trim(c.cast("string")) != "", c)


def normalize_raw(df: DataFrame, provider: str, legal_basis: str | None) -> DataFrame:
    """Raw text row -> canonical posting: defaults (period yearly, job type Full-time,
    employment permanent), fallbacks (application_url <- url, posted_at / last_seen_at <-
    posted_date, occupation_group <- role_type, source_posting_id <- id, source <- provider,
    legal basis <- provider's), skills (S3), booleans (S5), timestamps (S6), city/country (S7).
    A missing description becomes "" and missing skills an empty list."""
    g = lambda c: _get(df, c)
    ts = {c: parse_timestamp(g(c)).cast("timestamp_ntz") if c in df.columns else F.lit(None).cast("timestamp_ntz")
          for c in DATE_COLUMNS}
    loc = g("location").cast("string")
    url = _nz(g("url"))
    return df.select(
        g("id").cast("string").alias("id"), g("title").cast("string").alias("title"),
        g("company").cast("string").alias("company"), loc.alias("location"),
        _nz(g("salary_min")).cast("string").try_cast("double").alias("salary_min"),
        _nz(g("salary_max")).cast("string").try_cast("double").alias("salary_max"),
        F.coalesce(_nz(g("salary_period")), F.lit("yearly")).alias("salary_period"),
        parse_bool(g("salary_is_estimated"), False).alias("salary_is_estimated"),
        _nz(g("salary_confidence")).cast("string").try_cast("double").alias("salary_confidence"),
        F.coalesce(_nz(g("job_type")), F.lit("Full-time")).alias("job_type"),
        F.coalesce(_nz(g("employment_type")), F.lit("permanent")).alias("employment_type"),
        F.coalesce(g("description").cast("string"), F.lit("")).alias("description"),
        split_list(g("required_skills")).alias("required_skills"),
        ts["posted_date"].alias("posted_date"),
        F.coalesce(ts["posted_at"], ts["posted_date"]).alias("posted_at"),
        ts["expires_at"].alias("expires_at"),
        F.coalesce(ts["last_seen_at"], ts["posted_date"]).alias("last_seen_at"),
        F.coalesce(_nz(g("source")), F.lit(provider)).alias("source"),
        F.coalesce(_nz(g("source_posting_id")), g("id").cast("string")).alias("source_posting_id"),
        url.alias("url"), F.coalesce(_nz(g("application_url")), url).alias("application_url"),
        _nz(g("company_career_url")).alias("company_career_url"),
        F.coalesce(_nz(g("country")), infer_country(loc)).alias("country"),
        F.coalesce(_nz(g("city")), infer_city(loc)).alias("city"),
        _nz(g("federal_state")).alias("federal_state"), _nz(g("remote_status")).alias("remote_status"),
        _nz(g("role_type")).alias("role_type"),
        F.coalesce(_nz(g("occupation_group")), _nz(g("role_type"))).alias("occupation_group"),
        _nz(g("experience_level")).alias("experience_level"),
        F.coalesce(_nz(g("source_legal_basis")), F.lit(legal_basis).cast("string")).alias("source_legal_basis"),
        _nz(g("ingestion_batch_id")).alias("ingestion_batch_id"),
        F.coalesce(_nz(g("currency")), F.lit("EUR")).alias("currency"),
    )


def keyword_filter(jobs: DataFrame, keywords: list[str], location: str | None = None, work_mode: str | None = None) -> DataFrame:
    """Location contains; work mode equals unless ``any``; *any* term of any keyword in the
    text blob (title, company, location, description, role, work mode, skills); no terms -> all."""
    d = jobs
    if location:
        d = d.where(F.lower(F.col("location")).contains(location.lower()))
    if work_mode and work_mode.lower() != "any":
        d = d.where(F.lower(F.coalesce(F.col("remote_status"), F.lit(""))) == work_mode.lower())
    terms = [t.strip().lower() for k in keywords for t in k.split() if t.strip()]
    if not terms:
        return d
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                                      ("title", "company", "location", "description", "role_type", "remote_status")],
                               F.array_join(F.col("required_skills"), " ")))
    hit = F.lit(False)
    for t in terms:
        hit = hit | blob.contains(t)
    return d.where(hit)


def fetch(jobs: DataFrame, keywords: list[str], limit: int, order: str = "id", location: str | None = None, work_mode: str | None = None) -> DataFrame:
    """The first ``limit`` matches in row order (``order``); a distributed top-k, not a sort of all matches."""
    return keyword_filter(jobs, keywords, location, work_mode).orderBy(order).limit(limit)


@dataclass(frozen=True)
class Feed:
    """A source behind the fetch contract: its id, its rows and the legal basis they come with."""

    source_id: str
    rows: DataFrame
    legal_basis: str | None = None

    def fetch(self, keywords: list[str], limit: int, order: str = "id", location: str | None = None, work_mode: str | None = None) -> DataFrame:
        rows = self.rows
        for c, default in (("source", self.source_id), ("source_legal_basis", self.legal_basis)):
            given = F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn(c, F.coalesce(given, F.lit(default).cast("string")))
        return fetch(rows, keywords, limit, order, location, work_mode)


def run_sources(feeds: list[Feed], requested: list[str], keywords: list[str], limit_per_source: int, order: str = "id") -> DataFrame:
    """What every requested source fetches, in one frame with ``_provider``; at most ``limit_per_source`` rows each.
    An unknown source is an error before anything is read."""
    known = {f.source_id.lower(): f for f in feeds}
    unknown = [s for s in requested if s.lower() not in known]
    if unknown:
        raise ValueError(f"No provider registered for source {', '.join(map(repr, unknown))}.")
    return union_sources({s.lower(): known[s.lower()].fetch(keywords, limit_per_source, order) for s in requested})


def per_keyword_fetch(jobs: DataFrame, keywords: list[str], limit: int, order: str = "id") -> DataFrame:
    """One pull per keyword (keyword position order), each capped at ``limit``, stop once
    ``limit`` rows are gathered: the first ``limit`` rows by (keyword position, row order)."""
    kws = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("kw")) for i, k in enumerate(keywords or [""])])
    e = jobs.select("*", F.explode(kws).alias("_k"))
    blob = F.lower(F.concat_ws(" ", "title", "company", "location", "description"))
    e = e.where(F.exists(F.filter(F.split(F.lower(F.col("_k.kw")), " "), lambda t: t != ""), lambda t: blob.contains(t))
                | (F.trim(F.col("_k.kw")) == ""))
    w = Window.partitionBy("_k.pos").orderBy(order)
    e = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return e.orderBy("_k.pos", order).limit(limit).drop("_k", "_rn")


def union_sources(frames: dict[str, DataFrame], limit_per_source: int | None = None, order: str = "id") -> DataFrame:
    """Union by name (missing columns as nulls), at most ``limit_per_source`` rows per source."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("_provider", F.lit(name))
        if limit_per_source is not None:
            d = d.orderBy(order).limit(limit_per_source)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


NESTED_SCHEMA = ("id string, title string, company struct<name:string>, location string, "
                 "salary struct<minimum:double,maximum:double>, jobType string, description string, "
                 "postedDate string, url string")


def parse_nested_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Nested JSON records (company.name, salary.minimum ...) -> postings; records that do not
    parse or lack an ISO posting date are dropped; skills extracted from the description (S15)."""
    p = df.select(F.from_json(F.col(column), NESTED_SCHEMA, {"mode": "PERMISSIVE"}).alias("j")).select("j.*")
    posted = parse_timestamp(F.col("postedDate")).cast("timestamp_ntz")
    out = p.select(
        F.coalesce(F.col("id"), F.lit("")).alias("id"), F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("company.name"), F.lit("")).alias("company"), F.coalesce(F.col("location"), F.lit("")).alias("location"),
        F.col("salary.minimum").alias("salary_min"), F.col("salary.maximum").alias("salary_max"),
        F.coalesce(F.col("jobType"), F.lit("Full-time")).alias("job_type"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        extract_skills(F.col("description")).alias("required_skills"), posted.alias("posted_date"),
        F.lit("linkedin").alias("source"), F.coalesce(F.col("id"), F.lit("")).alias("source_posting_id"),
        F.col("url").alias("url"), F.col("url").alias("application_url"),
        F.lit("yearly").alias("salary_period"), F.lit(False).alias("salary_is_estimated"))
    return out.where(F.col("posted_date").isNotNull())


def clean_salary_value(c: Column) -> Column:
    """Null, non-numeric or <= 0 -> null."""
    v = c.cast("string").try_cast("double")
    return F.when(v > 0, v)


#: commas outside double quotes
_HEADER_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> files with it, from the first line of every CSV file under ``path`` (one short row per file). Files that
    cannot be read have none."""
    first = (spark.read.option("wholetext", False).option("ignoreCorruptFiles", True).text(path)
             .select("value", F.input_file_name().alias("file"), F.expr("_metadata.file_block_start").alias("at"))
             .where("at = 0").groupBy("file").agg(F.first("value").alias("line")))
    header = F.transform(F.split(F.regexp_replace("line", "^\ufeff", ""), _HEADER_COMMA), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    files: dict[tuple[str, ...], list[str]] = {}
    for r in first.select("file", header.alias("h")).collect():
        files.setdefault(tuple(r.h), []).append(r.file)
    return files


def read_alternate_csv_dir(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """A directory of CSV files whose columns may use alternate names, in any order and mixed; the first present
    name wins; salaries cleaned (S14); skills extracted from the description (S15).

    Files are read once per distinct header; files that hold none of the known columns or cannot be read, and rows with more
    fields than their header, are left out: ``csv_dir_report`` counts them. Quoted fields may hold line breaks;
    ``multi_line=False`` is for large files without any, which are then split over tasks."""
    out = None
    for header, files in sorted(csv_layouts(spark, path).items()):
        if not _KNOWN & set(header):
            continue
        part = _alternate_layout(_checked_rows(spark, header, files, multi_line).where("_more is null"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _alternate_layout(spark.createDataFrame([], "id string"))
    return out if limit is None else out.orderBy("id").limit(limit)


_KNOWN = {n for names in ALTERNATE_NAMES.values() for n in names}


def _checked_rows(spark: SparkSession, header: tuple[str, ...], files: list[str], multi_line: bool) -> DataFrame:
    """Rows of files with this header as text, with ``_more`` (the first field beyond the header; such a record does not fit
    it) and ``_file``. Missing last fields are null. A header that names a column twice keeps the first."""
    names = [n if n not in header[:i] else f"{n}_{i}" for i, n in enumerate(header)]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + ", _more string"
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("escape", '"')
    return reader.option("ignoreCorruptFiles", True).csv(files).withColumn("_file", F.input_file_name())


def csv_dir_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per file under ``path`` that has a byte: (file, status, rows, corrupt_rows). Status: ``read``, ``unknown_layout``
    (none of the known columns), or ``unreadable``; the last two give no rows, and the job goes on without them."""
    layouts = csv_layouts(spark, path)
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    headed = spark.createDataFrame([(f, bool(_KNOWN & set(h))) for h, fs in layouts.items() for f in fs], "file string, known boolean")
    counts = spark.createDataFrame([], "file string, rows long, corrupt_rows long")
    for header, files in sorted(layouts.items()):
        if _KNOWN & set(header):
            checked = _checked_rows(spark, header, files, multi_line)
            counts = counts.unionByName(checked.groupBy(F.col("_file").alias("file")).agg(
                F.count_if(F.col("_more").isNull()).alias("rows"), F.count_if(F.col("_more").isNotNull()).alias("corrupt_rows")))

    def name(c: str) -> Column:
        return F.element_at(F.split(F.col(c), "/"), -1)

    status = F.when(F.col("known").isNull(), "unreadable").when(F.col("known"), "read").otherwise("unknown_layout")
    joined = (listed.withColumn("file", name("file")).join(headed.withColumn("file", name("file")), "file", "left")
              .join(counts.withColumn("file", name("file")), "file", "left"))
    return joined.select("file", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("corrupt_rows", F.lit(0)).alias("corrupt_rows"))


def _alternate_layout(raw: DataFrame) -> DataFrame:
    cols = set(raw.columns)

    def pick(key):
        names = [n for n in ALTERNATE_NAMES[key] if n in cols]
        return F.coalesce(*[_nz(F.col(n)) for n in names]) if names else F.lit(None).cast("string")

    out = raw.select(
        pick("id").alias("id"), pick("title").alias("title"), pick("company").alias("company"),
        pick("location").alias("location"), F.coalesce(pick("job_type"), F.lit("Full-time")).alias("job_type"),
        F.coalesce(pick("description"), F.lit("")).alias("description"),
        clean_salary_value(pick("salary_min")).alias("salary_min"), clean_salary_value(pick("salary_max")).alias("salary_max"))
    return out.withColumn("required_skills", F.array_distinct(extract_skills(F.col("description"))))


def write_csv(df: DataFrame, path: str, skills: str = "required_skills", compression: str = "none") -> None:
    """CSV with the skill list joined by ``;``."""
    out = df.withColumn(skills, F.array_join(skills, ";")) if skills in df.columns else df
    for f in out.schema.fields:
        if f.dataType.typeName() in ("array", "map", "struct"):
            out = out.withColumn(f.name, F.to_json(f.name))
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)  # values as they are


def save_valid(df: DataFrame, path: str, as_of: dt.datetime, kind: str = "csv", strict: bool = False) -> DataFrame:
    """A sink that validates. Good rows go to ``path`` (CSV, or JSON lines), rows that break a rule to
    ``path`` + ``_rejected`` as JSON lines with their ``failures``; returns (rule, rows) with the rule ``valid`` for the rows
    written. ``strict`` raises instead when any row breaks a rule, and writes nothing. Files are gzip, which the readers take as
    they are: the text is several times the size of the rows."""
    from jobsieve.operators import validation as va
    from jobsieve.session import cut_lineage
    if strict:
        va.validate_strict(df, as_of)
    checked = cut_lineage(va.with_failures(df, as_of))  # judged once for both sinks and the counts
    good = checked.where(F.size("failures") == 0).drop("failures")
    write_csv(good, path, compression="gzip") if kind == "csv" else write_json(good, path, compression="gzip")
    checked.where(F.size("failures") > 0).write.mode("overwrite").json(f"{path}_rejected", compression="gzip")
    rules = F.when(F.size("failures") == 0, F.array(F.lit("valid"))).otherwise(F.col("failures"))
    return checked.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path, compression=compression)


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON message per posting (``value`` column), ready for a Kafka or file sink."""
    return df.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


# ---- versioned table -------------------------------------------------------------------------

def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def write_version(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version of the table at ``root``; returns the version.

    The next version folder can only hold leftovers of a failed attempt (no ``_SUCCESS``), so a
    retried job overwrites it; committed versions are never touched."""
    versions = committed_versions(df.sparkSession, root)
    v = (versions[-1] + 1) if versions else 1
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/v={v:08d}")
    return v


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest committed version (None when the table has none)."""
    versions = committed_versions(spark, root)
    if not versions:
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/v={versions[-1]:08d}")
