"""Driver table access and the posting-shaped view built from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The as-of instant used for every time-dependent operator on the driver tables.
AS_OF = dt.datetime(2000, 1, 1)

# Fixed mapping of ``o_orderkey % 5`` to a source id and its legal basis: two registry
# sources that are allowed, two that are blocked, one unknown id with an accepted basis.
SOURCE_BY_BUCKET = [
    ("legal_demo_csv", "Local legal seed data created for portfolio use."),
    ("company_feed", "Company feed with explicit permission from the employer."),
    ("linkedin", None),
    ("scraper", None),
    ("partner_portal", "Licensed partner agreement for listing display."),
]
WORK_MODE_BY_STATUS = {"F": "remote", "O": "onsite", "P": "hybrid"}
# Given by key, so that every branch of the operators meets data: (every n-th key, values taken in turn).
TITLE_WORDS = (9, ["Nurse", "Pflegefachkraft", "Warehouse Worker", "Staplerfahrer", "Accountant", "Buchhaltung",
                   "Store Manager", "Elektriker", "Recruiter", "Payroll Clerk"])
EXTRA_SKILLS = (6, ["Forklift License", "CRM", "DATEV", "Kundenservice", "Patient Care", "Bestand", "Python", "Java",
                    "JavaScript", "Rust", "Ruby", "TypeScript", "PostgreSQL", "Docker"])
CITIES = (8, ["Munich", "Hamburg", "Leipzig", "Bremen", "Berlin"])
LEVELS = (10, ["Junior", "Senior", "Lead", "Trainee"])
ESTIMATED_EVERY, SEEN_EVERY, OUTLIER_EVERY, OUTLIER_FACTOR = 12, 4, 501, 20
# One question template per bucket of user turns, as a further row; the last bucket has none.
QUESTION_BUCKETS = 10
QUESTION_ROLES = ["nurse", "steel", "no such role", "Store Manager", "brushed tin"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: its ordered line structs (line, part, supplier, name, type).

    One shuffle on ``l_orderkey``, of the lines as they are: lists begun on the reading side would merge little and hold
    (and spill) a whole file split there. The part dimension joins by Spark's size-checked broadcast.
    The array per order is bounded by the order's own line count (the posting's skill list)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_type"))
            ).alias("lines")
        )
    )


_POSTING_INPUTS = ("orders", "customer", "nation", "region", "lineitem", "part")


def _input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Sizes and modification times of the input files (listing only, no data read)."""
    import hashlib
    jvm = spark._jvm
    parts = []
    for name in _POSTING_INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        it = fs.listFiles(path, True)
        while it.hasNext():
            st = it.next()
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()[:24]


def postings(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The posting table: the view below, materialised once per input snapshot as Parquet under
    the shared checkpoint folder (like the reference's posting table, loaded once and queried
    many times). ``materialize=False`` returns the view itself."""
    if not materialize:
        return postings_view(spark, sf_dir)
    from jobsieve.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/postings-{_code_version()}-{_input_fingerprint(spark, sf_dir)}"
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        # written aside and renamed whole: of concurrent builders the first to finish publishes
        from jobsieve.session import scratch_path
        made = scratch_path(spark, "postings")
        postings_view(spark, sf_dir).write.parquet(made)
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs.mkdirs(target.getParent())
        if fs.exists(marker) or not fs.rename(jvm.org.apache.hadoop.fs.Path(made), target):
            return spark.read.parquet(path if fs.exists(marker) else made)
    return spark.read.parquet(path)


def _code_version() -> str:
    """Hash of this module: a changed view never serves a table built by older code."""
    import hashlib
    import inspect
    import sys
    return hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:12]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, asked, text): all turns of ``conversations`` with their own texts, and for most user turns a question
    made from a template as a further row (``asked``)."""
    own = table(spark, sf_dir, "conversations")
    c = own.where(F.col("role") == "user")
    n = F.col("conv_id").cast("string")

    def pick(values: list[str], by):
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    asked = [
        F.concat(F.lit("What are the top "), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(" skills?")),
        F.lit("Is there any salary outlier in the data?"),
        F.concat(F.lit("What is the salary for '"), pick(QUESTION_ROLES, F.col("conv_id")), F.lit("'?")),
        F.lit("Which in-demand roles come next quarter?"),
        F.lit("How many remote jobs are there?"),
        F.lit("How many jobs are listed?"),
        F.concat(F.lit('Why was the salary of "'), n, F.lit('" flagged?')),
        F.concat(F.lit("Explain the salary anomaly of job id: "), n),
        F.concat(F.lit("Openings for "), pick(TITLE_WORDS[1], F.col("conv_id")), F.lit(" with "), pick(EXTRA_SKILLS[1], F.col("conv_id") + F.col("turn")), F.lit(" experience")),
    ]
    bucket = ((F.col("conv_id") * 7 + F.col("turn")) % QUESTION_BUCKETS).cast("int")
    made = c.where(bucket < len(asked)).select("conv_id", "turn", F.lit(True).alias("asked"), F.get(F.array(*asked), bucket).alias("text"))
    return own.select("conv_id", "turn", F.lit(False).alias("asked"), "text").unionByName(made)


def postings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical posting rows derived from orders, customer, nation, region, lineitem and part."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    lines = order_lines(spark, sf_dir)

    base = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
        .join(lines, o.o_orderkey == lines.l_orderkey, "left")
    )
    key = F.col("o_orderkey")
    bucket = key % 5
    source = F.element_at(F.array(*[F.lit(s) for s, _ in SOURCE_BY_BUCKET]), (bucket + 1).cast("int"))
    basis = F.element_at(
        F.array(*[F.lit(b).cast("string") for _, b in SOURCE_BY_BUCKET]), (bucket + 1).cast("int")
    )
    first_type = F.col("lines")[0]["p_type"]

    def dealt(spec, otherwise):
        every, values = spec
        turn = (F.floor(key / every) % len(values)).cast("int")
        return F.when(key % every == 0, F.element_at(F.array(*map(F.lit, values)), turn + 1)).otherwise(otherwise)

    skills = F.coalesce(F.transform("lines", lambda x: x["p_name"]), F.array().cast("array<string>"))
    extra = dealt(EXTRA_SKILLS, F.lit(None).cast("string"))
    skills = F.when(extra.isNotNull(), F.concat(skills, F.array(extra))).otherwise(skills)
    city = dealt(CITIES, F.col("n_name"))
    country = F.when(key % CITIES[0] == 0, F.lit("Germany")).otherwise(F.col("r_name"))
    no_salary = (
        (key % 7 == 0)
        | (F.col("c_mktsegment") == "HOUSEHOLD")
        | (F.col("n_nationkey") == 24)
        | ((F.col("n_nationkey") < 5) & (F.col("o_orderpriority") == "5-LOW"))
        | ((F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderpriority") == "2-HIGH"))
    )
    smin = F.floor("o_totalprice").cast("double") * F.when(key % OUTLIER_EVERY == 1, F.lit(float(OUTLIER_FACTOR))).otherwise(F.lit(1.0))
    smax = smin + (key % 20 * 1000).cast("double")
    work_mode = F.coalesce(
        *[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in WORK_MODE_BY_STATUS.items()]
    )
    lead = dealt(TITLE_WORDS, first_type)
    title = F.when(lead.isNull(), F.col("c_mktsegment")).otherwise(F.concat(lead, F.lit(" "), F.col("c_mktsegment")))
    estimated = key % ESTIMATED_EVERY == 5
    posted = F.col("o_orderdate").cast("timestamp_ntz")
    return base.select(
        key.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("source_posting_id"),
        source.alias("source"),
        basis.alias("source_legal_basis"),
        title.alias("title"),
        F.col("c_name").alias("company"),
        F.concat(city, F.lit(", "), country).alias("location"),
        city.alias("city"),
        country.alias("country"),
        F.lit(None).cast("string").alias("federal_state"),
        F.concat(F.lit("Role in "), F.col("n_name"), F.lit(" requiring "), F.array_join(skills, ", ")).alias(
            "description"
        ),
        F.lit("Full-time").alias("job_type"),
        F.lit("permanent").alias("employment_type"),
        F.when(~no_salary, smin).alias("salary_min"),
        F.when(~no_salary, smax).alias("salary_max"),
        F.lit("yearly").alias("salary_period"),
        estimated.alias("salary_is_estimated"),
        F.when(estimated, (key % 7).cast("double") / 10).alias("salary_confidence"),
        F.lit("EUR").alias("currency"),
        skills.alias("required_skills"),
        posted.alias("posted_date"),
        posted.alias("posted_at"),
        (posted + F.make_dt_interval(days=(key % 400).cast("int"))).alias("expires_at"),
        F.when(key % SEEN_EVERY == 0, posted).alias("last_seen_at"),
        F.lit(False).alias("is_expired"),
        F.when(key % 3 == 0, F.concat(F.lit("https://jobs.example.org/postings/"), key.cast("string"))).alias("url"),
        F.when(key % 11 == 0, F.concat(F.lit("https://apply.example.org/"), key.cast("string"))).alias(
            "application_url"
        ),
        F.lit(None).cast("string").alias("company_career_url"),
        work_mode.alias("remote_status"),
        F.col("c_mktsegment").alias("role_type"),
        first_type.alias("occupation_group"),
        dealt(LEVELS, F.col("o_orderpriority")).alias("experience_level"),
        F.lit(None).cast("string").alias("ingestion_batch_id"),
    )
