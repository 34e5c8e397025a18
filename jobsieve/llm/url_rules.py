"""URL rules by a sort-merge range join: reversed-host keys turn prefixes into intervals, and a sorted sweep keeps a
stack of the rules that are open.

A rule ``(host, path, verdict)`` fits its host and all subdomains of it when the URL's path starts with the rule's path.
With the labels of a host reversed (``www.example.com`` -> ``com.example.www.``) "this host or a subdomain" is "the key
starts with the rule's key", and all keys that start with ``lo`` are the interval from ``lo`` to ``lo`` + byte 0xFF (no
UTF-8 text holds that byte). Intervals of prefixes are nested or apart, so the open ones form a stack.

Two sweeps of the same shape follow each other, as a rule is a prefix in two directions:

1. over reversed hosts: every URL meets the stack of rule hosts open at its host;
2. over (rule host, path), one row per URL and open rule host: the top of the stack is that host's longest fitting path.

A sweep sorts rules and URLs together by range partitions (ties by row number, so one host with a third of all rows
spreads over tasks) and carries the stack of the latest opened rule forward, across partitions by a table of one row per
partition. Rules that ended in between are popped by their upper end. Slots of the stacks are filled in a sweep over the
rules' own starts and ends, where the depth is a running sum of +1 and -1. Neither side is broadcast or collected; the one
number that reaches the driver is the greatest depth of nesting, which is the width of the stack.

Defined cases: a null URL, one without ``://`` or an empty table has host and path empty or no rows; a null rule host or
path is empty, and an empty rule host fits every URL; of rules that fit, the longest (host and path together) wins, then
the one with the longer host; rules with equal host and path and different verdicts block; URLs that fit no rule get the
default verdict and a null rule. Repeated rows are judged each. Columns beyond id and URL are not read, so names cannot
clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsieve.llm.common import materialise, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: str | Column = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: str | Column = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_host(host: str | Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; the empty host is the empty key."""
    host = F.col(host) if isinstance(host, str) else host
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _key(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _end(lo: Column) -> Column:
    return F.concat(lo, F.unhex(F.lit("FF")))


def _laid(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in range partitions of ``order``, with the partition's number. Bounds are sampled, so the table is written
    once and every pass reads the same numbers."""
    width = shuffle_width(rows.sparkSession)
    return materialise(rows.repartitionByRange(width, *order).withColumn("pid", F.spark_partition_id()), "url-sweep")


def _running(*order: str):
    return Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier():
    """Over a table of one row per partition."""
    return Window.partitionBy(F.lit(0)).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)


def _carried(laid: DataFrame, values: dict[str, Column], *order: str) -> DataFrame:
    """``laid`` with the latest non-null of each value up to the row in ``order``, partitions before included."""
    rows = laid.select("*", *[v.alias(f"_{n}") for n, v in values.items()])
    lasts = rows.groupBy("pid").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(n) for n in values])
    before = lasts.select("pid", *[F.last(n, ignorenulls=True).over(_earlier()).alias(f"_before_{n}") for n in values])
    here = rows.select("*", *[F.last(f"_{n}", ignorenulls=True).over(_running(*order)).alias(f"_here_{n}") for n in values])
    return here.join(before, "pid").select(*laid.columns, *[F.coalesce(f"_here_{n}", f"_before_{n}").alias(n) for n in values])


def open_stacks(intervals: DataFrame) -> DataFrame:
    """(lo, stack): for every interval start the open intervals there, outermost first, itself last. ``intervals`` has a
    unique binary ``lo`` and a struct ``item`` with the field ``hi``."""
    events = intervals.select(F.col("lo").alias("key"), F.lit(1).alias("step"), "item").unionByName(
        intervals.select(F.col("item.hi").alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(intervals.schema["item"].dataType).alias("item")))
    laid = _laid(events, "key", "step")
    base = laid.groupBy("pid").agg(F.sum("step").alias("net")).select(
        "pid", F.coalesce(F.sum("net").over(_earlier()), F.lit(0)).alias("base"))
    deep = materialise(laid.withColumn("depth", F.sum("step").over(_running("key", "step"))).join(base, "pid")
                       .select("pid", "key", "step", "item", (F.col("base") + F.col("depth")).cast("int").alias("depth")), "url-depth")
    width = deep.agg(F.max("depth")).first()[0] or 0
    slots = {f"slot{d}": F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("item")) for d in range(1, width + 1)}
    if not slots:
        return intervals.select("lo", F.array("item").alias("stack"))
    return _carried(deep, slots, "key", "step").where("step = 1").select(
        F.col("key").alias("lo"), F.slice(F.array(*slots), F.lit(1), F.col("depth")).alias("stack"))


def meet_stacks(rows: DataFrame, stacks: DataFrame) -> DataFrame:
    """``rows`` (binary ``key``, unique ``rid``) with ``stack``: the intervals that hold the key, outermost first."""
    empty = F.lit(None).cast(stacks.schema["stack"].dataType)
    starts = stacks.select(F.col("lo").alias("key"), F.lit(-1).cast("long").alias("rid"), F.col("stack").alias("opened"))
    laid = _laid(starts.unionByName(rows.withColumn("opened", empty), allowMissingColumns=True), "key", "rid")
    swept = _carried(laid, {"stack": F.col("opened")}, "key", "rid").where("rid >= 0")
    still_open = F.filter("stack", lambda x: F.col("key") < x["hi"])
    return swept.withColumn("stack", F.coalesce(still_open, F.array().cast(stacks.schema["stack"].dataType))).drop("opened", "pid")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages`` by ``rules`` (host, path, verdict)."""
    rule = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rule = rule.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' sorts behind 'allow'
    lo = _key(F.concat(reversed_host("host"), F.lit("#"), F.col("path")))  # neither hosts nor paths hold a #
    host_lo = _key(reversed_host("host"))
    hosts = rule.select("host").distinct().select(host_lo.alias("lo"), F.struct(_end(host_lo).alias("hi"), reversed_host("host").alias("host")).alias("item"))
    paths = rule.select(lo.alias("lo"), F.struct(
        _end(lo).alias("hi"), (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "verdict").alias("item"))

    urls = materialise(pages.select(F.col(id_column).alias("id"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"),
                                    F.monotonically_increasing_id().alias("rid")), "urls")
    by_host = meet_stacks(urls.withColumn("key", _key(reversed_host("host"))), open_stacks(hosts))
    # one row per open rule host, or one without
    met = by_host.select("id", "host", "path", "rid", F.explode_outer("stack").alias("open")).withColumn(
        "key", _key(F.concat(F.col("open.host"), F.lit("#"), F.col("path")))).drop("open")
    by_path = meet_stacks(met, open_stacks(paths))
    fitting = F.transform("stack", lambda x: F.struct(x["size"].alias("size"), x["host_size"].alias("host_size"), x["rule"].alias("rule"), x["verdict"].alias("verdict")))
    best = by_path.groupBy("rid").agg(F.first(F.struct("id", "host", "path")).alias("page"), F.max(F.array_max(fitting)).alias("best"))
    return best.select(F.col("page.id").alias(id_column), "page.host", "page.path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a short list; long ones come from a table."""
    rows = F.array(*[F.struct(F.lit(h).cast("string").alias("host"), F.lit(p).cast("string").alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).selectExpr("'' AS host", "'' AS path", "'' AS verdict")
