"""Quality rules whose cut-offs are certified on labelled documents (SQL functions only).

Per document: words, code points in words, symbols, exclamation marks, repeated lines and words inside repeated 3-word windows.
A base rule rejects texts under ``min_words`` words or with over half of their words in repeated windows. The
other rules compare one ratio each with a cut-off chosen per stratum: among labelled good documents of the
stratum that pass the base rule, the strictest cut-off of a fixed grid whose false-rejection rate is below
``risk / number of rules`` by an exact binomial (Clopper-Pearson) upper bound at level ``delta / (strata x rules)``.
Strata and rules are corrected for by Bonferroni; along a grid the tests run from lenient to strict and stop at
the first failure (a fixed sequence, which needs no further correction; as rejections only grow on the way, that is
the strictest cut-off that passes). So with probability 1 - delta all chosen rules together falsely reject at most
``risk`` of the good documents in every stratum. A stratum with too few labels certifies nothing and its rules
stay off.

Defined cases: null text is empty (no words, fails the base rule); a null stratum is a stratum of its own;
labels of unknown documents, null labels and conflicting duplicates (any 0 counts as not good) are ignored as
good evidence; no documents or no labels give an empty or base-rule-only result; extra columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import NOT_SPACE, SPACE, SPACE_CHARS, materialise, text_digest, text_or_empty, unused

#: rule -> (numerator, denominator, grid from strict to lenient); a document is rejected above the cut-off.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "long_words": ("word_chars", "n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "exclaims": ("n_exclaims", "n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0]),
    "symbols": ("n_symbols", "n_words", [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0]),
    "dup_lines": ("n_dup_lines", "n_lines", [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "repeat_words": ("n_repeat_words", "n_words", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45]),
}


@dataclass(frozen=True)
class QualityParams:
    """``risk``: largest share of good documents that all rules may reject in a stratum; ``delta``: chance that
    the guarantee fails anywhere; ``max_terms``: binomial terms summed before the geometric bound of the rest."""

    min_words: int = 50
    max_repeat_percent: int = 50
    risk: float = 0.03
    delta: float = 0.05
    max_terms: int = 10_000


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_repeat_words (row-local)."""
    t = text_or_empty(text)
    words = docs.select(*keep, t.alias("_t"), F.btrim(t, F.lit(SPACE_CHARS)).alias("_b")).select(
        *keep, "_t",
        F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", SPACE + "+")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"))
    # a 3-word window is its 64-bit hash and place; equal windows are neighbours after the sort
    grams = words.select(
        *keep, "_t", "_l", F.size("_w").cast("long").alias("n_words"),
        F.when(F.size("_w") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(
            F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))).alias("_g"))
    found = grams.select(
        *keep, "_t", "_l", "n_words",
        F.sort_array(F.transform(F.filter("_g", lambda x, j: F.coalesce(
            (x["h"] == F.get("_g", j - 1)["h"]) | (x["h"] == F.get("_g", j + 1)["h"]),
            x["h"] == F.get("_g", j - 1)["h"], x["h"] == F.get("_g", j + 1)["h"], F.lit(False))),
            lambda x: x["i"])).alias("_p"))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return found.select(
        *keep, "n_words",
        (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.aggregate("_p", zero, lambda a, x: F.struct(
            x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"]).alias("n_repeat_words"))


def base_failed(p: QualityParams) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by eight factors."""
    y = x + 8.0
    series = (1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
              - 1 / (1680 * F.pow(y, F.lit(7.0))))
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_cdf(k: Column, n: Column, p: float, max_terms: int) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), k <= n; for k at or above the mean 1.0 (never a certificate).

    Below the mean the terms fall geometrically from k downwards: at most ``max_terms`` are summed and the rest
    is bounded by a geometric series, so the value is exact or, beyond that, slightly too large."""
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p))
                + (nd - kd) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    steps = F.least(k, F.lit(max_terms).cast("long"))

    def step(a: Column, j: Column) -> Column:
        i = kd - j.cast("double") + 1  # term i-1 from term i
        t = a["t"] * i * (1 - p) / ((nd - i + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    def finish(a: Column) -> Column:
        i = kd - steps.cast("double")
        ratio = i * (1 - p) / ((nd - i + 1) * p)
        return a["s"] + F.when(i > 0, a["t"] * ratio / (1 - ratio)).otherwise(0.0)

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), start, step, finish)).otherwise(1.0)
    return F.when(kd >= nd * p, 1.0).otherwise(top * total)


def certified_cutoffs(stats: DataFrame, good: DataFrame, p: QualityParams) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cut-off of each rule and stratum (rows only where one is).

    ``stats`` holds doc_id, stratum and the text statistics; ``good`` the distinct ids of labelled good documents."""
    strata = max(stats.select("stratum").distinct().count(), 1)
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("value"),
                                 F.array(*map(F.lit, grid)).alias("grid")) for r, (a, b, grid) in RULES.items()])
    cells = (stats.where(~base_failed(p)).join(good, "doc_id", "left_semi")
             .select("stratum", F.explode(entries).alias("e"))
             .select("stratum", "e.rule", "e.value", F.explode("e.grid").alias("cutoff"))
             .groupBy("stratum", "rule", "cutoff")
             .agg(F.count("*").alias("n"), F.count_if(F.col("value") > F.col("cutoff")).alias("k")))
    level = p.delta / (strata * len(RULES))
    tail = binomial_cdf(F.col("k"), F.col("n"), p.risk / len(RULES), p.max_terms)
    return cells.where(tail <= level).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", p: QualityParams = QualityParams(),
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``keep``, the statistics, base_failed, failed_rules (array) and kept.

    The statistics are computed once and written; labels choose the cut-offs; the strata x rules table joins
    back by an equi-join whose strategy Spark picks by size."""
    source = docs.select(F.col("doc_id"), F.col("text"), F.col(stratum).alias("stratum"), *keep)
    stats = materialise(text_stats(source, keep=("doc_id", "stratum", *keep)), "text-stats")
    good = (labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    cut = (certified_cutoffs(stats, good, p).withColumnRenamed("stratum", "_s")
           .groupBy("_s").pivot("rule", list(RULES)).agg(F.first("cutoff")))
    failed = F.array_compact(F.array(*[
        F.when(F.col(a) / F.greatest(F.col(b), F.lit(1)) > F.col(r), F.lit(r)) for r, (a, b, _) in RULES.items()]))
    return (stats.join(cut, stats["stratum"].eqNullSafe(cut["_s"]), "left")
            .withColumn("base_failed", base_failed(p)).withColumn("failed_rules", failed)
            .select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged.

    A verdict is a function of text and stratum, so rejected rows leave by (stratum, text digest)."""
    key, name = F.struct(F.col(stratum).alias("s"), text_digest("text").alias("d")), unused(docs, "_llm_key")
    verdicts = quality_verdicts(docs.select("doc_id", "text", stratum, key.alias(name)), labels, stratum, p, (name,))
    gone = verdicts.where("not kept").select(name).distinct()
    return docs.withColumn(name, key).join(gone, name, "left_anti").select(*docs.columns)
