"""Model plans over documents + labels (M1-M11) and fixed-rule predictions for exact metric checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.operators import model as ml
from jobsieve.plans.registry import register
from jobsieve.session import cut_lineage, scratch_path
from jobsieve.sources.tables import table

# A fixed rule classifier (long documents -> quality 1) gives predictions that SQL can evaluate too.
_RULE = """(SELECT CAST(l.quality AS VARCHAR) AS actual, CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END AS predicted
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _rule_preds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(F.col("quality").cast("string").alias("actual"),
                                          F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("predicted"))


@register("m8_confusion_rule", f"SELECT actual, predicted, count(*) AS count FROM {_RULE} GROUP BY actual, predicted")
def m8_confusion_rule(spark, sf_dir):
    return ml.confusion(_rule_preds(spark, sf_dir), "actual", "predicted")


_REPORT_SQL = f"""
WITH c AS (SELECT actual, predicted, count(*) AS n FROM {_RULE} GROUP BY 1, 2),
cls AS (SELECT actual AS cls FROM c UNION SELECT predicted FROM c),
r AS (SELECT cls.cls,
             coalesce((SELECT sum(n) FROM c WHERE c.actual = cls.cls), 0) AS support,
             coalesce((SELECT sum(n) FROM c WHERE c.predicted = cls.cls), 0) AS pc,
             coalesce((SELECT sum(n) FROM c WHERE c.actual = cls.cls AND c.predicted = cls.cls), 0) AS tp FROM cls),
m AS (SELECT cls, support, CASE WHEN pc > 0 THEN tp / pc ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM r)
SELECT cls, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM m"""


@register("m9_class_report_rule", _REPORT_SQL)
def m9_class_report_rule(spark, sf_dir):
    return ml.class_report(_rule_preds(spark, sf_dir), "actual", "predicted")


@register("m7_evaluate_rule", f"""
WITH rep AS ({_REPORT_SQL.replace('round(p, 6) AS precision', 'p AS precision').replace('round(r, 6) AS recall', 'r AS recall')
              .replace("round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1", "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1")})
SELECT round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM {_RULE}), 6) AS accuracy,
       round(avg(round(f1, 6)), 6) AS f1_macro,
       round(sum(round(f1, 6) * support) / (SELECT count(*) FROM {_RULE}), 6) AS f1_weighted,
       round(avg(round(precision, 6)), 6) AS precision_macro, round(avg(round(recall, 6)), 6) AS recall_macro
FROM rep""")
def m7_evaluate_rule(spark, sf_dir):
    return ml.evaluate(_rule_preds(spark, sf_dir), "actual", "predicted")


def _frame(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("description"), F.lit(None).cast("string").alias("required_skills"),
        F.col("n_chars").cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"),
        F.col("source"), F.lit(None).cast("string").alias("remote_status"), F.col("lang").alias("location"),
        F.col("quality").cast("string").alias("role_type"))


def _split(spark, sf_dir):
    """A deterministic 80/20 holdout by the id's hash."""
    f = _frame(spark, sf_dir)
    holdout = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long") % 5 == 0
    return f.where(~holdout), f.where(holdout)


@register("m1_feature_frame", """
SELECT d.doc_id, 0 AS skill_count, CAST(d.n_chars AS DOUBLE) AS salary_avg,
       CASE WHEN d.n_chars IS NULL THEN 1 ELSE 0 END AS salary_was_missing,
       coalesce(d.source, 'unknown') AS source, 'unknown' AS remote_status, coalesce(d.lang, 'unknown') AS location,
       CAST(length(trim(coalesce(d.text, ''))) AS INTEGER) AS text_len, CAST(l.quality AS VARCHAR) AS role_type
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def m1_feature_frame(spark, sf_dir):
    f = ml.feature_frame(_frame(spark, sf_dir))
    return f.select("doc_id", "skill_count", "salary_avg", "salary_was_missing", "source", "remote_status", "location",
                    F.length("combined_text").alias("text_len"), "role_type")


_WORDS = r"[\p{L}\p{N}_]{2,}"
_GRAMS = f"""_w AS (SELECT l.doc_id, regexp_extract_all(lower(trim(coalesce(d.text, ''))), '{_WORDS}') AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
_t AS (SELECT doc_id, unnest(list_concat(w, list_concat(
         list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS t FROM _w),
_tf AS (SELECT doc_id, t, count(*) AS tf FROM _t GROUP BY doc_id, t),
_n AS (SELECT count(*) AS n FROM _w),
_idf AS (SELECT t, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM _tf, _n GROUP BY t, n)"""


def _counted(spark, sf_dir):
    f = cut_lineage(ml.feature_frame(_frame(spark, sf_dir)).withColumn("_row", F.monotonically_increasing_id()))
    counts = ml.term_counts(f)  # counted anew by each reader, which costs less than storing as many rows as there are terms
    return f, counts, ml.term_index(counts, f.count())


@register("m2_term_frequencies", f"""
WITH {_GRAMS}
SELECT _w.doc_id, CAST(count(t) AS BIGINT) AS terms, CAST(coalesce(sum(tf), 0) AS BIGINT) AS occurrences, coalesce(round(sum(idf), 4), 0.0) AS idf_sum, coalesce(round(sqrt(sum((tf * idf) ** 2)), 4), 0.0) AS norm
FROM _w LEFT JOIN _tf USING (doc_id) LEFT JOIN _idf USING (t) GROUP BY _w.doc_id""")
def m2_term_frequencies(spark, sf_dir):
    f, counts, index = _counted(spark, sf_dir)
    per = counts.hint("merge").join(index, "f").groupBy("_row").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("occurrences"), F.round(F.sum("idf"), 4).alias("idf_sum"), F.round(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)), 4).alias("norm"))
    return f.select("doc_id", "_row").join(per, "_row", "left").drop("_row").fillna(0)


@register("m2_terms_by_document_frequency", f"""
WITH {_GRAMS}
SELECT df, count(*) AS terms, round(any_value(idf), 9) AS idf FROM _idf GROUP BY df""")
def m2_terms_by_document_frequency(spark, sf_dir):
    _, _, index = _counted(spark, sf_dir)
    return index.groupBy("df").agg(F.count(F.lit(1)).alias("terms"), F.round(F.first("idf"), 9).alias("idf"))


_FRAME = """(SELECT 'salary_avg' AS "column", CAST(d.n_chars AS DOUBLE) AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'skill_count', 0.0 FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'salary_was_missing', CASE WHEN d.n_chars IS NULL THEN 1.0 ELSE 0.0 END FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@register("m3_category_index", """
SELECT "column", value, count(*) AS rows FROM (
  SELECT 'source' AS "column", coalesce(d.source, 'unknown') AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'remote_status', 'unknown' FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'location', coalesce(d.lang, 'unknown') FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY ALL""")
def m3_category_index(spark, sf_dir):
    return ml.category_index(ml.feature_frame(_frame(spark, sf_dir)))


@register("m4_numeric_profile", f"""
WITH m AS (SELECT "column", median(v) AS median FROM {_FRAME} GROUP BY "column")
SELECT "column", any_value(median) AS median, round(avg(coalesce(v, median)), 6) AS mean, round(stddev_pop(coalesce(v, median)), 6) AS deviation
FROM {_FRAME} JOIN m USING ("column") GROUP BY "column" """)
def m4_numeric_profile(spark, sf_dir):
    n = ml.numeric_profile(ml.feature_frame(_frame(spark, sf_dir)))
    return n.select("column", "median", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@register("m5_class_weights", """
SELECT CAST(quality AS VARCHAR) AS role_type, count(*) AS rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality""")
def m5_class_weights(spark, sf_dir):
    w = ml.class_weights(ml.feature_frame(_frame(spark, sf_dir)), "role_type")
    return w.withColumn("weight", F.round("weight", 9))


_MODELS: dict = {}


def _model(spark, sf_dir):
    """The holdout model for these tables, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        tr, _ = _split(spark, sf_dir)
        _MODELS[key] = ml.train(tr)
    return _MODELS[key]


@register("m6_m7_holdout_metrics", None)
def m6_m7_holdout_metrics(spark, sf_dir):
    _, te = _split(spark, sf_dir)
    return ml.evaluate(ml.predict(_model(spark, sf_dir), te), "role_type", "predicted_role_type")


@register("m10_role_forecast", None)
def m10_role_forecast(spark, sf_dir):
    return ml.forecast(ml.predict(_model(spark, sf_dir), _frame(spark, sf_dir)), quarters_ahead=1, top_n=10)


def _profile_sql(section: str, rows: str) -> str:
    def counted(name, c):
        return f"SELECT '{section}' AS section, '{name}_distribution:' || {c} AS name, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM {rows} GROUP BY {c}"

    quartile = {"25%": "0.25", "50%": "0.5", "75%": "0.75"}
    stats = {"count": "count(v)", "mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", **{n: f"quantile_cont(v, {q})" for n, q in quartile.items()}, "max": "max(v)"}
    parts = [counted("label", "role_type"), counted("remote_status", "remote_status"), counted("source", "source"),
             f"SELECT '{section}', 'row_count', CAST(count(*) AS DOUBLE), NULL FROM {rows}", f"SELECT '{section}', 'column_count', 14.0, NULL"]
    parts += [f"SELECT '{section}', 'salary_avg:{n}', coalesce(CAST({e} AS DOUBLE), 0.0), NULL FROM {rows}" for n, e in stats.items()]
    return " UNION ALL ".join(parts)


def _m11_sql() -> str:
    hashed = (r"CAST(sum(CAST('0x' || substr(md5('=' || CAST(CAST(doc_id AS DECIMAL(38, 6)) AS VARCHAR) || chr(31) || '=' || chr(31) || coalesce('=' || raw_text, '-') || chr(31) || '-' || chr(31) || "
              r"coalesce('=' || CAST(CAST(n_chars AS DECIMAL(38, 6)) AS VARCHAR), '-') || chr(31) || '-' || chr(31) || coalesce('=' || raw_source, '-') || chr(31) || '-' || chr(31) || coalesce('=' || raw_lang, '-') "
              r"|| chr(31) || coalesce('=' || role_type, '-')), 1, 15) AS BIGINT)) AS VARCHAR)")
    params = {"feature_count": "7.0", "growth_per_quarter": str(ml.GROWTH_PER_QUARTER), "max_rows": f"{ml.MAX_ROWS}.0"}
    texts = {("param", "model_type"): "logistic_regression", ("param", "ngram_range"): "1-3", ("tag", "model_family"): "role_classifier", ("tag", "problem_type"): "multiclass_classification"}
    rows = [f"SELECT 'param', '{k}', CAST({v} AS DOUBLE), NULL" for k, v in params.items()] + [f"SELECT '{s}', '{k}', NULL, '{v}'" for (s, k), v in texts.items()]
    for part, where in (("train", "train"), ("eval", "NOT train")):
        rows.append(f"SELECT 'param', '{part}_rows', CAST(count(*) AS DOUBLE), NULL FROM _f WHERE {where}")
        rows.append(f"SELECT 'tag', '{part}_dataset_fingerprint', NULL, {hashed} FROM _f WHERE {where}")
    return f"""
WITH _f AS (SELECT d.doc_id, d.text AS raw_text, d.n_chars, d.source AS raw_source, d.lang AS raw_lang, CAST(d.n_chars AS DOUBLE) AS v, coalesce(d.source, 'unknown') AS source,
  'unknown' AS remote_status, CAST(l.quality AS VARCHAR) AS role_type, CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 5 <> 0 AS train
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT section, name, round(value, 6) AS value, text FROM ({_profile_sql('train', '(SELECT * FROM _f WHERE train)')} UNION ALL {_profile_sql('evaluation', '(SELECT * FROM _f WHERE NOT train)')}
  UNION ALL {' UNION ALL '.join(rows)})"""


@register("m11_run_record", _m11_sql())
def m11_run_record(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return ml.run_record(tr, te).withColumn("value", F.round("value", 6))


@register("m11_experiment_run", None)
def m11_experiment_run(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return ml.run_experiment(tr, te, scratch_path(spark, "experiment"))
