"""Taxonomy plans over documents, benchmark items and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsieve.functions.text import fold, tokens
from jobsieve.operators import taxonomy as tx
from jobsieve.plans import sql_text as st
from jobsieve.plans.oracle_base import QUESTIONS_CTE, with_postings
from jobsieve.plans.registry import register
from jobsieve.session import scratch_path
from jobsieve.sources.tables import postings, questions, table


@register("p10_fold_documents",
          f"SELECT doc_id, md5({st.fold('text')}) AS folded_md5, CAST(length({st.fold('text')}) AS INTEGER) AS folded_len FROM documents")
def p10_fold_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(fold("text")).alias("folded_md5"), F.length(fold("text")).alias("folded_len"))


@register("p11_tokens_documents",
          f"SELECT doc_id, CAST(len({st.folded_tokens(st.fold('text'))}) AS INTEGER) AS n_tokens, "
          f"md5(array_to_string({st.folded_tokens(st.fold('text'))}, ' ')) AS tokens_md5 FROM documents")
def p11_tokens_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_TEXT_MATCH_SQL = """
WITH {tax},
_d AS (SELECT {idc} AS {idc}, {fold} AS nt FROM {src}),
_dt AS (SELECT {idc}, nt, {tok} AS tt FROM _d)
SELECT DISTINCT _dt.{idc}, _tn.ordinal, _tn.concept_type, _tn.preferred_label
FROM _dt JOIN _tn ON {hit}"""


def _text_match_sql(src, idc, textc):
    return _TEXT_MATCH_SQL.format(tax=st.taxonomy_ctes(), idc=idc, fold=st.fold(textc), tok=st.folded_tokens("nt"),
                                  src=src, hit=st.hit("_dt.nt", "_dt.tt"))


def _text_match(df, idc, text):
    c = tx.load_concepts(df.sparkSession)
    return tx.match_concepts_join(df, idc, F.col(text), c).join(c.select("ordinal", "concept_type", "preferred_label"), "ordinal").select(
        idc, "ordinal", "concept_type", "preferred_label")


@register("j1_taxonomy_match_documents", _text_match_sql("documents", "doc_id", "text"))
def j1_taxonomy_match_documents(spark, sf_dir):
    return _text_match(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("j1_taxonomy_match_conversations", "WITH " + QUESTIONS_CTE + "," + _text_match_sql(
    "(SELECT conv_id || ':' || turn || ':' || asked AS msg_id, text FROM _questions)", "msg_id", "text").replace("WITH", "", 1))
def j1_taxonomy_match_conversations(spark, sf_dir):
    c = questions(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn", "asked").alias("msg_id"), "text")
    return _text_match(c, "msg_id", "text")


@register("j1a_occupation_documents", f"""
WITH {st.taxonomy_ctes()},
_d AS (SELECT doc_id, {st.fold('text')} AS nt FROM documents),
_dt AS (SELECT doc_id, nt, {st.folded_tokens('nt')} AS tt FROM _d)
SELECT doc_id, arg_min(_tn.preferred_label, _tn.ordinal) AS occupation, min(_tn.ordinal) AS ordinal
FROM _dt JOIN _tn ON _tn.concept_type = 'occupation' AND {st.hit('_dt.nt', '_dt.tt')}
GROUP BY doc_id""")
def j1a_occupation_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    occ = tx.load_concepts(spark).where("concept_type = 'occupation'")
    first = tx.match_concepts_join(d, "doc_id", F.col("text"), occ).groupBy("doc_id").agg(F.min("ordinal").alias("ordinal"))
    return first.join(occ.select("ordinal", F.col("preferred_label").alias("occupation")), "ordinal").select("doc_id", "occupation", "ordinal")


_ITEM_TERMS = f"""_tn AS (SELECT item_id AS ordinal, 'passage' AS concept_type, text AS preferred_label, {st.fold('text')} AS tnorm, {st.folded_tokens(st.fold('text'))} AS ttok FROM benchmark)"""


@register("j1_item_terms_documents", f"""
WITH {_ITEM_TERMS},
_dt AS (SELECT doc_id, nt, {st.folded_tokens('nt')} AS tt FROM (SELECT doc_id, {st.fold('text')} AS nt FROM documents))
SELECT DISTINCT doc_id, CAST(ordinal AS INTEGER) AS ordinal FROM _dt JOIN _tn ON {st.hit('_dt.nt', '_dt.tt')}""")
def j1_item_terms_documents(spark, sf_dir):
    """A taxonomy that grows with the tables: every benchmark item is a concept with one long term."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ordinal"), F.lit("passage").alias("concept_type"), F.array("text").alias("all_terms"))
    return tx.match_concepts_join(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), items)


_PART_CONCEPTS = """_pc AS (SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS ordinal, 'skill' AS concept_type, p_name AS preferred_label, min(p_type) AS broader_group,
  list_concat([p_name], list_sort(list(DISTINCT p_brand))) AS all_terms FROM part WHERE p_name IS NOT NULL GROUP BY p_name)"""


def _part_taxonomy(spark, sf_dir):
    """A taxonomy CSV made from the parts: label, broader group and brands as aliases, in label order."""
    parts = table(spark, sf_dir, "part").where("p_name is not null").groupBy(F.col("p_name").alias("preferred_label")).agg(
        F.min("p_type").alias("broader_group"), F.array_join(F.sort_array(F.collect_set("p_brand")), ";").alias("aliases"))
    path = scratch_path(spark, "taxonomy")
    rows = parts.select(F.lit("skill").alias("concept_type"), "preferred_label", F.lit("").alias("concept_uri"), "broader_group", "aliases")
    rows.orderBy("preferred_label").coalesce(1).write.option("header", True).csv(path)
    return tx.load_concepts(spark, path)


@register("j1_part_taxonomy_postings", with_postings(f"""
SELECT DISTINCT _dt.id, _t.ordinal, _t.preferred_label FROM _dt JOIN _t ON {st.hit('_dt.nt', '_dt.tt', '_t')}""",
    f"""{_PART_CONCEPTS},
_t AS (SELECT ordinal, preferred_label, {st.fold('term')} AS tnorm, {st.folded_tokens(st.fold('term'))} AS ttok FROM (SELECT ordinal, preferred_label, unnest(all_terms) AS term FROM _pc)),
_dt AS (SELECT id, nt, {st.folded_tokens('nt')} AS tt FROM (SELECT id, {st.fold('description')} AS nt FROM postings))"""))
def j1_part_taxonomy_postings(spark, sf_dir):
    c = _part_taxonomy(spark, sf_dir)
    m = tx.match_concepts_join(postings(spark, sf_dir), "id", F.col("description"), c)
    return m.join(c.select("ordinal", "preferred_label"), "ordinal").select("id", "ordinal", "preferred_label")


def _job_text_sql():
    return "concat_ws(' ', coalesce(title, ''), coalesce(role_type, ''), coalesce(occupation_group, ''), coalesce(description, ''))"


ENRICH_SELECT = f"""
SELECT p.id, o.occupation, list_sort(list_distinct(list_filter(
         list_concat(coalesce(o.occ_terms, []), coalesce(s.sk_terms, [])), lambda t: t IS NOT NULL AND t <> ''))) AS st_list
FROM postings p
LEFT JOIN (
  SELECT id, arg_min(preferred_label, ordinal) AS occupation,
         arg_min(list_append(all_terms, broader_group), ordinal) AS occ_terms
  FROM (SELECT DISTINCT p.id, _tn.ordinal, c.preferred_label, c.all_terms, c.broader_group
        FROM (SELECT id, {st.fold(_job_text_sql())} AS nt FROM postings) p
        JOIN _tn ON _tn.concept_type = 'occupation' AND {st.hit('p.nt', st.folded_tokens('p.nt'))}
        JOIN _concepts c ON c.ordinal = _tn.ordinal)
  GROUP BY id) o ON o.id = p.id
LEFT JOIN (
  SELECT id, flatten(list(list_append(all_terms, broader_group))) AS sk_terms
  FROM (SELECT DISTINCT p.id, c.ordinal, c.all_terms, c.broader_group
        FROM (SELECT id, {st.fold('s')} AS nt FROM (SELECT id, unnest(required_skills) AS s FROM postings)) p
        JOIN _tn ON _tn.concept_type = 'skill' AND {st.hit('p.nt', st.folded_tokens('p.nt'))}
        JOIN _concepts c ON c.ordinal = _tn.ordinal)
  GROUP BY id) s ON s.id = p.id"""


@register("j1c_posting_enrichment", with_postings(
    "SELECT id, occupation, coalesce(array_to_string(st_list, '|'), '') AS search_terms FROM _enr",
    st.taxonomy_ctes() + ", _enr AS (" + ENRICH_SELECT + ")"))
def j1c_posting_enrichment(spark, sf_dir):
    p = postings(spark, sf_dir)
    e = tx.enrich_postings(p, tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    return e.select("id", F.col("occupation.preferred_label").alias("occupation"),
                    F.array_join("search_terms", "|").alias("search_terms"))


@register("q1_query_expansion_benchmark", f"""
WITH {st.taxonomy_ctes()},
_q AS (SELECT item_id, text AS q, {st.fold('text')} AS nt FROM benchmark),
_m AS (SELECT DISTINCT _q.item_id, _tn.ordinal FROM _q JOIN _tn ON {st.hit('_q.nt', st.folded_tokens('_q.nt'))}),
_all AS (
  SELECT item_id, unnest(string_split_regex(lower({st.strip('q')}), '\\s+')) AS t FROM _q
  UNION ALL SELECT item_id, q FROM _q
  UNION ALL SELECT item_id, unnest({st.folded_tokens('nt')}) FROM _q
  UNION ALL SELECT _m.item_id, unnest(c.all_terms) FROM _m JOIN _concepts c USING (ordinal)
  UNION ALL SELECT _m.item_id, c.broader_group FROM _m JOIN _concepts c USING (ordinal)
)
SELECT item_id, array_to_string(list_sort(list_distinct(list(lower({st.strip('t')}))
         FILTER (WHERE t IS NOT NULL AND lower({st.strip('t')}) <> ''))), '|') AS expanded_terms
FROM _all GROUP BY item_id""")
def q1_query_expansion_benchmark(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    e = tx.expand_query(b, "text", tx.concept_set(spark))
    return e.select("item_id", F.array_join("expanded_terms", "|").alias("expanded_terms"))


@register("q2_normalize_query_conversations", f"""
WITH {QUESTIONS_CTE}, {st.taxonomy_ctes()},
_q AS (SELECT conv_id, turn, asked, {st.fold('text')} AS nt FROM _questions),
_m AS (SELECT DISTINCT _q.conv_id, _q.turn, _q.asked, _tn.ordinal, _tn.concept_type, _tn.preferred_label
       FROM _q JOIN _tn ON {st.hit('_q.nt', st.folded_tokens('_q.nt'))})
SELECT _q.conv_id, _q.turn, _q.asked,
       coalesce(string_agg(m.preferred_label, '|' ORDER BY m.ordinal) FILTER (WHERE m.concept_type = 'occupation'), '') AS occupations,
       coalesce(string_agg(m.preferred_label, '|' ORDER BY m.ordinal) FILTER (WHERE m.concept_type = 'skill'), '') AS skills
FROM _q LEFT JOIN _m m ON m.conv_id = _q.conv_id AND m.turn = _q.turn AND m.asked = _q.asked
GROUP BY _q.conv_id, _q.turn, _q.asked""")
def q2_normalize_query_conversations(spark, sf_dir):
    n = tx.normalize_query(questions(spark, sf_dir), "text", tx.concept_set(spark, "occupation"), tx.concept_set(spark, "skill"))
    return n.select("conv_id", "turn", "asked", F.array_join("occupations", "|").alias("occupations"),
                    F.array_join("skills", "|").alias("skills"))


@register("s15_extract_skills_documents", "SELECT doc_id, array_to_string(list_filter([" +
          ", ".join(st.q(t) for t in tx.EXTRACTION_SKILLS) +
          "], lambda t: contains(lower(coalesce(text, '')), lower(t))), '|') AS skills FROM documents")
def s15_extract_skills_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tx.extract_skills(F.col("text")), "|").alias("skills"))


@register("s20_taxonomy_concepts", f"""WITH {_PART_CONCEPTS}
SELECT ordinal, concept_type, preferred_label, broader_group, array_to_string(all_terms, '|') AS all_terms FROM _pc""")
def s20_taxonomy_concepts(spark, sf_dir):
    c = _part_taxonomy(spark, sf_dir)
    return c.select("ordinal", "concept_type", "preferred_label", "broader_group",
                    F.array_join("all_terms", "|").alias("all_terms"))
