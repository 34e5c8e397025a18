"""The registered queries of the corpus operators and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.llm import bpe, embeddings, minhash, packing, preference, quality, repair, search, sharding, suffix, toxicity, url_rules, warc
from jobsieve.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the vocabulary is a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path(name)


# ---- 1: WARC ---------------------------------------------------------------------------------------------------

_BASE32_SQL = """
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr({h} || '0', 1 + CAST(floor(i * 5 / 4.0) AS INTEGER), 2))::INTEGER
          >> (3 - (i * 5) % 4)) & 31), 1)), 'string_agg', '')
"""

_OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS original FROM h GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32_SQL.format(h="h.hex")} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM h JOIN f USING (hex)
"""


@query("op1_warc", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


# ---- 5: sharding -----------------------------------------------------------------------------------------------

#: bytes of text a shard may hold
SHARD_BYTES = 1 << 20

_OP5_SQL = f"""
WITH k AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    list_aggregate(list_transform(range(1, 16), lambda i: lpad(bin(CAST('0x' || substr(
      md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), i, 1) AS INTEGER)), 4, '0')), 'string_agg', '') AS bits
  FROM documents),
l AS (SELECT d, substr(bits, 1, d) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM k, (SELECT unnest(range(61)) AS d) GROUP BY d, substr(bits, 1, d)),
m AS (SELECT doc_id, n_bytes, bits, min(d) AS d FROM k JOIN l ON l.shard = substr(k.bits, 1, CAST(l.d AS INTEGER))
  WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1 GROUP BY ALL)
SELECT doc_id, n_bytes, l.shard, CAST(m.d AS INTEGER) AS depth, shard_bytes, shard_docs
FROM m JOIN l ON l.d = m.d AND l.shard = substr(m.bits, 1, CAST(m.d AS INTEGER))
"""


@query("op5_extendible_shards", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


# ---- 7: preference formatting ----------------------------------------------------------------------------------

_OP7_SQL = """
WITH c AS (SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS cid, conv_id, turn, coalesce(role, '') AS role, text FROM conversations),
last AS (SELECT cid, conv_id, max(turn) AS rt, arg_max({'t': text}, (turn IS NOT NULL, coalesce(turn, 0), text IS NOT NULL, coalesce(text, ''))).t AS reply
  FROM c WHERE role = 'assistant' GROUP BY cid, conv_id),
plan AS (SELECT a.cid, a.rt, coalesce(b.reply, a.reply) AS other FROM last a LEFT JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
t AS (SELECT cid AS conv_id, turn, role, coalesce(text, '') AS text, coalesce(CASE WHEN turn IS NOT DISTINCT FROM rt AND role = 'assistant' THEN other ELSE text END, '') AS text2
  FROM c JOIN plan USING (cid) WHERE turn IS NULL OR turn <= rt),
sides AS (SELECT conv_id, turn, role, text, 'c' AS side FROM t UNION ALL SELECT conv_id, turn, role, text2, 'r' FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS i,
        '<|' || role || '|>' || chr(10) AS head FROM sides),
diff AS (SELECT conv_id, i, bool_or(side = 'c') AND bool_or(side = 'r') AND count(DISTINCT (role, text)) = 1 AS same FROM o GROUP BY conv_id, i),
k AS (SELECT conv_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS k FROM diff GROUP BY conv_id),
r AS (SELECT o.*, k.k, head || text || chr(10) AS line,
        coalesce(sum(length(head || text || chr(10))) FILTER (i > k.k)
          OVER (PARTITION BY o.conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM o JOIN k USING (conv_id)),
g AS (SELECT conv_id, k, side,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= k), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i > k), '') AS completion,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(text)), ',' ORDER BY i)
      FILTER (i > k AND role = 'assistant'), '') AS mask
  FROM r GROUP BY conv_id, k, side)
SELECT CAST(nullif(a.conv_id, 'null') AS BIGINT) AS pair_id, CAST(a.k AS INTEGER) AS prompt_turns, a.prompt, a.completion AS chosen, b.completion AS rejected,
       a.mask AS chosen_mask, b.mask AS rejected_mask
FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.side = 'c' AND b.side = 'r'
"""


@query("op7_preference_pairs", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preference.reply_swaps(table(spark, sf_dir, "conversations"))
    pairs = preference.preference_pairs(chosen, rejected)
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(spans)


# ---- 8: quality rules ------------------------------------------------------------------------------------------

def _op8_sql(p: quality.QualityParams = quality.QualityParams()) -> str:
    sp, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest({g}) AS cutoff" for r, (_, _, g) in quality.RULES.items())
    value = " ".join(f"WHEN '{r}' THEN {a} / greatest({b}, 1)" for r, (a, b, _) in quality.RULES.items())
    alpha = p.risk / len(quality.RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
ln AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}')),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM ln GROUP BY rid),
s AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(t) - length(regexp_extract_all(t, '{sp}')) AS BIGINT) AS word_chars,
    CAST(length(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclaims,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lc USING (rid)),
b AS (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM s),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid AS ({grid}),
v AS (SELECT lang, grid.rule, cutoff, CASE rule {value} END AS value FROM b SEMI JOIN good USING (doc_id), grid WHERE NOT base_failed),
cells AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k FROM v GROUP BY ALL),
tail AS (SELECT lang, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))) AS p
  FROM (SELECT *, unnest(range(k + 1)) AS i FROM cells) GROUP BY ALL),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tail
  WHERE p <= {p.delta} / (greatest((SELECT count(*) FROM (SELECT DISTINCT lang FROM b)), 1) * {len(quality.RULES)}) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(NOT EXISTS (SELECT 1 FROM cut WHERE b.lang IS NOT DISTINCT FROM cut.lang AND CASE rule {value} END > cutoff), true) AS kept
FROM b
"""


@query("op8_quality_rules", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


# ---- 10: byte-level BPE ----------------------------------------------------------------------------------------

@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# ---- 9: packing ------------------------------------------------------------------------------------------------

@query("op9_best_two_fit")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


# ---- 4: toxicity -----------------------------------------------------------------------------------------------

@query("op4_compression_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---- 2: MinHash near-duplicates --------------------------------------------------------------------------------

_OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      ELSE [array_to_string(ws, ' ')] END) AS sh FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS to_node FROM documents UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.to_node),
c AS (SELECT node AS doc_id, min(to_node) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@query("op2_minhash_near_duplicates", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# ---- 3: repeated passages --------------------------------------------------------------------------------------

@query("op3_suffix_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


# ---- 6: embedding near-duplicates ------------------------------------------------------------------------------

_OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS to_node FROM embeddings UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.to_node),
c AS (SELECT node AS vec_id, min(to_node) AS component_id FROM reach GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query("op6_spherical_cells", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


# ---- 11: conversation repair -----------------------------------------------------------------------------------

_OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda v, j: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)), 4294967295)) % 20 AS kind FROM o),
d AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY cid ORDER BY i) AS before FROM r),
g AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid),
ins(a, b, cost, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)),
    (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(letter) AS (VALUES ('D'), ('K'), ('R')),
e AS (SELECT f.cid, f.i, ins.a, letters || letter AS letters,
    ins.cost + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
    CASE WHEN letter = 'D' THEN ins.b WHEN letter = 'K' AND role[1] = 's' THEN 1 WHEN ins.b = 2 THEN 3 ELSE 2 END AS b,
    lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
      ELSE CASE WHEN ins.b = 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END AS lines
  FROM f, ins, edit WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R'
    OR role[1] = CASE WHEN ins.b = 2 THEN 'a' ELSE 'u' END OR (role[1] = 's' AND ins.b = 0)))),
s AS (SELECT cid, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM g
  UNION ALL
  SELECT s.cid, e.i, e.b, min({'cost': best.cost + e.cost, 'audit': best.audit || e.letters, 'lines': best.lines || e.lines})
  FROM s JOIN e ON e.cid = s.cid AND e.i = s.i + 1 AND e.a = s.state GROUP BY s.cid, e.i, e.b),
z AS (SELECT s.cid, min({'cost': best.cost + ins.cost, 'audit': best.audit || letters, 'lines': best.lines || ins.lines}) AS best
  FROM s JOIN g ON g.cid = s.cid AND g.n = s.i JOIN ins ON ins.a = s.state WHERE ins.b IN (0, 3) GROUP BY s.cid),
ids AS (SELECT DISTINCT cid, conv_id FROM o)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(regexp_replace(coalesce(best.lines, ''), '\n$', '')) AS repaired_sha256
FROM ids LEFT JOIN g USING (cid) LEFT JOIN z USING (cid)
"""


@query("op11_branch_and_bound", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_report(table(spark, sf_dir, "conversations"))


# ---- 12: ranked lexical search ---------------------------------------------------------------------------------

_OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT rid, doc_id, len(ts) AS n FROM t WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM t) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (rid), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@query("op12_best_positions", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.best_documents(documents, items, 50).withColumnRenamed("query_id", "item_id")


# ---- 13: URL rules ---------------------------------------------------------------------------------------------

_OP13_SQL = f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {', '.join(str(r) for r in url_rules.RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (rid)
"""


@query("op13_url_intervals", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.RULES))
