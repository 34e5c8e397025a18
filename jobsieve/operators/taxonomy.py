"""Taxonomy matching and enrichment (S20, J1, J1a-c, Q1, Q2, S15).

Two ways with one result. ``match_concepts`` is row-local, for short fields and taxonomies of literal size (the seed: 55
concepts, ~280 terms): the table is folded once by Spark, then embedded as a literal array of structs.
``match_concepts_join`` takes long texts and a taxonomy of any size as a table: an equi-join of the texts' character grams
and tokens to the rarest gram and token of every term, verified in full."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.functions.text import fold, folded_tokens, split_list, tokens
from jobsieve.session import cut_lineage
from jobsieve.sources.taxonomy_seed import EXTRACTION_SKILLS, SEED_CSV

CONCEPT_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("concept_type", T.StringType()),
    T.StructField("preferred_label", T.StringType()),
    T.StructField("concept_uri", T.StringType()),
    T.StructField("broader_group", T.StringType()),
    T.StructField("aliases_text", T.StringType()),
])


def load_concepts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Taxonomy CSV -> (ordinal, concept_type, preferred_label, concept_uri, broader_group,
    aliases, all_terms). ``ordinal`` keeps file order (the first matching occupation wins)."""
    if path is None:
        rows = [(i, r["concept_type"], r["preferred_label"], r.get("concept_uri"), r.get("broader_group"), r.get("aliases"))
                for i, r in enumerate(csv.DictReader(io.StringIO(SEED_CSV)))]
        raw = spark.createDataFrame(rows, CONCEPT_SCHEMA)
    else:
        src = spark.read.csv(path, header=True).withColumn("_mid", F.monotonically_increasing_id())
        # a taxonomy file is small and bounded; file order is the ordinal
        raw = src.select(
            (F.row_number().over(Window.orderBy("_mid")) - 1).cast("int").alias("ordinal"),
            "concept_type", "preferred_label", "concept_uri", "broader_group", F.col("aliases").alias("aliases_text"))
    nz = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    aliases = split_list("aliases_text")
    return raw.select(
        "ordinal", F.trim("concept_type").alias("concept_type"), F.trim("preferred_label").alias("preferred_label"),
        nz("concept_uri").alias("concept_uri"), nz("broader_group").alias("broader_group"),
        aliases.alias("aliases"),
        F.concat(F.array(F.trim("preferred_label")), aliases).alias("all_terms"),
    )


def concept_terms(concepts: DataFrame) -> DataFrame:
    """One row per (concept, term) with the folded term and its token set."""
    return concepts.select("*", F.posexplode("all_terms").alias("term_pos", "term")).select(
        "*", fold("term").alias("term_norm"), tokens("term").alias("term_tokens"))


def collect_terms(concepts: DataFrame) -> list:
    """The folded (concept, term) rows in file order, for a taxonomy that is to be embedded as a literal (a larger
    one stays a table: ``match_concepts_join``)."""
    return concept_terms(concepts).orderBy("ordinal", "term_pos").collect()


_CACHE: dict = {}
_SEED_ROWS: dict = {}


def concept_set(spark: SparkSession, concept_type: str | None = None) -> "ConceptSet":
    """The seed taxonomy's :class:`ConceptSet`, built once per session and type; the seed is
    folded by one Spark job per session and each type is a subset of those rows."""
    app = spark.sparkContext.applicationId
    key = (app, concept_type)
    if key not in _CACHE:
        if app not in _SEED_ROWS:
            _SEED_ROWS[app] = collect_terms(load_concepts(spark))
        _CACHE[key] = ConceptSet(spark, concept_type, rows=_SEED_ROWS[app])
    return _CACHE[key]


def explode_matches(df: DataFrame, column: str, alias: str = "c") -> DataFrame:
    """Explode a match array, keeping only matched rows.

    ``explode_outer`` + a filter *above* the generator: a plain ``explode`` makes Catalyst infer
    ``size(column) > 0`` and push it below the projection that computes the matches, which would
    evaluate the whole matcher a second time outside codegen."""
    return df.select("*", F.explode_outer(column).alias(alias)).drop(column).where(F.col(alias).isNotNull())


def _sql_str(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_array(items: list[str]) -> str:
    return f"CAST(array({', '.join(items)}) AS ARRAY<STRING>)" if items else "CAST(array() AS ARRAY<STRING>)"


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct ones of sorted ``keys``, and the values of each."""
    if not len(keys):
        return [], []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first].tolist(), np.split(values, first[1:])


class ConceptSet:
    """A folded concept table embedded in the plan: the concept structs (literal array, file order) as SQL text (one parse in
    the JVM instead of thousands of expression-building calls), and the matcher of a batch of folded texts."""

    def __init__(self, spark: SparkSession, concept_type: str | None = None, concepts: DataFrame | None = None,
                 rows: list | None = None):
        if rows is None:
            c = concepts if concepts is not None else load_concepts(spark)
            rows = collect_terms(c.where(F.col("concept_type") == concept_type) if concept_type else c)
        elif concept_type:
            rows = [r for r in rows if r["concept_type"] == concept_type]
        by: dict[int, dict] = {}
        for r in rows:
            d = by.setdefault(r["ordinal"], {"r": r, "terms": []})
            d["terms"].append((r["term_norm"], list(r["term_tokens"])))
        self.entries = [(o, by[o]["terms"]) for o in sorted(by)]
        structs = []
        for o, _ in self.entries:
            r = by[o]["r"]
            structs.append(
                "named_struct('ordinal', {o}, 'concept_type', {t}, 'preferred_label', {l}, 'concept_uri', {u}, "
                "'broader_group', {b}, 'aliases', {a}, 'all_terms', {at})".format(
                    o=o, t=_sql_str(r["concept_type"]), l=_sql_str(r["preferred_label"]), u=_sql_str(r["concept_uri"]),
                    b=_sql_str(r["broader_group"]), a=_sql_array([_sql_str(x) for x in r["aliases"]]),
                    at=_sql_array([_sql_str(x) for x in r["all_terms"]])))
        self.array_sql = f"array({', '.join(structs)})"

    def finder(self) -> Callable[[pa.Array], list[list[int]]]:
        """For a batch of folded texts the 0-based positions (file order) of the concepts that match each: a term hits when its
        folded form is a substring of the text, or all its tokens are among the text's. One scan per distinct text finds those
        that hold any term or the longest token of one; only these are tested term by term."""
        entries = [(i, [(n, t) for n, t in terms if n]) for i, (_, terms) in enumerate(self.entries)]
        hints = sorted({n for _, terms in entries for n, _ in terms} | {rf"\b{max(t, key=len)}\b" for _, terms in entries for _, t in terms if t})
        any_hint = "|".join(hints)

        def one(text: str) -> list[int]:
            words = set(text.split(" "))
            return [i for i, terms in entries if any(n in text or (t and words.issuperset(t)) for n, t in terms)]

        def find(texts: pa.Array) -> list[list[int]]:
            coded = texts.dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            found: list[list[int]] = [[]] * len(coded.dictionary)
            if hints:
                for k in np.flatnonzero(pc.match_substring_regex(coded.dictionary, any_hint).to_numpy(zero_copy_only=False)):
                    found[k] = one(coded.dictionary[int(k)].as_py())
            return [[] if k is None else found[k] for k in coded.indices.to_pylist()]

        return find

    def positions(self, folded: Column) -> Column:
        """Positions (file order) of the concepts that match a folded text."""
        find = self.finder()

        def at(texts: pa.Array) -> pa.Array:
            return pa.array(find(texts), pa.list_(pa.int32()))

        return F.arrow_udf(at, "array<int>")(folded)

    def list_positions(self, folded: Column) -> Column:
        """Distinct positions of the concepts that match any text of a list of folded texts, in first-seen order."""
        find = self.finder()

        def at(lists: pa.Array) -> pa.Array:
            hits = find(lists.flatten())
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            out: list[list[int]] = [[]] * len(lists)
            met = np.flatnonzero([bool(h) for h in hits])
            for row, of in zip(*_runs(np.searchsorted(ends, met, side="right"), met)):
                out[row] = list(dict.fromkeys(i for k in of for i in hits[k]))
            return pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(at, "array<int>")(folded)

    def concepts_at(self, positions: str) -> Column:
        return F.expr(f"transform({positions}, i -> element_at({self.array_sql}, i + 1))")


def match_concepts(df: DataFrame, text: Column, concepts: ConceptSet, out: str = "concepts") -> DataFrame:
    """All concepts (file order) whose folded label/alias is a substring of the folded text, or
    whose every >=3-char token is among the text's tokens; for short fields and a taxonomy of literal size."""
    d = df.withColumn("_at", concepts.positions(fold(text)))
    return d.withColumn(out, concepts.concepts_at("_at")).drop("_at")


GRAM = 3
#: what a folded text is made of; a gram of 1 to ``GRAM`` of these has one number below ``GRAM_CODES``
_LETTERS = b" abcdefghijklmnopqrstuvwxyz0123456789"
_STARTS = [sum(len(_LETTERS) ** k for k in range(1, n)) for n in range(1, GRAM + 2)]
GRAM_CODES = _STARTS[-1]


def _gram_codes(texts: pa.Array, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every gram of the given lengths in a batch of folded texts, repeats included."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    letter = np.zeros(256, np.int32)
    letter[np.frombuffer(_LETTERS, np.uint8)] = np.arange(len(_LETTERS))
    c = letter[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]] if len(texts) and offsets[-1] > offsets[0] else np.zeros(0, np.int32)
    sizes = np.diff(offsets).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(c))  # characters from here to the text's end
    rows, codes = [], []
    for n in lengths:
        at = np.flatnonzero(left >= n)
        code = np.zeros(len(at), np.int32)
        for k in range(n):
            code = code * len(_LETTERS) + c[at + k]
        rows.append(row[at])
        codes.append(code + _STARTS[n - 1])
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _own_grams(labels: DataFrame) -> DataFrame:
    """(_tn, _g): the grams a text must hold to hold the term: its ``GRAM``-grams, or a shorter term itself."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("_tn")
            size = np.array(pc.utf8_length(names).to_pylist(), np.int64)
            row, code = _gram_codes(names, [*range(1, GRAM + 1)])
            length = np.searchsorted(_STARTS, code, side="right")
            own = np.unique((row * GRAM_CODES + code)[length == np.minimum(size, GRAM)[row]])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own // GRAM_CODES)).cast(pa.string()), pa.array((own % GRAM_CODES).astype(np.int32))], ["_tn", "_g"])

    return labels.select("_tn").mapInArrow(cut, "_tn string, _g int")


def _held_grams(texts: DataFrame, codes: list[int], counted: bool) -> DataFrame:
    """The distinct grams of every text that are among ``codes`` (bounded by the alphabet): rows (_k, _g), or with ``counted``
    (_g, _df), how many texts hold each."""
    wanted = np.zeros(GRAM_CODES, bool)
    wanted[codes] = True
    lengths = [n for n in range(1, GRAM + 1) if wanted[_STARTS[n - 1]:_STARTS[n]].any()]

    def held(b: pa.RecordBatch) -> np.ndarray:
        row, code = _gram_codes(b.column("_nt"), lengths)
        keep = wanted[code]
        return np.unique(row[keep] * GRAM_CODES + code[keep])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = held(part)
                yield pa.RecordBatch.from_arrays([part.column("_k").take(pa.array(found // GRAM_CODES)).cast(pa.binary()), pa.array((found % GRAM_CODES).astype(np.int32))], ["_k", "_g"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAM_CODES, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                n += np.bincount(held(b.slice(at, 1024)) % GRAM_CODES, minlength=GRAM_CODES)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["_g", "_n"])

    if counted:
        return texts.select("_nt").mapInArrow(counts, "_g int, _n long").groupBy("_g").agg(F.sum("_n").alias("_df"))
    return texts.select("_k", "_nt").mapInArrow(pairs, "_k binary, _g int")


def _codes(df: DataFrame) -> list[int]:
    """The distinct gram codes of a frame: ``GRAM_CODES`` at most."""
    return [r["_g"] for r in df.select("_g").distinct().collect()]


def _rarest(wanted: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """(_tn, key): of each term's keys that which the fewest texts hold; no row where a key stands in no text."""
    return (wanted.join(frequency, key, "left").groupBy("_tn").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), key)).alias("_r"))
            .where("_r._df > 0").select("_tn", F.col(f"_r.{key}").alias(key)))


def match_concepts_join(df: DataFrame, id_col: str, text: Column, concepts: DataFrame) -> DataFrame:
    """J1 for a taxonomy table of any size (``load_concepts`` shape): (id_col, ordinal) of every match.

    A term is keyed by the rarest of its grams in the texts at hand, and by the rarest of its tokens, so neither a common
    syllable nor a common word brings texts and terms together; a term with a gram or token that no text holds has no such
    key. Texts meet terms on those keys as (text digest, term) pairs, and the distinct pairs are tested in full: the text
    contains the term, or holds all its tokens. Equal texts are matched once; texts and matches meet by shuffles, since their
    size cannot be told from that of the files they come from."""
    t = cut_lineage(df.select(F.col(id_col), fold(text).alias("_nt")).where("_nt <> ''").withColumn("_k", F.unhex(F.md5("_nt"))))
    texts = cut_lineage(t.select("_k", "_nt").distinct())
    terms = cut_lineage(concept_terms(concepts).where("term_norm <> ''").select("ordinal", F.col("term_norm").alias("_tn"), F.col("term_tokens").alias("_tt")).distinct())
    labels = terms.select("_tn", "_tt").distinct()
    wanted = cut_lineage(_own_grams(labels))
    keyed = cut_lineage(_rarest(wanted, _held_grams(texts, _codes(wanted), counted=True), "_g"))
    inside = _held_grams(texts, _codes(keyed), counted=False).join(keyed, "_g").select("_k", "_tn")

    words = labels.select("_tn", F.explode("_tt").alias("_w"))
    have = texts.select("_k", F.explode(F.array_distinct(F.filter(F.split("_nt", " "), lambda w: F.length(w) >= 3))).alias("_w"))
    frequency = have.join(words.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    spoken = cut_lineage(_rarest(words, frequency, "_w"))
    pairs = inside.unionByName(have.join(spoken, "_w").select("_k", "_tn")).distinct()

    def spoken_by(w: Column) -> Column:
        nt, gap = F.col("_nt"), F.lit(" ")
        return F.contains(nt, F.concat(gap, w, gap)) | F.startswith(nt, F.concat(w, gap)) | F.endswith(nt, F.concat(gap, w)) | (nt == w)

    tokens_of = F.filter(F.split("_tn", " "), lambda w: F.length(w) >= 3)
    spoken_whole = (F.size(tokens_of) > 0) & F.forall(tokens_of, spoken_by)
    hits = pairs.hint("merge").join(texts, "_k").where(F.contains("_nt", "_tn") | spoken_whole).select("_k", "_tn")
    hits = hits.join(terms.select("_tn", "ordinal").distinct(), "_tn").select("_k", "ordinal").distinct()
    return t.select(id_col, "_k").join(hits.hint("merge"), "_k").select(id_col, "ordinal").distinct()


def _job_text() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "role_type", "occupation_group", "description")]
    return F.concat_ws(" ", *parts)


def enrich_postings(df: DataFrame, occupations: ConceptSet, skills_lit: ConceptSet, skills: str = "required_skills") -> DataFrame:
    """Add ``occupation`` (J1a: first matching occupation over title, role, group,
    description), ``skill_concepts`` (J1b: per skill, matching skill concepts, deduped, first-seen order) and
    ``search_terms`` (labels, aliases, broader groups; sorted distinct)."""
    d = match_concepts(df, _job_text(), occupations, "_occ").withColumn("occupation", F.get(F.col("_occ"), 0)).drop("_occ")
    folded = F.transform(F.coalesce(F.col(skills), F.array().cast("array<string>")), fold)
    d = d.withColumn("_sk", skills_lit.list_positions(folded)).withColumn("skill_concepts", skills_lit.concepts_at("_sk"))
    occ_terms = F.when(F.col("occupation").isNotNull(),
                       F.concat(F.col("occupation.all_terms"), F.array(F.col("occupation.broader_group"))))
    sk_terms = F.flatten(F.transform("skill_concepts", lambda c: F.concat(c["all_terms"], F.array(c["broader_group"]))))
    allt = F.concat(F.coalesce(occ_terms, F.array().cast("array<string>")), sk_terms)
    d = d.withColumn("search_terms", F.array_sort(F.array_distinct(F.filter(allt, lambda t: t.isNotNull() & (t != "")))))
    return d.drop("_sk")


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def expand_query(df: DataFrame, query: str, all_concepts: ConceptSet, out: str = "expanded_terms") -> DataFrame:
    """Q1: split terms + whole query + >=3-char folded tokens + labels, aliases and broader groups
    of every matching concept; lower-cased, stripped, sorted, distinct."""
    q = F.col(query).cast("string")
    d = match_concepts(df, q, all_concepts, "_m")
    split_terms = F.filter(F.split(F.lower(strip(F.coalesce(q, F.lit("")))), r"\s+"), lambda t: t != "")
    concept_terms_ = F.flatten(F.transform("_m", lambda c: F.concat(c["all_terms"], F.array(c["broader_group"]))))
    allt = F.concat(split_terms, F.array(F.coalesce(q, F.lit(""))), tokens(q), concept_terms_)
    cleaned = F.filter(F.transform(allt, lambda t: F.lower(strip(t))), lambda t: t.isNotNull() & (t != ""))
    return d.withColumn(out, F.array_sort(F.array_distinct(cleaned))).drop("_m")


def normalize_query(df: DataFrame, query: str, occupations: ConceptSet, skills_lit: ConceptSet) -> DataFrame:
    """Q2: matched occupation labels and skill labels (file order)."""
    d = match_concepts(df, F.col(query), occupations, "_o")
    d = match_concepts(d, F.col(query), skills_lit, "_s")
    return d.withColumn("occupations", F.transform("_o", lambda c: c["preferred_label"])) \
            .withColumn("skills", F.transform("_s", lambda c: c["preferred_label"])).drop("_o", "_s")


def extract_skills(text: Column, dictionary: list[str] | None = None) -> Column:
    """Dictionary terms contained (case-insensitive) in the text, in dictionary order."""
    terms = dictionary or EXTRACTION_SKILLS
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(F.lower(t)))
