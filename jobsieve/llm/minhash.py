"""Near-duplicate documents by MinHash banding with sequential Bayesian verification.

1. Sketch: every text becomes its set of distinct 5-word shingles (64-bit hashes), a signature of 256 minima and 32
   band hashes; texts with equal sets are one class from here on, however many copies there are.
2. Candidates: a bucket is a band hash that two or more classes share. Every member is first paired with the
   bucket's smallest class only (a star), so pairs grow with members, not with their square.
3. Verification: signatures are compared 32 minima at a time; with a uniform prior the posterior after m matches of
   n is Beta(m+1, n-m+1), and a pair is pruned as soon as P(similarity >= threshold) falls below ``miss``.
   Survivors are confirmed on the full sets.
4. Rest: buckets whose members are still in several components are compared pair by pair across components,
   inside tasks and in blocks of bounded size; a found link joins its components at once, so pairs that are already
   connected are skipped and at most one link per joined component leaves a task. No candidate pair is dropped.
5. Components of all links.

A pair at the threshold is missed with probability (1 - t^8)^32 by banding (4e-5 at 0.85; (1 - t^6)^42, 3e-6 at 0.8,
with the pipeline's bands) and about ``miss`` per batch by pruning; no pair below the threshold is ever linked. Defined cases: null or empty texts and texts
without words have an empty set and link with nothing; fewer than five words are one shingle; repeated rows and ids
share a class; a null id never is a component's id unless the component has no other (then null); an empty
table gives no rows; extra columns are ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm import shingles
from jobsieve.llm.common import binary_rows, bounded_slices, connected_components, materialise, shuffle_width, small_arrow_batches, text_digest, text_or_empty, unused


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: least similarity in percent; ``miss``: posterior below which a pair is pruned; ``batch``: minima
    compared at a time; ``block``: members of a bucket held in a task at once."""

    percent: int = 85
    width: int = 5
    size: int = 256
    rows: int = 8
    batch: int = 32
    miss: float = 1e-5
    block: int = 512


def needed_matches(p: MinHashParams) -> list[int]:
    """Least matches after each batch: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m) must reach ``miss``."""
    t, out = p.percent / 100, []
    for n in range(p.batch, p.size + 1, p.batch):
        tail, m = 0.0, -1
        while tail < p.miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, others: np.ndarray, need: list[int], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``others`` that are never pruned against ``sig``, with their matches."""
    rows, matches = np.arange(len(others)), np.zeros(len(others), dtype=np.int64)
    for i, m in enumerate(need):
        cut = slice(i * batch, (i + 1) * batch)
        matches = matches + (others[rows, cut] == sig[cut]).sum(axis=1)
        ok = matches >= m
        rows, matches = rows[ok], matches[ok]
        if not len(rows):
            break
    return rows, matches


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of 100 * |a and b| >= percent * |a or b| on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame, p: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, k (digest of the set), c (its first 8 bytes), n_shingles, sig, bands; one row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = shingles.signature_family(p.size)
        for batch in bounded_slices(batches, "text", 1 << 20):
            texts = binary_rows(batch.column("text"))
            sets = shingles.shingle_sets(texts, p.width)
            sigs = np.stack([shingles.signature(s, family) if len(s) else np.zeros(p.size, dtype=np.uint32) for s in sets])
            bands = shingles.band_hashes(sigs, p.rows).view(np.int64)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            small = sigs.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.md5(t).digest() for t in texts]), pa.array(keys, pa.binary()),
                 pa.array([int.from_bytes(k[:8], "big", signed=True) if k else None for k in keys], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() if k else None for r, k in zip(small, keys)], pa.binary()),
                 pa.array([r if k else None for r, k in zip(bands, keys)], pa.list_(pa.int64()))],
                ["doc_id", "digest", "k", "c", "n_shingles", "sig", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, digest binary, k binary, c bigint, n_shingles bigint, sig binary, bands array<bigint>")


def first_per_task(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, text) without repeats inside a task: copies of one text shrink to a row per task before any shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, d in enumerate(batch.column("digest").to_pylist()):
                if d not in seen:
                    seen.add(d)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    return docs.select(text_digest(text_col).alias("digest"), text_or_empty(text_col).alias("text")).mapInArrow(run, "digest binary, text string")


def _shingle_sets(texts: DataFrame, p: MinHashParams) -> DataFrame:
    """(c, k, sig, text) -> (c, k, sig, set): the sorted 64-bit hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text", 1 << 20):
            sets = [s.tobytes() for s in shingles.shingle_sets(binary_rows(batch.column("text")), p.width)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("c", "k", "sig")], pa.array(sets, pa.binary())], ["c", "k", "sig", "set"])

    return texts.mapInArrow(run, "c bigint, k binary, sig binary, set binary")


def _star_links(members: DataFrame, p: MinHashParams) -> DataFrame:
    """(hub, salt, first, k, sig, set) sorted by group with the hub's row(s) first -> links (a, b)."""
    need = needed_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in bounded_slices(batches, "set", 16 << 20):
            a, b = [], []
            for hub, salt, first, k, sig, data in zip(*(batch.column(n).to_pylist() for n in ("hub", "salt", "first", "k", "sig", "set"))):
                if group != (hub, salt):
                    group, hubs = (hub, salt), []
                sig, own = np.frombuffer(sig, dtype=np.uint8), np.frombuffer(data, dtype=np.uint64)
                if first:
                    hubs.append((k, sig, own))
                    continue
                for k0, sig0, set0 in hubs:
                    if len(surviving(sig0, sig[None, :], need, p.batch)[0]) and similar(set0, own, p.percent):
                        a.append(k0), b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return members.mapInArrow(run, "a binary, b binary")


def _group_links(keys: list[bytes], comps: list[bytes], minor: list[bool], sigs: np.ndarray, sets: list[np.ndarray],
                 need: list[int], p: MinHashParams) -> list[tuple[bytes, bytes]]:
    """Links that join components inside one block; every pair across components is tested or already joined."""
    label = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]  # numbers of the components
    out = []
    for x in np.flatnonzero(minor):
        open_rows = np.flatnonzero(label != label[x])
        rows, matches = surviving(sigs[x], sigs[open_rows], need, p.batch)
        for y in open_rows[rows[np.argsort(-matches, kind="stable")]]:
            if label[x] != label[y] and similar(sets[x], sets[y], p.percent):
                label[label == label[y]] = label[x]
                out.append((keys[x], keys[y]))
    return out


def _block_links(rows: DataFrame, p: MinHashParams) -> DataFrame:
    """(bk, i, j, comp, minor, k, sig, set) sorted by (bk, i, j) -> links (a, b); one block pair at a time in memory."""
    need = needed_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> pa.RecordBatch:
            links = _group_links([h[0] for h in held], [h[1] for h in held], [h[2] for h in held],
                                 np.stack([np.frombuffer(h[3], dtype=np.uint8) for h in held]),
                                 [np.frombuffer(h[4], dtype=np.uint64) for h in held], need, p)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])

        for batch in bounded_slices(batches, "set", 16 << 20):
            cols = [batch.column(n).to_pylist() for n in ("bk", "i", "j", "k", "comp", "minor", "sig", "set")]
            for bk, i, j, *rest in zip(*cols):
                if group != (bk, i, j):
                    if held:
                        yield flush()
                    group, held = (bk, i, j), []
                held.append(rest)
        if held:
            yield flush()

    return rows.mapInArrow(run, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id",
                           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketch rows (doc_id, digest, k, n_shingles) and the components (k, component) of linked classes."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    rows = materialise(sketch(docs, p, id_col, text_col), "sketch")
    banded = rows.where("c is not null").select("c", F.explode("bands").alias("bk")).distinct()  # copies of a set go here
    buckets = banded.groupBy("bk").agg(F.min("c").alias("hub"), F.max("c").alias("top")).where("hub < top").select("bk", "hub")
    members = materialise(banded.join(buckets, "bk"), "bucket-members")
    some = members.select("c").distinct()
    classes = rows.join(some, "c", "left_semi").groupBy("c", "k").agg(F.min("digest").alias("digest"), F.min("sig").alias("sig"))
    texts = first_per_task(docs, text_col).join(classes, "digest").select("c", "k", "sig", "text")
    sets = materialise(_shingle_sets(texts, p).dropDuplicates(["k"]), "shingle-sets")

    # stars: the hub's row goes to every part of a large star
    pairs = materialise(members.where("c <> hub").select("hub", "c").distinct(), "star-pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"))
    spokes = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("first"), "c")
    centres = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("first"), F.col("hub").alias("c"))
    stars = (spokes.unionByName(centres).join(sets, "c").select("hub", "salt", "first", "k", "sig", "set")
             .repartition(shuffle_width(spark), "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("first")))
    first_links = materialise(_star_links(stars, p), "star-links")
    joined = connected_components(first_links)

    # buckets that still span components: one bucket per distinct member list
    comp = sets.select("c", "k").join(joined, F.col("k") == F.col("node"), "left").select("c", F.coalesce("component", "k").alias("comp"))
    placed = materialise(members.select("bk", "c").join(comp, "c"), "placed")
    sizes = placed.groupBy("bk", "comp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s"),
                                             F.sum(F.hash("c").cast("long")).alias("s2"))
    spread = (sizes.groupBy("bk").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"),
                                      F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.count("*").alias("comps")).where("comps > 1")
              .groupBy("s", "s2", "n", "major", "n_major").agg(F.min("bk").alias("bk")))
    blocks = spread.select(
        "bk", "major", F.when(F.col("n") <= p.block, 1).otherwise(F.ceil((F.col("n") - F.col("n_major")) / p.block)).cast("int").alias("na"),
        F.when(F.col("n") <= p.block, 0).otherwise(F.ceil(F.col("n_major") / p.block)).cast("int").alias("nb"))
    minor = F.col("comp") != F.col("major")
    h = F.xxhash64("c")
    located = placed.join(blocks, "bk").select("bk", "c", "comp", "na", "nb", minor.alias("minor"), F.when(
        minor | (F.col("nb") == 0), F.pmod(h, F.col("na"))).otherwise(F.col("na") + F.pmod(h, F.greatest("nb", F.lit(1)))).cast("int").alias("x"))
    other = F.when(F.col("x") < F.col("na"), F.sequence(F.lit(0), F.col("na") + F.col("nb") - 1)).otherwise(F.sequence(F.lit(0), F.col("na") - 1))
    spots = (located.select("bk", "c", "comp", "minor", "x", F.explode(other).alias("y"))
             .select("bk", "c", "comp", "minor", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")))
    rest = (spots.join(sets, "c").select("bk", "i", "j", "k", "comp", "minor", "sig", "set")
            .repartition(shuffle_width(spark), "bk", "i", "j").sortWithinPartitions("bk", "i", "j"))
    more_links = materialise(_block_links(rest, p), "block-links")
    components = connected_components(joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                                      .unionByName(more_links))
    return rows.select("doc_id", "digest", "k", "n_shingles"), components.withColumnRenamed("node", "k")


def _labelled(docs: DataFrame, p: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_shingles, component (null without words) and component_id of every document row."""
    rows, linked = near_duplicate_classes(docs, p, id_col, text_col)
    classes = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("low"))
    named = classes.join(linked, "k", "left").select("k", "low", F.coalesce("component", "k").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    by_class = named.join(lowest, "component").select(F.col("k").alias("_k"), "component", "lowest")
    out = rows.join(by_class, F.col("k") == F.col("_k"), "left")
    return out.select("doc_id", "digest", "n_shingles", "component",
                      F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row."""
    return _labelled(docs, p, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_per_group(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per group of near-duplicates, all columns unchanged: the one with the smallest id (then text digest; of
    rows equal in both, any). Rows without words link with nothing and all stay."""
    labelled = _labelled(docs, p).where("component is not null and doc_id <=> component_id")
    keep = labelled.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("r")).select(
        F.col("r.doc_id").alias("_llm_i"), F.col("r.digest").alias("_llm_d"))
    wordless = ~text_or_empty("text").rlike(r"[^\x20\x09-\x0D]")
    digest = unused(docs, "_llm_digest")
    keyed = docs.where(~wordless).withColumn(digest, text_digest("text"))
    one = (keyed.join(keep, (keyed[digest] == keep["_llm_d"]) & keyed["doc_id"].eqNullSafe(keep["_llm_i"]), "left_semi")
           .dropDuplicates([digest, "doc_id"]).select(*docs.columns))
    return one.unionByName(docs.where(wordless))
