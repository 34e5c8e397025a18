"""Extendible hashing of documents into shards under a byte limit (SQL functions only).

A document's key is a 60-bit hash of its id and text. The directory starts with one bucket; a bucket over the
limit splits on its next hash bit, all others stay, so a shard is the shortest hash prefix whose documents fit.
Bucket sizes come from one pre-aggregated histogram of fixed depth (a few bits beyond the expected one) rolled
up to all shorter prefixes; only prefixes that are still too large are refined from the documents in them, by
further bits. Identical copies (same id and text) run out of hash bits together; they go on with the bits of a
row number, so a hot key splits like any other bucket.

Defined cases: a null id or text hashes as its own value and null text has 0 bytes; one document above the
limit is a shard of its own; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import materialise, text_or_empty

HASH_BITS = 60
#: levels refined per pass over what is still too large, and beyond the expected depth in the first pass
STRIDE, MARGIN = 12, 4


def hash_bits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The first 60 bits of MD5(id, text) as a string of 0 and 1."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text_or_empty(text_col))
    return F.lpad(F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 15), 16, 2), HASH_BITS, "0")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (hash prefix), depth, shard_bytes, shard_docs for every document row."""
    # bits of the row number, most volatile first: copies spread evenly and only where their hash is used up
    row = F.reverse(F.conv(F.monotonically_increasing_id().cast("string"), 10, 2))
    keyed = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(F.encode(text_or_empty(text_col), "UTF-8")).cast("long").alias("n_bytes"),
        F.concat(hash_bits(id_col, text_col), F.rpad(row, HASH_BITS, "0")).alias("bits")), "shard-keys")
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(max(math.ceil(math.log2(max(total, 1) / limit)), 0) + MARGIN, 2 * HASH_BITS)
    start, open_rows, found = 0, keyed, None
    while True:
        leaves = _leaves(open_rows, limit, start, depth)
        found = leaves if found is None else found.unionByName(leaves)
        if depth >= 2 * HASH_BITS:
            break
        rest = _oversize(open_rows, limit, depth)
        if rest.isEmpty():
            break
        open_rows = materialise(open_rows.withColumn("_p", F.substring("bits", 1, depth)).join(rest, "_p", "left_semi").drop("_p"), "shard-open")
        start, depth = depth + 1, min(depth + STRIDE, 2 * HASH_BITS)
    directory = materialise(found, "shard-directory")
    return _lookup(keyed, directory)


def _histogram(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.substring("bits", 1, depth).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))


def _oversize(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    return _histogram(rows, depth).where(f"bytes > {limit} and docs > 1").select(F.col("p").alias("_p"))


def _leaves(rows: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """Buckets of depth start..depth that fit while their parent (if any in the range) does not."""
    levels = (_histogram(rows, depth)
              .select(F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"), "p", "bytes", "docs")
              .groupBy("d", F.substring(F.col("p"), F.lit(1), F.col("d")).alias("shard"))
              .agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("d") == 2 * HASH_BITS)
    parents = levels.where(~fits).select((F.col("d") + 1).alias("d"), F.col("shard").alias("_parent"))
    kept = levels.where(fits)
    if start == 0:
        roots = kept.where("d = 0").select("shard", F.col("d").alias("depth"), "shard_bytes", "shard_docs")
    else:  # every open row lies below an oversize bucket of the level before
        roots = kept.where(F.col("d") == start).select("shard", F.col("d").alias("depth"), "shard_bytes", "shard_docs")
    below = (kept.where(F.col("d") > start).withColumn("_parent", F.expr("substring(shard, 1, d - 1)"))
             .join(parents, ["d", "_parent"], "left_semi").select("shard", F.col("d").alias("depth"), "shard_bytes", "shard_docs"))
    return roots.unionByName(below)


def _lookup(keyed: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory look-up: one equi-join per depth in use would scan the rows often; instead every row tries the
    depths in use and meets exactly one shard, by one join on the prefix."""
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 2 * HASH_BITS values
    if not depths:
        return keyed.select("doc_id", "n_bytes").withColumns({
            "shard": F.lit(""), "depth": F.lit(0), "shard_bytes": F.lit(0).cast("long"), "shard_docs": F.lit(0).cast("long")}).where("false")
    tries = keyed.select("doc_id", "n_bytes", "bits", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return (tries.withColumn("shard", F.expr("substring(bits, 1, depth)"))
            .join(directory, ["depth", "shard"]).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"))
