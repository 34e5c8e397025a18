"""Helpers shared by the corpus operators.

Words are maximal runs of characters other than space and the ASCII controls 0x09-0x0D (`WORD`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.session import scratch_path

# The white space that ends a word, as a Java/DuckDB pattern and as characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_digest(column: str | Column = "text") -> Column:
    """MD5 of the UTF-8 bytes as 16-byte binary: the key of a distinct text."""
    return F.unhex(F.md5(F.encode(text_or_empty(column), "UTF-8")))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh Parquet folder under the shared checkpoint folder and read it back, so that later stages
    neither recompute it nor depend on any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound the bytes of an Arrow batch sent to a Python worker (Spark's default is 64 MB per task): texts differ in
    length by five orders, so a bound in rows alone does not hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bounded_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most ``max_bytes`` of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        cut = np.cumsum(sizes) // max_bytes
        edges = np.concatenate(([0], np.flatnonzero(cut[1:] != cut[:-1]) + 1, [n]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def binary_rows(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column as bytes; null is empty."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [v or b"" for v in column.to_pylist()]


def _is_star_forest(links: DataFrame) -> bool:
    """Every node is either a centre or has exactly one link, to its centre."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the undirected ``edges``.

    Alternating large-star and small-star contraction: every round is two grouped minima and joins over the
    remaining links, whose number never grows; a star's centre is a key of a minimum (pre-aggregated before
    the shuffle), never a collected neighbour list. Links are written to the shared folder after every round."""
    links = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while not _is_star_forest(links):
        # large star: every larger neighbour of u links to the smallest of u's neighbourhood
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours link to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = materialise(small, "links")
    return (links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
