"""Feature view operators: materialisation (U5), point-in-time lookup (J9), online lookup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.session import cut_lineage


def materialize_latest(features: DataFrame, key: str, ts: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Latest feature row per entity with ``start <= ts <= end`` (``max_by``: map-side combine)."""
    f = features.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end)))
    rest = [c for c in f.columns if c != key]
    return f.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), *[F.col(c) for c in rest if c != ts])).alias("r")) \
        .select(key, "r.*")


def point_in_time(entities: DataFrame, features: DataFrame, key: str, ts: str, feature_cols: list[str],
                  ttl: dt.timedelta = dt.timedelta(days=365), entity_id: str = "row_id") -> DataFrame:
    """For every entity row (key, ts) the newest feature row with the same key and
    ``feature_ts <= ts``, ignored when older than ``ttl``.

    As-of join without a per-key sort: feature and entity rows are range-partitioned together by (key, time), so one key
    with all its events spreads over many tasks. Inside a partition a running ``last(..., ignorenulls)`` carries the
    latest feature forward (feature rows sort before entity rows at the same instant: inclusive); entity rows with no
    earlier feature in their partition take the key's last one of the partitions before, from a (partition, key) table.
    The partition ids depend on sampled bounds, so the rows are written once before the two passes read them."""
    fstruct = F.struct(F.col(ts).alias("feature_ts"), *[F.col(c) for c in feature_cols])
    fe = features.select(F.col(key), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias(entity_id), fstruct.alias("_f"))
    en = entities.select(F.col(key), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.col(entity_id),
                         F.lit(None).cast(fe.schema["_f"].dataType).alias("_f"))
    both = fe.unionByName(en)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = cut_lineage(both.repartitionByRange(parts, key, "_ts", "_side").withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", key).orderBy("_ts", "_side", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = u.withColumn("_in", F.last("_f", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    # latest feature per (partition, key), then the latest one of the partitions before
    ends = u.groupBy(key, "_pid").agg(F.max_by("_f", F.struct(F.col("_f.feature_ts"), F.col("_f"))).alias("_lf"))
    wb = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    prev = ends.select(F.col(key).alias("_k"), F.col("_pid").alias("_p"), F.last("_lf", ignorenulls=True).over(wb).alias("_pf"))
    j = within.join(prev, within[key].eqNullSafe(prev["_k"]) & (within["_pid"] == prev["_p"]), "left")
    last = F.coalesce(F.col("_in"), F.col("_pf"))
    fresh = last["feature_ts"] >= F.col("_ts") - F.lit(ttl)
    return j.select(entity_id, key, F.col("_ts").alias(ts),
                    *[F.when(fresh, last[c]).alias(c) for c in ["feature_ts"] + feature_cols])


def online_lookup(latest: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Latest features for the requested keys (left join: unknown keys get nulls)."""
    return keys.select(key).join(latest, key, "left")
