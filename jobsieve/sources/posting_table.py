"""The posting table: base and changed rows in immutable Parquet files, bucketed by id, behind a manifest.

A commit writes the changed rows alone, in one folder, and becomes visible with one small manifest file that names every live
folder and bucket, so what is written follows the batch and readers see one version. Reading merges: a base row gives way to
the newest changed row of its id (the few changed ids are joined away, the base is not shuffled). ``compact`` folds the changed
rows of the buckets that hold many of them into new base files; ``vacuum`` removes what no kept version names. The
manifest also keeps the ledger ``applied`` (writer -> its last transaction): committing a transaction again is a no-op, so a
stream's replayed batch changes nothing. One writer at a time; a second one fails at its commit and can retry."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


@dataclass
class Segment:
    folder: str
    kind: str  # base | delta
    rows: dict[str, int]  # live bucket -> rows


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 16
    schema: str = ""
    segments: list[Segment] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    active: int = 0
    commit: dict = field(default_factory=dict)  # writer, transaction, time and counts of the commit that made this version


class PostingTable:
    """Rows with a unique, non-null ``id`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self.versions()
        if not versions:
            return Manifest(buckets=self.buckets)
        stream = self._fs.open(self._path(f"{self.root}/_log/{versions[-1] if version is None else version:012d}.json"))
        try:
            raw = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**{**raw, "segments": [Segment(**s) for s in raw["segments"]]})

    def _publish(self, m: Manifest) -> None:
        """Written aside and renamed whole; the rename is the commit."""
        target, aside = self._path(f"{self.root}/_log/{m.version:012d}.json"), self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {m.version} of {self.root} was published by another writer")

    def has_applied(self, writer: str, transaction: int) -> bool:
        return self.manifest().applied.get(writer, -1) >= transaction

    def history(self) -> DataFrame:
        """One row per kept version: writer, transaction, time, rows and active rows after it, and the commit's counts."""
        rows = []
        for v in self.versions():
            m = self.manifest(v)
            c = m.commit
            rows.append((v, c.get("writer"), c.get("transaction"), c.get("at"), m.rows, m.active, c.get("changed", 0), c.get("inserted", 0), c.get("expired", 0)))
        return self.spark.createDataFrame(rows, "version long, writer string, transaction long, at string, rows long, active long, changed long, inserted long, expired long")

    # ---- reading

    def _read(self, segments: list[Segment], kind: str, schema: T.StructType, buckets: set[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{s.folder}/_bucket={b}" for s in segments if s.kind == kind for b in s.rows if buckets is None or b in buckets]
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_seq", T.LongType())]))
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_seq", T.LongType())]))

    def _merged(self, m: Manifest, buckets: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        base = self._read(m.segments, "base", schema, buckets).drop("_seq")
        changed = [s for s in m.segments if s.kind == "delta" and (buckets is None or buckets & s.rows.keys())]
        if not changed:
            return base
        delta = self._read(m.segments, "delta", schema, buckets)
        # one commit holds an id once: only rows of several commits have to meet
        newest = delta.drop("_seq") if len(changed) == 1 else delta.groupBy("id").agg(F.max_by(F.struct(*schema.names), "_seq").alias("r")).select("r.*")
        return base.join(delta.select("id").distinct(), "id", "left_anti").select(*schema.names).unionByName(newest)

    def current(self, version: int | None = None) -> DataFrame | None:
        """The rows of the newest (or a kept) version; None when the table has none."""
        m = self.manifest(version)
        return self._merged(m) if m.version else None

    # ---- writing

    def _write(self, rows: DataFrame, kind: str, version: int, n_buckets: int) -> tuple[Segment, dict[str, int]]:
        """The folder of a version's files, and the counts of what stands in them. Counts are read back from two columns of
        the written files, so a stage that ran twice cannot count twice."""
        folder = f"data/{version:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{folder}"
        out = rows.withColumns({"_seq": F.lit(version).cast("long"), "_bucket": F.pmod(F.xxhash64("id"), F.lit(n_buckets)).cast("int")})
        out.repartition(n_buckets, "_bucket").write.partitionBy("_bucket").parquet(path)
        counts = dict.fromkeys(("changed", "inserted", "now_active", "were_active", "expired"), 0)
        if not any(s.getPath().getName().startswith("_bucket=") for s in self._fs.listStatus(self._path(path))):
            return Segment(folder, kind, {}), counts
        active = ~F.coalesce(F.col("is_expired"), F.lit(False))
        per = self.spark.read.schema(T.StructType([*out.schema.fields])).parquet(path).groupBy("_bucket").agg(
            F.count(F.lit(1)).alias("changed"), F.count_if(F.col("_was_active").isNull()).alias("inserted"), F.count_if(active).alias("now_active"),
            F.count_if(F.coalesce("_was_active", F.lit(False))).alias("were_active"), F.count_if(F.coalesce("_swept", F.lit(False))).alias("expired")).collect()  # one row per bucket
        for r in per:
            for c in counts:
                counts[c] += r[c]
        return Segment(folder, kind, {str(r["_bucket"]): r["changed"] for r in per}), counts

    def commit(self, changes: DataFrame, writer: str, transaction: int = 0) -> Manifest:
        """Publish changed rows: the table's columns, ``_was_active`` (null: a new row) and ``_swept`` (expired by the sweep).

        The rows are written once; a transaction that the ledger already holds changes nothing."""
        m = self.manifest()
        if m.applied.get(writer, -1) >= transaction:
            return m
        version = m.version + 1
        columns = [f for f in changes.schema.fields if f.name not in ("_was_active", "_swept")]
        if m.version:
            columns = T.StructType.fromJson(json.loads(m.schema)).fields
            changes = changes.select(*[F.col(f.name).cast(f.dataType) for f in columns], "_was_active", "_swept")
        segment, n = self._write(changes, "delta" if m.version else "base", version, m.buckets)
        at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
        new = Manifest(version, m.buckets, T.StructType(columns).json(), [*m.segments, segment] if segment.rows else m.segments, {**m.applied, writer: transaction},
                       m.rows + n["inserted"], m.active + n["now_active"] - n["were_active"],
                       {"writer": writer, "transaction": transaction, "at": at, "changed": n["changed"], "inserted": n["inserted"], "expired": n["expired"]})
        self._publish(new)
        return new

    def compact(self, max_deltas: int = 8, share: float = 0.25) -> int:
        """Fold the changed rows of every bucket with ``max_deltas`` folders of them, or a ``share`` of the bucket's base
        rows, into new base files. Other buckets are not read. Returns the number of buckets rewritten."""
        m = self.manifest()
        due = set()
        for b in {b for s in m.segments for b in s.rows}:
            deltas = [s.rows[b] for s in m.segments if s.kind == "delta" and b in s.rows]
            base = sum(s.rows[b] for s in m.segments if s.kind == "base" and b in s.rows)
            if deltas and (len(deltas) >= max_deltas or sum(deltas) >= share * base):
                due.add(b)
        if not due:
            return 0
        rows = self._merged(m, due).withColumns({"_was_active": F.lit(None).cast("boolean"), "_swept": F.lit(None).cast("boolean")})
        segment, _ = self._write(rows, "base", m.version + 1, m.buckets)
        kept = [Segment(s.folder, s.kind, {b: n for b, n in s.rows.items() if b not in due}) for s in m.segments]
        at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
        self._publish(Manifest(m.version + 1, m.buckets, m.schema, [s for s in [*kept, segment] if s.rows], m.applied, m.rows, m.active,
                               {"writer": "compact", "transaction": m.version + 1, "at": at}))
        return len(due)

    def vacuum(self, keep: int = 2) -> int:
        """Delete older manifests and the folders that none of the ``keep`` newest versions names (leftovers of failed
        commits too). Not to be run beside a writer. Returns the number of folders deleted."""
        versions = self.versions()
        live = {s.folder for v in versions[-keep:] for s in self.manifest(v).segments}
        gone = 0
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in live:
                self._fs.delete(s.getPath(), True)
                gone += 1
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{v:012d}.json"), False)
        return gone
