"""Removal of passages that occur more than once, by sharded suffix arrays.

A byte goes when a 200-byte string that covers it also starts anywhere else, in the same document or in another.

1. Keys. Every 200-byte window gets a key from its content alone (the smallest hash of its 48-byte strings), so equal
   windows share a key; neighbouring windows mostly do too, so a document is a few runs of windows. Runs whose key
   occurs nowhere else are done: none of their windows can repeat.
2. Shards. The remaining runs, as byte segments, are dealt out by key; a key with more than ``hot`` runs is split
   over several shards. A shard (a bounded block of segments) gets a suffix array of its window starts by
   Larsson-Sadakane refinement and their common prefixes by Kasai's rule; a window whose prefix with a neighbour
   reaches 200 bytes repeats inside the shard.
3. Merging. Only keys split over shards need more: each of their shards gives its distinct windows as a sorted run
   of 128-bit fingerprints, dealt out by ranges of the fingerprint, and the runs are merged by binary search; windows
   found in two shards repeat.
4. Documents. The repeated window starts of a document unite to the removed byte ranges.

Texts are handled once per distinct text (under their MD5); a text that occurs twice repeats wholly if it has 200
bytes. No document, key or passage is gathered beyond a bounded block. Defined cases: null text is empty;
repeated rows and ids are copies like any others; texts under 200 bytes stay whole; an empty table gives no rows;
extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm import suffix_array
from jobsieve.llm.common import binary_rows, bounded_slices, materialise, shuffle_width, small_arrow_batches, text_digest, text_or_empty, unused


@dataclass(frozen=True)
class RepeatParams:
    """``width``: bytes of a repeated string; ``gram``: bytes hashed for keys; ``hot``: runs of one key per shard;
    ``block``: segment bytes in one suffix array."""

    width: int = 200
    gram: int = 48
    hot: int = 4096
    block: int = 2 << 20


def _ref(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def window_keys(docs: DataFrame, p: RepeatParams, text_col: str = "text") -> DataFrame:
    """(m, ref, run): key, short name of the text, and its run packed as first window * 4096 + windows * 2 + inner.

    A text that repeats inside a task is read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in bounded_slices(batches, "text", 4 << 20):
            keys, refs, runs = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for t in binary_rows(batch.column("text")):
                if len(t) < p.width or (d := hashlib.md5(t).digest()) in seen:
                    continue
                seen.add(d)
                m, start, size, inner = suffix_array.window_runs(t, p.width, p.gram)
                keys.append(m), refs.append(np.full(len(m), _ref(d), dtype=np.int64)), runs.append(start * 4096 + size * 2 + inner)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(refs)), pa.array(np.concatenate(runs))], ["m", "ref", "run"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "m bigint, ref bigint, run bigint")


def _texts(docs: DataFrame, p: RepeatParams, text_col: str) -> DataFrame:
    """(ref, digest, text) of the texts that are long enough, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in bounded_slices(batches, "text"):
            keep, refs, digests = [], [], []
            for i, t in enumerate(binary_rows(batch.column("text"))):
                if len(t) >= p.width and (d := hashlib.md5(t).digest()) not in seen:
                    seen.add(d)
                    keep.append(i), refs.append(_ref(d)), digests.append(d)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(digests, pa.binary()), batch.column("text").take(pa.array(keep))], ["ref", "digest", "text"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "ref bigint, digest binary, text string")


def _once(rows: DataFrame) -> DataFrame:
    """Rows sorted by (ref, digest): the first of every digest; runs repeated by copies of a text are dropped too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in bounded_slices(batches, "text"):
            keep = []
            for i, d in enumerate(batch.column("digest").to_pylist()):
                if d != last:
                    keep.append(i)
                last = d
            if keep:
                yield batch.take(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _segments(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """(m, shards, digest, start, seg): the bytes of every candidate run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text", 2 << 20):
            out: list[list] = [[], [], [], [], []]
            for d, t, runs in zip(batch.column("digest").to_pylist(), binary_rows(batch.column("text")), batch.column("runs").to_pylist()):
                for m, packed, shards in {(r["m"], r["run"], r["shards"]) for r in runs}:
                    a, n = packed >> 12, (packed >> 1) & 2047
                    seg = t[a:a + n + p.width - 1]
                    if len(seg) == n + p.width - 1:  # else the run is of another text with the same short name
                        for col, v in zip(out, (m, shards, d, a, seg)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()))],
                                             ["m", "shards", "digest", "start", "seg"])

    return texts.select("digest", "text", "runs").mapInArrow(run, "m bigint, shards int, digest binary, start bigint, seg binary")


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _shards(segments: DataFrame, p: RepeatParams) -> DataFrame:
    """Segments sorted by (m, salt) -> suffix arrays of blocks of whole (m, salt) groups.

    Rows (digest, a, b): windows a..b-1 of the text repeat. Rows (m, part, run, owners): a sorted run of fingerprints
    of a split key's shard, for merging, with the text and window of those not yet known to repeat."""
    names = ["digest", "a", "b", "m", "part", "run", "owners"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        distinct: dict[bytes, list[int]] = {}
        for i, r in enumerate(rows):
            distinct.setdefault(r[5], []).append(i)
        segs = list(distinct)
        found, _, _ = suffix_array.repeated_windows(segs, p.width)
        out: list[list] = [[] for _ in names]
        split: dict[tuple, list] = {}
        for seg, again in zip(segs, found):
            holders = distinct[seg]
            if len(holders) > 1:
                again = np.ones(len(again), dtype=bool)
            for a, b in _ranges(again):
                for i in holders:
                    for col, v in zip(out, (rows[i][3], rows[i][4] + a, rows[i][4] + b, None, None, None, None)):
                        col.append(v)
            m, salt, shards, digest, start, _ = rows[holders[0]]
            if shards > 1:
                runs = split.setdefault((m, salt, shards), [])
                for j in range(len(again)):
                    mark = hashlib.blake2b(seg[j:j + p.width], digest_size=16).digest()
                    runs.append((mark, b"" if again[j] else digest + (start + j).to_bytes(8, "big")))
        for (m, _, shards), marks in split.items():
            parts: dict[int, list] = {}
            for mark, owner in sorted(set(marks)):
                mine = parts.setdefault(mark[0] * shards >> 8 if shards <= 256 else int.from_bytes(mark[:4], "big") * shards >> 32, [])
                if mine and mine[-1][0] == mark:
                    continue
                mine.append((mark, owner or bytes(24)))
            for part, mine in parts.items():
                for col, v in zip(out, (None, None, None, m, part, b"".join(x for x, _ in mine), b"".join(x for _, x in mine))):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in bounded_slices(batches, "seg"):
            for row in zip(*(batch.column(n).to_pylist() for n in ("m", "salt", "shards", "digest", "start", "seg"))):
                if row[:2] != group:
                    group = row[:2]
                    if size >= p.block:
                        yield block(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield block(held)

    return segments.mapInArrow(run, "digest binary, a bigint, b bigint, m bigint, part int, run binary, owners binary")


def _merge(runs: DataFrame) -> DataFrame:
    """Sorted runs of one (m, part), streamed in that order -> (digest, a, b) of windows found in two shards."""
    def close(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        marks = [np.frombuffer(r, dtype="S16") for r, _ in held]
        digest, a = [], []
        for hit, (_, owners) in zip(suffix_array.merge_runs(marks), held):
            for i in np.flatnonzero(hit).tolist():
                own = owners[24 * i:24 * i + 24]
                if own.strip(b"\0"):
                    digest.append(own[:16]), a.append(int.from_bytes(own[16:], "big"))
        at = np.array(a, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(at), pa.array(at + 1)], ["digest", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in bounded_slices(batches, "run"):
            for m, part, r, o in zip(*(batch.column(n).to_pylist() for n in ("m", "part", "run", "owners"))):
                if group != (m, part):
                    if held:
                        yield close(held)
                    group, held = (m, part), []
                held.append((r, o))
        if held:
            yield close(held)

    return runs.mapInArrow(run, "digest binary, a bigint, b bigint")


def repeated_ranges(docs: DataFrame, p: RepeatParams = RepeatParams(), text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digest, text) of the texts with candidate windows, and (digest, a, b): their repeated window starts a..b-1."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    keys = materialise(window_keys(docs, p, text_col), "window-keys")
    # one row per key, combined in every task: a key is a candidate if its runs differ (an inner repeat differs from itself)
    place = F.xxhash64("ref", "run")
    shared = (keys.groupBy("m").agg(F.min(F.when(F.col("run") % 2 == 1, F.lit(-(1 << 63))).otherwise(place)).alias("low"),
                                    F.max(place).alias("high"), F.count("*").alias("n"))
              .where("low <> high").select("m", F.ceil(F.col("n") / p.hot).cast("int").alias("shards")))
    candidates = keys.join(shared, "m").select("ref", F.struct("m", "run", "shards").alias("r"))
    by_text = candidates.groupBy("ref").agg(F.collect_set("r").alias("runs"))  # the runs of one text, copies merged in every task
    joined = _texts(docs, p, text_col).join(by_text, "ref").sortWithinPartitions("ref", "digest")
    texts = materialise(_once(joined), "candidate-texts")
    salted = _segments(texts, p).withColumn("salt", F.pmod(F.xxhash64("digest", "start"), F.col("shards")).cast("int"))
    shards = materialise(_shards(salted.select("m", "salt", "shards", "digest", "start", "seg").repartition(shuffle_width(spark), "m", "salt")
                                 .sortWithinPartitions("m", "salt"), p), "repeats")
    runs = (shards.where("run is not null").select("m", "part", "run", "owners")
            .repartition(shuffle_width(spark), "m", "part").sortWithinPartitions("m", "part"))
    ranges = shards.where("digest is not null").select("digest", "a", "b").unionByName(_merge(runs))
    return texts.select("digest", "text"), ranges


def _cut(text: bytes, ranges: list[tuple[int, int]], width: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the kept bytes, from repeated window starts [a, b)."""
    removed, spans, kept, at = 0, 0, [], 0
    for a, b in sorted(ranges):
        end = b + width - 1
        if a > at or not spans:
            kept.append(text[at:a])
            spans += 1
            removed += end - a
        elif end > at:
            removed += end - at
        at = max(at, end)
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def _document_results(texts: DataFrame, ranges: DataFrame, p: RepeatParams, with_text: bool) -> DataFrame:
    """digest -> n_removed, n_spans, kept_sha256 or kept text (whole characters) of the texts that lose bytes."""
    by_text = ranges.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # the ranges of one text
    last = "kept" if with_text else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text", 4 << 20):
            n, s, k = [], [], []
            for t, ranges in zip(binary_rows(batch.column("text")), batch.column("ranges").to_pylist()):
                removed, spans, kept = _cut(t, [(r["a"], r["b"]) for r in ranges], p.width)
                n.append(removed), s.append(spans)
                k.append(kept.decode("utf-8", "ignore") if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())],
                                             ["_digest", "n_removed", "n_spans", last])

    return texts.join(by_text, "digest").select("digest", "text", "ranges").mapInArrow(run, f"_digest binary, n_removed bigint, n_spans bigint, {last} string")


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document row."""
    texts, ranges = repeated_ranges(docs, p, text_col)
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"),
                       F.sha2(raw, 256).alias("sha"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    found = copies.join(_document_results(texts, ranges, p, False), F.col("digest") == F.col("_digest"), "left").drop("_digest")
    out = rows.join(found.withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d"), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= p.width)
    return out.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
                      F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
                      F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (broken characters at a cut go as well) and ``n_chars``, where
    there is such a column, brought up to date; all other columns and all rows stay."""
    texts, ranges = repeated_ranges(docs, p)
    digest, n_copies, kept = (unused(docs, c) for c in ("_llm_digest", "_llm_copies", "_llm_kept"))
    keyed = docs.withColumn(digest, text_digest("text"))
    copies = keyed.groupBy(digest).agg(F.count("*").alias(n_copies))
    found = copies.join(_document_results(texts, ranges, p, True).select(F.col("_digest").alias(digest), F.col("kept").alias(kept)), digest, "left")
    whole = (F.col(n_copies) > 1) & (F.octet_length(F.encode(text_or_empty("text"), "UTF-8")) >= p.width)
    text = F.when(whole, F.lit("")).otherwise(F.coalesce(kept, "text"))
    out = keyed.join(found, digest).withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = whole | F.col(kept).isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
