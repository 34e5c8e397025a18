"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to ``chunk`` characters are encoded where they are read. A longer text is cut into chunks that overlap
the next one; every chunk is a row of its own and is pre-tokenised in parallel from its first character, which
may lie inside a pre-token. Pre-token boundaries depend only on what follows them, so once a boundary of the
trusted chunk before and one of the next chunk coincide inside the overlap, all later boundaries of the next
chunk are right: there the chunks are stitched. Where an overlap holds no common boundary (one pre-token longer
than it), nothing after it is trusted and the rest of that text is one piece. The pieces between stitches are
encoded in parallel and their ids are joined in order; decoding concatenates the raw bytes of ids.

Results depend on the text alone, so long texts travel once per distinct text, under their digest; copies and
repeated ids share the result. Defined cases: null text is empty (no ids); an empty table gives no rows; special
token strings are ordinary text; extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import bounded_slices, materialise, small_arrow_batches, text_digest, text_or_empty

#: boundaries this close (in characters) to a chunk's end may be cut short by it
EDGE = 2
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, begin: int, end: int | None = None) -> list[int]:
    """Starts of the pre-tokens of ``text[begin:end]``, as places in ``text``."""
    end = len(text) if end is None else end
    return [begin + m.start() for m in _splitter(pattern).finditer(text[begin:end])]


def edge_boundaries(piece: str, pattern: str, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries in the first ``2 * overlap`` and in the last ``2 * overlap`` characters of a chunk (places in it).

    The head runs from the chunk's first character; the tail from the chunk's own resynchronised boundary, so both
    lists are what pre-tokenising the chunk from its start gives."""
    starts = boundaries(piece, pattern, 0)
    if not last:
        # the end cuts the last pre-tokens: keep those whose end is a boundary well before it
        starts = [s for s, e in zip(starts, starts[1:]) if e <= len(piece) - EDGE]
    # never cut beside a control character: engines differ on which of them are white space
    near = [s for s in starts if s <= 2 * overlap or s >= len(piece) - 2 * overlap]
    near = [s for s in near if s and not _CONTROL.search(piece[s - 1:s + 1])]
    head = [] if first else [s for s in near if s <= 2 * overlap]
    tail = [] if last else [s for s in near if s >= len(piece) - 2 * overlap]
    return head, tail


def stitch(cuts: list[tuple[int, list[int], list[int]]], overlap: int) -> list[int]:
    """Safe cut places of a text from its chunks in order: (chunk start, head, tail) with places in the text.

    A cut is a boundary of the trusted run that the next chunk has too. Without one no later chunk is trusted and
    the rest of the text is one piece."""
    out: list[int] = []
    trusted = set(cuts[0][2]) if cuts else set()
    for _, head, tail in cuts[1:]:
        common = [b for b in head if b in trusted]
        if common:
            out.append(common[0])
            trusted = set(tail)
        else:
            break
    return out


def digest_ids(ids: list[int]) -> tuple[int, str]:
    return len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 32_768, overlap: int = 512,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document row."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    long_text = F.char_length("text") > chunk
    # one pass over the table: short texts are encoded here, long ones pass as their digest only
    here = rows.select("doc_id", F.when(~long_text, F.col("text")).alias("text"), F.when(long_text, text_digest("text")).alias("key"))

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in bounded_slices(batches, "text"):
            out = []
            for t in batch.column("text").to_pylist():
                if t is None:
                    out.append((None, None, None))
                else:
                    ids = enc.encode_ordinary(t)
                    out.append((*digest_ids(ids), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            n, a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["doc_id", "key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(rows.dtypes)["doc_id"]
    short = here.mapInArrow(encode_short, f"doc_id {kind}, key binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    long_rows = encode_long(rows.where(long_text).select("text"), ranks_path, pattern, chunk, overlap)
    joined = short.join(long_rows.select(F.col("key").alias("_k"), *[F.col(c).alias("_" + c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")]),
                        F.col("key") == F.col("_k"), "left")
    return joined.select("doc_id", *[F.coalesce(c, "_" + c).alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


def encode_long(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key (text digest), n_tokens, ids_sha256, decoded_sha256 of the distinct texts, encoded by overlapping chunks."""
    keyed = texts.select(text_digest("text").alias("key"), F.col("text"))
    n_chunks = F.ceil(F.char_length("text") / F.lit(chunk)).cast("int")
    chunks = (keyed.select("key", "text", F.char_length("text").alias("size"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("c"))
              .select("key", "c", "size", F.substring(F.col("text"), F.col("c") * chunk + 1, F.lit(chunk + overlap)).alias("piece")))
    chunks = materialise(chunks.dropDuplicates(["key", "c"]), "bpe-chunks")  # copies of one text meet per chunk, not per text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "piece"):
            c, size = batch.column("c").to_pylist(), batch.column("size").to_pylist()
            ends = [edge_boundaries(p, pattern, overlap, i == 0, (i + 1) * chunk >= n) for p, i, n in zip(batch.column("piece").to_pylist(), c, size)]
            place = [([i * chunk + b for b in h], [i * chunk + b for b in t]) for i, (h, t) in zip(c, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("c"), pa.array([h for h, _ in place], pa.list_(pa.int32())),
                                              pa.array([t for _, t in place], pa.list_(pa.int32()))], ["key", "c", "head", "tail"])

    edges = chunks.mapInArrow(scan, "key binary, c int, head array<int>, tail array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column("edges").to_pylist():
                out.append(stitch([(e["c"] * chunk, e["head"] or [], e["tail"] or []) for e in lists], overlap))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "cuts"])

    # per text: only the few boundaries around its chunk edges
    cuts = (edges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "head", "tail"))).alias("edges"))
            .mapInArrow(cut, "key binary, cuts array<int>"))
    # piece j is [cuts[j-1], cuts[j]); chunk c gives the part of each piece that starts in it or runs through it
    parts = (chunks.join(cuts, "key")
             .select("key", "c", "size", "cuts", F.substring(F.col("piece"), F.lit(1), F.lit(chunk)).alias("body"), "piece")
             .mapInArrow(_pieces(chunk), "key binary, piece int, c int, part string"))
    whole = (parts.groupBy("key", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "part"))), lambda x: x["part"]), "").alias("text")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in bounded_slices(batches, "text"):
            ids = [np.asarray(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), pa.array(ids, pa.binary())], ["key", "piece", "ids"])

    encoded = whole.mapInArrow(encode, "key binary, piece int, ids binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                raw = b"".join(parts)
                decoded = hashlib.sha256()
                for p in parts:
                    decoded.update(enc.decode_bytes(np.frombuffer(p, dtype="<u4").tolist()))
                out.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    ordered = encoded.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("parts"))
    return ordered.mapInArrow(finish, "key binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _pieces(chunk: int):
    """Cut chunk bodies (without overlap) at the safe places: one row per (piece, chunk) part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "body"):
            keys, pieces, cs, parts = [], [], [], []
            for key, c, cuts, body in zip(*(batch.column(n).to_pylist() for n in ("key", "c", "cuts", "body"))):
                begin, end = c * chunk, c * chunk + len(body)
                inner = [x for x in cuts if begin < x < end]
                first = sum(1 for x in cuts if x <= begin)
                marks = [begin, *inner, end]
                for j, (a, b) in enumerate(zip(marks, marks[1:])):
                    keys.append(key), pieces.append(first + j), cs.append(c), parts.append(body[a - begin:b - begin])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pieces, pa.int32()), pa.array(cs, pa.int32()), pa.array(parts, pa.string())],
                                             ["key", "piece", "c", "part"])
    return run
