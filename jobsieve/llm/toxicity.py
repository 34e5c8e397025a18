"""Toxicity by compression distance: how much shorter a window gets once a toxic dictionary is at hand.

Two zstandard dictionaries are trained separately: one on windows of ordinary labelled texts, one on the words of
toxic texts that occur there in many more different surroundings than in ordinary ones (a likelihood-ratio test
on distinct neighbour pairs, so that copied passages count once). Every text is cut into windows of consecutive
words and each window is compressed with the ordinary dictionary and with the toxic one placed before it; the
difference in bytes is the window's gain (close to 0 unless the window holds toxic words). Counts of windows per
gain are the document's features, and a logistic fit on the labelled texts calibrates them to a probability.

Labels are the only supervision and are read from training rows alone (crc32 of the id as text, modulo 3, not 1);
the fit uses a sample bounded by ``ToxicityParams`` in rows and bytes, taken by hash order; every text is scored
whole. Defined cases: null and empty texts score like a text without windows; a null id is never held out; ids
with contradicting labels are left out of the fit; without texts of both classes every score is 0; an empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.llm.common import bounded_slices, unused


@dataclass(frozen=True)
class ToxicityParams:
    """``toxic_rows``, ``ordinary_rows``, ``row_bytes``: bound of the labelled sample (rows, and bytes per row: of a longer
    text the fit sees the pieces of 64 words that come first by their hash, up to that size); ``ordinary_windows``: bound of
    the 4-word windows, drawn at random from the sample's ordinary texts, that the ordinary dictionary is trained on;
    ``window``: words per window; ``gain_levels``: gains (bytes) that are counted; ``threshold``: predicted 1 from
    this score on; ``evidence``: least likelihood ratio of a toxic word; ``prefixes``: word beginnings tested as well."""

    toxic_rows: int = 1500
    ordinary_rows: int = 3000
    row_bytes: int = 16_000
    ordinary_windows: int = 100_000
    window: int = 16
    level: int = 9
    ordinary_dict: int = 8192
    toxic_dict: int = 4096
    segment: int = 32
    min_contexts: int = 5
    evidence: float = 30.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    gain_levels: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    threshold: float = 0.7


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shifted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case UTF-8 bytes, every byte moved by its place in its word, and the starts of the words.

    The shift makes a string match a dictionary only at the same place in a word, so that a toxic beginning is
    not mistaken for the same syllables inside other words; white space becomes a plain space."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    gap = _SPACE[raw]
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(gap, at, -1)) - 1
    out = np.where(gap, 32, raw + (place * 37).astype(np.uint8)).astype(np.uint8)
    return out, np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))


def windows(text: str, size: int) -> list[bytes]:
    """Shifted windows of ``size`` consecutive words, each between spaces."""
    out, starts = shifted(text)
    if not len(starts):
        return []
    data, cuts = out.tobytes(), starts[::size].tolist()
    return [b" " + data[a:b].rstrip(b" ") + b" " for a, b in zip(cuts, [*cuts[1:], len(data)])]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    plain = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=plain, write_checksum=False, write_dict_id=False)


def _lengths(c: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    out = c.multi_compress_to_buffer(parts)
    return np.fromiter((len(out[i]) for i in range(len(out))), dtype=np.int64, count=len(out))


class GainScorer:
    """Window gains of texts from a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, p: ToxicityParams):
        self.p, self.plain, self.with_toxic = p, _compressor(ordinary, p.level), _compressor(toxic + ordinary, p.level)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: windows that gain at least each level, windows, largest gain."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            w = windows(t, self.p.window)
            parts += w
            owner.append(np.full(len(w), i))
        out = np.zeros((len(texts), len(self.p.gain_levels) + 2))
        if not parts:
            return out
        gain, own = _lengths(self.plain, parts) - _lengths(self.with_toxic, parts), np.concatenate(owner)
        for j, g in enumerate(self.p.gain_levels):
            out[:, j] = np.bincount(own[gain >= g], minlength=len(texts))
        out[:, -2] = np.bincount(own, minlength=len(texts))
        np.maximum.at(out[:, -1], own, gain)
        return out


def design(f: np.ndarray) -> np.ndarray:
    """Columns of the logistic fit: hits, hits per 100 windows, largest gain."""
    hits, n = f[:, :-2], f[:, -2:-1]
    return np.concatenate([np.ones((len(f), 1)), np.log1p(hits), np.log1p(100 * hits / np.maximum(n, 1)), f[:, -1:] / 5], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - q) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], p: ToxicityParams) -> set[bytes]:
    """Words of toxic texts that, themselves or by a prefix of ``prefixes`` bytes, have far more distinct
    neighbour pairs per running pair in toxic than in ordinary texts."""
    def units(w: bytes) -> list[bytes]:
        return [w + b" ", *(w[:n] for n in p.prefixes if len(w) > n)]

    def contexts(texts: list[list[bytes]]) -> tuple[dict[bytes, int], int]:
        seen: dict[bytes, set[int]] = {}
        for t in texts:
            for a, w, b in zip([b"", *t[:-1]], t, [*t[1:], b""]):
                pair = hash((a, w, b))
                for u in units(w):
                    seen.setdefault(u, set()).add(pair)
        return {u: len(v) for u, v in seen.items()}, max(sum(len(v) for u, v in seen.items() if u.endswith(b" ")), 1)

    (ct, nt), (co, no) = contexts(toxic), contexts(ordinary)
    found = set()
    for u, k in ct.items():
        m = co.get(u, 0)
        if k < p.min_contexts or k / nt < 4 * (m + 0.5) / no:
            continue
        expect = (k + m) * nt / (nt + no)
        ratio = 2 * (k * np.log(k / expect) + (m * np.log(m / (k + m - expect)) if m else 0.0))
        if ratio >= p.evidence:
            found.add(u)
    return {w for t in toxic for w in t if not found.isdisjoint(units(w))}


def _train_dictionary(size: int, samples: list[bytes], p: ToxicityParams) -> bytes:
    """A trained dictionary; too few samples to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=p.level, d=6, k=p.segment).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8)


def train(texts: list[str], toxic: list[int], p: ToxicityParams) -> tuple[bytes, bytes, list[float]]:
    """Ordinary dictionary, toxic dictionary and logistic weights from labelled texts."""
    rng = np.random.default_rng(7)
    split = [t.lower().encode().split() for t in texts]
    bad, good = [s for s, y in zip(split, toxic) if y], [s for s, y in zip(split, toxic) if not y]
    listed = toxic_words(bad, good, p)
    hits = [windows(w.decode(), 1)[0] for t in bad for w in t if w in listed]
    hits = [hits[i] for i in rng.permutation(len(hits))]
    six = [b"".join(hits[i:i + 6]) for i in range(0, len(hits), 6)]
    plain = [w for t, y in zip(texts, toxic) if not y for w in windows(t, 4)]
    plain = [plain[i] for i in rng.permutation(len(plain))[:p.ordinary_windows]]
    ordinary, nasty = _train_dictionary(p.ordinary_dict, plain, p), _train_dictionary(p.toxic_dict, six, p)
    weights = logistic(design(GainScorer(ordinary, nasty, p).features(texts)), np.asarray(toxic, dtype=float))
    return ordinary, nasty, weights.tolist()


def bounded_text(text: str, limit: int) -> str:
    """``text``, or of a longer one the pieces of 64 words that come first by their hash, in text order, up to ``limit``
    bytes (pieces above the limit are left out)."""
    if len(text.encode()) <= limit:
        return text
    words = text.split()
    pieces = [" ".join(words[i:i + 64]) for i in range(0, len(words), 64)]
    chosen, size = [], 0
    for _, i in sorted((zlib.crc32(piece.encode()), i) for i, piece in enumerate(pieces)):
        n = len(pieces[i].encode()) + 1
        if size + n <= limit:
            chosen.append(i)
            size += n
    return " ".join(pieces[i] for i in sorted(chosen))


def training_sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """Bounded labelled sample (text, toxic) of the training rows: ids by hash order, then their texts."""
    known = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most and toxic in (0, 1)").drop("_most"))
    usable = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).withColumn("_order", F.md5(F.col("doc_id").cast("string")))
    parts = [usable.where(F.col("toxic") == y).orderBy("_order").limit(n) for y, n in ((1, p.toxic_rows), (0, p.ordinary_rows))]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "toxic")  # at most toxic_rows + ordinary_rows rows

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text"):
            texts = pa.array([bounded_text(t, p.row_bytes) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("toxic")], ["doc_id", "text", "toxic"])

    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return (sample.mapInArrow(bound, sample.schema)
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy("doc_id").select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> tuple[bytes, bytes, list[float]] | None:
    """Train in one task on the bounded sample; the model (two dictionaries and a few weights) comes back. None
    where a class has no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        if len({y for _, y in rows}) == 2:
            ordinary, nasty, weights = train([t for t, _ in rows], [y for _, y in rows], p)
            yield pa.RecordBatch.from_arrays([pa.array([ordinary]), pa.array([nasty]), pa.array([weights])], ["ordinary", "toxic", "weights"])

    model = training_sample(docs, labels, p).coalesce(1).mapInArrow(run, "ordinary binary, toxic binary, weights array<double>").collect()
    return (bytes(model[0][0]), bytes(model[0][1]), list(model[0][2])) if model else None


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]] | None, p: ToxicityParams = ToxicityParams(),
          text: str = "text", keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """``keep`` columns (all by default) plus ``name``: the probability that the text is toxic."""
    keep = docs.columns if keep is None else keep
    input_ = unused(docs, "_text")
    rows = docs.select(*keep, F.col(text).alias(input_))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = GainScorer(model[0], model[1], p) if model else None
        weights = np.asarray(model[2]) if model else None
        for batch in bounded_slices(batches, input_, 2 << 20):
            if scorer is None:
                out = np.zeros(batch.num_rows)
            else:
                f = scorer.features([t or "" for t in batch.column(input_).to_pylist()])
                out = 1 / (1 + np.exp(-np.clip(design(f) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out)], [*keep, name])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row."""
    model = fit(docs, labels, p)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, model, p, keep=["doc_id"]).select(
        "doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= p.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, all their columns unchanged."""
    name = unused(docs, "_score")
    return score(docs, fit(docs, labels, p), p, name=name).where(F.col(name) < p.threshold).drop(name)
