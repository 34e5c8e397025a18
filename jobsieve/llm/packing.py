"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Every document is its token ids plus an end id; only documents longer than a sequence are cut. Packing depends on
lengths alone, so the plan is made from the histogram of piece lengths (at most one row per length): open a bin
with the longest piece left, fill it greedily with the longest that fit, then replace its smallest piece by two
unpacked pieces whose sum fits the expanded gap more tightly. A bin pattern is used as often as the counts allow,
so every step uses up a length, and the plan's size depends on the sequence length and not on the data.

Pieces are then matched to the plan by rank: the rank of a piece among those of its length is its place in its own
task plus the count of earlier tasks (a prefix sum over task x length counts), so no length is ever gathered in one
place, although one length (whole sequences) may hold most rows.

Defined cases: null text is empty (one piece, the end id alone); repeated rows and equal ids are packed like any
others; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.common import binary_rows, bounded_slices, materialise

#: words whose ids a worker remembers; a memory bound only, forgotten words are tokenised again
CACHED_WORDS = 800_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str):
    """Pattern of the added tokens' texts, which the tokenizer maps to their ids wherever they stand in a text."""
    import re
    return re.compile("|".join(re.escape(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values()) or r"(?!)")


@lru_cache(maxsize=2)
def _merges(path: str):
    """The file's merges for tiktoken, whose merge loop is several times faster: encoder, ids by rank, word-end ranks.

    A word end is the space after it: the 256 byte-and-end symbols rank first, then the merges in order, then single
    bytes, so that pairs merge in the order of the file."""
    import json

    import tiktoken
    from tokenizers import pre_tokenizers
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on, in order
    kept = [b for b in range(256) if chr(b) in set(pre_tokenizers.ByteLevel.alphabet()) and b < 256]
    letter = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}

    def raw(symbol: str) -> bytes:
        word_end = symbol.endswith("</w>")
        return bytes(letter[c] for c in (symbol[:-4] if word_end else symbol)) + b" " * word_end

    ranks = {bytes([b, 32]): i for i, b in enumerate(b for b in range(256) if b != 32)}
    for m in model["merges"]:
        left, right = m if isinstance(m, list) else m.split(" ")
        ranks.setdefault(raw(left) + raw(right), len(ranks))
    for b in range(256):
        ranks.setdefault(bytes([b]), len(ranks))
    ids = {raw(k): v for k, v in model["vocab"].items() if all(c in letter for c in k.removesuffix("</w>"))}
    by_rank = np.array([ids.get(t, 0) for t in ranks], dtype="<u4")
    ends = np.array([t.endswith(b" ") for t in ranks])
    return tiktoken.Encoding("word", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), by_rank, ends


@lru_cache(maxsize=2)
def _splitter(path: str):
    """The file's own pre-token pattern, and words that normalise to their plain lower case."""
    import json

    import regex
    with open(path, encoding="utf-8") as f:
        steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
    return regex.compile(steps[0]["pattern"]["Regex"]), regex.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")


_CACHE: dict[str, dict[bytes, bytes]] = {}


def _encode_words(words: list[bytes], path: str) -> list[bytes]:
    """Ids of single words: ASCII and Latin letters through the merge table, anything else and words that hold
    an added token through the tokenizer."""
    (pattern, plain), added = _splitter(path), _added(path)
    enc, by_rank, ends = _merges(path)
    out: list[bytes] = [b""] * len(words)
    pieces, fast, count = [], [], []
    for i, w in enumerate(words):
        t = w.decode()
        if plain.fullmatch(t) and not added.search(t):
            t = t.lower()
            parts = [t] if t.isalpha() else pattern.findall(t)
            pieces += parts
            fast.append(i), count.append(len(parts))
        else:
            out[i] = np.asarray(_tokenizer(path).encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    if pieces:
        got = np.asarray(enc.encode_ordinary(" ".join(pieces) + " "))
        stops = (np.flatnonzero(ends[got]) + 1)[np.cumsum(count) - 1]
        raw = by_rank[got].tobytes()
        for i, a, b in zip(fast, [0, *stops[:-1].tolist()], stops.tolist()):
            out[i] = raw[4 * a:4 * b]
    return out


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of UTF-8 texts.

    The tokenizer drops white space and no pre-token spans it, so a text's ids are those of its words in order;
    each distinct word is tokenised once and remembered."""
    cache = _CACHE.setdefault(path, {})
    if len(cache) > CACHED_WORDS:
        cache.clear()
    split = [t.split() for t in texts]
    known = [list(map(cache.get, words)) for words in split]
    new = list({w for words, ids in zip(split, known) for w, i in zip(words, ids) if i is None})
    for a in range(0, len(new), 20_000):
        some = new[a:a + 20_000]
        cache.update(zip(some, _encode_words(some, path)))
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, copies), ...])]: bin patterns, longest pieces first, from the counts of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    places = np.arange(size + 1)
    out = []

    def fits() -> np.ndarray:
        """fits[g]: the longest length left of at most g (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, places, 0))

    longest = fits()
    while longest[size]:
        pattern: list[list[int]] = []
        gap = size
        while gap and longest[gap]:
            n = int(longest[gap])
            used = sum(k for m, k in pattern if m == n)
            k = min(int(left[n]) - used, gap // n)
            if k > 0:
                pattern.append([n, k])
                gap -= n * k
                if gap >= n:  # this length is used up: look below it
                    below = longest[n - 1]
                    while gap and below:
                        k = min(int(left[below]), gap // int(below))
                        pattern.append([int(below), k])
                        gap -= int(below) * k
                        below = longest[min(gap, int(below) - 1)]
                    break
        total = sum(k for _, k in pattern)
        if gap and total > 1:
            _swap_smallest(pattern, gap, left, longest, places)
        use = {}
        for n, k in pattern:
            use[n] = use.get(n, 0) + k
        times = min(int(left[n]) // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= times * k
        out.append((times, sorted(use.items(), reverse=True)))
        longest = fits()
    return out


def _swap_smallest(pattern: list[list[int]], gap: int, left: np.ndarray, longest: np.ndarray, places: np.ndarray) -> None:
    """Replace one copy of the pattern's smallest length by the two unpacked lengths that fill its place best."""
    small = pattern[-1][0]
    room = gap + small
    spare = left.copy()
    for n, k in pattern:
        spare[n] -= k
    spare[small] += 1
    best = np.maximum.accumulate(np.where(spare > 0, places, 0))
    first = np.flatnonzero(spare[:room] > 0)
    if not len(first):
        return
    second = best[room - first]
    # two copies of one length need two of them; else the next shorter one stands in
    twin = (second == first) & (spare[first] < 2)
    second = np.where(twin, best[np.maximum(first - 1, 0)], second)
    sums = np.where(second > 0, first + second, 0)
    i = int(np.argmax(sums))
    if sums[i] > small:
        pattern[-1][1] -= 1
        if not pattern[-1][1]:
            pattern.pop()
        pattern += [[int(first[i]), 1], [int(second[i]), 1]]


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), task, place: pieces with their place among the pieces of
    their length in their task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    end = np.asarray([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in bounded_slices(batches, "text", 4 << 20):
            owner, piece, start, length, crc, place, kept = [], [], [], [], [], [], []
            for i, ids in enumerate(token_ids(binary_rows(batch.column("text")), tokenizer)):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                for j, a in enumerate(range(0, n, size)):
                    part = raw[4 * a:4 * (a + size)]
                    m = len(part) // 4
                    owner.append(i), piece.append(j), start.append(a), length.append(m), crc.append(zlib.crc32(part)), place.append(int(seen[m]))
                    seen[m] += 1
                    if with_ids:
                        kept.append(bytes(part))
            cols = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(owner), pa.int32()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_ids, names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = materialise(token_pieces(docs, tokenizer, size, end_id, with_ids, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = materialise(by_task.select("length", "task", "n", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    keys, at, times, offsets, base = _slots(best_two_fit(counts, size))
    ranked = pieces.join(by_task.drop("n"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "task")
    out = [c for c in pieces.columns if c not in ("task", "place")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            s = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            x = rank - at[s]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(base[s] + x % times[s], pa.int64()),
                                              pa.array(offsets[s] + x // times[s] * length, pa.int64())], [*out, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c in out)
    return ranked.select(*out, "rank").mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """The plan by (length, first rank): key, first rank, times, offset in the sequence, first sequence."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in plan:
        offset = 0
        for n, copies in pattern:
            first = taken.get(n, 0)
            rows.append(((n << 48) | first, first, times, offset, sequence))
            taken[n] = first + times * copies
            offset += n * copies
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(cols[:, i]) for i in range(5))
