"""Role classifier and demand forecast.

Feature frame (M1) -> TF-IDF over 1-3-grams (M2) + one-hot categoricals (M3) + median-imputed, standardised numerics (M4)
-> class-balanced multinomial logistic regression (M5). Evaluation (M7-M9) is plain aggregation over (label, prediction)
pairs, so it also runs on any table of predictions.

The model is a table, not a driver object: one row per term or category (its 64-bit hash, idf, and a weight per class). A
term index of any size is built by grouped counts, and rows meet it by an equi-join. The fit sees every labelled row. With an
L2 penalty the best weights are a combination of the rows, so the solver needs nothing of the terms but products of the rows'
inner-product matrix with a vector, and that matrix is never built: the terms' columns are stored packed, in ranges of the
hash, a round is one pass of tasks over them, and the weights of all terms follow by a last pass. The driver holds some 600
bytes per labelled row and class."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.salary import midpoint_any
from jobsieve.functions.text import split_list
from jobsieve.operators.salary import floor_quantiles
from jobsieve.session import cut_lineage, scratch_path

CATEGORICAL = ["source", "remote_status", "location"]
NUMERIC = ["salary_avg", "skill_count", "salary_was_missing"]
GROWTH_PER_QUARTER = 0.08  # fixed value that must equal the reference's default growth rate
#: word characters of a term, as in the Unicode class \w; a term has two or more
WORD = r"[\p{L}\p{N}_]{2,}"
#: a recorded parameter of every run (M11); the fit sees all rows unless a caller of ``train`` bounds it
MAX_ROWS = 4096


def feature_frame(df: DataFrame, label: str | None = "role_type") -> DataFrame:
    """M1: skills list, skill_count, salary_avg (mean of present bounds), missing flag, ``unknown``
    defaults for the categoricals, combined text. Raises on an empty frame or a missing label."""
    if df.limit(1).count() == 0:
        raise ValueError("Training data is empty.")
    if label and label not in df.columns:
        raise ValueError(f"Training data must include '{label}'.")
    cols = set(df.columns)
    skills_col = df.schema["required_skills"].dataType.simpleString() if "required_skills" in cols else None
    if skills_col is None:
        skills = F.array().cast("array<string>")
    elif skills_col == "string":
        skills = split_list("required_skills")
    else:
        skills = F.filter(F.transform(F.coalesce(F.col("required_skills"), F.array().cast("array<string>")),
                                      lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))

    def str_or(c: str, default: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in cols else F.lit(default)

    lo = F.col("salary_min").cast("double") if "salary_min" in cols else F.lit(None).cast("double")
    hi = F.col("salary_max").cast("double") if "salary_max" in cols else F.lit(None).cast("double")
    d = df.select("*", skills.alias("_skills"), midpoint_any(lo, hi).alias("_avg"))
    title, desc = str_or("title", ""), str_or("description", "")
    out = d.select(
        *[c for c in df.columns if c not in ("required_skills", "source", "remote_status", "location", "title", "description")],
        F.col("_skills").alias("required_skills"), F.size("_skills").alias("skill_count"),
        F.col("_avg").alias("salary_avg"), F.col("_avg").isNull().cast("int").alias("salary_was_missing"),
        str_or("source", "unknown").alias("source"), str_or("remote_status", "unknown").alias("remote_status"),
        str_or("location", "unknown").alias("location"), title.alias("title"), desc.alias("description"),
        F.trim(F.concat_ws(" ", title, desc, F.array_join("_skills", " "))).alias("combined_text"))
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M5 balanced weights per class: (label, rows, weight = n / (classes * rows))."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_t", total).select(label, "rows", (F.col("_t.n") / (F.col("_t.k") * F.col("rows"))).alias("weight"))


# ---- M2: terms -------------------------------------------------------------------------------------------------

def grams(text: str | Column, longest: int = 3) -> Column:
    """The 1- to ``longest``-grams of lower-cased words; none of a null text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(WORD), F.lit(0))

    def runs(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    # the words are computed once and bound to a lambda variable
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(w, *[runs(w, n) for n in range(2, longest + 1)])), 1)


def _counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches whose second column lists hashes: slices of whole rows with about a million hashes together, and (place in the
    slice, hash, how often) of the distinct hashes of each row."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")) - at)
            part = b.slice(at, n)
            i = np.repeat(np.arange(n), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
            f = part.column(1).flatten().to_numpy()
            order = np.lexsort((f, i))
            i, f = i[order], f[order]
            first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (f[1:] != f[:-1])))) if len(f) else np.zeros(0, np.int64)
            tf = np.diff(np.concatenate((first, [len(f)]))) if len(f) else first
            yield part, i[first], f[first], tf.astype(np.int64)
            at += n


def _hashes(text: str) -> Column:
    return F.transform(grams(text), lambda g: F.xxhash64(g))


def term_counts(rows: DataFrame, row: str = "_row", text: str = "combined_text") -> DataFrame:
    """(row, f, tf): how often each term, as its 64-bit hash, stands in each row. ``row`` names every row once, so terms are
    counted where the row lies and nothing is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, i, f, tf in _counted_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(f), pa.array(tf)], [row, "f", "tf"])

    return rows.select(row, _hashes(text).alias("f")).mapInArrow(count, f"`{row}` {rows.schema[row].dataType.simpleString()}, f long, tf long")


def term_index(counts: DataFrame, n_rows: int) -> DataFrame:
    """(f, df, idf) of every term: idf = ln((1 + rows) / (1 + df)) + 1."""
    return counts.groupBy("f").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1 + F.lit(n_rows)) / (1 + F.col("df"))) + 1)


# ---- M3, M4: categories and numbers -----------------------------------------------------------------------------

def category_index(df: DataFrame) -> DataFrame:
    """M3: (column, value, rows) of every category seen."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in CATEGORICAL])
    return df.select(F.explode(pairs).alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("rows"))


def _category_hashes() -> Column:
    return F.array(*[F.xxhash64(F.lit(f"{c}="), F.col(c)) for c in CATEGORICAL])


def _category_features(rows: DataFrame, row: str = "_row") -> DataFrame:
    return rows.select(row, F.explode(_category_hashes()).alias("f"))


def numeric_profile(df: DataFrame) -> DataFrame:
    """M4: per numeric column its median (of present values), and mean and deviation (population) once gaps hold the median."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in NUMERIC])).alias("c")).select("c.*")
    medians = floor_quantiles(long, ["column"], "value", {}, {"median": 0.5})
    filled = long.join(medians, "column", "left").withColumn("value", F.coalesce("value", "median", F.lit(0.0)))
    return filled.groupBy("column").agg(F.first("median").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


# ---- M5: fit ---------------------------------------------------------------------------------------------------

@dataclass
class RoleModel:
    """Class labels, the numbers' profile and weights, biases, and the table (f, idf, w) of terms and categories
    (``idf`` null: a category)."""

    labels: list[str]
    numbers: dict[str, tuple[float, float, float]]
    number_weights: list[list[float]]
    bias: list[float]
    weights: DataFrame
    facts: dict = field(default_factory=dict)

    def number(self, c: str) -> Column:
        median, mean, deviation = self.numbers[c]
        return (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / (deviation or 1.0)


#: characters of text per range of the packed columns; a text has at most as many terms as characters
RANGE_CHARS = 1 << 22
_PACKED = "category boolean, f binary, size binary, i binary, tf binary, own_f binary, own_i binary, own_tf binary"


class _Columns:
    """The rows' terms and categories by column, packed in ranges of the hash: per chunk the hashes, how many rows hold each, and
    these rows' numbers and counts. Terms that stand in a single row are kept apart (``own_``): between rows their inner
    products are zero, so a round needs nothing of them but one number per row."""

    def __init__(self, rows: DataFrame, starts: dict[int, int], n: int):
        """``starts``: the number of the first row of each partition of ``_row``."""
        self.spark, self.n = rows.sparkSession, n
        self.tasks = max(1, self.spark.sparkContext.defaultParallelism)
        chars = rows.agg(F.sum(F.length("combined_text"))).first()[0] or 0
        ranges = max(1, -(-chars // RANGE_CHARS))
        firsts = np.zeros(max(starts, default=0) + 1, np.int64)
        firsts[list(starts)] = list(starts.values())

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, i, f, tf in _counted_batches(batches):
                row = part.column(0).to_numpy()
                number = (firsts[row >> 33] + (row & ((1 << 33) - 1))).astype(np.int32)
                kinds = part.column(2).flatten().to_numpy()
                i = np.concatenate((number[i], np.repeat(number, len(CATEGORICAL))))
                f, tf = np.concatenate((f, kinds)).view(np.uint64), np.concatenate((tf, np.zeros(len(kinds), np.int64))).astype(np.int32)
                order = np.argsort(f)
                i, f, tf = i[order], f[order], tf[order]
                at = ((f >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)  # 0 .. ranges - 1, in the order of f
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(at[cut[:-1]]), *[pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (f, i, tf)]], ["at", "f", "i", "tf"])

        def pack(t: pa.Table) -> pa.Table:
            f, i, tf = (np.concatenate([np.frombuffer(v, kind) for v in t[c].to_pylist()]) for c, kind in (("f", np.int64), ("i", np.int32), ("tf", np.int32)))
            order = np.argsort(f, kind="stable")
            f, i, tf = f[order], i[order], tf[order]
            first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            size = np.diff(np.concatenate((first, [len(f)])))
            of_category, single = tf[first] == 0, size == 1
            own = first[single & ~of_category]
            out = [(False, b"", b"", b"", b"", *(x[o].tobytes() for x in (f, i, tf))) for o in np.array_split(own, max(1, len(own) >> 16))]
            once = np.maximum.reduceat(tf, first) == 1  # terms that stand once in each of their rows need no counts
            for kind, counted, of in ((False, False, once & ~single), (False, True, ~once & ~single & ~of_category), (True, False, of_category)):
                runs = np.flatnonzero(of)
                for some in np.split(runs, np.flatnonzero(np.diff(np.cumsum(size[runs]) >> 16)) + 1) if len(runs) else []:  # about 65 thousand entries
                    held = np.repeat(first[some] - np.concatenate(([0], np.cumsum(size[some])[:-1])), size[some]) + np.arange(size[some].sum())
                    out.append((kind, f[first[some]].tobytes(), size[some].astype(np.int32).tobytes(), i[held].tobytes(), tf[held].tobytes() if counted else b"", b"", b"", b""))
            return pa.table([pa.array(c, pa.bool_() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out))], names=[c.split()[0] for c in _PACKED.split(", ")])

        blocks = rows.select("_row", _hashes("combined_text").alias("f"), _category_hashes().alias("c")).mapInArrow(deal, "at long, f binary, i binary, tf binary")
        path = scratch_path(self.spark, "columns")
        # a reader holds a row group of such long values whole
        blocks.groupBy("at").applyInArrow(pack, _PACKED).write.option("parquet.block.row.count.limit", 16).parquet(path)
        self.packed = self.spark.read.schema(_PACKED).parquet(path)
        squares, own = self._summed(self.packed.select("category", "size", "i", "tf", "own_i", "own_tf"), self._squares(), 2 * n).reshape(2, n)
        #: of each row: one over the Euclidean norm of its terms (0: it has none), and its own terms' part of its square
        self.scale = np.divide(1.0, np.sqrt(squares), out=np.zeros(n), where=squares > 0)
        self.own = own * self.scale ** 2

    def _squares(self) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray]:
        n = self.n

        def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((2, n))
            for r in _records(batches, n):
                if not r["category"]:
                    i, v = r["i"], _times(np.repeat(_idf(n, r["size"]), r["size"]), r["tf"])
                    out[0] += np.bincount(i, v * v, n)
                    own = np.bincount(r["own_i"], (r["own_tf"] * _idf(n, 1)) ** 2, n)
                    out += own
            return out

        return of

    def _summed(self, rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
        """The sum of the arrays of ``length`` that ``of`` makes in every task, added up in blocks by tasks."""
        block = 1 << 17

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = of(batches).ravel()
            for a in range(0, length, block):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([out[a:a + block].tobytes()], pa.binary())], ["a", "v"])

        def total(t: pa.Table) -> pa.Table:
            return pa.table({"a": t["a"].slice(0, 1), "v": pa.array([sum(np.frombuffer(v) for v in t["v"].to_pylist()).tobytes()], pa.binary())})

        parts = rows.coalesce(self.tasks).mapInArrow(made, "a long, v binary")
        if length * self.tasks > 1 << 20:  # more than 8 MB are added up before they reach the driver
            parts = parts.groupBy("a").applyInArrow(total, "a long, v binary")
        out = np.zeros(length)
        for r in parts.collect():
            out[r.a:r.a + block] += np.frombuffer(r.v)
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """The rows' inner products times ``v`` (rows x k): one pass over the columns."""
        n, k = v.shape
        sent = self.spark.sparkContext.broadcast((np.ascontiguousarray(v.T), self.scale))

        def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            given, scale = sent.value
            scaled = given * scale
            text, kind = np.zeros((k, n)), np.zeros((k, n))
            for r in _records(batches, n):
                size, i, tf = r["size"], r["i"], r["tf"]
                first = np.cumsum(size) - size
                for c in range(k if len(i) else 0):
                    if r["category"]:
                        kind[c] += np.bincount(i, np.repeat(np.add.reduceat(given[c][i], first), size), n)
                    else:
                        g = np.add.reduceat(_times(scaled[c][i], tf), first) * _idf(n, size) ** 2
                        text[c] += np.bincount(i, _times(np.repeat(g, size), tf), n)
            return text * scale + kind

        try:
            out = self._summed(self.packed.select("category", "size", "i", "tf"), of, k * n).reshape(k, n).T
        finally:
            sent.destroy()
        return out + self.own[:, None] * v

    def weights(self, a: np.ndarray) -> DataFrame:
        """(f, idf, w) of every term and category: the rows that hold it, times ``a`` (rows x classes); written once."""
        n, classes = a.shape
        sent = self.spark.sparkContext.broadcast((a, self.scale))

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, scale = sent.value

            def rows(f: np.ndarray, idf: pa.Array, w: np.ndarray) -> Iterator[pa.RecordBatch]:
                for at in range(0, len(f), 1 << 16):
                    some = np.ascontiguousarray(w[at:at + (1 << 16)])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * classes), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(f[at:at + (1 << 16)]), idf.slice(at, 1 << 16), lists], ["f", "idf", "w"])

            for r in _records(batches, 0):
                size, i = r["size"], r["i"]
                if len(i):
                    x = np.ones(len(i)) if r["category"] else _times(np.repeat(_idf(n, size), size), r["tf"]) * scale[i]
                    w = np.stack([np.add.reduceat(x * given[i, c], np.cumsum(size) - size) for c in range(classes)], axis=1)
                    yield from rows(r["f"], pa.nulls(len(size), pa.float64()) if r["category"] else pa.array(_idf(n, size)), w)
                i, one = r["own_i"], _idf(n, 1)
                yield from rows(r["own_f"], pa.array(np.full(len(i), one)), (r["own_tf"] * one * scale[i])[:, None] * given[i])

        try:
            return cut_lineage(self.packed.mapInArrow(learned, "f long, idf double, w array<double>"))
        finally:
            sent.destroy()


def _records(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict]:
    """The packed rows as arrays, those of one kind joined until they have ``least`` entries (and some 65 thousand)."""
    def joined(held: list[dict]) -> dict:
        out = {c: np.concatenate([np.frombuffer(r[c], np.int64 if c in ("f", "own_f") else np.int32) for r in held]) for c in held[0] if c != "category"}
        return {**out, "category": held[0]["category"], "tf": out["tf"] if len(out.get("tf", ())) else None}

    waiting: dict[tuple, list[dict]] = {}
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            kind = (r["category"], bool(r["tf"]))
            held = waiting.setdefault(kind, [])
            held.append(r)
            if sum(len(x["i"]) + len(x.get("own_i") or b"") for x in held) >= 4 * max(least, 1 << 16):
                yield joined(waiting.pop(kind))
    yield from map(joined, waiting.values())


def _times(x: np.ndarray, tf: np.ndarray | None) -> np.ndarray:
    """``x`` times the counts; without counts each is one."""
    return x if tf is None else x * tf


def _idf(n: int, df: np.ndarray | int) -> np.ndarray:
    """As ``term_index`` has it."""
    return np.log((1 + n) / (1 + df)) + 1


def logistic_fit(times: Callable[[np.ndarray], np.ndarray], y: np.ndarray, weight: np.ndarray, classes: int, rounds: int = 200, kept: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the L2-penalised (C = 1) weighted multinomial fit: the weights are the rows' combination by ``a``, the scores
    ``times(a) + b``, where ``times`` multiplies with the rows' inner products.

    Limited-memory BFGS over the weights, which are held as their ``a``: every step is a sum of gradients, so with each vector's
    product at hand steps, line searches and angles need no further product, and a round costs one. Over the classes a row's
    ``a`` sums to zero, so that of the last class is left out."""
    n, k = len(y), classes - 1
    target = np.eye(classes)[y][:, :k]

    def dot(u: tuple, v: tuple) -> float:
        (a, _, b), (_, ka, c) = u, v
        return float((a * ka).sum() + (a.sum(axis=1) * ka.sum(axis=1)).sum() + (b * c).sum() + b.sum() * c.sum())

    def plus(u: tuple, t: float, v: tuple) -> tuple:
        return tuple(x + t * w for x, w in zip(u, v))

    def loss_of(z: tuple) -> tuple[float, np.ndarray]:
        m = z[1] + z[2]
        m = np.column_stack((m, -m.sum(axis=1)))
        m -= m.max(axis=1, keepdims=True)
        p = m - np.log(np.exp(m).sum(axis=1, keepdims=True))
        penalty = 0.5 * dot((z[0], z[1], 0 * z[2]), (z[0], z[1], 0 * z[2]))
        return penalty - float((weight * p[np.arange(n), y]).sum()), weight[:, None] * (np.exp(p[:, :k]) - target)

    def gradient(z: tuple, residual: np.ndarray) -> tuple:
        return z[0] + residual, z[1] + times(residual), residual.sum(axis=0)

    z = (np.zeros((n, k)), np.zeros((n, k)), np.zeros(k))
    steps: list[tuple[tuple, tuple, float]] = []
    if k:
        loss, residual = loss_of(z)
        grad = gradient(z, residual)
        for _ in range(rounds):
            if dot(grad, grad) ** 0.5 < 1e-5 * weight.sum():
                break
            d, back = grad, []
            for s, g, sg in reversed(steps):
                back.append(dot(s, d) / sg)
                d = plus(d, -back[-1], g)
            if steps:
                s, g, sg = steps[-1]
                d = tuple(x * (sg / dot(g, g)) for x in d)
            for (s, g, sg), al in zip(steps, reversed(back)):
                d = plus(d, al - dot(g, d) / sg, s)
            slope, t = -dot(grad, d), 1.0 if steps else 1.0 / max(1.0, dot(grad, grad) ** 0.5)
            while True:
                new = plus(z, -t, d)
                new_loss, residual = loss_of(new)
                if new_loss <= loss + 1e-4 * t * slope or t < 1e-12:
                    break
                t /= 2
            new_grad = gradient(new, residual)
            s, g = plus(new, -1.0, z), plus(new_grad, -1.0, grad)
            if (sg := dot(s, g)) > 1e-12:
                steps = [*steps[1 - kept:], (*(tuple(x.astype(np.float32) for x in v) for v in (s, g)), sg)]  # directions bear rounding
            z, loss, grad = new, new_loss, new_grad
    a, b = z[0], z[2]
    return np.column_stack((a, -a.sum(axis=1))), np.append(b, -b.sum())


def train(df: DataFrame, label: str = "role_type", max_rows: int | None = None) -> RoleModel:
    """M5: fit on the rows of ``df`` that have a label: all of them, unless the caller gives ``max_rows`` (so many by hash order).
    The weights table is written under the checkpoint folder."""
    f = feature_frame(df, label).where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("_row"), F.col(label).cast("string").alias("_label"), *CATEGORICAL, *NUMERIC, "combined_text")
    f = cut_lineage(f)
    balance = {r["_label"]: (r["rows"], r["weight"]) for r in class_weights(f, "_label").collect()}  # one row per class
    labels, n_rows = sorted(balance), sum(r for r, _ in balance.values())
    numbers = {r["column"]: (r["median"] or 0.0, r["mean"], r["deviation"]) for r in numeric_profile(f).collect()}  # three rows
    model = RoleModel(labels, numbers, [], [], f)

    bounded = max_rows is not None and n_rows > max_rows
    order = [F.xxhash64("combined_text", "_label", *CATEGORICAL).alias("_o")] if bounded else []
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("_label")).cast("int") - 1
    held = f.select("_row", code.alias("_y"), *[model.number(c).alias(c) for c in NUMERIC], *order).toArrow()  # a few numbers per row
    place = np.argsort(held["_row"].to_numpy())
    row, y = held["_row"].to_numpy()[place], held["_y"].to_numpy()[place]
    numeric = np.column_stack([held[c].to_numpy()[place] for c in NUMERIC])
    weight = np.array([balance[v][1] for v in labels])[y]
    if bounded:
        weight[np.lexsort((row, held["_o"].to_numpy()[place]))[max_rows:]] = 0.0  # such rows have no part in the weights
    parts, starts = np.unique(row >> 33, return_index=True)

    columns = _Columns(f, dict(zip(parts.tolist(), starts.tolist())), n_rows)
    a, b = logistic_fit(lambda v: columns.times(v) + numeric @ (numeric.T @ v), y, weight, len(labels))
    model.number_weights, model.bias = (numeric.T @ a).tolist(), b.tolist()
    model.weights = columns.weights(a)
    model.facts = {"rows": n_rows, "fitted_rows": int((weight > 0).sum()), "classes": len(labels), "max_rows": max_rows or MAX_ROWS}
    return model


# ---- M6: predict -----------------------------------------------------------------------------------------------

def predict(model: RoleModel, df: DataFrame, label: str = "role_type", out: str = "predicted_role_type") -> DataFrame:
    """M6: the most likely label of every row, plus its probability as ``confidence``. Unknown terms and categories
    count nothing; ties go to the label that sorts first."""
    f = cut_lineage(feature_frame(df, None).withColumn("_row", F.monotonically_increasing_id()))
    classes = range(len(model.labels))
    terms = term_counts(f).unionByName(_category_features(f).withColumn("tf", F.lit(1).cast("long")))
    # a row has far more terms than its size lets Spark guess: they are never broadcast
    met = terms.hint("merge").join(model.weights, "f").withColumn("v", F.col("tf") * F.col("idf"))
    sums = met.groupBy("_row").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"),
        F.array(*[F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w")[c]) for c in classes]).alias("_text"),
        F.array(*[F.sum(F.when(F.col("idf").isNull(), F.col("w")[c]).otherwise(0.0)) for c in classes]).alias("_cat"))
    scored = f.join(sums, "_row", "left")

    def logit(c: int) -> Column:
        numbers = sum((model.number(n) * model.number_weights[j][c] for j, n in enumerate(NUMERIC)), F.lit(model.bias[c]))
        text = F.when(F.col("_norm") > 0, F.col("_text")[c] / F.col("_norm")).otherwise(0.0)
        return numbers + F.coalesce(text, F.lit(0.0)) + F.coalesce(F.col("_cat")[c], F.lit(0.0))

    scored = scored.withColumn("_logits", F.array(*[logit(c) for c in classes]))
    top = F.array_max("_logits")
    names = F.array(*map(F.lit, model.labels))
    total = F.aggregate("_logits", F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return scored.withColumn(out, F.element_at(names, F.array_position("_logits", top).cast("int"))).withColumn("confidence", 1 / total) \
        .drop("_row", "_norm", "_text", "_cat", "_logits")


def confusion(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """M8: (actual, predicted, count) — the long form of the confusion matrix."""
    return pred.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def class_report(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """M9: per class precision, recall, F1, support (zero division -> 0)."""
    c = confusion(pred, actual, predicted)
    tp = c.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("count").alias("tp"))
    sup = c.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    pc = c.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("predicted_count"))
    j = sup.join(pc, "cls", "full").join(tp, "cls", "left").fillna(0, ["support", "predicted_count", "tp"])
    prec = F.when(F.col("predicted_count") > 0, F.col("tp") / F.col("predicted_count")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return j.select("cls", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(f1, 6).alias("f1"), F.col("support").cast("long").alias("support"))


def evaluate(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """M7: accuracy, macro / weighted F1, macro precision and recall (one row)."""
    r = class_report(pred, actual, predicted).where(F.col("support") > 0).unionByName(
        class_report(pred, actual, predicted).where(F.col("support") == 0))
    n = pred.select(F.count(F.lit(1))).scalar()
    acc = pred.select(F.avg((F.col(actual).cast("string") == F.col(predicted).cast("string")).cast("double"))).scalar()
    return r.agg(F.round(acc, 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("f1_macro"),
                 F.round(F.sum(F.col("f1") * F.col("support")) / n, 6).alias("f1_weighted"),
                 F.round(F.avg("precision"), 6).alias("precision_macro"), F.round(F.avg("recall"), 6).alias("recall_macro"))


def forecast(pred: DataFrame, predicted: str = "predicted_role_type", quarters_ahead: int = 1, top_n: int = 10,
             growth_per_quarter: float = GROWTH_PER_QUARTER) -> DataFrame:
    """Per predicted role: observed count, projected index = count * (1 + g * quarters),
    mean max-probability (4 dp); top ``top_n`` by projection (ties by role)."""
    g = 1 + growth_per_quarter * quarters_ahead
    return (pred.groupBy(F.col(predicted).alias("role"))
            .agg(F.count(F.lit(1)).alias("observed_count"), F.round(F.avg("confidence"), 4).alias("confidence_score"))
            .withColumn("projected_demand_index", F.col("observed_count") * F.lit(g))
            .withColumn("quarters_ahead", F.lit(quarters_ahead))
            .orderBy(F.col("projected_demand_index").desc(), "role").limit(top_n))


def dataset_profile(parts: dict[str, DataFrame], label: str = "role_type") -> DataFrame:
    """(section, name, value) of prepared frames: rows, columns, distributions of label, work mode and source, and the
    description of ``salary_avg`` (count, mean, std, min, quartiles, max; 0 where undefined). One unpivoted aggregate over
    all parts, and one pass for their quartiles."""
    columns = {part: len(df.columns) for part, df in parts.items()}
    rows = None
    for part, df in parts.items():
        one = df.select(F.lit(part).alias("section"), F.col(label).cast("string").alias("label"), "remote_status", "source", F.col("salary_avg").cast("double").alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    tags = F.array(F.lit("row_count"), *[F.concat(F.lit(f"{n}_distribution:"), F.col(c)) for n, c in
                                         (("label", "label"), ("remote_status", "remote_status"), ("source", "source"))])
    counts = rows.select("section", F.explode(F.array_compact(tags)).alias("name")).groupBy("section", "name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    quartiles = floor_quantiles(rows, ["section"], "v", {}, {"25%": 0.25, "50%": 0.5, "75%": 0.75}).withColumnRenamed("section", "_s")
    stats = rows.groupBy("section").agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                        F.min("v").alias("min"), F.max("v").alias("max"))
    stats = stats.join(quartiles, F.col("section") == F.col("_s"), "left")
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    described = stats.select("section", F.explode(F.array(*[F.struct(F.lit(f"salary_avg:{n}").alias("name"), F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias("value")) for n in names])).alias("d"))
    width = rows.sparkSession.createDataFrame([(p, "column_count", float(n)) for p, n in columns.items()], "section string, name string, value double")
    return counts.unionByName(described.select("section", "d.name", "d.value")).unionByName(width)


FEATURES = ["combined_text", *CATEGORICAL, *NUMERIC]


def run_record(train_df: DataFrame, eval_df: DataFrame, label: str = "role_type", params: dict | None = None) -> DataFrame:
    """M11 without learned numbers: (section, name, value, text) of the run's tags (family, problem, fingerprints), its
    parameters, and the profiles of both prepared tables."""
    from jobsieve.operators.stats import fingerprint
    spark = train_df.sparkSession
    profile = cut_lineage(dataset_profile({"train": feature_frame(train_df, label), "evaluation": feature_frame(eval_df, label)}, label))
    sizes = profile.where("name = 'row_count'").select(F.lit("param").alias("section"), F.concat(F.when(F.col("section") == "train", "train").otherwise("eval"), F.lit("_rows")).alias("name"),
                                                       "value", F.lit(None).cast("string").alias("text"))
    fixed = {"feature_count": len(FEATURES), "growth_per_quarter": GROWTH_PER_QUARTER, "max_rows": MAX_ROWS, "model_type": "logistic_regression", "ngram_range": "1-3", **(params or {})}
    rows = [("param", k, float(v) if isinstance(v, (int, float)) else None, None if isinstance(v, (int, float)) else str(v)) for k, v in fixed.items()]
    rows += [("tag", "model_family", None, "role_classifier"), ("tag", "problem_type", None, "multiclass_classification")]
    out = sizes.unionByName(spark.createDataFrame(rows, "section string, name string, value double, text string"))
    for name, df in (("train", train_df), ("eval", eval_df)):
        out = out.unionByName(fingerprint(df).select(F.lit("tag").alias("section"), F.lit(f"{name}_dataset_fingerprint").alias("name"),
                                                     F.lit(None).cast("double").alias("value"), F.col("hash_sum").alias("text")))
    return out.unionByName(profile.withColumn("text", F.lit(None).cast("string")))


def run_experiment(train_df: DataFrame, eval_df: DataFrame, out_dir: str, label: str = "role_type", params: dict | None = None) -> DataFrame:
    """Train, evaluate, and write predictions, report, confusion matrix, weights and the run record (with the metrics as
    rows of section ``metric``) as Parquet under ``out_dir`` (shared storage). Returns the run record as written."""
    model = train(train_df, label)
    model.weights.write.mode("overwrite").parquet(f"{out_dir}/weights")
    predict(model, eval_df, label).write.mode("overwrite").parquet(f"{out_dir}/predictions")
    spark = train_df.sparkSession
    pred = spark.read.parquet(f"{out_dir}/predictions")
    class_report(pred, label, "predicted_role_type").write.mode("overwrite").parquet(f"{out_dir}/report")
    confusion(pred, label, "predicted_role_type").write.mode("overwrite").parquet(f"{out_dir}/confusion")
    metrics = evaluate(pred, label, "predicted_role_type")
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit("metric").alias("section"), F.lit(m).alias("name"), F.col(m).alias("value"), F.lit(None).cast("string").alias("text"))
                                              for m in metrics.columns])).alias("m")).select("m.*")
    run = run_record(train_df, eval_df, label, {**(params or {}), **{k: v for k, v in model.facts.items() if k != "rows"}}).unionByName(long)
    run.withColumn("run_at", F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))).write.mode("overwrite").parquet(f"{out_dir}/run")
    return spark.read.parquet(f"{out_dir}/run")
