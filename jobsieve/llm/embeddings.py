"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells.

Equal vectors are one class. Centres are fitted on a bounded sample (``sample`` distinct vectors by hash order, one
task); every vector is then assigned to its nearest cell and, as a visitor, to all cells that may hold a partner:
for unit vectors x, y with cosine t, x.c' >= x.c - |x - y| |c' - c| whenever y lies in the cell of c', and random
directions use only part of that bound, so ``slack`` times it is allowed (1.0 would be exact; recall at the
default is measured in the tests). Cells are cut into blocks of members and of visitors, and every pair of blocks with members is one matrix product in
double precision, so a hot cell is many bounded tasks. A pair that could meet in both its cells counts in one.
Link counts are summed per block before the shuffle, and a block sends a spanning forest, never its pairs.

Defined cases: null, empty and zero vectors and vectors with null or non-finite components link with nothing;
vectors of different length never link; equal vectors (repeated rows included) link with each other; a null id
counts as a link of others but never names a component unless it is alone; an empty table gives no rows; extra
columns, labels among them, are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import connected_components, materialise, shuffle_width


@dataclass(frozen=True)
class CellParams:
    """``cosine``: least similarity of a link; ``per_cell``: distinct vectors aimed at per cell; ``max_cells``: bound of
    the broadcast centres (larger cells just have more blocks); ``sample``, ``rounds``: k-means fit; ``block``:
    members per side of a product (visitors: four times as many)."""

    cosine: float = 0.95
    per_cell: int = 1000
    max_cells: int = 1024
    sample: int = 20_000
    rounds: int = 12
    slack: float = 0.3
    block: int = 1024


def units(column: pa.Array) -> list[bytes | None]:
    """The vectors as bytes of unit doubles, a matrix per length; None where a vector cannot link."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    starts = np.cumsum(sizes) - sizes
    out: list[bytes | None] = [None] * len(column)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]  # keeps the squares finite and normal
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for i, u in zip(at[good].tolist(), x):
            out[i] = u.tobytes()
    return out


def unit(v: list | None) -> np.ndarray | None:
    """One vector as unit doubles; None where it cannot link."""
    u = units(pa.array([v], pa.list_(pa.float64())))[0]
    return None if u is None else np.frombuffer(u)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length, as rows."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centres of unit rows: assignment by cosine, centres as normalised sums; empty cells keep their centre."""
    c = x[np.random.default_rng(5).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        s = np.zeros_like(c)
        np.add.at(s, (x @ c.T).argmax(axis=1), x)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-300)[:, None], c)
    return c


def _vectors(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = units(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r and hashlib.md5(r).digest() for r in raw], pa.binary()),
                 pa.array([r and len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "k", "dim", "u"])

    return rows.mapInArrow(run, f"vec_id {kind}, k binary, dim int, u binary")


def fit_centres(distinct: DataFrame, total: dict[int, int], p: CellParams) -> dict[int, np.ndarray]:
    """dim -> centres, fitted in one task on the bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, u in zip(batch.column("dim").to_pylist(), batch.column("u").to_pylist()):
                by_dim.setdefault(d, []).append(np.frombuffer(u))
        for d, rows in by_dim.items():
            k = max(1, min(p.max_cells, -(-total.get(d, 1) // p.per_cell)))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([spherical_kmeans(np.stack(rows), k, p.rounds).tobytes()], pa.binary())], ["dim", "c"])

    sample = distinct.select("k", "dim", "u").orderBy("k").limit(p.sample).coalesce(1)
    return {r.dim: np.frombuffer(bytes(r.c)).reshape(-1, r.dim) for r in sample.mapInArrow(run, "dim int, c binary").collect()}


def _entries(distinct: DataFrame, centres: dict[int, np.ndarray], p: CellParams) -> DataFrame:
    """(dim, cell, home, k, n, u, visits): a row in the vector's own cell, which lists the cells that it visits, and one
    row in each of these."""
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # |c' - c| between centres; unit vectors, so from their products
        reach = {d: p.slack * np.sqrt(2 - 2 * p.cosine) * np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) for d, c in centres.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                dims = np.asarray(part.column("dim"))
                for dim in np.unique(dims).tolist():
                    rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                    n = rows.num_rows
                    # a length that the sample does not hold is one cell
                    sim = matrix(rows.column("u")) @ centres.get(dim, np.zeros((1, dim))).T
                    home = sim.argmax(axis=1)
                    near = sim >= (sim[np.arange(n), home][:, None] - reach.get(dim, np.zeros((1, 1)))[home])
                    near[np.arange(n), home] = False
                    guest, cell = np.nonzero(near)
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(near.sum(axis=1)))), pa.int32()), pa.array(cell, pa.int32()))
                    none = pa.array([[]] * len(guest), types[-1])
                    both = rows.take(pa.array(np.concatenate((np.arange(n), guest))))
                    yield pa.RecordBatch.from_arrays(
                        [both.column("dim"), pa.array(np.concatenate((home, cell)), pa.int32()), pa.array(np.concatenate((home, home[guest])), pa.int32()),
                         *(both.column(c) for c in ("k", "n", "u")), pa.concat_arrays([own, none])], ["dim", "cell", "home", "k", "n", "u", "visits"])

    return distinct.select("dim", "k", "n", "u").mapInArrow(run, "dim int, cell int, home int, k binary, n bigint, u binary, visits array<int>")


def _visits(block: pa.Table, homes: np.ndarray) -> np.ndarray:
    """Row x home: whether the row visits that cell."""
    out = np.zeros((block.num_rows, len(homes)), dtype=bool)
    lists = block.column("visits").combine_chunks()
    row, cell = np.repeat(np.arange(block.num_rows), np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())
    if len(homes) and len(cell):
        at = np.minimum(np.searchsorted(homes, cell), len(homes) - 1)
        known = homes[at] == cell
        out[row[known], at[known]] = True
    return out


def block_links(a: pa.Table, b: pa.Table | None, cell: int, p: CellParams) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, bytes]]]:
    """Link weights per vector and a spanning forest of the links between blocks a and b (b None: inside a).

    A block has the columns home, k, n, u, visits."""
    sides = [a] if b is None else [a, b]
    vectors = [matrix(t.column("u")) for t in sides]
    homes = [np.asarray(t.column("home")) for t in sides]
    x, y, hx, hy = vectors[0], vectors[-1], homes[0], homes[-1]
    link = x @ y.T >= p.cosine
    if b is None:
        link &= np.tri(len(x), dtype=bool, k=-1).T
    # at least one side lives here; if both cells see the pair, the one with the smaller number counts it
    link &= (hx[:, None] == cell) | (hy[None, :] == cell)
    lower = np.unique(np.concatenate(homes))
    lower = lower[lower < cell]
    if len(lower) and link.any():
        for seen, guests, at in ((_visits(sides[0], lower), hy, link), (_visits(sides[-1], lower), hx, link.T)):
            low = np.flatnonzero(guests < cell)
            at[:, low] &= ~seen[:, np.searchsorted(lower, guests[low])]
    numbers = [np.asarray(t.column("n")) for t in sides]
    keys = [k for t in sides for k in t.column("k").to_pylist()]
    weight = np.zeros(len(keys), dtype=np.int64)
    off = len(x) if b is not None else 0
    i, j = np.nonzero(link)
    np.add.at(weight, i, numbers[-1][j]), np.add.at(weight, j + off, numbers[0][i])
    # component labels by repeated minima along links
    label = np.arange(len(keys))
    while len(i):
        low = np.minimum(label[i], label[j + off])
        new = label.copy()
        np.minimum.at(new, i, low), np.minimum.at(new, j + off, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    edges = [(keys[v], keys[label[v]]) for v in np.flatnonzero(label != np.arange(len(keys))).tolist()]
    return [(keys[v], int(weight[v])) for v in np.flatnonzero(weight).tolist()], edges


def _block_results(entries: DataFrame, p: CellParams) -> DataFrame:
    """Entries sorted by (dim, cell, i, j, x) -> (k, n_links) per block pair and (k, other) forest links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        sides: dict[int, list[pa.RecordBatch]] = {}

        def flush() -> pa.RecordBatch:
            _, cell, i, j = group
            weights, edges = [], []
            if i == j or len(sides) == 2:
                first, *second = (pa.Table.from_batches(sides[x]) for x in sorted(sides))
                weights, edges = block_links(first, second[0] if second else None, cell, p)
            k = [w[0] for w in weights] + [e[0] for e in edges]
            return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([w[1] for w in weights] + [None] * len(edges), pa.int64()),
                                               pa.array([None] * len(weights) + [e[1] for e in edges], pa.binary())], ["k", "n_links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([np.asarray(batch.column(c)) for c in ("dim", "cell", "i", "j", "x")])
            edges = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            rows = batch.select(["home", "k", "n", "u", "visits"])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                *here, x = at[:, lo].tolist()
                if group != tuple(here):
                    if sides:
                        yield flush()
                    group, sides = tuple(here), {}
                sides.setdefault(x, []).append(rows.slice(lo, hi - lo))
        if sides:
            yield flush()

    return entries.mapInArrow(run, "k binary, n_links bigint, other binary")


def near_duplicate_vectors(vectors: DataFrame, p: CellParams = CellParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    rows = materialise(_vectors(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))), "vectors")
    distinct = materialise(rows.where("k is not null").groupBy("k").agg(
        F.first("dim").alias("dim"), F.first("u").alias("u"), F.count("*").alias("n"), F.min("vec_id").alias("low")), "distinct-vectors")
    total = {r.dim: r.n for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    entries = materialise(_entries(distinct, fit_centres(distinct, total, p), p), "cell-entries")
    # blocks 0..mb-1 hold a cell's members, mb.. its visitors (in larger blocks); visitors never meet each other
    member = F.col("home") == F.col("cell")
    blocks = (entries.groupBy("dim", "cell").agg(F.ceil(F.count_if(member) / p.block).cast("int").alias("mb"),
                                                 F.ceil(F.count_if(~member) / (4 * p.block)).cast("int").alias("vb")).where("mb > 0"))
    h = F.xxhash64("k")
    placed = entries.join(blocks, ["dim", "cell"]).withColumn("x", F.when(member, F.pmod(h, F.col("mb"))).otherwise(
        F.col("mb") + F.pmod(h, F.greatest("vb", F.lit(1)))).cast("int"))
    partners = F.sequence(F.lit(0), F.when(member, F.col("mb") + F.col("vb") - 1).otherwise(F.col("mb") - 1))
    paired = (placed.withColumn("y", F.explode(partners))
              .select("dim", "cell", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "home", "k", "n", "u", "visits")
              .repartition(shuffle_width(spark), "dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j", "x"))
    found = materialise(_block_results(paired, p), "vector-links")
    counts = found.where("n_links is not null").groupBy("k").agg(F.sum("n_links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("k").alias("a"), F.col("other").alias("b")))
    named = (distinct.select("k", "n", "low").join(counts, "k", "left").join(joined.withColumnRenamed("node", "k"), "k", "left")
             .select("k", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("component", "k").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_key = named.join(lowest, "component").select(F.col("k").alias("_k"), "n_links", "component_id")
    out = rows.select("vec_id", "k").join(by_key, F.col("k") == F.col("_k"), "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
