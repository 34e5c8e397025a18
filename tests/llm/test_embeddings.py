import math

import numpy as np
import pyarrow as pa
import pytest

from jobsieve.llm import embeddings


def brute(rows, t=0.95):
    units = [embeddings.unit(v) for _, v in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= t:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, n[i], low.get(find(i)), low.get(find(i)) == d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("p", [embeddings.CellParams(), embeddings.CellParams(per_cell=20, block=16, slack=1.0), embeddings.CellParams(per_cell=10, block=7, slack=1.0)])
def test_matches_brute_force(spark, p):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vecs = [(base[i % 12] + rng.normal(size=16) * 0.2).astype("float32").tolist() for i in range(150)]
    vecs += [vecs[0], vecs[0], [float(3 * x) for x in vecs[1]], None, [], [0.0] * 16, [None] + [1.0] * 15, [math.nan] + [1.0] * 15, [math.inf] * 16, [1.0, 2.0], [2.0, 4.0], [1e-40] * 16]
    rows = list(enumerate(vecs)) + [(4, vecs[4]), (None, vecs[2]), (None, None)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n int, k string").repartition(3)
    want = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, embeddings.near_duplicate_vectors(df, p).collect()), key=str) == brute(want)
    assert embeddings.near_duplicate_vectors(df.where("false"), p).count() == 0


def test_recall_on_real_vectors_with_planted_copies(spark):
    rng = np.random.default_rng(8)
    real = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    copies = []
    for v in real[:800]:  # cosine from 0.95 up
        u, e = embeddings.unit(v), rng.normal(size=len(v))
        e -= (e @ u) * u
        t = rng.uniform(0.9501, 0.99)
        copies.append((t * u + math.sqrt(1 - t * t) * e / np.linalg.norm(e)).tolist())
    rows = list(enumerate([list(map(float, v)) for v in real] + copies))
    x = np.stack([embeddings.unit(v) for _, v in rows])
    true = int(np.triu(x @ x.T >= 0.95, 1).sum())
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), embeddings.CellParams(per_cell=100)).collect()
    found = sum(r.n_links for r in got) / 2
    assert true >= 800 and 0.95 * true <= found <= true
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_rows_as_a_matrix():
    rows = [[1.0, 2.0], None, [], [0.0, 0.0], [3.0], [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [1e-300, 1e-300], [1e300, 0.0]]
    got = embeddings.units(pa.array(rows, pa.list_(pa.float64())).slice(1))
    assert [g is not None for g in got] == [False, False, False, True, False, False, False, True, True]
    assert np.allclose(np.frombuffer(got[7]), math.sqrt(0.5)) and np.frombuffer(got[8]).tolist() == [1.0, 0.0]


def test_length_outside_the_sample(spark):
    rows = [(i, [1.0, float(i)]) for i in range(4)] + [(9, [0.0, 0.0, 2.0]), (8, [0.0, 0.0, 1.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embeddings.near_duplicate_vectors(df, embeddings.CellParams(sample=1, slack=1.0)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_pair_seen_by_two_cells_counts_once():
    rng = np.random.default_rng(4)
    p = embeddings.CellParams(cosine=0.5)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    home = rng.integers(0, 4, 60)
    visits = [sorted({int(v) for v in rng.integers(0, 4, 3)} - {int(h)}) for h in home]
    n = rng.integers(1, 4, 60)
    want, got = np.zeros(60, dtype=int), np.zeros(60, dtype=int)
    for i in range(60):
        for j in range(60):
            if i != j and x[i] @ x[j] >= 0.5 and (home[i] == home[j] or home[j] in visits[i] or home[i] in visits[j]):
                want[i] += n[j]

    def block(ids, member):
        return pa.table({"home": home[ids], "k": [b"%02d" % i for i in ids], "n": n[ids], "u": [x[i].tobytes() for i in ids],
                         "visits": pa.array([visits[i] if member else [] for i in ids], pa.list_(pa.int32()))})

    for cell in range(4):
        mine = np.flatnonzero(home == cell)
        guests = np.array([i for i in range(60) if cell in visits[i]], dtype=int)
        for other in (None, block(guests, False)):
            if other is None or len(guests):
                for k, w in embeddings.block_links(block(mine, True), other, cell, p)[0]:
                    got[int(k)] += w
    assert got.tolist() == want.tolist()


def test_centres_are_unit_and_separate_clusters():
    rng = np.random.default_rng(0)
    c = np.eye(4)
    x = np.repeat(c, 50, axis=0) + rng.normal(size=(200, 4)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = embeddings.spherical_kmeans(x, 4, 10)
    assert np.allclose(np.linalg.norm(got, axis=1), 1)
    assert (x @ got.T).max(axis=1).min() > 0.5
