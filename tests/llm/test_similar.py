"""Nearest neighbours against brute force; byte form of vectors."""

import numpy as np
import pytest

from litloom.llm.packing_vectors import pack, unpack
from litloom.llm.similar import nearest_neighbours, similar_pairs


def clustered(n, dim, seed, size=15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size + 1, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    return (np.round(x * 64) / 64).astype(np.float32)


def brute(x, ids, k):
    x = x.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cos, -9)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))[:k]
        out[a] = [ids[j] for j in order]
    return out


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "x", 1) for i, row in zip(ids, x)], "id long, vec array<float>, h string, shard int")


def found(df, k, **kw):
    got: dict = {}
    for r in nearest_neighbours(df, "id", "vec", k, **kw).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    return got


def test_exact_with_factor_one(spark):
    x, ids = clustered(400, 24, 1), np.arange(400) * 3 + 1
    assert found(table(spark, x, ids), 5, factor=1.0, tree_factor=1.0, leaf=32) == brute(x, ids.tolist(), 5)


@pytest.mark.parametrize("shard_rows", [60, 7])
def test_split_shards_find_the_same(spark, shard_rows):
    x, ids = clustered(300, 24, 5, size=150), np.arange(300) * 2
    df = table(spark, x, ids)
    assert found(df, 5, factor=1.0, tree_factor=1.0, leaf=16, shard_rows=shard_rows) == brute(x, ids.tolist(), 5)


def test_every_width_is_searched(spark):
    rng = np.random.default_rng(6)
    wide, slim = clustered(60, 12, 7), clustered(30, 5, 8)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(wide)] + [(1000 + int(i), [float(v) for v in r]) for i, r in enumerate(slim)] + [(5000, [1.0, 2.0])]
    rng.shuffle(rows)
    got = found(spark.createDataFrame([(i, v) for i, v in rows], "id long, vec array<float>"), 4, factor=1.0, tree_factor=1.0)
    assert got == {**brute(wide, list(range(60)), 4), **brute(slim, list(range(1000, 1030)), 4)}


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        nearest_neighbours(spark.createDataFrame([("a", [1.0])], "id string, vec array<float>"), "id", "vec")


def test_recall_of_the_relaxed_search(spark):
    x, ids = clustered(1500, 32, 2), np.arange(1500)
    want = brute(x, ids.tolist(), 10)
    recalls = []
    for factor in (1000.0, 30.0):
        got = found(table(spark, x, ids), 10, factor=factor)
        recalls.append(sum(len(set(want[i]) & set(got[i])) for i in want) / (10 * len(want)))
    assert recalls[1] >= 0.95 and recalls[1] >= recalls[0] > 0.8


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 0.0], "a", 1) for i in range(40)] + [(100, [0.5, 0.0], "a", 1), (101, [0.0, 2.0], "a", 1), (102, None, "a", 1), (103, [0.0, 0.0], "a", 1), (104, [1.0], "a", 1), (105, [float("nan"), 1.0], "a", 1), (106, [], "a", 1)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, h string, shard int")
    got = found(df, 3)
    assert set(got) == {*range(40), 100, 101}  # the vector of width one has no fellow
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2] and got[100] == [0, 1, 2] and got[101] == [0, 1, 2]
    pairs = {tuple(r) for r in similar_pairs(df, "id", "vec", 3).collect()}
    assert (0, 100) in pairs and all(a < b for a, b in pairs)


def test_empty_and_single(spark):
    schema = "id long, vec array<float>"
    assert nearest_neighbours(spark.createDataFrame([], schema), "id", "vec").count() == 0
    assert nearest_neighbours(spark.createDataFrame([(1, None)], schema), "id", "vec").count() == 0
    assert nearest_neighbours(spark.createDataFrame([(1, [1.0, 2.0])], schema), "id", "vec").count() == 0


@pytest.mark.parametrize("scale", [1, 1 / 128, 300, 1 / 3, 1e-30])
def test_byte_form_is_lossless(scale):
    x = (np.random.default_rng(0).integers(-90, 90, (20, 7)) * scale).astype(np.float32)
    x[3] = -0.0
    assert (unpack(pack(x), 7) == x).all() and pack(x)[3] == pack(np.zeros((1, 7), dtype=np.float32))[0]
