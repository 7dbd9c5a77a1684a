"""Problem 3 - the k most similar vectors of every vector.

A bounded sample of the rows, drawn evenly by hash, gives the vantage points: sampled rows, moved to the middle of the
sampled rows near them. They divide the collection into shards (the cell of the nearest vantage point), which so follow
the data's own density. A vector goes to its own shard and to every shard that the triangle inequality, relaxed by
``factor``, does not rule out; in each shard a vantage-point tree answers all of the shard's vectors at once. With
``factor=1`` and ``tree_factor=1`` only impossible shards and branches are left out, so the search is exact; larger
factors prune what is unlikely. Every row is indexed and searched.

Bounds used, with ``tau`` an upper bound of the distance to the k-th neighbour (at first that to the k-th nearest of the
sampled rows that began the vantage points, in a tree that to the k-th found so far; the trees' tighter ``tau`` goes with
a smaller factor of their own, ``tree_factor``): a shard whose vantage point is ``d_s`` away holds nothing closer than
``(d_s - d_home) / 2``; the far side of a tree node holds nothing closer than ``|d - mu|``.

A shard of more than ``shard_rows`` rows is cut into blocks by hash and searched block against block, each pair of blocks
a group of its own: the same neighbours come out, and no group holds more than about twice that many rows. A list that
stays short because its shard is small is completed from the sampled rows, which every task knows.

Exact copies of a vector are searched once and expanded afterwards, so a vector that a third of all rows share costs
one search.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing_vectors import pack, unpack

#: Most vantage points, and so most vectors in a worker's closure (twice).
MAX_VANTAGE = 8192
#: Sampled rows for each vantage point, and most of all: these are the vectors that reach the driver.
SAMPLE_EACH, MAX_SAMPLE = 24, 65_536
#: Times that the vantage points move to the middle of their sampled rows.
ROUNDS = 3
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x))[:, None].astype(np.float32)


def _distance(sim: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors from their cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sim))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the usable vectors of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(at)).flatten().cast(pa.float32())
    x = np.asarray(values.fill_null(float("nan")), dtype=np.float32).reshape(len(at), dim)
    with np.errstate(over="ignore"):
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def _middles(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Unit vectors moved to the middle of the rows of ``x`` that are nearest to them; those without rows stay."""
    points = start.copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(x[lo : lo + 4096] @ points.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        present, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        ok = size > 1e-9
        points[present[ok]] = (sums[ok] / size[ok, None]).astype(np.float32)
    return points


class _Tree:
    """Vantage-point tree over unit vectors, searched for all of them together."""

    def __init__(self, x: np.ndarray, k: int, factor: float, leaf: int):
        self.x, self.k, self.factor, self.leaf = x, k, factor, leaf
        n = len(x)
        self.best = np.full((n, k), -2.0, dtype=np.float32)
        self.who = np.full((n, k), -1, dtype=np.int32)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        root = self._build(np.arange(len(self.x)), 0)
        self._visit(root, np.arange(len(self.x)))
        return self.who, self.best

    def _build(self, at: np.ndarray, depth: int):
        if len(at) <= self.leaf:
            return at
        vp = self.x[at[(depth * 7919) % len(at)]]
        d = _distance(self.x[at] @ vp)
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        mu = d[order[half]]
        return vp, mu, self._build(at[order[:half]], depth + 1), self._build(at[order[half:]], depth + 1)

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, q)
            return
        vp, mu, inner, outer = node
        d = _distance(self.x[q] @ vp)
        near = d < mu
        self._visit(inner, q[near])
        self._visit(outer, q[~near])
        tau = _distance(self.best[q, -1])
        far = self.factor * np.abs(d - mu) <= tau
        self._visit(outer, q[near & far])
        self._visit(inner, q[~near & far])

    def _scan(self, leaf: np.ndarray, q: np.ndarray) -> None:
        for lo in range(0, len(q), 2048):
            part = q[lo : lo + 2048]
            sim = self.x[part] @ self.x[leaf].T
            sim[part[:, None] == leaf[None, :]] = -2.0
            m = min(self.k, sim.shape[1])
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            sims = np.concatenate([self.best[part], np.take_along_axis(sim, top, 1)], axis=1)
            whos = np.concatenate([self.who[part], leaf[top].astype(np.int32)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : self.k]
            self.best[part] = np.take_along_axis(sims, order, 1)
            self.who[part] = np.take_along_axis(whos, order, 1)


def _search_shard(t: pa.Table, dim: int, k: int, factor: float, leaf: int, vantage: np.ndarray, vantage_ids: list[list[int]]) -> pa.Table:
    packed = t.column("packed").to_pylist()
    raw = unpack(packed, dim)
    who, best = _Tree(_unit(raw), k + 6, factor, leaf).run()
    ids = t.column("ids").combine_chunks()
    lengths = np.asarray(ids.value_lengths())
    flat, offset = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
    width = int(lengths.max(initial=1))
    member = np.full((len(raw) + 1, width), np.iinfo(np.int64).max)  # the last row stands for "nobody"
    member[:-1][np.arange(width) < lengths[:, None]] = flat
    squares = np.einsum("ij,ij->i", raw, raw, dtype=np.float64)
    out_ids, out_cos = [], []
    for lo in range(0, len(raw), 512):
        w = who[lo : lo + 512]
        dots = np.einsum("qd,qkd->qk", raw[lo : lo + 512], raw[w], dtype=np.float64)
        cos = np.round(dots / np.sqrt(squares[lo : lo + 512, None] * squares[w]), 9)
        cos[w < 0] = -9.0
        mem = member[w].reshape(len(w), -1)
        far = np.where(mem == np.iinfo(np.int64).max, 9.0, -np.repeat(cos, width, axis=1))
        order = np.argsort(mem, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), axis=1, kind="stable"), 1)[:, :k]
        out_ids.append(np.take_along_axis(mem, order, 1))
        out_cos.append(np.take_along_axis(far, order, 1))
    mem, far = np.concatenate(out_ids), np.concatenate(out_cos)
    if far.shape[1] < k:
        gap = ((0, 0), (0, k - far.shape[1]))
        mem, far = np.pad(mem, gap), np.pad(far, gap, constant_values=9.0)
    real = far < 9.0
    for i in np.flatnonzero(real.sum(axis=1) < k):
        # too few rows in this shard: the vantage points, rows as well, complete the list
        dots = vantage.astype(np.float64) @ raw[i].astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", vantage, vantage, dtype=np.float64) * squares[i])
        own = set(flat[offset[i] : offset[i + 1]].tolist())
        more = {(-round(float(c), 9), m) for c, ids_ in zip(dots / norms, vantage_ids) for m in ids_ if m not in own}
        best_ = sorted(more | set(zip(far[i][real[i]].tolist(), mem[i][real[i]].tolist())))[:k]
        far[i, : len(best_)], mem[i, : len(best_)] = [x for x, _ in best_], [x for _, x in best_]
        real[i, : len(best_)] = True
    offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(far[real]), pa.array(mem[real])], names=["far", "id"])
    return pa.table({"h": t.column("h"), "ids": t.column("ids"), "near": pa.ListArray.from_arrays(offsets, pairs)})


def nearest_neighbours(
    df: DataFrame, id_col: str, vec_col: str, k: int = 10, factor: float = 100.0, tree_factor: float = 10.0, n_vantage: int | None = None, leaf: int = 512, shard_rows: int = 25_000
) -> DataFrame:
    """``(id, neighbour, rank, cosine)``: up to ``k`` neighbours of each usable vector by cosine, equal cosines by smaller id.

    Usable are vectors without null, NaN or infinite components that are not all zero; other rows neither ask nor answer.
    Vectors of different width are not compared: each width that occurs is a search of its own. Rows with equal vectors
    are neighbours of each other (cosine 1). Ids are whole numbers, anything else is an error; rows without id take no
    part. ``n_vantage`` defaults to the square root of the row count, 16 to 8192. An empty input gives no rows.
    """
    if dict(df.dtypes)[id_col] not in INTEGERS:
        raise TypeError(f"ids must be whole numbers, {id_col} is {dict(df.dtypes)[id_col]}")
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v is not null and id is not null and size(v) > 0")
    widths = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").collect()  # one row a width
    found = [_neighbours(base.where(F.size("v") == r["w"]), r["w"], r["count"], k, factor, tree_factor, n_vantage, leaf, shard_rows) for r in widths]
    found = [x for x in found if x is not None]
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], "id long, neighbour long, rank int, cosine double")


def _neighbours(base: DataFrame, dim: int, n: int, k: int, factor: float, tree_factor: float, n_vantage: int | None, leaf: int, shard_rows: int) -> DataFrame | None:
    """``nearest_neighbours`` among ``n`` vectors of one width; None if none is usable."""
    want = n_vantage or min(MAX_VANTAGE, max(16, math.isqrt(n)))
    # rows whose hash is below a bound, so that no task has to order them; each row once however often it is repeated
    size, spread = max(2 * want, min(SAMPLE_EACH * want, MAX_SAMPLE)), 2**30
    even = base.select("v", F.xxhash64("v").alias("x"), F.xxhash64("id", "v", F.lit(17)).alias("o")).where(F.pmod("o", F.lit(spread)) < math.ceil(spread * min(1.0, size / n)))
    drawn = even.dropDuplicates(["o"]).toArrow().sort_by("o")
    at, x = _matrix(drawn.column("v"), dim)
    by_vector = dict(zip(reversed(pack(x)), np.asarray(drawn.column("x"))[at][::-1].tolist()))
    sampled = list(reversed(by_vector))
    if not sampled:
        return None
    kept = sampled[:want]
    raw_vantage = unpack(kept, dim)
    vantage = _unit(raw_vantage)
    points = _middles(_unit(unpack(sampled, dim)), vantage)
    place = {r: i for i, r in enumerate(kept)}
    digests = [xxhash.xxh3_128_digest(r) for r in kept]

    def keyed(batches):
        for b in batches:
            at, x = _matrix(b.column("v"), dim)
            rows = pack(x)
            yield pa.record_batch(
                {
                    "id": b.column("id").take(pa.array(at)),
                    "h": pa.array([xxhash.xxh3_128_digest(r) for r in rows], pa.binary()),
                    "packed": pa.array(rows, pa.binary()),
                }
            )

    rows = base.mapInArrow(keyed, "id long, h binary, packed binary")
    smallest = rows.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("rn") <= k + 1)
    distinct = smallest.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("packed", "id").alias("packed"))
    wanted = set(digests)

    def of_vantage(batches):
        for b in batches:
            at, x = _matrix(b.column("v"), dim)
            hit = [(i, r) for i, r in zip(at.tolist(), pack(x)) if xxhash.xxh3_128_digest(r) in wanted]
            yield pa.record_batch({"id": b.column("id").take(pa.array([i for i, _ in hit], pa.int64())), "packed": pa.array([r for _, r in hit], pa.binary())})

    # at most k + 1 of the rows that share a vantage point's vector
    alike = base.where(F.xxhash64("v").isin(sorted({by_vector[r] for r in kept})))
    copies = alike.mapInArrow(of_vantage, "id long, packed binary").withColumn("rn", F.row_number().over(Window.partitionBy("packed").orderBy("id"))).where(F.col("rn") <= k + 1)
    vantage_ids: list[list[int]] = [[] for _ in kept]
    for r in copies.select("id", "packed").toLocalIterator():
        vantage_ids[place[bytes(r["packed"])]].append(r["id"])

    def shards(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that a row goes to."""
        d = _distance(x @ points.T)
        home = d.min(axis=1, keepdims=True)
        tau = np.full(len(x), 2.0)
        if len(vantage) > k + 1:
            tau = _distance(np.partition(x @ vantage.T, -(k + 2), axis=1)[:, -(k + 2)])
        return np.nonzero(factor * (d - home) / 2 <= tau[:, None])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, shard = shards(_unit(unpack(b.column("packed").to_pylist(), dim)))
            part = b.take(pa.array(q))
            yield pa.record_batch({"shard": pa.array(shard.astype(np.int32)), **{c: part.column(c) for c in ("h", "ids", "packed")}})

    def sizes(batches):
        total = np.zeros(len(points), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(shards(_unit(unpack(b.column("packed").to_pylist(), dim)))[1], minlength=len(points))
        yield pa.record_batch({"shard": pa.array(np.arange(len(points), dtype=np.int32)), "n": pa.array(total)})

    # blocks of the shards: one row a shard, so bounded by the vantage points
    blocks = distinct.mapInArrow(sizes, "shard int, n long").groupBy("shard").agg(F.greatest(F.ceil(F.sum("n") / shard_rows), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    routed = distinct.mapInArrow(route, "shard int, h binary, ids array<long>, packed binary").join(F.broadcast(blocks), "shard").withColumn("own", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    routed = routed.withColumn("pair", F.explode(pair)).select("shard", "pair.i", "pair.j", "h", "ids", "packed")
    found = routed.groupBy("shard", "i", "j").applyInArrow(
        lambda t: _search_shard(t, dim, k, tree_factor, leaf, raw_vantage, vantage_ids), "h binary, ids array<long>, near array<struct<far:double,id:long>>"
    )
    lists = found.groupBy("h").agg(
        F.first("ids").alias("ids"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")
    )
    copies_first: Column = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id")))
    members = rows.select("id", "h").join(lists, "h")
    ranked = F.slice(F.array_sort(F.filter(F.concat(copies_first, "near"), lambda s: s["id"] != F.col("id"))), 1, k)
    return members.select("id", F.posexplode(ranked).alias("pos", "n")).select(
        "id", F.col("n.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("n.far")).alias("cosine")
    )


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 10, factor: float = 100.0, **kw) -> DataFrame:
    """``(a, b)``, a < b, distinct: one of the two is among the other's ``k`` nearest (see ``nearest_neighbours``)."""
    n = nearest_neighbours(df, id_col, vec_col, k, factor, **kw)
    return n.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
