"""Stored indexes for search: postings by stem for the text arm, cells of near vectors for the vector arm.

A search reads the buckets of its words and the cells near its vector; partition pruning keeps the rest unread. The text
index gives exactly what a scan gives. The vector index is approximate while fewer cells are probed than there are.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Search
from ..functions.stemming import STOP_WORDS, stem
from . import retrieval
from .retrieval import K1, B, Phrase

#: Folders the postings lie in by stem, and files a folder's postings are spread over by text, for words that most texts hold.
BUCKETS, SPREAD = 64, 4
#: Most cells of a vector index, and sampled vectors for each, which are what the driver sees.
MAX_CELLS, SAMPLE_EACH = 4096, 16


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _postings(batches):
    for b in batches:
        stems, ids, counts, sizes = [], [], [], []
        for i, text in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist()):
            tokens = text or []
            seen = Counter(stem(t) for t in tokens if t not in STOP_WORDS)
            stems += seen.keys()
            counts += seen.values()
            ids += [i] * len(seen)
            sizes += [len(tokens)] * len(seen)
        yield pa.record_batch({"stem": pa.array(stems, pa.string()), "id": pa.array(ids, pa.int64()), "tf": pa.array(counts, pa.int32()), "length": pa.array(sizes, pa.int32())})


def write_text_index(chunks: DataFrame, path: str) -> None:
    """Writes ``postings(bucket, stem, id, tf, length)`` and ``stats(n, mean)`` of the chunks' contents under ``path``."""
    tokens = chunks.select(F.col("id").cast("long").alias("id"), F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    rows = tokens.mapInArrow(_postings, "stem string, id long, tf int, length int").withColumn("bucket", _bucket(F.col("stem")))
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "stem", "id")
    spread.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    tokens.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("tokens"), F.lit(0))).alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")


def indexed_bm25(spark: SparkSession, path: str, chunks: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` as ``retrieval.bm25`` gives it, from the postings of the query's words.

    Phrases are looked for in the texts of the chunks that hold all their words. A query with an alternative that only
    excludes fits almost every chunk; it is answered by a scan.
    """
    groups = retrieval.parse_query(query)
    if not groups or not all(any(p.wanted for p in g) for g in groups):
        return retrieval.bm25(chunks, query)
    stems = sorted({s for g in groups for p in g for s in p.stems if s is not None})
    scored = sorted({s for g in groups for p in g if p.wanted for s in p.stems if s is not None})
    buckets = [r.b for r in spark.createDataFrame([(s,) for s in stems], "stem string").select(_bucket(F.col("stem")).alias("b")).distinct().collect()]
    rows = spark.read.schema("stem string, id long, tf int, length int, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("stem").isin(stems))
    df = {r.stem: r["count"] for r in rows.groupBy("stem").count().collect()}  # one row a word of the query
    stats = spark.read.parquet(f"{path}/stats").first()
    n, mean = stats.n, stats.mean or 1.0
    tf = {s: F.coalesce(F.sum(F.when(F.col("stem") == s, F.col("tf"))), F.lit(0)).cast("double").alias(f"tf{i}") for i, s in enumerate(stems)}
    place = {s: F.col(f"tf{i}") for i, s in enumerate(stems)}
    held = rows.groupBy("id").agg(F.max("length").alias("length"), *tf.values())

    def all_words(p: Phrase) -> Column:
        return reduce(lambda a, b: a & b, (place[s] > 0 for s in p.stems if s is not None))

    phrases = sorted({p.stems for g in groups for p in g if len(p.stems) > 1}, key=str)
    may = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (all_words(p) for p in g if p.wanted)) for g in groups))
    held = held.where(may)
    if phrases:
        low = chunks.select("id", F.lower("content").alias("low")).join(held, "id")
        forms = retrieval.word_forms(low.select("low"), stems)
        patterns = [F.col("low").rlike(retrieval._alone(p, forms)) if all(forms[s] for s in p if s is not None) else F.lit(False) for p in phrases]
        held = low.select(*held.columns, *(x.alias(f"p{i}") for i, x in enumerate(patterns)))

    def holds(p: Phrase) -> Column:
        here = F.col(f"p{phrases.index(p.stems)}") if len(p.stems) > 1 else all_words(p)
        return here if p.wanted else ~here

    match = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, g)) for g in groups))
    parts = [F.lit(0.0).cast("double")]
    for s in scored:
        idf = math.log(1.0 + (n - df.get(s, 0) + 0.5) / (df.get(s, 0) + 0.5))
        parts.append(F.lit(idf) * place[s] * (K1 + 1) / (place[s] + K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))))
    return held.where(match).select("id", reduce(lambda a, b: a + b, parts).alias("score"))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the vectors of a width that are neither all zero nor unreadable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    x = np.asarray(column.take(pa.array(at)).flatten().cast(pa.float32()).fill_null(float("nan")), dtype=np.float32).reshape(len(at), dim)
    size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    good = np.isfinite(size) & (size > 0)
    return at[good], (x[good] / size[good, None]).astype(np.float32)


def write_vector_index(chunks: DataFrame, path: str, cells: int | None = None, rounds: int = 4) -> None:
    """Writes ``rows(cell, id, embedding)`` and ``cells(cell, middle)`` under ``path``.

    The cells are those of points in the middle of sampled vectors (at most ``SAMPLE_EACH`` a cell); their number defaults
    to the square root of the rows, at most ``MAX_CELLS``. Vectors of another width than the most frequent one and all-zero
    ones, which a search finds last or never, lie in cell -1, which every search reads.
    """
    spark = chunks.sparkSession
    base = chunks.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    widths = base.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    dim, n = (widths[0].w, widths[0]["count"]) if widths else (0, 0)
    want = cells or min(MAX_CELLS, max(1, math.isqrt(n)))
    share = min(1.0, SAMPLE_EACH * want / max(1, n))
    order = F.xxhash64("id", F.lit(5))
    drawn = base.where(F.pmod(order, F.lit(2**30)) < math.ceil(2**30 * share)).select("embedding", order.alias("o")).toArrow().sort_by("o")
    _, x = _matrix(drawn.column("embedding"), dim)
    points = x[:want].copy()
    for _ in range(rounds if len(x) else 0):
        home = (x @ points.T).argmax(axis=1)
        for k in range(len(points)):
            middle = x[home == k].sum(axis=0)
            if (size := float(np.linalg.norm(middle))) > 1e-9:
                points[k] = middle / size

    def assign(batches):
        for b in batches:
            at, y = _matrix(b.column("embedding"), dim)
            cell = np.full(b.num_rows, -1, dtype=np.int32)
            if len(points) and len(at):
                cell[at] = (y @ points.T).argmax(axis=1)
            yield b.append_column("cell", pa.array(cell))

    rows = base.mapInArrow(assign, "id long, embedding array<float>, cell int")
    rows.repartition("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, middle array<float>").write.mode("overwrite").parquet(f"{path}/cells")


def indexed_vector_arm(spark: SparkSession, path: str, query: list[float], pool: int, probes: int = 16) -> DataFrame:
    """``(id, distance, rank)`` of the nearest chunks in the ``probes`` cells nearest to the query; more cells are taken
    while these hold less than ``pool`` rows."""
    cells = spark.read.schema("cell int, middle array<float>").parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS rows
    rows = spark.read.schema("id long, embedding array<float>, cell int").parquet(f"{path}/rows")
    order: list[int] = []
    if cells and len(query) == len(cells[0].middle):
        near = np.array([c.middle for c in cells]) @ np.asarray(query, dtype=np.float64)
        order = [cells[i].cell for i in np.argsort(-near, kind="stable")]
    while True:
        some = rows.where(F.col("cell").isin([-1, *order[:probes]]))
        if probes >= len(order) or some.limit(pool).count() >= pool:
            return retrieval.vector_arm(some if order else rows, query, pool)
        probes *= 2


def indexed_search(spark: SparkSession, path: str, chunks: DataFrame, query: str, vector: list[float], top_k: int | None = None, config: Search = DEFAULT.search, probes: int = 16) -> DataFrame:
    """``(id, score)`` as ``retrieval.hybrid_search`` over all chunks gives it, from indexes under ``path/text`` and ``path/vector``."""
    k = config.default_top_k if top_k is None else top_k
    if not query or not query.strip():
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    words = retrieval.ranked(indexed_bm25(spark, f"{path}/text", chunks, query), [F.round("score", 9).desc(), F.col("id")], config.candidate_pool)
    return retrieval.top(retrieval.fuse([indexed_vector_arm(spark, f"{path}/vector", vector, config.candidate_pool, probes), words], config.rrf_k), k)
