"""Cross-document synthesis: construct groups, guarded findings, clusters of future-work statements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import non_blank, pair_key
from ..runtime import cut_lineage
from .store import with_ids


def naming(extractions: DataFrame, labels: list[str]) -> DataFrame:
    """Extractions that name one of the labels exactly."""
    wanted = F.array(*(F.lit(x) for x in labels)).cast("array<string>")
    return extractions.where(F.coalesce(F.arrays_overlap("constructs", wanted), F.lit(False)))


def construct_groups(extractions: DataFrame, min_papers: int = DEFAULT.synthesis.min_papers_per_construct) -> DataFrame:
    """``(construct, paper_id, key_finding)`` of constructs that at least ``min_papers`` papers name, and of those papers with a
    finding if they are as many again."""
    named = extractions.select("paper_id", "key_finding", F.explode(F.array_distinct(F.coalesce("constructs", F.array().cast("array<string>")))).alias("construct"))
    per = named.where("construct is not null").groupBy("construct").agg(F.count("*").alias("n"), F.count_if(non_blank("key_finding")).alias("told"))
    enough = per.where((F.col("n") >= min_papers) & (F.col("told") >= min_papers)).select("construct")
    return named.where(non_blank("key_finding")).join(enough, "construct", "left_semi").select("construct", "paper_id", "key_finding")


def guarded_findings(reported: DataFrame, groups: DataFrame, existing: DataFrame, pos: str = "pos") -> DataFrame:
    """Reported findings ``(pos, construct, paper_a_id, claim_a, paper_b_id, claim_b)`` that may be recorded.

    Both papers must belong to the construct's group, be different and have a claim; the pair, in either direction,
    must not be recorded yet; of equal reports the first by ``pos`` counts.
    """
    key = pair_key("construct", "paper_a_id", "paper_b_id")
    members = groups.select("construct", "paper_id").distinct()
    a, b = (members.withColumnRenamed("paper_id", c) for c in ("paper_a_id", "paper_b_id"))
    sound = reported.where("claim_a is not null and claim_b is not null and paper_a_id <> paper_b_id")
    known = sound.join(a, ["construct", "paper_a_id"], "left_semi").join(b, ["construct", "paper_b_id"], "left_semi").withColumn("pair_key", key)
    fresh = known.join(existing.select(key.alias("pair_key")).distinct(), "pair_key", "left_anti")
    first = Window.partitionBy("pair_key").orderBy(pos)
    return fresh.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").select(*reported.columns, "pair_key")


#: Statements that are assigned together, and so most vectors that pass through the driver or one task at a time.
BLOCK = 4096


def _similarities(seeds: np.ndarray, norms: np.ndarray, v: np.ndarray, size: float) -> np.ndarray:
    """Cosines of a vector with seeds of its width or wider; products are rounded to float, sums are not."""
    top = (seeds[:, : len(v)] * v).astype(np.float64).sum(axis=1)
    return np.divide(top, norms * size, out=np.zeros(len(seeds)), where=norms * size > 0)


def _norm(v: np.ndarray) -> float:
    return float(np.sqrt((v * v).astype(np.float64).sum()))


def seeds_of(vectors: list[np.ndarray], threshold: float, before: list[tuple[float, int] | None] | None = None) -> list[int]:
    """For each vector, in input order, the index of its cluster's seed: itself if it founds one, ``-1 - k`` for seed ``k``
    of those found before.

    A vector joins the cluster whose seed is most similar (equal: the later one) if that reaches the threshold.
    ``before`` gives for each vector the best ``(similarity, k)`` among earlier seeds, or None.
    """
    out: list[int] = []
    width = max((len(v) for v in vectors), default=0)
    seeds, norms, at = np.zeros((16, width), dtype=np.float32), np.zeros(16), []
    for i, vector in enumerate(vectors):
        v = np.asarray(vector, dtype=np.float32)
        size, n = _norm(v), len(at)
        best, score = None, -np.inf
        if before is not None and before[i] is not None:
            score, best = before[i][0], -1 - before[i][1]
        if n:
            sims = _similarities(seeds[:n], norms[:n], v, size)
            k = n - 1 - int(np.argmax(sims[::-1]))
            if sims[k] >= score:
                score, best = sims[k], at[k]
        if best is not None and score >= threshold:
            out.append(best)
            continue
        if n == len(norms):
            seeds, norms = np.concatenate([seeds, np.zeros_like(seeds)]), np.concatenate([norms, norms])
        seeds[n, : len(v)], norms[n] = v, size
        at.append(i)
        out.append(i)
    return out


def cluster_vectors(vectors: list[np.ndarray], threshold: float) -> list[list[int]]:
    """Greedy seed clusters of a bounded list, as lists of indices in the order of their seeds."""
    groups: dict[int, list[int]] = {}
    for i, seed in enumerate(seeds_of(vectors, threshold)):
        groups.setdefault(seed, []).append(i)
    return list(groups.values())


def _best_seeds(seeds: DataFrame, block: list[tuple[int, list[float]]], threshold: float) -> dict[int, tuple[float, int]]:
    """For each ``(rn, vector)`` of a block the best ``(similarity, rn of the seed)``, equal ones to the later, among all seeds."""
    vectors = [(rn, np.asarray(v, dtype=np.float32)) for rn, v in block]

    def compare(batches):
        best: dict[int, tuple[float, int]] = {}
        for b in batches:
            rows = [np.asarray(x, dtype=np.float32) for x in b["vector"]]
            width = max([len(x) for x in rows] + [len(v) for _, v in vectors], default=0)
            m = np.zeros((len(rows), width), dtype=np.float32)
            for k, x in enumerate(rows):
                m[k, : len(x)] = x
            norms, numbers = np.array([_norm(x) for x in rows]), b["rn"].to_numpy()
            for rn, v in vectors if len(rows) else ():
                sims = _similarities(m, norms, v, _norm(v))
                top = sims.max()
                k = int(numbers[sims == top].max())
                if top >= threshold and (rn not in best or best[rn] < (float(top), k)):
                    best[rn] = (float(top), k)
        yield pd.DataFrame([(rn, s, k) for rn, (s, k) in best.items()], columns=["rn", "s", "k"]).astype({"rn": "int64", "s": "float64", "k": "int64"})

    found = seeds.select("rn", "vector").mapInPandas(compare, "rn long, s double, k long").groupBy("rn").agg(F.max(F.struct("s", "k")).alias("m"))
    return {r.rn: (r.m.s, r.m.k) for r in found.collect()}  # at most BLOCK rows


def _assigned(told: DataFrame, threshold: float) -> DataFrame:
    """``(rn, seed)``: the seed's number for each numbered statement ``(rn, vector)``, from 1.

    The statements are taken up in blocks of ``BLOCK`` in their order. A block is compared with all seeds found so far,
    which stay distributed, and then folded by itself, which bounds what the driver holds by a block.
    """
    spark = told.sparkSession
    seeds, links, low = told.select("rn", "vector").limit(0), spark.createDataFrame([], "rn long, seed long"), 1
    while True:
        rows = [(r.rn, r.vector) for r in told.where(F.col("rn").between(low, low + BLOCK - 1)).select("rn", "vector").orderBy("rn").collect()]
        if not rows:
            return links
        known = _best_seeds(seeds, rows, threshold) if low > 1 else {}
        found = seeds_of([v for _, v in rows], threshold, [known.get(rn) for rn, _ in rows])
        pairs = [(rn, rows[k][0] if k >= 0 else -1 - k) for (rn, _), k in zip(rows, found)]
        links = links.unionByName(spark.createDataFrame(pairs, links.schema))
        if len(rows) < BLOCK:  # the last block
            return links
        links = cut_lineage(links)
        fresh = spark.createDataFrame([(rn, s) for rn, s in pairs if rn == s], links.schema).select("rn")
        seeds = cut_lineage(seeds.unionByName(told.join(fresh, "rn", "left_semi").select("rn", "vector")))
        low += BLOCK


def future_work_clusters(
    statements: DataFrame, threshold: float = DEFAULT.synthesis.future_work_similarity, min_papers: int = DEFAULT.synthesis.min_papers_per_construct
) -> DataFrame:
    """``(cluster, theme, paper_ids, paper_count)`` of ``(pos, paper_id, statement, vector)``.

    Clusters need ``min_papers`` members and distinct papers; the theme is the shortest statement, the first of equals.
    Clusters are numbered by their first statements, paper ids stand in the order of the statements. Blank statements and
    null vectors take no part; too few statements give no clusters. ``pos`` is unique.
    """
    told = cut_lineage(statements.where(non_blank("statement") & F.col("vector").isNotNull()).select("pos", "paper_id", "statement", "vector"))
    numbered = cut_lineage(told.join(with_ids(told.select("pos"), "pos"), "pos"))
    members = numbered.select("rn", "paper_id", "statement").join(_assigned(numbered, threshold), "rn")
    papers = members.groupBy("seed", "paper_id").agg(F.min("rn").alias("first"), F.count("*").alias("n"), F.min(F.struct(F.length("statement").alias("size"), "rn", "statement")).alias("short"))
    groups = papers.groupBy("seed").agg(
        F.sum("n").alias("members"), F.count("*").cast("int").alias("paper_count"), F.min("short").alias("short"), F.array_sort(F.collect_list(F.struct("first", "paper_id"))).alias("listed")
    )
    kept = cut_lineage(groups.where((F.col("members") >= min_papers) & (F.col("paper_count") >= min_papers)))
    order = with_ids(kept.select("seed"), "seed").select("seed", (F.col("rn") - 1).cast("int").alias("cluster"))
    return kept.join(order, "seed").select("cluster", F.col("short.statement").alias("theme"), F.transform("listed", lambda x: x["paper_id"]).alias("paper_ids"), "paper_count")


def cluster_citekeys(clusters: DataFrame, papers: DataFrame) -> DataFrame:
    """Clusters with ``citekeys``, sorted; ids without a paper are left out. Most papers first."""
    each = clusters.select("cluster", F.explode("paper_ids").alias("paper_id"))
    keys = each.join(papers.select(F.col("id").alias("paper_id"), "citekey"), "paper_id").groupBy("cluster").agg(F.array_sort(F.collect_list("citekey")).alias("citekeys"))
    return clusters.join(keys, "cluster", "left").withColumn("citekeys", F.coalesce("citekeys", F.array().cast("array<string>"))).orderBy(F.desc("paper_count"), "cluster")


def with_citekeys(extractions: DataFrame, papers: DataFrame) -> DataFrame:
    """Extractions with the citekeys of their papers."""
    return extractions.join(papers.select(F.col("id").alias("paper_id"), "citekey"), "paper_id")


def on_construct(contradictions: DataFrame, construct: str | None) -> DataFrame:
    """Findings on one construct, letter case aside; all for None."""
    return contradictions if construct is None else contradictions.where(F.lower("construct") == construct.lower())


def contradiction_rows(contradictions: DataFrame, papers: DataFrame) -> DataFrame:
    """Findings with the citekeys and titles of both papers."""
    a = papers.select(F.col("id").alias("paper_a_id"), F.col("citekey").alias("citekey_a"), F.col("title").alias("title_a"))
    b = papers.select(F.col("id").alias("paper_b_id"), F.col("citekey").alias("citekey_b"), F.col("title").alias("title_b"))
    return contradictions.join(a, "paper_a_id").join(b, "paper_b_id").select(
        "id", "construct", "citekey_a", "title_a", "claim_a", "citekey_b", "title_b", "claim_b", "possible_moderator", "reviewed", "verdict"
    )


def findings_prompt(groups: DataFrame, papers: DataFrame) -> DataFrame:
    """``(construct, prompt)``: the findings of a group's papers, one a line, by citekey."""
    told = groups.join(papers.select(F.col("id").alias("paper_id"), "citekey"), "paper_id")
    lines = F.array_sort(F.collect_list(F.concat(F.lit("["), "citekey", F.lit("] "), "key_finding")))
    return told.groupBy("construct").agg(F.concat(F.lit("Findings on "), F.first("construct"), F.lit(":\n"), F.array_join(lines, "\n")).alias("prompt"))
