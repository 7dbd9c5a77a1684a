"""Hybrid retrieval: an exact vector arm and a full-text arm, fused by reciprocal rank.

Each arm filters first, ranks the whole filtered corpus and keeps a pool; arms carry only ids and ranks, texts are
joined back for the final hits. Ties always go to the smaller id. The text arm matches as search boxes do: English words
by their stems, stop words left out, bare words must all occur, ``or`` separates alternatives, ``-`` excludes, quoted words
must stand together. It scores by BM25 over stems.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Search
from ..functions.similarity import distance_to
from ..functions.stemming import SPECIAL, STOP_WORDS, stem
from ..functions.text import citation_marker, non_blank

K1, B = 1.2, 0.75


def filtered(chunks: DataFrame, sections: list[str] | None = None, paper_ids: list[int] | None = None) -> DataFrame:
    """Chunks of the named sections and papers; an empty list, or one of nulls only, filters nothing."""
    for column, wanted in (("canonical_section", sections), ("paper_id", paper_ids)):
        kept = [x for x in wanted or [] if x is not None]
        if kept:
            chunks = chunks.where(F.col(column).isin(kept))
    return chunks


def ranked(df: DataFrame, order: list[Column], pool: int) -> DataFrame:
    """The first ``pool`` rows with their ``rank``; Spark keeps only ``pool`` rows per task before it numbers them."""
    w = Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def vector_arm(chunks: DataFrame, query: list[float], pool: int) -> DataFrame:
    """``(id, distance, rank)`` of the nearest chunks by cosine distance; chunks without embedding take no part, all-zero ones come last."""
    scored = chunks.where(F.col("embedding").isNotNull()).select("id", distance_to(F.col("embedding"), query).alias("distance"))
    return ranked(scored, [F.round("distance", 12).asc_nulls_last(), F.col("id")], pool)


class Phrase(NamedTuple):
    """Stems that stand together, None for any word (a stop word's place); a single word is a phrase of one."""

    stems: tuple[str | None, ...]
    wanted: bool


def parse_query(query: str) -> list[list[Phrase]]:
    """Alternatives of phrases: ``routes -b or "c of d"`` is ``[[rout, not b], [c * d]]``; stop words alone are nothing."""
    groups: list[list[Phrase]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query or ""):
        if word.lower() == "or":
            groups.append([])
            continue
        wanted = not (minus or word.startswith("-"))
        stems = [None if t in STOP_WORDS else stem(t) for t in re.split("[^a-z0-9]+", (quoted or word).lower()) if t]
        while stems and stems[0] is None:
            stems = stems[1:]
        while stems and stems[-1] is None:
            stems = stems[:-1]
        if stems:
            groups[-1].append(Phrase(tuple(stems), wanted))
    return [g for g in groups if g]


def _begins(stem_: str) -> list[str]:
    """What words of a stem begin with."""
    return [stem_[:-1] or stem_, *(w for w, s in SPECIAL.items() if s == stem_)]


def _may_hold(stem_: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col("low").contains(x) for x in _begins(stem_)))


def word_forms(low: DataFrame, stems: list[str]) -> dict[str, list[str]]:
    """The words of the texts ``low(low)`` that have one of the stems. Only words that begin like a stem are taken out of
    the texts, made distinct and stemmed where they are; the few forms of the asked stems reach the driver."""
    starts = sorted({x for s in stems for x in _begins(s)})

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem)

    found = low.where(reduce(lambda a, b: a | b, map(_may_hold, stems)))
    words = found.select(F.explode(F.regexp_extract_all("low", F.lit(f"(?<![a-z0-9])((?:{'|'.join(starts)})[a-z0-9]*)"), F.lit(1))).alias("word")).distinct()
    out: dict[str, list[str]] = {s: [] for s in stems}
    for r in words.select("word", stemmed("word").alias("stem")).where(F.col("stem").isin(stems)).orderBy("word").collect():
        out[r.stem].append(r.word)
    return out


def _alone(phrase: Sequence[str | None], forms: dict[str, list[str]]) -> str:
    """Pattern of a phrase's words in any form, between other characters than letters and digits."""
    words = ["[a-z0-9]+" if s is None else f"(?:{'|'.join(sorted(forms[s], key=lambda w: (-len(w), w)))})" for s in phrase]
    return "(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])"


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` of the chunks that match; statistics come from all chunks given.

    Occurrences are counted in the text as it stands, without making token arrays: one pass for the forms of the words,
    one for the statistics, and one over the texts that hold the words for their scores. Excluded words don't score.
    """
    groups = parse_query(query)
    nothing = chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    stems = sorted({s for g in groups for p in g for s in p.stems if s is not None})
    if not stems:
        return nothing
    low = chunks.select("id", F.lower("content").alias("low"))
    forms = word_forms(low, stems)
    terms = [s for s in sorted({s for g in groups for p in g if p.wanted for s in p.stems if s is not None}) if forms[s]]
    counts = [F.regexp_count("low", F.lit(_alone([t], forms))).alias(f"tf{i}") for i, t in enumerate(terms)]
    # a text without content has no tokens but counts as a chunk
    lengths = F.coalesce(F.regexp_count("low", F.lit("[a-z0-9]+")), F.lit(0)).alias("length")
    seen = [F.count_if(_may_hold(t) & (c > 0)).alias(f"df{i}") for i, (t, c) in enumerate(zip(terms, counts))]
    row = low.agg(F.count("*").alias("n"), F.avg(lengths).alias("mean"), *seen).first()
    n, mean = row["n"], row["mean"] or 1.0

    def holds(phrase: Phrase) -> Column:
        if not all(forms[s] for s in phrase.stems if s is not None):
            here = F.lit(False)
        else:
            words = reduce(lambda a, b: a & b, (_may_hold(s) for s in phrase.stems if s is not None))
            here = F.coalesce(words & F.col("low").rlike(_alone(phrase.stems, forms)), F.lit(False))
        return here if phrase.wanted else ~here

    match = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, g)) for g in groups))
    parts = [F.lit(0.0).cast("double")]
    for i in range(len(terms)):
        df, tf = row[f"df{i}"], F.col(f"tf{i}").cast("double")
        idf = math.log(1.0 + (n - df + 0.5) / (df + 0.5))
        parts.append(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))))
    return low.where(match).select("id", lengths, *counts).select("id", F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)).alias("score"))


def text_arm(chunks: DataFrame, query: str, pool: int) -> DataFrame:
    return ranked(bm25(chunks, query), [F.round("score", 9).desc(), F.col("id")], pool)


def fuse(arms: list[DataFrame], k: int = DEFAULT.search.rrf_k) -> DataFrame:
    """``(id, score)``: the sum of ``1 / (k + rank)`` over the arms that hold the id."""
    union = reduce(DataFrame.unionByName, (a.select("id", "rank") for a in arms))
    return union.groupBy("id").agg(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank"))).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    if k < 0:
        raise ValueError("top_k must not be negative")
    return scored.orderBy(F.round("score", 12).desc(), "id").limit(k)


def hybrid_search(
    chunks: DataFrame, query: str, vector: list[float], top_k: int | None = None, sections: list[str] | None = None,
    paper_ids: list[int] | None = None, config: Search = DEFAULT.search,
) -> DataFrame:
    """``(id, score)`` of the best chunks. A blank query gives no rows; ``top_k`` defaults to the configuration's."""
    k = config.default_top_k if top_k is None else top_k
    if not query or not query.strip():
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    kept = filtered(chunks, sections, paper_ids)
    return top(fuse([vector_arm(kept, vector, config.candidate_pool), text_arm(kept, query, config.candidate_pool)], config.rrf_k), k)


def hydrate(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with their texts and citations, in the order of the hits; hits whose chunk is gone are dropped.

    Hits are at most ``top_k`` rows, so they travel to the chunks and papers.
    """
    c = chunks.select("id", "paper_id", "section", "canonical_section", "page", "content")
    p = papers.select(F.col("id").alias("paper_id"), "citekey", "title")
    found = c.join(F.broadcast(hits), "id")
    full = p.join(F.broadcast(found), "paper_id")
    return full.select(
        "id", "citekey", "title", "section", "canonical_section", "page", "content", "score", citation_marker("citekey", "page").alias("marker")
    ).orderBy(F.round("score", 12).desc(), "id")


def evidence_block(hits: DataFrame) -> DataFrame:
    """One row ``evidence``: the hits' contents in order, each behind its citation marker."""
    line = F.concat("marker", F.lit(" "), "content")
    listed = F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "id", line.alias("line"))))
    return hits.where(non_blank("content")).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("evidence"))
