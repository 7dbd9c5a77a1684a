"""Construct coverage: which papers mention a construct in which section, and where none does.

A construct is mentioned where its text stands in a chunk's content, letter case aside, inside words as well. All
constructs of a block are looked for in one pass over the contents by an automaton; only the constructs travel, as one
broadcast a block, and the driver holds one block at a time.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GRID_SECTIONS

#: Constructs that one pass over the chunks carries.
BLOCK = 100_000


def distinct_constructs(extractions: DataFrame) -> DataFrame:
    """``(construct)``: every distinct non-null label, in order."""
    return extractions.select(F.explode("constructs").alias("construct")).where("construct is not null").distinct().orderBy("construct")


def _matcher(sent: Broadcast):
    def run(batches):
        block = sent.value
        low = sorted({c.lower() for c in block if c})
        by_low: dict[str, list[str]] = {}
        for c in block:
            by_low.setdefault(c.lower(), []).append(c)
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for c in low:
                automaton.add_word(c, c)
            automaton.make_automaton()
            find = (lambda text: {v for _, v in automaton.iter(text)}) if low else (lambda text: set())
        except ImportError:
            find = lambda text: {c for c in low if c in text}
        always = by_low.get("", [])
        for b in batches:
            rows, names = [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                if text is None:
                    continue
                hits = [c for x in find(text.lower()) for c in by_low[x]] + always
                rows += [i] * len(hits)
                names += hits
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column(c).take(at) for c in ("paper_id", "canonical_section")] + [pa.array(names, pa.string())], names=["paper_id", "canonical_section", "construct"])

    return run


def mentions(chunks: DataFrame, constructs: DataFrame) -> DataFrame:
    """``(paper_id, canonical_section, construct)``, distinct; chunks without a section don't count."""
    base = chunks.where(F.col("canonical_section").isNotNull()).select("paper_id", "canonical_section", "content")
    sc, sent, block = base.sparkSession.sparkContext, [], []
    for r in constructs.select("construct").where("construct is not null").distinct().toLocalIterator():
        block.append(r.construct)
        if len(block) == BLOCK:
            sent.append(sc.broadcast(block))
            block = []
    if block or not sent:
        sent.append(sc.broadcast(block))
    found = [base.mapInArrow(_matcher(b), "paper_id long, canonical_section string, construct string") for b in sent]
    return reduce(DataFrame.unionByName, found).distinct()


def coverage(chunks: DataFrame, papers: DataFrame, constructs: DataFrame) -> DataFrame:
    """``(construct, canonical_section, paper_count, citekeys)`` of the non-empty cells."""
    p = papers.select(F.col("id").alias("paper_id"), "citekey")
    cells = mentions(chunks, constructs).join(p, "paper_id").groupBy("construct", "canonical_section")
    return cells.agg(F.count_distinct("paper_id").alias("paper_count"), F.array_sort(F.collect_set("citekey")).alias("citekeys"))


def gap_grid(chunks: DataFrame, papers: DataFrame, constructs: DataFrame) -> DataFrame:
    """``(construct, section_pos, section, coverage_count, citekeys)``: every construct by every grid section, empty cells included."""
    slots = F.array(*(F.struct(F.lit(i).alias("section_pos"), F.lit(s).alias("section")) for i, s in enumerate(GRID_SECTIONS)))
    frame = constructs.select("construct").distinct().select("construct", F.explode(slots).alias("s")).select("construct", "s.*")
    cells = coverage(chunks, papers, constructs).withColumnRenamed("canonical_section", "section").select("construct", "section", "citekeys")
    joined = frame.join(cells, ["construct", "section"], "left")
    keys = F.coalesce("citekeys", F.array().cast("array<string>"))
    return joined.select("construct", "section_pos", "section", F.size(keys).alias("coverage_count"), keys.alias("citekeys"))


def uncovered(grid: DataFrame) -> DataFrame:
    return grid.where("coverage_count = 0").select("construct", "section_pos", "section")


def asserted_but_untested(grid: DataFrame) -> DataFrame:
    """Constructs with an empty cell in RESULTS or in DISCUSSION, in order."""
    return grid.where(F.col("section").isin("RESULTS", "DISCUSSION") & (F.col("coverage_count") == 0)).select("construct").distinct().orderBy("construct")
