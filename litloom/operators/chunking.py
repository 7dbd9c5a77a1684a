"""Documents to chunks: paragraphs packed to a size, oversized paragraphs cut at sentences, ordinals across a paper."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Chunking
from ..functions.text import heading_slot, non_blank, numbered_heading, skippable_heading


def split_long(text: str, max_chars: int, overlap: int) -> list[str]:
    """Pieces of a paragraph over the limit, filled with whole sentences; each repeats the end of the one before."""
    import re

    pieces, held = [], ""
    for sentence in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text):
        if held and len(held) + len(sentence) + 1 > max_chars:
            pieces.append(held.strip())
            held = held[-overlap:] if overlap else ""
        held = f"{held} {sentence}" if held else sentence
        while len(held) > max_chars:
            pieces.append(held[:max_chars].strip())
            held = held[max_chars - overlap :]
    if held:
        pieces.append(held.strip())
    return pieces


def pack_paragraphs(paragraphs: list[tuple[str, int | None]], config: Chunking = DEFAULT.chunking) -> list[tuple[str, int | None]]:
    """``(text, page of its first paragraph)`` of a section's chunks."""
    out: list[tuple[str, int | None]] = []
    held: list[str] = []
    size, page = 0, None

    def flush() -> None:
        nonlocal size
        if held:
            out.append(("\n\n".join(held).strip(), page))
            held.clear()
            size = 0

    for text, at in paragraphs:
        if text is None or not text.strip():
            continue
        if len(text) > config.max_chars:
            flush()
            out += [(p, at) for p in split_long(text, config.max_chars, config.overlap_chars)]
            continue
        if held and (size + len(text) + 2 > config.max_chars or size >= config.target_chars):
            flush()
        if not held:
            page = at
        size += len(text) + (2 if held else 0)
        held.append(text)
    flush()
    return out


def packed(paragraphs: Column, config: Chunking = DEFAULT.chunking) -> Column:
    """Chunks ``array<struct<text,page>>`` of an array of paragraphs ``struct<text,page>``."""

    @F.pandas_udf("array<struct<text:string,page:int>>")
    def pack(values: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "page": p} for t, p in pack_paragraphs([(x["text"], x["page"]) for x in v], config)] if v is not None else [] for v in values])

    return pack(paragraphs)


def sections_of(paragraphs: DataFrame) -> DataFrame:
    """``(paper_id, section_pos, heading, number, paragraphs)`` from one row per paragraph, in order."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("para_pos", "para_id", F.col("text"), F.col("page").cast("int").alias("page")))), lambda p: F.struct(p["text"].alias("text"), p["page"].alias("page"))
    )
    return paragraphs.groupBy("paper_id", "section_pos").agg(F.min("heading").alias("heading"), F.min("number").alias("number"), listed.alias("paragraphs"))


def chunk_documents(sections: DataFrame, abstracts: DataFrame | None = None, config: Chunking = DEFAULT.chunking) -> DataFrame:
    """``(paper_id, ordinal, section, canonical_section, page, content)``.

    The abstract, if there is one, is chunk 0 as it stands; then come the sections that are neither empty nor skipped.
    Sections are packed apart from each other, so work spreads by section; only ordinals are numbered by paper.
    """
    kept = sections.where(~skippable_heading("heading", config))
    each = kept.select(
        "paper_id", "section_pos", numbered_heading("number", "heading").alias("section"), heading_slot("heading").alias("canonical_section"),
        F.posexplode(packed(F.col("paragraphs"), config)).alias("piece", "c"),
    ).select("paper_id", "section_pos", "piece", "section", "canonical_section", F.col("c.page").alias("page"), F.col("c.text").alias("content"))
    if abstracts is not None:
        first = abstracts.where(non_blank("abstract")).select(
            "paper_id", F.lit(-1).alias("section_pos"), F.lit(0).alias("piece"), F.lit("Abstract").alias("section"), F.lit("ABSTRACT").alias("canonical_section"),
            F.lit(None).cast("int").alias("page"), F.trim("abstract").alias("content"),
        )
        each = first.unionByName(each)
    return with_ordinals(each, [F.col("section_pos"), F.col("piece")]).select("paper_id", "ordinal", "section", "canonical_section", "page", "content")


def with_ordinals(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """Chunks with ``ordinal``, from 0 within each paper."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order)) - 1)


def looks_empty(documents: DataFrame, limit: int = DEFAULT.empty_document_chars) -> DataFrame:
    """``(paper_id, sections, chars, empty)`` of documents given as paragraphs: no sections or less than ``limit`` characters."""
    stats = documents.groupBy("paper_id").agg(F.count_distinct("section_pos").alias("sections"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return stats.withColumn("empty", (F.col("sections") == 0) | (F.col("chars") < limit))


def full_text(sections: DataFrame) -> DataFrame:
    """``(paper_id, text)``: headings and paragraphs of a paper as one text, in order."""
    body = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n\n")
    part = F.concat_ws("\n", F.col("heading"), body)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", part.alias("part")))), lambda s: s["part"])
    return sections.groupBy("paper_id").agg(F.trim(F.array_join(joined, "\n\n")).alias("text"))
