"""Evidence for a paper within a character budget, best sections first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..schema import EVIDENCE_ORDER


def budgeted_sections(sections: DataFrame, budget: int = DEFAULT.synthesis.evidence_budget_chars) -> DataFrame:
    """``(paper_id, priority, slot, body)`` of ``(paper_id, slot, body)``: bodies by priority of their slots until the budget is used, the last one cut."""
    order = F.create_map(*(x for i, s in enumerate(EVIDENCE_ORDER) for x in (F.lit(s), F.lit(i))))
    known = sections.where(F.col("body").isNotNull()).withColumn("priority", order[F.col("slot")]).where("priority is not null")
    before = Window.partitionBy("paper_id").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    used = known.withColumn("used", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0))).where(F.col("used") < budget)
    return used.select("paper_id", "priority", "slot", F.substring(F.col("body"), F.lit(1), (F.lit(budget) - F.col("used")).cast("int")).alias("body"))


def evidence(sections: DataFrame, budget: int = DEFAULT.synthesis.evidence_budget_chars) -> DataFrame:
    """``(paper_id, evidence)``: the budgeted sections under their slot names."""
    part = F.concat(F.lit("### "), "slot", F.lit("\n"), "body")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("priority", part.alias("part")))), lambda s: s["part"])
    return budgeted_sections(sections, budget).groupBy("paper_id").agg(F.trim(F.array_join(listed, "\n\n")).alias("evidence"))


def section_bodies(chunks: DataFrame) -> DataFrame:
    """``(paper_id, slot, body)``: a paper's texts of one canonical slot in order of ordinal."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "content"))), lambda c: c["content"])
    return chunks.where("canonical_section is not null").groupBy("paper_id", F.col("canonical_section").alias("slot")).agg(F.array_join(listed, "\n\n").alias("body"))


def extraction_prompts(texts: DataFrame, papers: DataFrame) -> DataFrame:
    """``(paper_id, evidence)``: the texts behind what is known of their papers; what isn't known is said to be unknown."""
    fields = [F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown"))) for label, c in (("Paper", "citekey"), ("Title", "title"), ("Authors", "authors"), ("Year", "year"), ("Venue", "venue"))]
    known = papers.select(F.col("id").alias("paper_id"), F.concat_ws("\n", *fields).alias("about"))
    return texts.join(known, "paper_id").select("paper_id", F.concat("about", F.lit("\n\nFill in the row from this text:\n\n"), "evidence").alias("evidence"))
