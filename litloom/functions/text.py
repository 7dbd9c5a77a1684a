"""Text rules as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Chunking

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def non_blank(x: C) -> Column:
    """True where a text is neither null nor blank (any white space, not only blanks)."""
    x = _c(x)
    return x.isNotNull() & x.rlike(r"\S")


def blank_to_null(x: C) -> Column:
    x = F.trim(_c(x))
    return F.when(x != "", x)


def first_non_blank(*xs: C) -> Column:
    return F.coalesce(*(F.when(non_blank(x), _c(x)) for x in xs))


# What is cleaned out of running text, applied in this order.
CLEANING = (
    ("\u00a0", " "),
    (r"\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]", ""),
    (r"\([^()]*?(?:et al\.|,\s*\d{4})[^()]*?\)", ""),
    (r"(\p{L})-\s+(\p{L})", "$1$2"),
    (r"\s+([,.;:)])", "$1"),
    (r"\s+", " "),
)


def clean_text(x: C) -> Column:
    """Text without citation marks, line-break hyphens and surplus white space."""
    return F.trim(reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), CLEANING, _c(x)))


def strip_numbering(x: C) -> Column:
    """A lower-case heading without its number ("3.1. Method", "IV. Results", "2) Discussion", "4 Method")."""
    low = F.lower(_c(x))
    marked = F.regexp_replace(low, r"^\s*(?:\d+(?:\.\d+)*|[ivxlc]+)\s*[.):\-–]\s*", "")
    return F.trim(F.when(marked == low, F.regexp_replace(low, r"^\s*\d+(?:\.\d+)*\s+", "")).otherwise(marked))


# Rules from heading to slot, the first that holds decides. "has" looks anywhere, "starts" at the start.
SLOT_RULES = (
    ("FUTURE_WORK", "future", ("work", "research", "direction")),
    ("LIMITATIONS", "has", ("limitation",)),
    ("ABSTRACT", "starts", ("abstract",)),
    ("INTRODUCTION", "starts", ("introduction", "background", "motivation")),
    ("RELATED_WORK", "has", ("literature review", "related work", "state of the art", "prior")),
    ("THEORY", "has", ("theoretical", "theory", "conceptual", "hypothes")),
    ("METHOD", "has", ("method", "approach", "research design", "data collection", "model formulation", "materials")),
    ("RESULTS", "has", ("result", "finding", "analysis", "experiment", "case stud", "evaluation", "numerical")),
    ("DISCUSSION", "has", ("discussion", "implication")),
    ("CONCLUSION", "starts", ("conclusion", "concluding", "summary")),
)


def heading_slot(x: C) -> Column:
    """Canonical slot of a heading; OTHER for null, blank and unknown ones."""
    h = strip_numbering(x)
    out = F.when(~F.coalesce(non_blank(x), F.lit(False)), "OTHER")
    for slot, how, words in SLOT_RULES:
        hit = reduce(lambda a, b: a | b, (h.startswith(w) if how == "starts" else h.contains(w) for w in words))
        out = out.when(h.contains("future") & hit if how == "future" else hit, slot)
    return out.otherwise("OTHER")


def skippable_heading(x: C, config: Chunking = DEFAULT.chunking) -> Column:
    """True where a heading starts with one of the skipped names; null and blank headings are kept."""
    h = F.lower(F.trim(_c(x)))
    return F.coalesce(reduce(lambda a, b: a | b, (h.startswith(s) for s in config.skip_sections)), F.lit(False))


def normalise_doi(x: C) -> Column:
    return blank_to_null(F.regexp_replace(F.trim(_c(x)), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", ""))


def parse_year(x: C) -> Column:
    """The first year from 1800 to 2199 in a text."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(x).cast("string"), r"((?:18|19|20|21)\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")


def normalise_authors(x: C) -> Column:
    """"A and B and A" as "A; B", in order of first mention; null for none."""
    names = F.transform(F.split(_c(x), r"(?i)\s+and\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    kept = F.array_distinct(F.filter(names, lambda s: s != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def declared_filename(x: C) -> Column:
    """File name of the first PDF among the attachments of a ``file`` field."""

    def name(part: Column) -> Column:
        fields = F.split(part, ":")
        typed = part.contains(":") & F.lower(part).contains("application/pdf")
        value = F.when(typed & (F.size(fields) >= 2), F.element_at(fields, -2)).otherwise(part)
        value = F.regexp_replace(value, r"^internal-pdf://\d+/", "")
        return F.trim(F.regexp_replace(value, r"^.*[/\\]", ""))

    names = F.transform(F.split(_c(x), ";"), lambda p: name(F.trim(p)))
    return F.get(F.filter(names, lambda n: F.lower(n).endswith(".pdf")), F.lit(0))


def strip_extension(x: C) -> Column:
    return F.regexp_replace(_c(x), r"(?s)^(.+)\.[^.]*$", "$1")


def file_name(x: C) -> Column:
    return F.regexp_replace(_c(x), r"(?s)^.*[/\\]", "")


def short_citation(authors: C, year: C) -> Column:
    """"Surname et al. (2020)"; "Anon" without authors, "n.d." without year."""
    a = _c(authors)
    surname = F.trim(F.split(F.split(a, ";")[0], ",")[0])
    who = F.when(non_blank(a), F.concat(surname, F.when(a.contains(";"), " et al.").otherwise(""))).otherwise("Anon")
    return F.concat(who, F.lit(" ("), F.coalesce(_c(year).cast("string"), F.lit("n.d.")), F.lit(")"))


def citation_marker(citekey: C, page: C) -> Column:
    k, p = _c(citekey), _c(page)
    return F.when(p.isNull(), F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit("["), k, F.lit(" p."), p.cast("string"), F.lit("]")))


def embedding_text(section: C, content: C) -> Column:
    return F.concat(F.lit("["), F.coalesce(_c(section), F.lit("null")), F.lit("] "), _c(content))


def numbered_heading(number: C, heading: C) -> Column:
    n = _c(number)
    return F.when(non_blank(n), F.concat_ws(" ", n, _c(heading))).otherwise(_c(heading))


def page_from_coords(x: C) -> Column:
    """Page after the first semicolon of a coordinate text ("p;3,72.0,..."); null for other forms."""
    return F.nullif(F.regexp_extract(_c(x), r"^[^;]*;(\d+),", 1), F.lit("")).cast("int")


def sentences(x: C) -> Column:
    return F.split(_c(x), r"(?<=[.!?])\s+")


def escape_like(x: C) -> Column:
    """``\\``, ``%`` and ``_`` escaped, the escape sign first."""
    return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit("\\" + mark)), ("\\", "%", "_"), _c(x))


def vector_literal(x: C) -> Column:
    """``[1.0,2.5]``; null or empty vectors are an error."""
    v = _c(x)
    text = F.concat(F.lit("["), F.array_join(F.transform(v, lambda f: f.cast("string")), ","), F.lit("]"))
    return F.when(F.coalesce(F.size(v) > 0, F.lit(False)), text).otherwise(F.raise_error(F.lit("empty vector")).cast("string"))


def pair_key(construct: C, a: C, b: C) -> Column:
    """Key of a finding that does not depend on the direction of the pair."""
    x, y = _c(a).cast("string"), _c(b).cast("string")
    first, second = F.least(_c(a), _c(b)).cast("string"), F.greatest(_c(a), _c(b)).cast("string")
    return F.concat_ws("|", F.lower(_c(construct)), F.coalesce(first, x), F.coalesce(second, y))


def initials(given: C) -> Column:
    parts = F.filter(F.split(F.trim(_c(given)), r"\s+"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lit("."))), " ")
