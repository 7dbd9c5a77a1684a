"""TEI XML source: parsed documents as one nested row each. Documents with a DOCTYPE are refused."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "title string, authors array<string>, year int, doi string, abstract string, "
    "sections array<struct<heading:string,number:string,paragraphs:array<struct<text:string,page:int>>>>, error string"
)

# The cleaning of running text, in this order (the JVM form is functions.text.CLEANING).
_CLEAN = [
    (re.compile("\u00a0"), " "), (re.compile(r"\[\s*[0-9]+(?:\s*[,-]\s*[0-9]+)*\s*\]"), ""), (re.compile(r"\([^()]*?(?:et al\.|,\s*[0-9]{4})[^()]*?\)"), ""),
    (re.compile(r"([^\W\d_])-\s+([^\W\d_])"), r"\1\2"), (re.compile(r"\s+([,.;:)])"), r"\1"), (re.compile(r"\s+"), " "),
]


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _clean(text: str | None) -> str | None:
    if text is None:
        return None
    for pattern, by in _CLEAN:
        text = pattern.sub(by, text)
    return text.strip() or None


def _text(e: ElementTree.Element) -> str:
    """Text of an element; references and formulas become a blank, segmented sentences are kept apart."""
    out = [e.text or ""]
    for child in e:
        name = _name(child)
        if name in ("ref", "formula") or not name:
            out.append(" " if name else "")
        else:
            out.append(_text(child) + (" " if name == "s" else ""))
        out.append(child.tail or "")
    return "".join(out)


def _all(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if e is None else [x for x in e.iter() if _name(x) == name]


def _direct(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if e is None else [x for x in e if _name(x) == name]


def _page(p: ElementTree.Element) -> int | None:
    m = re.match(r"[^;]*;([0-9]+),", p.get("coords") or "")
    return int(m.group(1)) if m else None


def _paragraphs(e: ElementTree.Element) -> list[dict]:
    return [{"text": t, "page": _page(p)} for p in _direct(e, "p") if (t := _clean(_text(p)))]


def _sections(body: ElementTree.Element | None) -> list[dict]:
    out: list[dict] = []

    def walk(e: ElementTree.Element) -> None:
        for div in _direct(e, "div"):
            head = next(iter(_direct(div, "head")), None)
            paragraphs = _paragraphs(div)
            if paragraphs:
                heading = _clean(_text(head)) if head is not None else None
                out.append({"heading": heading or "Body", "number": head.get("n") if head is not None else None, "paragraphs": paragraphs})
            walk(div)

    if body is not None:
        walk(body)
        if not out and (loose := _paragraphs(body)):
            out.append({"heading": "Body", "number": None, "paragraphs": loose})
    return out


def _author(e: ElementTree.Element) -> str | None:
    surname = next((_clean(_text(s)) for s in _all(e, "surname")), None)
    if not surname:
        return None
    first = [w for f in _all(e, "forename") for w in (_text(f)).split()]
    marks = " ".join(w[0].upper() + "." for w in first)
    return f"{surname}, {marks}" if marks else surname


def parse_tei(xml: str | bytes) -> dict:
    """The document of one TEI text as a row of ``DOCUMENT``; what can't be read has only ``error``."""
    empty = {"title": None, "authors": [], "year": None, "doi": None, "abstract": None, "sections": [], "error": None}
    if xml is None:
        return empty | {"error": "no text"}
    text = xml.decode("utf-8", errors="replace") if isinstance(xml, bytes) else xml
    if re.search(r"<!DOCTYPE", text, re.I):
        return empty | {"error": "DOCTYPE is not allowed"}
    try:
        root = ElementTree.fromstring(text.encode("utf-8"))
    except ElementTree.ParseError as e:
        return empty | {"error": f"not well-formed: {e}"}
    header = next(iter(_all(root, "teiHeader")), None)
    title = next((t for s in _all(header, "titleStmt") for x in _direct(s, "title") if (t := _clean(_text(x)))), None)
    scope = next(iter(_all(header, "analytic")), header)
    authors = [a for x in (_direct(scope, "author") or _all(scope, "author")) if (a := _author(x))]
    year = next((int(y) for d in _all(header, "date") for y in re.findall(r"[0-9]{4}", d.get("when") or _text(d))[:1] if 1900 <= int(y) <= 2100), None)
    doi = next((t for i in _all(header, "idno") if (i.get("type") or "").lower() == "doi" and (t := _clean(_text(i)))), None)
    abstract = None
    for a in _all(header, "abstract")[:1]:
        direct = [t for p in _direct(a, "p") if (t := _clean(_text(p)))]
        abstract = "\n\n".join(direct) if direct else _clean(_text(a))
    body = next(iter(_all(next(iter(_all(root, "text")), None), "body")), None)
    return empty | {"title": title, "authors": authors, "year": year, "doi": doi, "abstract": abstract, "sections": _sections(body)}


def parsed(xml: Column) -> Column:
    @F.pandas_udf(DOCUMENT)
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_tei(v) for v in values], columns=["title", "authors", "year", "doi", "abstract", "sections", "error"]).astype({"year": "Int64"})

    return parse(xml)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """``(path, <document>)`` of the TEI files under ``path``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").format("binaryFile").load(path)
    return files.select("path", parsed(F.decode("content", "UTF-8")).alias("d")).select("path", "d.*")


def paragraph_rows(documents: DataFrame, key: str) -> DataFrame:
    """``(key, section_pos, para_pos, heading, number, text, page)`` of nested documents."""
    s = documents.select(key, F.posexplode("sections").alias("section_pos", "s"))
    return s.select(key, "section_pos", F.col("s.heading").alias("heading"), F.col("s.number").alias("number"), F.posexplode("s.paragraphs").alias("para_pos", "p")).select(
        key, "section_pos", "para_pos", "heading", "number", F.col("p.text").alias("text"), F.col("p.page").alias("page")
    )
