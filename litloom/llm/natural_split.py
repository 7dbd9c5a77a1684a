"""Problem 2 - cut items over a size limit into overlapping pieces at natural boundaries.

For each text the starts of words are its token offsets and the starts of sentences and paragraphs its sorted boundary
array. A piece ends at the last boundary within the limit, found by binary search; without one it is cut before the
last word that fits, and a word longer than the limit is cut hard. The next piece steps back by at most the overlap,
to a boundary or else the start of a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations after which no sentence ends.
NEVER_FINAL = set(
    "approx. adj. avg. ca. cf. ch. chap. col. dept. dr. ed. eds. e.g. eg. eq. eqs. esp. est. excl. fig. figs. gen. i.e. ie. incl. max. min. mr. mrs. ms. "
    "mt. op. par. pp. prof. ref. refs. resp. sec. sect. sects. st. tab. vol. vols. viz. vs. v. al. bzw. z.b. d.h. vgl. usw. p.ej. sr. sra. dra. nr. núm.".split()
)
#: After these no sentence ends if a number follows.
BEFORE_NUMBER = {"no.", "nos.", "p.", "art.", "app.", "pt.", "ex.", "n.", "bd.", "s.", "vers."}

CLOSING, OPENING = "”\"’'»›)\\]}", "“\"‘'«‹(\\[{¿¡„"
NOTE = r"(?:(?<!\d\.)\d{1,3}|(?<=\d\.\d{1,4}\.)\d{1,3}|(?<=(?:\D|^)\d{4}\.)\d{1,2}|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\[\d{1,3}\])?"
END = regex.compile(rf"[.!?…]+[{CLOSING}]*{NOTE}[{CLOSING}]*(?<gap>\s+)(?=[{OPENING}]*(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]|\p{{Ll}}+\p{{Lu}}))")
EMPTY_LINE = regex.compile(r"\n[^\S\n]*\n\s*")
WORD_BEFORE = regex.compile(r"[\p{L}\p{M}.]*$")
WORD_START = regex.compile(r"(?<!\S)\S")


def boundaries(text: str) -> list[tuple[int, str]]:
    """Sorted ``(offset, kind)`` of the sentences and paragraphs that start after the first one."""
    found = {m.end(): "paragraph" for m in EMPTY_LINE.finditer(text) if m.end() < len(text) and text[: m.start()].strip()}
    for m in END.finditer(text):
        at = m.end()
        if at in found or at >= len(text):
            continue
        mark = m.group(0)
        if mark[0] == "." and not mark[1:2].strip(" \t\r\n").startswith((".", "!", "?")) and regex.match(r"\.\s", mark):
            word = WORD_BEFORE.search(text, max(0, m.start() - 20), m.start()).group(0) + "."
            lower = word.lower().lstrip(".")
            nxt = text[at]
            initial = regex.fullmatch(r"(?:\p{Lu}\p{M}*\.)+", word.lstrip(".")) is not None
            if lower in NEVER_FINAL or lower in BEFORE_NUMBER and nxt.isdigit() or initial and nxt.isalpha():
                continue
        found[at] = "sentence"
    return sorted(found.items())


def pieces(text: str, at: list[int], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, stop, reason)`` of consecutive pieces of at most ``limit`` characters that cover the text."""
    words = [m.start() for m in WORD_START.finditer(text)]
    out, start, done, n = [], 0, 0, len(text)
    while n - start > limit:
        i, j = bisect_right(at, start + limit) - 1, bisect_right(words, start + limit) - 1
        if i >= 0 and at[i] > done:
            stop, reason = at[i], "boundary"
        elif j >= 0 and words[j] > done:
            stop, reason = words[j], "word"
        else:
            stop, reason = start + limit, "hard"
        out.append((start, stop, reason))
        done = stop
        back = max(stop - overlap, start + 1)
        i, j = bisect_left(at, back), bisect_left(words, back)
        if i < len(at) and at[i] < stop:
            start = at[i]
        elif j < len(words) and words[j] < stop:
            start = words[j]
        else:
            start = stop - min(overlap, limit // 2, stop - start - 1) if reason == "hard" else stop
    out.append((start, n, "end"))
    return out


def _cut(limit: int, overlap: int):
    @F.pandas_udf("boundaries array<struct<at:int,kind:string>>, pieces array<struct<start:int,stop:int,reason:string>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            b = boundaries(t) if t is not None and len(t) > limit else []
            rows.append((b, pieces(t, [x for x, _ in b], limit, overlap) if t else []))
        return pd.DataFrame(rows, columns=["boundaries", "pieces"])

    return cut


def cut_points(text: Column, limit: int = 1800, overlap: int = 150) -> Column:
    """``struct(boundaries, pieces)`` of a text; no boundaries for a text within the limit, no pieces for null or ''."""
    return _cut(limit, overlap)(text)


def split_oversized(df: DataFrame, text_col: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """The rows of ``df`` with ``text_col`` replaced by its pieces, plus ``piece_pos``, ``piece_start`` and ``cut_reason``.

    Texts within the limit, null and empty ones stay one row (reason ``end``), and don't pass through Python. Narrow:
    no shuffle. Offsets and sizes are Unicode characters. Columns of the names added are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    over = F.length(text_col) > limit
    whole = df.where(F.coalesce(~over, F.lit(True))).withColumns({"piece_pos": F.lit(0), "piece_start": F.lit(0), "cut_reason": F.lit("end")})
    long = df.where(over).withColumn("__cut", cut_points(F.col(text_col), limit, overlap))
    cols = [c for c in df.columns if c not in ("piece_pos", "piece_start", "cut_reason")]
    each = long.select(*cols, F.posexplode("__cut.pieces").alias("piece_pos", "__p"))
    parts = each.withColumns(
        {"piece_start": F.col("__p.start"), "cut_reason": F.col("__p.reason"), text_col: F.expr(f"substring(`{text_col}`, __p.start + 1, __p.stop - __p.start)")}
    )
    names = [*cols, "piece_pos", "piece_start", "cut_reason"]
    return whole.select(*names).unionByName(parts.select(*names))


def natural_boundaries(df: DataFrame, id_col: str, text_col: str, limit: int = 1800) -> DataFrame:
    """``(id, boundary, kind)`` of the oversized texts' boundaries; ``(id, -1, 'none')`` for one without any."""
    cut = df.where(F.length(text_col) > limit).select(F.col(id_col).alias("id"), cut_points(F.col(text_col), limit, 0)["boundaries"].alias("b"))
    none = F.array(F.struct(F.lit(-1).alias("at"), F.lit("none").alias("kind")))
    return cut.select("id", F.explode(F.when(F.size("b") > 0, F.col("b")).otherwise(none)).alias("x")).select("id", F.col("x.at").alias("boundary"), F.col("x.kind").alias("kind"))
