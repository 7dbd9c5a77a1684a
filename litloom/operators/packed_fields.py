"""Problem 5 - several values packed in one field, one row per value with its position.

The text is cut at quote characters, so that odd pieces are literals and even pieces are split at delimiters; a fold
of array functions puts the pieces together again and numbers the values. Everything is built-in expressions.

Quotes count only where they enclose a whole value (at the start or behind a delimiter, and closed before one), so
apostrophes and quotation marks inside a value are ordinary characters; braces enclose like quotes. A backslash
before a delimiter makes it part of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private marks that stand for a split, a quote and the shielded delimiters while a field is taken apart.
SPLIT, QUOTE = "\ue000", "\ue001"
SHIELDED = {";": "\ue002", ",": "\ue003", "|": "\ue004", "&": "\ue005"}

# Name suffixes and the marks for further unnamed authors.
SUFFIX = r"(?:Jr|Sr)\.?|II|III|IV"
UNNAMED = r"(?:and\s+|&\s*)?(?:(?i:others|et\.?\s*al\.?)|u\.\s?a\.|(?i:and\s+colleagues)|\.\.\.|…)"
UNNAMED_TAIL = r"[\s,]+(?:(?i:et\.?\s*al\.?|and\s+others)|u\.\s?a\.|…)\s*$"

INITIALS = r"(?:\p{Lu}\p{M}?\.?[\s-]?){1,4}"
AUTHOR_END = rf"(?:[;|\n\t&,•·]|\s//?(?=\s)|(?i:\band\b)|{SPLIT})"
AUTHOR_DELIMITER = r"\s*(?:[;|\n\t&•·]|(?<=\s)//?(?=\s)|(?<=\s|^|,)(?i:and)(?=\s|$))\s*"
#: A comma parts two names unless initials or a suffix follow it, which belong to the name before.
NAME_COMMA = rf"\s*+,\s*+(?!(?:{INITIALS}|{SUFFIX})\s*(?:,|{SPLIT}|$))"
#: "Surname, Given" without initials anywhere is one name.
FULL_NAME = r"^\s*(?:\p{Ll}+\s+)*[\p{L}\p{M}'’-]+\s*,\s*\p{Lu}[\p{Ll}\p{M}]+(?:\s+(?:\p{Lu}\.\s?)+)?\s*$"

FILE_END = rf"(?:[;|\n\t,•]|\s//(?=\s)|{SPLIT})"
#: A comma parts two files only behind a file extension or a media type, or next to a literal.
FILE_DELIMITER = r"\s*[;|\n\t•]\s*|^\s*,\s*|\s*,\s*$|\s+//\s+|(?<=\.[A-Za-z0-9]{2,5}|:[a-z]{2,20}/[A-Za-z0-9.+-]{2,40})\s*,\s*"


def _quoted(text: Column, end: str) -> Column:
    """Enclosing quotes and braces made QUOTE marks."""
    for opened, inner, closed in (('"', '[^"]*', '"'), (r"\{", "[^{}]*", r"\}"), ("'", "[^\n]*?", "'"), ("“", "[^”]*", "”")):
        text = F.regexp_replace(text, rf"(^|{end})(\s*){opened}({inner}){closed}(?=\s*(?:$|{end}))", f"$1$2{QUOTE}$3{QUOTE}")
    return text


def split_packed(field: Column, kind: str) -> Column:
    """The values of a field in order, as an array; ``kind`` is ``authors`` or ``files``. Null or blank gives an empty array."""
    end = AUTHOR_END if kind == "authors" else FILE_END
    text = F.regexp_replace(F.coalesce(field.cast("string"), F.lit("")), f"[{SPLIT}-\ue005]", "")
    text = F.regexp_replace(text, r"[\u00a0\u2000-\u200a\u202f\u3000]", " ")
    for mark, stand_in in SHIELDED.items():
        text = F.replace(text, F.lit("\\" + mark), F.lit(stand_in))
    pieces = F.split(_quoted(text, end), QUOTE, -1)

    def parted(piece: Column) -> Column:
        if kind == "files":
            return F.regexp_replace(piece, FILE_DELIMITER, SPLIT)
        strong = F.split(F.regexp_replace(piece, AUTHOR_DELIMITER, SPLIT), SPLIT, -1)
        names = F.transform(strong, lambda s: F.when(s.rlike(FULL_NAME), s).otherwise(F.regexp_replace(s, NAME_COMMA, SPLIT)))
        return F.array_join(names, SPLIT)

    # literals keep a QUOTE mark until the end: it tells a literal from an unnamed-authors mark of the same letters
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(QUOTE), p)).otherwise(parted(p))), "")
    values = F.split(joined, SPLIT, -1)
    if kind == "authors":
        values = F.transform(values, lambda v: F.when(v.contains(QUOTE), v).otherwise(F.regexp_replace(v, UNNAMED_TAIL, "")))
        values = F.filter(values, lambda v: ~F.regexp_replace(v, r"^[\s,.]+|\s+$", "").rlike(rf"^(?:{UNNAMED})$"))

    def cleaned(v: Column) -> Column:
        v = F.replace(v, F.lit(QUOTE), F.lit(""))
        for mark, stand_in in SHIELDED.items():
            v = F.replace(v, F.lit(stand_in), F.lit(mark))
        v = F.regexp_replace(v, r"\s+", " ")
        return F.trim(F.regexp_replace(F.trim(v), r"(?<=[^.])\s*,$", ""))

    return F.filter(F.transform(values, cleaned), lambda v: F.regexp_replace(v, r"[\s,;|]+", "") != "")


def unpack_fields(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``(id, field, pos, item)``: one row per value of the named columns (name -> kind of ``split_packed``).

    Narrow: no shuffle, one scan. Null, blank and empty-piece-only fields give no rows; rows repeated in the input
    are repeated in the result; other columns are not read.
    """
    parts = F.array(*(F.struct(F.lit(c).alias("field"), split_packed(F.col(c), kind).alias("items")) for c, kind in fields.items()))
    each = df.select(F.col(id_col).alias("id"), F.explode(parts).alias("p"))
    return each.select("id", F.col("p.field").alias("field"), F.posexplode("p.items").alias("pos", "item"))
