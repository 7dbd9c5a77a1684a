"""Problem 6 - records that are equal but for letter case, whitespace, punctuation, symbols, composition or field order.

Every field is reduced to its letters and digits, the fields to one canonical text, and that to a 128-bit hash by which
copies are counted with map-side combining. A second, independent 64-bit hash stands beside it: two different texts
with one 128-bit hash would differ there and stay apart.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

# What may stand before a doi.
DOI_PREFIX = re.compile(r"^(?:(?:https?:/{0,2})?(?:www\.)?(?:dx\.)?doi\.org/*|(?:info:)?doi[\s:/.]*(?=10[\s./]|$))+")


def _plain(text: str) -> str:
    """Composed, case-folded letters, marks and digits in order."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(c for c in text if c.isalnum() or unicodedata.category(c)[0] == "M")


def plain_text(text: str) -> str:
    return _plain(text)


def plain_doi(text: str) -> str:
    folded = re.sub(r"\s+", "", unicodedata.normalize("NFC", text).casefold()).lstrip("{[(<\"'")
    return _plain(DOI_PREFIX.sub("", folded))


def plain_runs(text: str) -> str:
    """Runs of letters and of digits in sorted order, so that their order does not count."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    kept = "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in folded)
    return " ".join(sorted(re.findall(r"\d+|[^\s\d]+", kept)))


FORMS = {"text": plain_text, "doi": plain_doi, "runs": plain_runs}


def canonical_form(column: Column, form: str) -> Column:
    """The canonical text of a field (``text``, ``doi`` or ``runs``); null stays null."""
    reduce_one = FORMS[form]

    @F.pandas_udf("string")
    def reduced(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else reduce_one(v))

    return reduced(column.cast("string"))


def with_key(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds ``__h`` (128 bits) and ``__x`` (64 bits) of the canonical record; null and empty fields stay different."""
    parts = [F.coalesce(F.concat(F.lit("v"), canonical_form(F.col(c), form)), F.lit("n")) for c, form in fields.items()]
    return df.withColumn("__text", F.concat_ws("\x1f", *parts)).withColumns({"__h": F.unhex(F.md5("__text")), "__x": F.xxhash64("__text")}).drop("__text")


def collapse(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``(first_id, copies)``: one row per distinct record, the smallest id standing for it.

    Rows with a null id are left out. An empty input gives no rows.
    """
    keyed = with_key(df.select(id_col, *[c for c in fields if c != id_col]).where(F.col(id_col).isNotNull()), fields)
    return keyed.groupBy("__h", "__x").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).drop("__h", "__x")


def copies_of(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``(first_id, copy_id)``: every row that is not the smallest id of its record.

    Groups are found by aggregation; only those of several rows are joined back, so a record that a third of all rows
    share is one row on the joined side and adaptive execution splits the other. Rows are canonicalised once: their ids
    and hashes are written down for the second reading.
    """
    keyed = with_key(df.select(id_col, *[c for c in fields if c != id_col]).where(F.col(id_col).isNotNull()), fields)
    keyed = cut_lineage(keyed.select(F.col(id_col).alias("copy_id"), "__h", "__x"))
    groups = keyed.groupBy("__h", "__x").agg(F.min("copy_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(groups, ["__h", "__x"]).where("copy_id <> first_id").select("first_id", "copy_id")
