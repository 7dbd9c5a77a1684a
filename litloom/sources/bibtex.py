"""BibTeX source: a file is read whole, taken apart into entries, and fields decoded."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accent commands and the combining marks they mean, and symbol commands.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "H": "\u030b", "r": "\u030a", "v": "\u030c", "u": "\u0306", "=": "\u0304", ".": "\u0307", "c": "\u0327", "k": "\u0328", "d": "\u0323"}
SYMBOLS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…"}


def decode_latex(text: str) -> str:
    """Accent and symbol commands resolved, braces dropped, white space squeezed."""

    def accent(m: re.Match) -> str:
        base = {"\\i": "i", "\\j": "j"}.get(m.group(2), m.group(2))
        return unicodedata.normalize("NFC", base + ACCENTS[m.group(1)])

    marks = "".join(re.escape(k) for k in ACCENTS if not k.isalpha())
    letters = "".join(k for k in ACCENTS if k.isalpha())
    text = re.sub(rf"\\([{marks}])\s*\{{?(\\[ij]|[A-Za-z])\}}?", accent, text)
    text = re.sub(rf"\\([{letters}])\s*\{{(\\[ij]|[A-Za-z])\}}", accent, text)
    text = re.sub(r"\\([A-Za-z]+)(?:\{\}|\s+|(?![A-Za-z]))", lambda m: SYMBOLS.get(m.group(1), m.group(0)), text)
    text = re.sub(r"\\([&%$#_{}])", r"\1", text)
    text = text.replace("``", "“").replace("''", "”").replace("---", "—").replace("--", "–").replace("~", " ")
    return " ".join(re.sub(r"[{}]", "", text).split())


def _value(text: str, i: int, macros: dict[str, str]) -> tuple[str, int]:
    """The value that starts at ``i``: braced, quoted, a number or a macro, joined by ``#``."""
    parts = []
    while True:
        while i < len(text) and text[i].isspace():
            i += 1
        if i >= len(text):
            raise ValueError("value breaks off")
        if text[i] in '{"':
            close = "}" if text[i] == "{" else '"'
            depth, j = 0, i + 1
            while j < len(text):
                c = text[j]
                if c == "\\":
                    j += 1
                elif depth == 0 and c == close:
                    break
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                j += 1
            if j >= len(text):
                raise ValueError("value is not closed")
            parts.append(text[i + 1 : j])
            i = j + 1
        else:
            m = re.compile(r"[^\s,#})]+").match(text, i)
            if not m:
                raise ValueError("value is missing")
            parts.append(m.group(0) if m.group(0).isdigit() else macros.get(m.group(0).lower(), m.group(0)))
            i = m.end()
        while i < len(text) and text[i].isspace():
            i += 1
        if i < len(text) and text[i] == "#":
            i += 1
            continue
        return "".join(parts), i


def parse_bibtex(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """``(citekey, entry type, fields)`` of every sound entry; malformed entries are left out, unknown macros kept as
    they stand. Text without any entry although it holds an ``@`` is an error."""
    out, macros = [], {}
    starts = [m for m in re.finditer(r"@\s*([A-Za-z]+)\s*([{(])", text)]
    for m, nxt in zip(starts, [*starts[1:], None]):
        kind = m.group(1).lower()
        if kind in ("comment", "preamble"):
            continue
        body = text[m.end() :]
        limit = nxt.start() - m.end() if nxt else len(body)
        try:
            if kind == "string":
                name = re.match(r"\s*([^\s=]+)\s*=", body)
                if name:
                    macros[name.group(1).lower()], _ = _value(body, name.end(), macros)
                continue
            head = re.match(r"\s*([^\s,{}]*)\s*,", body)
            if not head or head.end() > limit:
                continue
            fields, i = {}, head.end()
            while True:
                f = re.compile(r"[\s,]*([A-Za-z][\w-]*)\s*=").match(body, i)
                if not f:
                    break
                value, i = _value(body, f.end(), macros)
                fields.setdefault(f.group(1).lower(), decode_latex(value))
            if not re.compile(r"[\s,]*[})]").match(body, i):
                raise ValueError("entry is not closed")
            out.append((head.group(1), kind, fields))
        except ValueError:
            continue
    if starts and not out and all(m.group(1).lower() not in ("comment", "preamble", "string") for m in starts):
        raise ValueError("no readable entry in the file")
    return out


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, citekey, entry_type, fields)`` of the entries of all files under ``path``; each file is one task's work."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def entries(batches):
        for b in batches:
            rows = [(p, i, k, t, f) for p, v in zip(b["path"], b["value"]) for i, (k, t, f) in enumerate(parse_bibtex(v))]
            yield pd.DataFrame(rows, columns=["path", "pos", "citekey", "entry_type", "fields"])

    return files.mapInPandas(entries, "path string, pos int, citekey string, entry_type string, fields map<string,string>")
