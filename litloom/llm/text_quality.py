"""Problem 9 - text statistics per document and the share of text that is no natural prose.

A text is taken apart into blocks of lines of one build. Each block has three distributions: its words by class (function
words of the text's language, capitalised, plain, numbers, other tokens), its characters by class, and its characters by
the form of the line they stand in. They are compared with structural profiles by the Jensen-Shannon divergence - prose in
each language, and the ways in which lists, tables and junk are set - and the block gets the kind of the nearest profile.
No form decides by itself: a form is one class of one distribution, and words that tell otherwise outweigh it. A text in
which more than half the characters stand in blocks that are not prose gets the kind most of those have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words of the languages (they also serve as function words), in no order of rank.
COMMON = {
    "en": "the of and to in a is that it for on with as was at by an be this from are or not but which were their its they than then more most when where who what how if only both between into had has have been can may should would will also such we our us he she his her you your i my all each other some any no so do does did there these those up out off over under after before because while until though although about above across among against per whether neither nor one two once still yet very near outside seen",
    "fr": "le la les un une des de du et à au aux en dans que qui ne pas ce cette ces est sont a ont été être par pour sur avec sans plus moins comme où il elle ils elles nous vous se sa son ses leur leurs mais ou donc si entre selon dont lorsque quand aussi très peu reste on y",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde wurden hat haben mit von zu zum zur bei aus auf in im an am für über unter durch wie wo wenn dass daß ob sich es er sie wir ihr auch nur noch als nach vor zwischen bleibt je desto diese dieser dieses so kaum",
    "es": "el la los las un una unos unas de del y o pero no en a al que se es son fue fueron ha han por para con sin sobre entre más menos como cuando donde si su sus lo le les este esta estos estas también muy ya hay queda ser está están apenas cómo",
}
WORDS = {lang: frozenset(words.split()) for lang, words in COMMON.items()}

# What site navigation consists of.
NAVIGATION = frozenset(
    "home|next|previous|back|login|log in|sign in|sign up|register|share|export|menu|search|contact|about|about us|help|print|download|download pdf|view pdf|pdf|cite this|cite|permissions|"
    "back to top|top|accept cookies|cookies|cookie settings|reject all|accept all|subscribe|follow us|privacy|privacy policy|terms|terms of use|site map|sitemap|read more|more|close|skip to content|"
    "add to cart|save|email|tweet|like|references|figures|related articles|metrics|access denied|page not found|loading".split("|")
)

WORD_CLASSES = ("function", "capital", "plain", "number", "other")
CHAR_CLASSES = ("letter", "digit", "space", "end", "mark", "symbol")
#: Forms of lines. heading and name: a short line by itself; column: one of at least COLUMN short lines in a row.
FORMS = (
    "running", "sentence", "open", "heading", "name", "column", "gloss", "phrases", "item", "reference", "contents", "row", "numbers", "pairs", "noise", "rule", "again", "menu",
)
COLUMN = 4
#: Weights of the three divergences (words, characters, forms).
WEIGHTS = (1.0, 1.0, 0.5)

_LATIN = {"letter": 0.80, "digit": 0.02, "space": 0.15, "end": 0.015, "mark": 0.015}
_PARAGRAPH = {"running": 0.95, "sentence": 0.04, "heading": 0.01}
# The profiles; what a class doesn't name has no share, and shares are scaled to one.
PROSE = {
    "en": {"function": 0.33, "capital": 0.06, "plain": 0.55, "number": 0.05, "other": 0.01},
    "fr": {"function": 0.52, "capital": 0.04, "plain": 0.41, "number": 0.03},
    "de": {"function": 0.50, "capital": 0.27, "plain": 0.19, "number": 0.04},
    "es": {"function": 0.52, "capital": 0.04, "plain": 0.41, "number": 0.03},
}
PROFILES = [("prose", words, _LATIN, _PARAGRAPH) for words in PROSE.values()] + [
    ("prose", {"function": 0.14, "capital": 0.08, "plain": 0.68, "number": 0.06, "other": 0.04}, _LATIN, {"sentence": 0.8, "heading": 0.2}),
    ("prose", {"function": 0.04, "capital": 0.20, "plain": 0.50, "number": 0.15, "other": 0.11}, {"letter": 0.68, "digit": 0.07, "space": 0.15, "end": 0.04, "mark": 0.06}, {"heading": 1}),
    ("list", {"function": 0.08, "capital": 0.47, "plain": 0.29, "number": 0.03, "other": 0.13}, {"letter": 0.68, "digit": 0.03, "space": 0.13, "end": 0.06, "mark": 0.10}, {"reference": 1}),
    ("list", {"function": 0.12, "plain": 0.62, "number": 0.13, "other": 0.13}, {"letter": 0.77, "digit": 0.03, "space": 0.15, "end": 0.01, "mark": 0.03, "symbol": 0.01}, {"item": 1}),
    ("list", {"capital": 0.33, "plain": 0.67}, {"letter": 0.865, "space": 0.10, "mark": 0.035}, {"gloss": 0.9, "column": 0.1}),
    ("list", {"function": 0.07, "capital": 0.22, "plain": 0.11, "number": 0.40, "other": 0.20}, {"letter": 0.30, "digit": 0.08, "space": 0.10, "end": 0.52}, {"contents": 1}),
    ("list", {"function": 0.03, "plain": 0.97}, {"letter": 0.82, "space": 0.105, "mark": 0.075}, {"phrases": 1}),
    ("list", {"function": 0.04, "capital": 0.06, "plain": 0.90}, {"letter": 0.83, "space": 0.11, "mark": 0.06}, {"column": 0.9, "heading": 0.1}),
    ("list", {"function": 0.03, "capital": 0.60, "plain": 0.27, "other": 0.10}, {"letter": 0.77, "space": 0.10, "end": 0.04, "mark": 0.09}, {"name": 1}),
    ("table", {"capital": 0.02, "plain": 0.18, "number": 0.35, "other": 0.45}, {"letter": 0.29, "digit": 0.24, "space": 0.28, "end": 0.07, "mark": 0.06, "symbol": 0.06}, {"row": 1}),
    ("table", {"capital": 0.06, "plain": 0.28, "number": 0.56, "other": 0.10}, {"letter": 0.39, "digit": 0.29, "space": 0.19, "end": 0.09, "mark": 0.02, "symbol": 0.02}, {"numbers": 1}),
    ("table", {"plain": 0.20, "number": 0.20, "other": 0.60}, {"letter": 0.45, "digit": 0.25, "space": 0.10, "end": 0.08, "mark": 0.06, "symbol": 0.06}, {"pairs": 1}),
    ("junk", {"plain": 0.10, "other": 0.90}, {"letter": 0.56, "digit": 0.07, "space": 0.06, "end": 0.04, "mark": 0.07, "symbol": 0.20}, {"noise": 1}),
    ("junk", {"function": 0.10, "capital": 0.72, "plain": 0.18}, {"letter": 0.85, "space": 0.15}, {"menu": 1}),
    ("junk", {"plain": 1}, {"letter": 0.885, "space": 0.115}, {"open": 1}),
    ("junk", {"plain": 0.07, "other": 0.93}, {"letter": 0.17, "space": 0.03, "end": 0.17, "mark": 0.17, "symbol": 0.46}, {"rule": 1}),
    ("junk", {"function": 0.24, "capital": 0.20, "plain": 0.56}, {"letter": 0.835, "space": 0.16, "end": 0.005}, {"again": 1}),
]

TOKEN = regex.compile(r"\S+")
CORE = regex.compile(r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$", regex.S)
WORD = regex.compile(r"\p{Lu}?[\p{Ll}\p{M}]+(?:['’-]\p{L}[\p{L}\p{M}]*)*|\p{Lu}[\p{Lu}\p{M}]*(?:['’-]\p{Lu}+)*|\p{L}{1,3}|\p{Ll}\p{Lu}\p{Ll}+")
NUMBER = regex.compile(r"[-+−–]?(?:\d+(?:[.,:]\d+)*)(?:%|\*{1,3}|[a-z]{1,2})?")
CELL = regex.compile(r"[-+−–]?[(]?\d+(?:[.,]\d+)*[)]?(?:%|\*{0,3})|n\.s\.|n/a|–|-|SE|SD|N|M|b|β|min|max|share|mean")
RULE = regex.compile(r"[\W_]*|(?:x|X|o|O|0|\W|_)\s*(?:\S)?(?:(?:x|X|o|O|0|\W|_)\s*){3,}")
SEPARATOR = regex.compile(r"[|&;,\t]|\\\\|(?<=\d)\*+")
PAIR = regex.compile(r"[^=\s]+[=:][-+]?\d[\d.,]*%?[;,|]?")
BULLET = regex.compile(r"\s*(?:[-–—*•·▪◦‣>+]|\(?\d{1,3}[.)]|\(?[a-z]\)|[a-z]\.|[A-Z]\)|\(?[ivxlc]{1,5}[.)]|\[\d{1,3}\])\s+\S")
CONTENTS = regex.compile(r".*(?:\.{4,}|(?:\s\.){4,}|…{2,}|·{4,}|_{4,})\s*\d+\s*")
GLOSS = regex.compile(r"\s*\p{L}[\p{L}\p{M} '’/-]{1,40}(?::|\s[–—=-])\s+\S.*")
CITED = regex.compile(r"(?:\[\d{1,3}\]\s+\S|(?:\d{1,3}\.\s*)?(?:\p{Ll}+ )*\p{Lu}[\p{L}\p{M}'’-]+,\s(?:\p{Lu}\.[\s-]?)+[,;&]?\s?\(?)")
YEAR = regex.compile(r"\b(?:1[5-9]|20)\d\d[a-z]?\b")
NAME_LINE = regex.compile(r"\s*(?:\p{Ll}+ )*\p{Lu}[\p{L}\p{M}'’-]+(?:, ?(?:\p{Lu}\.\s?)+| \p{Lu}{1,2}|, \p{Lu}\p{Ll}+)(?:,? ?\([^)]*\))?[;,.]?\s*")
END_MARK = regex.compile(r"[.!?…:;][\"'”’)\]»]*\d{0,3}\s*$")
SENTENCE_END = regex.compile(r"\p{L}{2,}[)\]\"”’']*[.!?…](?:\s|$)")


LINE_END = regex.compile("\r\n|[\n\r\u2028\x0b\x0c]")
FORM_AT = {f: i for i, f in enumerate(FORMS)}
#: Blocks compared with the profiles at a time.
TOGETHER = 4096

#: Marks taken off a token before it is looked up among the common words.
MARKS = ".,;:!?()[]{}\"'“”‘’«»„¿¡…*-–—"


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[int, int, tuple[int, ...]]:
    """(word class without regard to function words, letters and digits, languages in which it is a common word)."""
    core = CORE.match(token).group(1)
    low = token.lower().strip(MARKS)
    languages = tuple(i for i, c in enumerate(WORDS.values()) if low in c)
    if NUMBER.fullmatch(core) or NUMBER.fullmatch(token):
        return 3, len(core), languages
    if WORD.fullmatch(core) and len(core) <= 24 and len(token) - len(core) <= 3:
        return 1 if core[0].isupper() and core[1:].islower() else 2, len(core), languages
    return 4, len(core), languages


@lru_cache(maxsize=20_000)
def _char_class(c: str) -> int:
    if c.isalpha():
        return 0 if c < "ɐ" or c.isalpha() and not "ﬀ" <= c <= "ﬆ" else 5
    if c.isdigit():
        return 1
    if c.isspace():
        return 2
    if c in ".!?":
        return 3
    if c in ",;:'\"()[]-–—’‘“”/%&«»¿¡":
        return 4
    return 5


def _information(x: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis."""
    return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(axis=-1)


def jensen_shannon(p, q) -> np.ndarray:
    """Divergence in bits, 0 to 1, of every distribution in ``p`` from every one in ``q``."""
    p, q = np.atleast_2d(np.asarray(p, dtype=float)), np.atleast_2d(np.asarray(q, dtype=float))
    mean = _information((p[:, None] + q[None]) / 2)
    return np.maximum(0.0, mean - (_information(p)[:, None] + _information(q)[None]) / 2)


def _profile_matrix(part: int, classes: tuple[str, ...]) -> np.ndarray:
    x = np.array([[p[part].get(c, 0.0) for c in classes] for p in PROFILES])
    return x / x.sum(axis=1, keepdims=True)


KINDS = np.array([p[0] for p in PROFILES])
MATRICES = [_profile_matrix(i, c) for i, c in ((1, WORD_CLASSES), (2, CHAR_CLASSES), (3, FORMS))]


def nearest_profiles(words, chars, forms) -> np.ndarray:
    """Number of the nearest profile of each block, from its three distributions."""
    if not len(words):
        return np.empty(0, dtype=int)
    far = sum(w * jensen_shannon(x, m) for w, x, m in zip(WEIGHTS, (words, chars, forms), MATRICES))
    return far.argmin(axis=1)


class _Doc:
    """What the steps share about a text: its language, which tokens are common words, its distributions."""

    def __init__(self, text: str):
        counts = Counter(text.split())
        hits, classes = [0] * len(WORDS), [0] * 5
        self.words = self.letters = total = 0
        seen = []
        for t, k in counts.items():
            kind, size, languages = _token(t)
            total += k
            classes[kind] += k
            if size:
                self.words += k
                self.letters += k * size
            if languages:
                seen.append((t, k, kind, languages))
                for i in languages:
                    hits[i] += k
        self.hits = max(hits)
        best = hits.index(self.hits)
        self.language = list(WORDS)[best] if self.hits else None
        self.common = {t for t, _, _, languages in seen if best in languages}
        for t, k, kind, languages in seen:
            if best in languages and kind != 4:
                classes[kind] -= k
                classes[0] += k
        chars = [0] * 6
        for c, k in Counter(text).items():
            chars[_char_class(c)] += k
        self.whole = [x / max(1, total) for x in classes], [x / max(1, len(text)) for x in chars]

    def count(self, tokens: list[str]) -> int:
        common = self.common
        return sum([t in common for t in tokens])

    def distributions(self, text: str) -> tuple[list[float], list[float]]:
        """(words by class, characters by class) of a block."""
        words, n = [0] * 5, 0
        for t, k in Counter(text.split()).items():
            n += k
            kind = _token(t)[0]
            words[0 if kind != 4 and t in self.common else kind] += k
        chars = [0] * 6
        for c, k in Counter(text).items():
            chars[_char_class(c)] += k
        return [x / max(1, n) for x in words], [x / max(1, len(text)) for x in chars]


def _cells(line: str, doc: _Doc) -> int:
    """Cells of a row in any layout, 0 if the line is none."""
    s = line.strip()
    if s.count("|") >= 2 or s.startswith("|") and s.endswith("|"):
        return len(s.strip("|").split("|"))
    if "\t" in s:
        return len(s.split("\t"))
    if s.endswith("\\\\") or s.count(" & ") >= 2 and not SENTENCE_END.search(s[:-1]):
        return len(s.split("&"))
    if "  " in s:
        parts = regex.split(r"\s{2,}", s)
        if len(parts) >= 3 and not any(len(p) > 40 for p in parts):
            tokens = s.split()
            if doc.count(tokens) < 0.15 * len(tokens):
                return len(parts)
    return 0


def _number_share(tokens: list[str]) -> float:
    return sum(bool(CELL.fullmatch(t)) for t in tokens) / max(1, len(tokens))


def _phrases(text: str, doc: _Doc) -> bool:
    """Short phrases set apart by semicolons or commas, without sentences."""
    body = regex.sub(r"^\s*\p{L}[\p{L} ]{0,25}:\s*", "", text)
    parts = [p.split() for p in regex.split(r"[;,•|/\n]", body) if p.strip()]
    if len(parts) < 3:
        return False
    words = [w for p in parts for w in p]
    share = sum(w in doc.common or bool(_token(w)[2]) for w in words) / len(words)
    return len(words) / len(parts) <= 4.5 and share < 0.12


def _line_form(line: str, doc: _Doc) -> str | None:
    """Form of a line that shows in the line itself, None if it takes more than that."""
    s = line.strip()
    tokens = s.split()
    if CITED.match(s) and (len(s) < 30 or YEAR.search(s)):
        return "reference"
    if len(tokens) >= 6 and "|" not in s and "\t" not in s and "&" not in s and "...." not in s and doc.count(tokens) >= 0.16 * len(tokens):
        return "item" if len(s) <= 120 and BULLET.match(line) else "running"
    if RULE.fullmatch(s) and len(set(s.replace(" ", ""))) <= 3 and len(s) > 1:
        return "rule"
    if len(s) >= 16:
        clean = [t for t in SEPARATOR.sub(" ", s).split() if t]
        if sum(len(t) for t in clean if _token(t)[0] != 4 or CELL.fullmatch(t)) < 0.5 * sum(map(len, clean)):
            pairs = [t for t in tokens if PAIR.fullmatch(t)]
            if len(pairs) < 0.45 * len(tokens) and not CONTENTS.fullmatch(s):
                return "noise"
    if CONTENTS.fullmatch(s):
        return "contents"
    if _cells(line, doc):
        return "row"
    if s.count(";") + s.count(",") >= 2:
        mark = ";" if s.count(";") >= s.count(",") else ","
        cells = [c.strip().strip('"') for c in s.split(mark)]
        numbers, empty = sum(bool(CELL.fullmatch(c)) for c in cells), sum(not c for c in cells[:-1])
        if len(cells) >= 3 and (numbers and numbers + empty >= 0.5 * (len(cells) - 1) or empty >= 2 or max(map(len, cells)) <= 24 and '",' in s.replace('", "', '","')):
            return "row"
        if len(cells) >= 3 and mark == "," and " " not in s and cells[-1]:
            return "row"
    if len(tokens) >= 3 and _number_share(tokens) >= 0.45:
        return "numbers"
    pairs = sum(bool(PAIR.fullmatch(t)) for t in tokens if "=" in t or ":" in t)
    if len(tokens) >= 2 and pairs >= 0.45 * len(tokens):
        return "pairs"
    if BULLET.match(line):
        return "item"
    return "name" if NAME_LINE.fullmatch(s) and len(s) < 60 else None


def line_forms(lines: list[str], doc: _Doc) -> list[str]:
    """Form of each line among its fellows."""
    keys = [x.strip().lower() for x in lines]
    repeated = Counter(keys)
    out = []
    for x, key in zip(lines, keys):
        form = _line_form(x, doc)
        if form in (None, "name", "running") and repeated[key] >= 3 and repeated[key] * 4 >= len(lines):
            form = "again"
        elif key in NAVIGATION:
            form = "menu"
        if form is None:
            n = len(x.split())
            if n <= 14 and GLOSS.fullmatch(x):
                form = "gloss"
            elif n <= 6:
                form = "heading"
            elif _phrases(x, doc):
                form = "phrases"
            else:
                form = "sentence" if SENTENCE_END.search(x.rstrip()[-12:]) else "open"
        out.append(form)
    return out


#: Forms of lines of words, and those among them that are short; lines of any other form stand in blocks of their own.
OF_WORDS = {"running", "sentence", "open", "phrases", "heading", "name", "gloss"}
SHORT = {"heading", "name", "gloss"}


def _blocks(lines: list[str], forms: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of one build; forms of short lines that stand in a column are renamed."""
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and (forms[j] == forms[i] or forms[i] in OF_WORDS and forms[j] in OF_WORDS):
            j += 1
        if forms[i] not in OF_WORDS:
            yield i, j
            i = j
            continue
        start = i  # of words that are not in a column
        while i < j:
            k = i
            while k < j and (forms[k] in SHORT) == (forms[i] in SHORT):
                k += 1
            column = forms[i] in SHORT and k - i >= COLUMN
            if column:
                yield from _paragraphs(lines, start, i)
                forms[i:k] = ["column" if f == "heading" else f for f in forms[i:k]]
                yield i, k
                start = k
            elif forms[i] in SHORT:
                forms[i:k] = ["heading"] * (k - i)
            i = k
        yield from _paragraphs(lines, start, j)


def _paragraphs(lines: list[str], start: int, stop: int) -> Iterator[tuple[int, int]]:
    """A block of words, or its lines one by one if they are as long as paragraphs."""
    if stop - start > 1 and all(len(x) > 160 for x in lines[start : stop - 1]):
        yield from ((k, k + 1) for k in range(start, stop))
    elif stop > start:
        yield start, stop


def blocks_of(text: str, doc: _Doc) -> list[tuple[int, list[float], list[float], list[float]]]:
    """``(characters, words by class, characters by class, characters by form of line)`` of the blocks of a text."""
    lines = [x for x in LINE_END.split(text) if x.strip()]
    forms = line_forms(lines, doc)
    out = []
    for i, j in _blocks(lines, forms):
        shares = [0.0] * len(FORMS)
        for k in range(i, j):
            shares[FORM_AT[forms[k]]] += len(lines[k])
        size = sum(shares)
        words, chars = doc.distributions(" ".join(x.strip() for x in lines[i:j]))
        out.append((int(size), words, chars, [x / size for x in shares]))
    return out


def document_kinds(texts: list[str], docs: list[_Doc] | None = None) -> list[tuple[str, float]]:
    """(kind, share of characters that are not prose) of each text, all compared with the profiles together; kind
    ``prose`` while the share is at most a half."""
    docs = docs or [_Doc(t) for t in texts]
    total = [dict.fromkeys(("list", "table", "junk", "prose"), 0) for _ in texts]
    pending: list[tuple[int, tuple]] = []

    def settle() -> None:
        sizes, words, chars, forms = zip(*(b for _, b in pending))
        for (i, _), n, at in zip(pending, sizes, nearest_profiles(words, chars, forms)):
            total[i][KINDS[at]] += n
        pending.clear()

    for i, (text, doc) in enumerate(zip(texts, docs)):
        pending += [(i, b) for b in blocks_of(text, doc)]
        if len(pending) >= TOGETHER:
            settle()
    if pending:
        settle()
    out = []
    for t in total:
        size = sum(t.values())
        share = 1 - t["prose"] / size if size else 0.0
        out.append(("blank" if not size else "prose" if share <= 0.5 else max(("list", "table", "junk"), key=t.get), share))
    return out


def document_kind(text: str) -> tuple[str, float]:
    """``document_kinds`` of one text."""
    return document_kinds([text])[0]


FIELDS = (
    "kind string, non_prose double, words long, lines long, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "punctuated_lines double, common_words double, language string, prose_divergence double"
)


def statistics(texts: list[str | None]) -> list[tuple]:
    """The fields of ``FIELDS`` of each text. A null, empty or blank text has kind ``blank``, zero counts and null ratios."""
    real = [t for t in texts if t is not None and t.strip()]
    docs = [_Doc(t) for t in real]
    kinds = document_kinds(real, docs)
    prose = KINDS == "prose"
    far = np.zeros(len(real))
    if real:
        words, chars = ([d.whole[i] for d in docs] for i in (0, 1))
        far = (jensen_shannon(words, MATRICES[0][prose]) + jensen_shannon(chars, MATRICES[1][prose])).min(axis=1)
    out = []
    for t, d, (kind, share), f in zip(real, docs, kinds, far):
        n, chars = d.words, d.whole[1]
        lines = [x for x in t.split("\n") if x.strip()]
        ended = sum(bool(END_MARK.search(x.rstrip()[-12:])) for x in lines) / len(lines)
        out.append((kind, share, n, len(lines), d.letters / n if n else None, chars[5], chars[1], ended, d.hits / n if n else None, d.language, float(f)))
    rows = iter(out)
    return [next(rows) if t is not None and t.strip() else ("blank", None, 0, 0, None, None, None, None, None, None, None) for t in texts]


def text_statistics(text: Column) -> Column:
    """Struct of the statistics of a text (see ``statistics``)."""

    @F.pandas_udf(FIELDS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(statistics(list(texts)), columns=[f.split()[0] for f in FIELDS.split(", ")])

    return stats.asNondeterministic()(text)  # else a filter on a field would compute all of it twice


def quality(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, <statistics>)``, one row per row of ``df``. Narrow: no shuffle."""
    return df.select(F.col(id_col).alias("id"), text_statistics(F.col(text_col)).alias("s")).select("id", "s.*")
