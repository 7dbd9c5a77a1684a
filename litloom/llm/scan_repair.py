"""Problem 1 - repair text from scanned pages into continuous paragraphs.

1. Lines of page furniture (running headers, page numbers) are told by their form and taken out.
2. A lexicon counts the words of the whole corpus, those of rows without scanning marks apart. All words that are frequent
   enough to explain another form a trie that every decoder holds; beyond the most frequent ones it is packed and opens
   where a decoder gets to.
3. Each text is decoded as one stream of characters without lines. Words that stand in unmarked rows are taken as they
   are; around all others a lattice over the characters is searched, whose arcs are words of the trie read with any of:
   characters confused (several a word), blanks inside a word (merges), no blank between words (splits), hyphens at line
   ends dropped, kept or hanging. The cheapest path is taken: costs are the words' negative log frequencies, fixed costs
   of the operations, and for unknown words a cost by length.
4. Paragraph boundaries are chosen by dynamic programming over the lines, from blank lines, line fill, sentence ends
   and beginnings.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: Words that every task keeps unpacked, and most corrections; beyond the second the corrections are joined to rows.
TOP_WORDS, MAX_FACTS = 50_000, 300_000
#: A correction must be this many times as frequent, in unmarked rows, as the word it replaces anywhere.
RATIO = 8

HYPHENS = "-­¬‐‑"
# What is printed (key) and what may have been meant.
CONFUSIONS = {
    "rn": ("m",), "m": ("rn", "in"), "ri": ("n",), "n": ("ri", "u"), "in": ("m",), "cl": ("d",), "d": ("cl",), "li": ("h",), "h": ("li", "b"), "ii": ("u",), "u": ("ii", "n"),
    "vv": ("w",), "w": ("vv",), "l": ("i", "t"), "i": ("l", "j"), "|": ("l", "i"), "!": ("l", "i"), "1": ("l", "i"), "0": ("o",), "5": ("s",), "6": ("b",), "8": ("b",), "9": ("g", "q"),
    "e": ("c",), "c": ("e",), "f": ("t",), "t": ("f", "l"), "o": ("a",), "a": ("o",), "b": ("h",), "s": ("5",), "g": ("q", "9"), "q": ("g",), "y": ("v",), "v": ("y",), "j": ("i",),
}
# Words after a hanging hyphen ("short- and long-term").
AFTER_HANGING = {"and", "or", "to", "nor", "und", "oder", "bis", "et", "ou", "y", "o", "e", "versus", "vs", "rather"}

TOKEN = regex.compile(r"[|!]?[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}|!]*[\p{L}\p{M}\p{N}|])?(?:[-‐‑’'][\p{L}\p{M}\p{N}|!]*[\p{L}\p{M}\p{N}|])*")
INNER_HYPHEN = regex.compile(r"[-‐‑]")
LETTER = regex.compile(r"\p{L}")
#: A line that breaks off inside a sentence: the mark of text that kept its printed lines.
MARKED = regex.compile(r"[\p{L},;­¬‐-][ \t]*\n")
NUMBER_LINE = regex.compile(r"[\[({<|~*•–—-]{0,2}\s*(?:\d{1,4}|[ivxlc]{1,6}|[IVXLC]{1,6})\s*[\])}>|~*•–—-]{0,2}")
PAGE_LINE = regex.compile(r"[\[(–—-]?\s*(?i:page|pages?|p\.|pp\.|seite|página|pág\.|folio)\s*\d{1,4}(?:\s*(?:of|/|von|de|sur)\s*\d{1,5})?\s*[\])–—-]?")
NUMBERED_HEAD = regex.compile(r"\|?\s*\d{1,4}(?:\s{2,}|\s*\|\s*)\S.*|\S.*(?:\s{2,}|\s*\|\s*)\d{1,4}\s*\|?")
TITLE_WORDS = r"(?:\p{Lu}[\p{L}\p{M}'’&-]*|of|on|in|and|the|for|to|de|la|du|des|und|der|die|&)"
ISSUE_LINE = regex.compile(rf"{TITLE_WORDS}(?:\s+{TITLE_WORDS})*,?\s+(?:(?i:vol\.?|no\.?|nr\.?|issue)\s*)?\d{{1,4}}\s*(?:\(\d{{1,4}}\)|,\s*(?i:no\.?|issue|nr\.?)\s*\d+).{{0,24}}")
CITED_LINE = regex.compile(r"(?:\p{Ll}+\s){0,3}\p{Lu}[^/]{2,60}/\s*\p{Lu}.*\d[\d\s,:()–-]*")
RUNNING = regex.compile(r"(?i)\|?\s*\d*\s*\|?\s*(?:running (?:title|head)|downloaded from|available online|copyright|©|issn|doi:?)\b.*")
SENTENCE_END = regex.compile(r"[.!?…:][\"'”’»)\]]*\d{0,3}$")


def furniture(lines: list[str]) -> list[bool]:
    """For each line: is it a running header or page number? Single-line texts have none."""
    real = [x for x in lines if x.strip()]
    out = [False] * len(lines)
    if len(real) < 2:
        return out
    mostly_lower = None
    for i, x in enumerate(lines):
        s = x.strip()
        if not s or len(s) > 120:
            continue
        if s[0].isdigit() or s[-1].isdigit() or s[0] in "[({<|~*•–—-" or s[0].isalpha() or not any(map(str.islower, s)):
            head = NUMBERED_HEAD.fullmatch(s) is not None and not SENTENCE_END.search(s)
            if head and s[0].isdigit() and not s.split(None, 1)[1:][0][:1].isupper() and "|" not in s:
                head = False
            caps = not any(map(str.islower, s))
            if caps and mostly_lower is None:
                mostly_lower = sum(sum(map(str.islower, x)) for x in real) > 0.6 * max(1, sum(sum(map(str.isalpha, x)) for x in real))
            caps = caps and mostly_lower and sum(c.isupper() for c in s) >= 4 and (any(c.isdigit() for c in s) or len(s.split()) >= 2) and s[-1] not in ".,;"
            out[i] = bool(NUMBER_LINE.fullmatch(s) and any(c.isdigit() for c in s) or PAGE_LINE.fullmatch(s) or head or caps or ISSUE_LINE.fullmatch(s) or CITED_LINE.fullmatch(s) or RUNNING.fullmatch(s))
    # what stands between the two halves of a cut word and doesn't go on with it is furniture as well
    for i, x in enumerate(lines):
        s = x.rstrip()
        if out[i] or len(s) < 3 or s[-1] not in HYPHENS or not s[-2].islower():
            continue
        rest = [k for k in range(i + 1, min(i + 6, len(lines))) if lines[k].strip() and not out[k]][:2]
        if len(rest) == 2 and rest[1] > rest[0] and (a := lines[rest[0]].strip())[:1].isupper() and len(a) < 90 and a[-1] not in ".,;" and lines[rest[1]].strip()[:1].islower():
            out[rest[0]] = any(c.isdigit() for c in a)
    if all(out[i] for i, x in enumerate(lines) if x.strip()):
        return [False] * len(lines)
    return out


class Piece:
    """A blank-separated run of the stream: its text, whether a hyphen ends its line, and the line it stands in."""

    __slots__ = ("before", "core", "after", "cut", "line", "low")

    def __init__(self, raw: str, cut: bool, line: int):
        body = raw[:-1] if cut else raw
        if body.isalpha():
            self.before, self.core, self.after = "", body, ""
        elif body[:-1].isalpha() and body[-1] in ".,;:)":
            self.before, self.core, self.after = "", body[:-1], body[-1]
        elif (m := TOKEN.search(body)) and LETTER.search(m.group(0)):
            self.before, self.core, self.after = body[: m.start()], m.group(0), body[m.end() :]
        else:
            self.before, self.core, self.after = body, "", ""
        self.cut, self.line = cut and bool(self.core) and not self.after, line
        if cut and not self.cut:
            self.after += raw[-1]
        self.low = self.core.lower()


def stream(lines: list[str], skip: list[bool]) -> list[Piece]:
    out = []
    for i, x in enumerate(lines):
        if skip[i]:
            continue
        raws = x.split()
        for j, raw in enumerate(raws):
            cut = j == len(raws) - 1 and i < len(lines) - 1 and len(raw) > 1 and raw[-1] in HYPHENS
            out.append(Piece(raw, cut, i))
    return out


def joined(a: Piece, b: Piece) -> tuple[str, str, str, str, str]:
    """(without hyphen, with hyphen, last part of a, first part of b, both joined), in lower case."""
    x, y = a.low, b.low
    last, first = INNER_HYPHEN.split(x)[-1], INNER_HYPHEN.split(y)[0]
    return x + y, f"{x}-{y}", last, first, last + first


def _hangs(b: Piece) -> bool:
    return b.low in AFTER_HANGING


class Lexicon:
    """Word counts and corrections that a decoder may look at: ``word -> (count, correction or None, count in unmarked
    rows, count of the correction's first word)``."""

    def __init__(self, top: dict[str, int], facts: dict[str, tuple[int, str | None, int, int]], total: float, rest: Rest | None = None):
        self.top, self.facts, self.total, self.rest = top, facts, max(total, 1.0), rest
        self.known_arcs: dict = {}
        self.costs: dict[str, float] = {}

    def count(self, word: str) -> int:
        return self.top.get(word) or self.facts.get(word, (0, None, 0, 0))[0]

    def clean(self, word: str) -> int:
        return self.top.get(word) or self.facts.get(word, (0, None, 0, 0))[2]

    def correction(self, word: str) -> str | None:
        return None if word in self.top else self.facts.get(word, (0, None, 0, 0))[1]

    def doubtful(self, word: str) -> bool:
        """Is a word hardly there in unmarked rows, so that it may be misread?"""
        if word in self.top:
            return False
        total, _, clean, _ = self.facts.get(word, (0, None, 0, 0))
        return clean < 2 or clean <= total * 0.25

    def cost(self, word: str) -> float:
        return self._cost(self.count(word))

    def frequent_cost(self, word: str) -> float | None:
        cost = self.costs.get(word)
        if cost is None and word in self.top:
            cost = self.costs[word] = self._cost(self.top[word])
        return cost

    def as_printed(self, word: str) -> float:
        """Cost of a word that stays as it is; a doubtful one costs by its length."""
        return max(self.cost(word), UNKNOWN + UNKNOWN_LETTER * len(word)) if self.doubtful(word) else self.cost(word)

    def fix_cost(self, word: str) -> float:
        """Cost of the first word of a word's correction; its count comes with the correction."""
        return self._cost(self.top.get(self.correction(word).split(" ")[0]) or self.facts[word][3])

    def _cost(self, count: int) -> float:
        return -math.log((count + 0.01) / self.total)

    def trie(self) -> dict:
        """The words that may be meant by letters; built once a process for each lexicon."""
        if _TRIE.get("top") is not self.top or _TRIE["rest"] is not self.rest:
            root: dict = {}
            for w, n in self.top.items():
                node = root
                for c in w:
                    node = node.setdefault(c, {})
                node[WORD_END] = n
            _TRIE.update(top=self.top, rest=self.rest, frequent=root, root=root, opened=OPENED + 1)
        if self.rest is not None and _TRIE["opened"] > OPENED:
            _TRIE.update(root=Branch(_TRIE["frequent"], self.rest, 0, len(self.rest.words), 0), opened=0)
        return _TRIE["root"]


#: The trie of the process and the lexicon it was built from.
_TRIE: dict = {}
WORD_END = ""
#: Branches of packed words that stay open.
OPENED = 500_000


class Rest(NamedTuple):
    """The words beyond the most frequent ones that may be meant, in order, and their counts."""

    words: pa.Array
    counts: pa.Array


class Branch(dict):
    """A node of the trie that takes its words of a range of ``Rest`` up when it is first asked."""

    __slots__ = ("rest", "lo", "hi", "depth")

    def __init__(self, frequent: dict, rest: Rest, lo: int, hi: int, depth: int):
        super().__init__(frequent)
        self.rest, self.lo, self.hi, self.depth = rest, lo, hi, depth

    def get(self, key: str, default=None):
        if self.rest is not None:
            self._open()
        return dict.get(self, key, default)

    def _open(self) -> None:
        rest, i, at = self.rest, self.lo, self.depth
        self.rest = None
        if i < self.hi and len(rest.words[i].as_py()) == at:
            self[WORD_END] = rest.counts[i].as_py()
            i += 1
        while i < self.hi:
            c = rest.words[i].as_py()[at]
            stop = bisect_right(range(self.hi), c, i, key=lambda k: rest.words[k].as_py()[at])
            self[c] = Branch(dict.get(self, c, {}), rest, i, stop, at + 1)
            _TRIE["opened"] += 1
            i = stop


# Fixed costs of the operations, in natural-log units.
FIX, SPLIT, MERGE, KEEP_HYPHEN, DROP_HYPHEN, UNSEEN_PAIR = 2.0, 2.0, 4.0, 0.7, 0.2, 1.0
UNKNOWN, UNKNOWN_LETTER = 12.0, 1.5
#: Characters that may be confused in one word of the lattice.
MOST_FIXES = 3
#: Letters of a word with confused characters that has no blank beside it.
SPLIT_FIXED = 4


def _single(p: Piece, lex: Lexicon) -> tuple[float, str, str | None]:
    """(cost, text, word meant if it was misread)"""
    if not p.core:
        return 0.0, p.before + p.after, None
    word = p.low
    known = lex.frequent_cost(word)
    if known is not None and word.isascii():
        return known, p.before + p.core + p.after, None
    fix = lex.correction(word)
    if fix:
        text = _cased(fix, p.core)
        return FIX + lex.fix_cost(word) + (SPLIT if " " in fix else 0), p.before + text + p.after, None if " " in fix else text
    plain = unicodedata.normalize("NFKC", p.core)
    if plain != p.core and any("ﬀ" <= c <= "ﬆ" for c in p.core):
        return FIX + lex.cost(plain.lower()), p.before + plain + p.after, plain
    return lex.as_printed(word), p.before + p.core + p.after, None


class Arc(NamedTuple):
    """A reading of the pieces up to ``stop``: its cost, words, and for each word whether characters were confused."""

    cost: float
    words: tuple[str, ...]
    fixed: tuple[bool, ...]


def arcs(cores: tuple[str, ...], cut: tuple[bool, ...], total: tuple[int, ...], lex: Lexicon) -> dict[int, Arc]:
    """Cheapest reading by the trie of the first 1, 2, ... of some pieces (lower-case cores that may merge), for those
    numbers of pieces that have one in which no blank between pieces ends a word.

    ``cut`` tells which pieces end in a line-end hyphen, ``total`` how often each stands in marked rows; a word must be
    ``RATIO`` times as frequent as every printed form that it explains.
    """
    root, out = lex.trie(), {}
    most = [min(MOST_FIXES, len(c) // 2) if len(c) > 2 or not c.isalpha() else 0 for c in cores]  # "fo" may be a broken-off "for"
    best: dict[tuple[int, int], Arc] = {(0, 0): Arc(0.0, (), ())}
    todo = [(0, 0)]
    while todo:
        at = min(todo)
        todo.remove(at)
        so_far = best[at]
        first, _ = at
        stack = [(root, first, at[1], 0, 0.0, "")]
        while stack:
            node, i, off, fixes, cost, word = stack.pop()
            core = cores[i]
            n = node.get(WORD_END)
            inside = off < len(core)
            # beside a split no single letters and no short corrected words: parts of a broken-off word would pass for these
            short = (inside or so_far.words) and (len(word) < 2 or fixes and len(word) < SPLIT_FIXED)
            if n is not None and word and not short and n >= RATIO * max(1, *total[first : i + 1]):
                c = so_far.cost + cost + lex._cost(n) + (SPLIT if inside else 0.0)
                arc = Arc(c, (*so_far.words, word), (*so_far.fixed, fixes > 0))
                if inside:
                    if c < best.get((i, off), NO_ARC).cost:
                        if (i, off) not in best:
                            todo.append((i, off))
                        best[i, off] = arc
                elif c < out.get(i + 1, NO_ARC).cost:
                    out[i + 1] = arc
            if off == len(core):
                if i + 1 < len(cores):
                    stack.append((node, i + 1, 0, fixes, cost + (DROP_HYPHEN if cut[i] else MERGE), word))
                    if cut[i] and (child := node.get("-")) is not None:
                        stack.append((child, i + 1, 0, fixes, cost + KEEP_HYPHEN, word + "-"))
                continue
            if (child := node.get(core[off])) is not None:
                stack.append((child, i, off + 1, fixes, cost, word + core[off]))
            if fixes < most[i]:
                for size in (1, 2):
                    for meant in CONFUSIONS.get(core[off : off + size], ()) if off + size <= len(core) else ():
                        child = node
                        for x in meant:
                            child = child.get(x)
                            if child is None:
                                break
                        else:
                            stack.append((child, i, off + size, fixes + 1, cost + FIX, word + meant))
    return out


NO_ARC = Arc(math.inf, (), ())


def _linked(a: Piece, b: Piece) -> bool:
    """May two pieces be parts of one word?"""
    return bool(a.core and b.core and not a.after and not b.before) and not (a.cut and _hangs(b))


def _zones(pieces: list[Piece], lex: Lexicon) -> list[tuple[int, int]]:
    """Ranges of pieces around doubtful words, each with what may merge with them."""
    top = lex.top
    marks = [i for i, p in enumerate(pieces) if p.low not in top and p.core and lex.doubtful(_plain_core(p))]
    for i, (a, b) in enumerate(zip(pieces, pieces[1:])):
        if a.cut and _linked(a, b) and not any(lex.count(w) for w in joined(a, b)[:2]):
            marks.append(i)
    out: list[tuple[int, int]] = []
    for i in sorted(set(marks)):
        start, stop = i, i + 1
        if i and _linked(pieces[i - 1], pieces[i]):
            start = i - 1
        if stop < len(pieces) and _linked(pieces[i], pieces[stop]):
            stop += 1
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _plain_core(p: Piece) -> str:
    return p.low if p.low.isascii() else unicodedata.normalize("NFKC", p.core).lower()


def _lattice(pieces: list[Piece], lex: Lexicon) -> dict[int, list[tuple[int, Arc]]]:
    """``start -> [(stop, reading)]`` of the zones of a text."""
    out: dict[int, list[tuple[int, Arc]]] = {}
    for start, stop in _zones(pieces, lex):
        cores = [_plain_core(p) for p in pieces[start:stop]]
        doubt = [lex.doubtful(c) for c in cores]
        for i in range(start, stop):
            j = i + 1
            while j < stop and _linked(pieces[j - 1], pieces[j]):
                j += 1
            # no reading is asked for of words that are known, beside no doubtful one
            near = [k for k in range(i, j) if doubt[k - start] or pieces[k].cut]
            if not near:
                continue
            j = min(j, near[-1] + 2)
            part = slice(i - start, j - start)
            key = tuple(cores[part]), tuple(p.cut for p in pieces[i:j]), tuple(lex.facts.get(c, (0, None, 0, 0))[0] if d else 0 for c, d in zip(cores[part], doubt[part]))
            found = lex.known_arcs.get(key)
            if found is None:
                if len(lex.known_arcs) > 200_000:
                    lex.known_arcs.clear()
                found = lex.known_arcs[key] = arcs(*key, lex)
            for n, arc in found.items():
                span = range(i, i + n)
                if n == 1 and not doubt[i - start] or n > 1 and not any(doubt[k - start] for k in span) and not any(pieces[k].cut for k in span):
                    continue  # a known word stays; known words printed apart are merged by their own rule
                if pieces[i + n - 1].cut and i + n < len(pieces):
                    continue  # the hyphen goes with the next piece
                if n == 2 and pieces[i].cut and any(lex.count(w) for w in joined(pieces[i], pieces[i + 1])[:2]):
                    continue  # a word that stands elsewhere was cut, not misread
                out.setdefault(i, []).append((i + n, arc))
    return out


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and like[:1].isupper() else word


def _cut_options(a: Piece, b: Piece, lex: Lexicon) -> list[tuple[float, str]]:
    """(cost, whole word) of reading two pieces as one word that a line end cut."""
    j, h, last, first, both = joined(a, b)
    plain_j, plain_h = a.core + b.core, f"{a.core}-{b.core}"
    fix_j, fix_h = (lex.correction(j) if not lex.count(j) else None), (lex.correction(h) if not lex.count(h) else None)
    nj, nh = lex.count(j), lex.count(h)
    options = []
    if fix_j and " " not in fix_j:
        options.append((DROP_HYPHEN + FIX + lex.fix_cost(j), _cased(fix_j, plain_j)))
    if fix_h and " " not in fix_h:
        options.append((KEEP_HYPHEN + FIX + lex.fix_cost(h), _cased(fix_h, plain_h)))
    proper = b.core[:1].isupper() and not a.core.isupper()
    parts = UNSEEN_PAIR + max(lex.cost(last), lex.cost(first))
    options.append((DROP_HYPHEN + (lex.cost(j) if nj else min(lex.cost(j), UNSEEN_PAIR + lex.cost(both) if lex.count(both) else 99.0)) + (20.0 if proper else 0.0), plain_j))
    options.append((KEEP_HYPHEN + (lex.cost(h) if nh else parts + (6.0 if nj else 0.0) + (0.0 if lex.count(last) and lex.count(first) else 6.0)) - (20.0 if proper else 0.0), plain_h))
    return options


def _apart(a: Piece, b: Piece, lex: Lexicon, least: float = math.inf) -> bool:
    """Are two pieces one word printed apart? By cost, and if the rarer part stands far less often in unmarked rows than
    the whole, and fewer than ``least`` times; of two real words, both have three letters ("net work", not "a cross")."""
    x, y = a.low, b.low
    n = lex.clean(x + y)
    if n < RATIO or a.cut or b.cut or a.after or b.before or not x.isalpha() or not y.isalpha() or not (b.core.islower() or a.core.isupper() and b.core.isupper()):
        return False
    if lex.correction(x + y):
        return False
    rarer = min(lex.clean(x), lex.clean(y))
    if rarer >= least or n < RATIO * rarer or rarer >= 2 and min(len(x), len(y)) < 3:
        return False
    return MERGE + lex.cost(x + y) < lex.cost(x) + lex.cost(y)


def decode(pieces: list[Piece], lex: Lexicon) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(words with the line they start in, findings as ``(kind, fixed)``) of the cheapest reading of a stream."""
    n = len(pieces)
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple] = [()] * (n + 1)  # (start, text, findings)
    lattice = _lattice(pieces, lex)
    for i, p in enumerate(pieces):
        base = best[i]
        cost, text, meant = _single(p, lex)
        if p.cut:
            text += "-"
            hanging = i + 1 < n and _hangs(pieces[i + 1])
            cost += 0.0 if hanging or i + 1 == n else 30.0
        if base + cost < best[i + 1]:
            best[i + 1], back[i + 1] = base + cost, (i, text, [("ocr", meant)] if meant else [])
        for stop, arc in lattice.get(i, ()):
            if base + arc.cost < best[stop]:
                best[stop], back[stop] = base + arc.cost, (i, *_reading(pieces[i:stop], arc))
        if i + 1 < n and p.core and (b := pieces[i + 1]).core and not p.after and not b.before:
            if p.cut:
                if not _hangs(b):
                    # a chain of cuts: take up further pieces while they end in a hyphen as well
                    k, whole = i + 1, p
                    while True:
                        b = pieces[k]
                        c, word = min(_cut_options(whole, b, lex))
                        if not b.cut or k + 1 >= n or not pieces[k + 1].core or pieces[k + 1].before or _hangs(pieces[k + 1]):
                            break
                        merged = Piece(word + "-", True, p.line)
                        whole, k = merged, k + 1
                    if base + c < best[k + 1]:
                        best[k + 1], back[k + 1] = base + c, (i, p.before + word + b.after + ("-" if b.cut else ""), [("hyphen", word)])
            elif _apart(p, b, lex):
                c = MERGE + lex.cost(p.low + b.low)
                if base + c < best[i + 2]:
                    best[i + 2], back[i + 2] = base + c, (i, p.before + p.core + b.core + b.after, [])
    words, found, i = [], [], n
    while i > 0:
        start, text, cases = back[i]
        words.append((text, pieces[start].line))
        found += cases[::-1]
        i = start
    return words[::-1], found[::-1]


def _reading(pieces: list[Piece], arc: Arc) -> tuple[str, list[tuple[str, str]]]:
    """(text, findings) of pieces read as an arc says."""
    printed = "".join(p.core for p in pieces)
    cut = any(p.cut for p in pieces[:-1])
    words, cases = [], []
    for k, (word, fixed) in enumerate(zip(arc.words, arc.fixed)):
        as_meant = _cased(word, printed) if k == 0 or printed.isupper() else word
        words.append(as_meant)
        if cut and len(arc.words) == 1:
            cases.append(("hyphen", as_meant))
        elif fixed:
            cases.append(("ocr", as_meant))
    return pieces[0].before + " ".join(words) + pieces[-1].after + ("-" if pieces[-1].cut else ""), cases


def paragraphs(lines: list[str], skip: list[bool], words: list[tuple[str, int]]) -> list[str]:
    """The words set as paragraphs; breaks are chosen by dynamic programming over the lines that hold text."""
    kept = [i for i, x in enumerate(lines) if x.strip() and not skip[i]]
    if not kept:
        return []
    width = sorted(len(lines[i].strip()) for i in kept)[int(0.8 * (len(kept) - 1))]
    # two states, line continues (0) or begins (1) a paragraph; a very short paragraph costs extra
    costs, choice = [(0.0, 0.0)], [(0, 0)]
    for a, b in zip(kept, kept[1:]):
        before, here = lines[a].strip(), lines[b].strip()
        blank = any(not x.strip() for x in lines[a + 1 : b])
        furniture_between = any(skip[a + 1 : b])
        ends, short = bool(SENTENCE_END.search(before)), len(before) < 0.75 * width
        starts = not here[:1].islower()
        join = (2.5 if blank and not furniture_between else 0.5 if blank else 0.0) + (1.5 if ends and short and starts else 0.0)
        split = 1.0 + (0.0 if ends else 3.0) + (0.0 if starts else 4.0) + (0.0 if blank else 1.2 if short else 2.5)
        from_join, from_split = costs[-1][0], costs[-1][1] + 0.3
        prior, which = (from_join, 0) if from_join <= costs[-1][1] else (costs[-1][1], 1)
        start_prior, start_which = (from_join, 0) if from_join <= from_split else (from_split, 1)
        costs.append((prior + join, start_prior + split))
        choice.append((which, start_which))
    state, begins = (0 if costs[-1][0] <= costs[-1][1] else 1), set()
    for k in range(len(kept) - 1, 0, -1):
        if state:
            begins.add(kept[k])
        state = choice[k][state]
    out: list[list[str]] = [[]]
    line = kept[0]
    for text, at in words:
        if any(line < x <= at for x in begins) and out[-1]:
            out.append([])
        line = max(line, at)
        out[-1].append(text)
    return [" ".join(p) for p in out if p]


def _needs(pieces: list[Piece], top) -> set[str]:
    """Words whose counts and corrections a decoder has to know beyond the frequent ones."""
    need = {w for p in pieces if p.core for w in (p.low, unicodedata.normalize("NFKC", p.core).lower())}
    for a, b in zip(pieces, pieces[1:]):
        if a.cut and b.core:
            need.update(joined(a, b))
        elif a.core and b.core and not a.after and not b.before and not (a.low in top and b.low in top):
            # a word beyond the frequent ones is no more frequent than two of them, so it isn't these printed apart
            need.add(a.low + b.low)
    return {w for w in need if w not in top}


def _count_words(batches):
    """Word counts of the batches: in rows without marks, in all rows, and words that decoders will ask for."""
    clean: Counter = Counter()
    total: Counter = Counter()
    asked: set[str] = set()
    raw: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            if not text:
                continue
            if not MARKED.search(text):
                raw.update(text.split())
                continue
            lines = text.split("\n")
            pieces = stream(lines, furniture(lines))
            for i, p in enumerate(pieces):
                if p.core and not p.cut and not (i and pieces[i - 1].cut):
                    total[p.low] += 1
            for a, c in zip(pieces, pieces[1:]):
                if a.cut and c.core:
                    asked.update(joined(a, c))
        if len(raw) > 200_000:
            _fold(raw, clean, total)
        if len(total) + len(asked) > 400_000:
            yield _counts(clean, total, asked)
            clean, total, asked = Counter(), Counter(), set()
    _fold(raw, clean, total)
    yield _counts(clean, total, asked)


def _fold(raw: Counter, clean: Counter, total: Counter) -> None:
    for t, n in raw.items():
        p = Piece(t, False, 0)
        if p.core:
            w = p.low
            clean[w] += n
            total[w] += n
    raw.clear()


def _counts(clean: Counter, total: Counter, asked: set[str]) -> pa.RecordBatch:
    words = list(set(total) | asked)
    numbers = {"clean": pa.array([clean[w] for w in words], pa.int64()), "total": pa.array([total[w] for w in words], pa.int64())}
    return pa.record_batch({"word": pa.array(words, pa.string()), **numbers})


#: Candidates that one batch carries from a worker.
CANDIDATE_ROWS = 20_000


def _meant(word: str) -> set[str]:
    """What a misread word may have been meant to be: one confusion undone, ligature signs resolved."""
    plain = unicodedata.normalize("NFKC", word)
    seen = {plain}
    for size in (1, 2):
        for i in range(len(plain) - size + 1):
            for meant in CONFUSIONS.get(plain[i : i + size], ()):
                seen.add(plain[:i] + meant + plain[i + size :])
    return seen - {word}


def _candidates(lengths: set[int]):
    """``(word, total, first, second)`` for doubtful words; second is there for splits. Only words of ``lengths``, those
    of the words that can be meant, are tried, so encoded data breed no candidates."""
    kinds = {"word": pa.string(), "total": pa.int64(), "first": pa.string(), "second": pa.string()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.record_batch({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), columns)})

    def run(batches):
        out: list[tuple] = []
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("total").to_pylist()):
                plain = unicodedata.normalize("NFKC", w)
                if not lengths.isdisjoint((len(plain) - 1, len(plain), len(plain) + 1)):
                    out += [(w, n, c, None) for c in _meant(w) if len(c) in lengths]
                if len(w) >= 7 and w.isalpha():
                    out += [(w, n, w[:i], w[i:]) for i in range(3, len(w) - 2) if i in lengths and len(w) - i in lengths]
                if len(out) >= CANDIDATE_ROWS:
                    yield batch(out)
                    out = []
        yield batch(out)

    return run


def lexicon_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word counts, corrections) of ``rows(text)``, both materialised."""
    counts = rows.select("text").mapInArrow(_count_words, "word string, clean long, total long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("total").alias("total"))
    counts = cut_lineage(counts)
    doubtful = counts.where((F.length("word") >= 3) & ((F.col("clean") < 2) | (F.col("clean") <= F.col("total") * 0.25)))
    known = counts.where(F.col("clean") >= RATIO).select("word", "clean")  # no other word can be a correction
    lengths = {r.n for r in known.select(F.length("word").alias("n")).distinct().collect()}  # numbers up to the longest word
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = doubtful.select("word", "total").repartition(parts).mapInArrow(_candidates(lengths), "word string, total long, first string, second string")
    one = found.where("second is null").join(known.withColumnsRenamed({"word": "first", "clean": "n"}), "first").where(F.col("n") >= RATIO * F.greatest("total", F.lit(1)))
    two = (
        found.where("second is not null and total > 0").join(known.withColumnsRenamed({"word": "first", "clean": "n1"}), "first")
        .join(known.withColumnsRenamed({"word": "second", "clean": "n2"}), "second").withColumn("n", F.least("n1", "n2") / 16).where(F.col("n") >= RATIO * F.col("total"))
        .withColumn("first", F.concat_ws(" ", "first", "second"))
    )
    best = one.select("word", "first", F.col("n").cast("double").alias("n")).unionByName(two.select("word", "first", F.col("n").cast("double").alias("n")))
    fixes = best.groupBy("word").agg(F.max_by("first", F.struct("n", "first")).alias("fix"))
    return counts, cut_lineage(fixes)


def _repair(text: str, lex: Lexicon) -> tuple[list[str], list[tuple[str, str]]]:
    lines = text.split("\n")
    skip = furniture(lines) if len(lines) > 1 else [False]
    words, found = decode(stream(lines, skip), lex)
    if not found and not any(skip) and not MARKED.search(text) and " ".join(w for w, _ in words).split() == text.split():
        return [text], []  # nothing to repair
    found += [("line", lines[i].strip()) for i, s in enumerate(skip) if s]
    return paragraphs(lines, skip, words), found


def _outcome(keyed: pa.RecordBatch, got: list[tuple[list[str], list[tuple[str, str]]]]) -> pa.RecordBatch:
    paragraphs_ = pa.array([g[0] for g in got], pa.list_(pa.string()))
    kind = pa.struct([("kind", pa.string()), ("fixed", pa.string())])
    found = pa.array([[{"kind": k, "fixed": f} for k, f in g[1]] for g in got], pa.list_(kind))
    return pa.record_batch([*keyed.columns, paragraphs_, found], names=[*keyed.schema.names, "paragraphs", "found"])


RESULT = "paragraphs array<string>, found array<struct<kind:string,fixed:string>>"


def repair_scans(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``(keys..., paragraphs, found)``: the repaired paragraphs of each text and what was repaired.

    Every row comes out once (repeated keys too). Texts without a word to repair and without broken lines come out as
    they are, as one paragraph; null and blank texts as an empty array. A word printed apart is joined; where no line is
    broken, only if one part is no word elsewhere. Kinds in ``found``: ``hyphen`` and ``ocr`` with
    the whole or meant word in the case of the text, ``line`` with the furniture line as it stands. The lexicon is
    learnt from the rows themselves, all of them.
    """
    base = rows.select(*keys, F.col(text_col).alias("text"))
    counts, fixes = lexicon_tables(base)
    doubtful = counts.join(fixes, "word", "left").select("word", "clean", "total", "fix")
    total = counts.agg(F.sum("total")).first()[0] or 1
    frequent = counts.join(fixes, "word", "left_anti").where("clean >= 2").orderBy(F.desc("clean"), "word").limit(TOP_WORDS)
    top = {r.word: r.clean for r in frequent.select("word", "clean").toLocalIterator()}
    rest = None
    if len(top) == TOP_WORDS:
        word, least = list(top.items())[-1] if top else ("", math.inf)
        later = (F.col("clean") < least) | (F.col("clean") == least) & (F.col("word") > word)
        got = counts.join(fixes, "word", "left_anti").where((F.col("clean") >= RATIO) & later).orderBy("word").select("word", "clean").toArrow().combine_chunks()
        if got.num_rows:
            rest = Rest(*(pa.concat_arrays(c.chunks) for c in got.columns))
    # what decoders ask beyond the frequent words: corrections, and words that stand in the corpus at all
    # a word beyond the frequent ones counts as it would among them
    n = F.when(F.col("fix").isNull() & (F.col("clean") >= 2), F.col("clean")).otherwise(F.greatest("clean", "total"))
    numbers = doubtful.select(F.col("word").alias("meant"), n.alias("n_fix"))
    meant = fixes.withColumn("meant", F.split("fix", " ")[0]).join(numbers, "meant").select("word", "n_fix")
    beyond = doubtful.where("fix is not null or total > 0 or clean > 0").join(frequent.select("word"), "word", "left_anti")
    facts = cut_lineage(beyond.join(meant, "word", "left").select("word", n.alias("n"), "fix", "clean", F.coalesce("n_fix", F.lit(0)).alias("n_fix")))
    schema = rows.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def whole(text: str | None, lex: Lexicon) -> tuple[list[str], list[tuple[str, str]]]:
        if text is None or not text.strip():
            return [], []
        if not MARKED.search(text) and all(w in safe or _plain(w, lex) for w in text.split()) and not torn(text.split(), lex) and not any(furniture(text.split("\n"))):
            return [text], []
        return _repair(text, lex)

    def torn(raws: list[str], lex: Lexicon) -> bool:
        near = (x for x in zip(raws, raws[1:]) if not (x[0] in safe and x[1] in safe) and x[0][-1].isalpha() and x[1][0].isalpha())
        return any(_apart(Piece(a, False, 0), Piece(b, False, 0), lex, least=2) for a, b in near)

    safe: set[str] = set()

    def _plain(raw: str, lex: Lexicon) -> bool:
        p = Piece(raw, False, 0)
        if p.core and (lex.doubtful(p.low) or lex.correction(p.low) or any("ﬀ" <= c <= "ﬆ" for c in raw)):
            return False
        if len(safe) < 200_000 and p.low in lex.top:
            safe.add(raw)
        return True

    if facts.count() <= MAX_FACTS:
        told = {r.word: (r.n, r.fix, r.clean, r.n_fix) for r in facts.toLocalIterator()}

        def run(batches):
            lex = Lexicon(top, told, total, rest)
            for b in batches:
                yield _outcome(b.select(keys), [whole(t, lex) for t in b.column("text").to_pylist()])

        return base.mapInArrow(run, f"{fields}, {RESULT}")

    def ask(batches):
        for b in batches:
            need = []
            for t in b.column("text").to_pylist():
                lines = (t or "").split("\n")
                need.append(sorted(_needs(stream(lines, furniture(lines)), top)))
            yield b.select(keys).append_column("need", pa.array(need, pa.list_(pa.string())))

    asked = base.mapInArrow(ask, f"{fields}, need array<string>").select(*keys, F.explode("need").alias("word")).distinct()
    answers = asked.join(facts, "word").groupBy(*keys).agg(F.collect_list(F.struct("word", "n", "fix", "clean", "n_fix")).alias("facts"))

    def run_joined(batches):
        for b in batches:
            told = [{x["word"]: (x["n"], x["fix"], x["clean"], x["n_fix"]) for x in f or ()} for f in b.column("facts").to_pylist()]
            yield _outcome(b.select(keys), [whole(t, Lexicon(top, f, total, rest)) for t, f in zip(b.column("text").to_pylist(), told)])

    matched = [base[k].eqNullSafe(answers[k]) for k in keys]
    with_facts = base.join(answers, matched, "left").select(*[base[k] for k in keys], base["text"], answers["facts"])
    return with_facts.mapInArrow(run_joined, f"{fields}, {RESULT}")
