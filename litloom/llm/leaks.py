"""Problem 8 - find documents of a corpus that hold passages of held-out test items.

Each task gathers its documents into shards and builds the shard's suffix array over words: its suffixes in the order of
their first six words, by doubling ranks of two, four and six words (what lies beyond is compared directly). Every suffix
of every test item is looked up in it by binary search, which gives all places that share at least six words with the
item; they are taken up ``PAIRS`` at a time, so words that all texts repeat cost time but not memory. Each longest verbatim match is then extended to both sides by banded alignment;
a document is reported if ``min_words`` words of an item stand in it with at most one word in ``words_per_edit``
replaced, dropped or added. Any such passage of 25 words with at most 3 edits holds a verbatim run of six words, so no
passage is missed for want of a seed. Nor for want of band or reach: if there is a passage, there is one of at most 49
words (of two halves of 25 words or more one has no more than its share of the edits), which has at most 6 edits.

The corpus is read, cut into words and searched once, whatever the number of test items, and isn't shuffled; only the
test items travel, broadcast in blocks of bounded size that the driver holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SEED = 6
REACH, BAND = 48, 6
PAD = REACH + BAND + 2
#: Words of test items in a broadcast block.
BLOCK_WORDS = 2_000_000
#: Places looked at together.
PAIRS = 1_000_000
#: Words of documents in a suffix array; a longer document forms a shard of its own.
SHARD_WORDS = 400_000

WRAPPED = regex.compile(r"[-­¬‐‑]\s*\n\s*")
SPLIT = regex.compile(r"[\s—–]+")
NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}\s—–]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation; hyphens join what they link, also across a line end."""
    if not text:
        return []
    return [w for w in SPLIT.split(NOT_WORD.sub("", WRAPPED.sub("", text.lower()))) if w]


class _Items:
    """A block of test items as word ids, and the windows of six words in them."""

    def __init__(self, block: list[tuple[Any, list[str]]]):
        self.names = list(dict.fromkeys(i for i, _ in block))
        number = {x: i for i, x in enumerate(self.names)}
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in block for w in ws}))}
        gap = np.full(PAD, -1, dtype=np.int64)
        parts, owner, start = [gap], [gap], [gap]
        for item, ws in block:
            parts += [np.array([self.vocabulary[w] for w in ws], dtype=np.int64), gap]
            owner += [np.full(len(ws), number[item]), gap]
            start += [np.arange(len(ws)), gap]
        self.ids, self.owner, self.start = np.concatenate(parts), np.concatenate(owner), np.concatenate(start)
        bad = np.concatenate([[0], np.cumsum(self.ids < 0)])
        n = len(self.ids) - SEED + 1
        self.windows = np.flatnonzero(bad[SEED : SEED + n] == bad[:n])


def _rank(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, rank of each) of pairs of ranks."""
    return np.unique(left * size + right, return_inverse=True)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rank of each wanted key by binary search, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _seeds(items: _Items, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item position, text position) of every six-word match, from the text's suffix array, ``PAIRS`` at a time."""
    v = len(items.vocabulary) + 1
    bad = np.concatenate([[0], np.cumsum(t == 0)])
    n = len(t) - SEED + 1
    p = np.flatnonzero(bad[SEED : SEED + n] == bad[:n])  # the suffixes that start with six known words
    if not len(p) or not len(items.windows):
        return
    k2, r2 = _rank(t[p], t[p + 1], v)
    k2b, r2b = _rank(t[p + 2], t[p + 3], v)
    k2c, r2c = _rank(t[p + 4], t[p + 5], v)
    k4, r4 = _rank(r2, r2b, len(k2b))
    k6, r6 = _rank(r4, r2c, len(k2c))
    suffixes = np.argsort(r6, kind="stable")
    ordered = r6[suffixes]
    w, a = items.windows, items.ids
    q2, q2b, q2c = _find(k2, a[w] * v + a[w + 1]), _find(k2b, a[w + 2] * v + a[w + 3]), _find(k2c, a[w + 4] * v + a[w + 5])
    ok = (q2 >= 0) & (q2b >= 0) & (q2c >= 0)
    w, q4, q2c = w[ok], _find(k4, q2[ok] * len(k2b) + q2b[ok]), q2c[ok]
    ok = q4 >= 0
    w, q6 = w[ok], _find(k6, q4[ok] * len(k2c) + q2c[ok])
    w, q6 = w[q6 >= 0], q6[q6 >= 0]
    lo, hi = np.searchsorted(ordered, q6, "left"), np.searchsorted(ordered, q6, "right")
    ends = np.cumsum(hi - lo)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
        of = np.searchsorted(ends, pair, "right")
        yield w[of], p[suffixes[hi[of] - (ends[of] - pair)]]


def _edits(a: np.ndarray, t: np.ndarray, k: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
    """Least edits by item words taken (0 to REACH) from (k, p) onwards in the direction of ``step``."""
    width = 2 * BAND + 1
    ramp = np.arange(width, dtype=np.int16)[:, None]
    item = a[k + step * np.arange(REACH)[:, None]]
    text = t[p + step * np.arange(-BAND, REACH + BAND)[:, None]]
    text[:BAND] = -2  # what lies behind the start matches nothing
    e = np.repeat(np.where(ramp < BAND, 99, ramp - BAND).astype(np.int16), len(k), axis=1)
    out = np.zeros((REACH + 1, len(k)), dtype=np.int16)
    for r in range(1, REACH + 1):
        new = e + (text[r - 1 : r - 1 + width] != item[r - 1])
        np.minimum(new[:-1], e[1:] + np.int16(1), out=new[:-1])
        new -= ramp
        for s in range(1, width):
            np.minimum(new[s], new[s - 1], out=new[s])
        new += ramp
        e = new
        e.min(axis=0, out=out[r])
    out[1:][item < 0] = 99  # beyond the item's end
    return out


def _holds(left: np.ndarray, right: np.ndarray, run: np.ndarray, min_words: int, per_edit: int) -> np.ndarray:
    """Which matches lie in a passage within REACH; exact, since the farthest word for each number of edits is tried."""
    most = (2 * REACH + min_words) // per_edit
    reach_left, reach_right = ([(side <= e).sum(axis=0) - 1 for e in range(min(most, REACH) + 1)] for side in (left, right))
    holds = np.zeros(len(run), dtype=bool)
    for x, to_left in enumerate(reach_left):
        for y, to_right in enumerate(reach_right[: most + 1 - x]):
            holds |= to_left + run + to_right >= max(min_words, (x + y) * per_edit)
    return holds


def _passages(items: _Items, t: np.ndarray, min_words: int, per_edit: int) -> tuple[np.ndarray, ...]:
    """(item position, text position, words, edits) of the passages found in a shard."""
    found = [x for k, p in _seeds(items, t) for x in _extended(items, t, k, p, min_words, per_edit)]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.empty(0, dtype=int) for _ in range(4))


def _extended(items: _Items, t: np.ndarray, k: np.ndarray, p: np.ndarray, min_words: int, per_edit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The passages around the longest matches among some places."""
    a = items.ids
    first = a[k - 1] != t[p - 1]  # the start of each longest match
    k, p = k[first], p[first]
    run = np.full(len(k), SEED)
    alive = np.arange(len(k))
    while len(alive):
        alive = alive[a[k[alive] + run[alive]] == t[p[alive] + run[alive]]]
        run[alive] += 1
    a, t = a.astype(np.int32), t.astype(np.int32)
    for lo in range(0, len(k), 4096):
        kk, pp, rr = k[lo : lo + 4096], p[lo : lo + 4096], run[lo : lo + 4096]
        right, left = _edits(a, t, kk + rr, pp + rr, 1), _edits(a, t, kk - 1, pp - 1, -1)
        held = np.flatnonzero(_holds(left, right, rr, min_words, per_edit))
        kk, pp, rr, right, left = kk[held], pp[held], rr[held], right[:, held], left[:, held]
        best, at, cost = np.zeros(len(kk), dtype=int), np.zeros(len(kk), dtype=int), np.zeros(len(kk), dtype=int)
        for x in range(REACH + 1):
            words = x + rr[None, :] + np.arange(REACH + 1)[:, None]
            edits = left[x][None, :].astype(int) + right
            good = np.where((words >= min_words) & (edits * per_edit <= words), words, 0)
            top = good.argmax(axis=0)
            size = good[top, np.arange(len(kk))]
            better = size > best
            best[better], at[better], cost[better] = size[better], x, edits[top, np.arange(len(kk))][better]
        hit = best > 0
        yield kk[hit] - at[hit], pp[hit] - at[hit], best[hit], cost[hit]


def _search(blocks: list[Broadcast], item_type: pa.DataType, min_words: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[Any] = []
        texts: list[list[str]] = []
        size, doc_type = 0, pa.null()

        def flush() -> pa.RecordBatch:
            gap = np.zeros(PAD, dtype=np.int64)
            starts = PAD + np.concatenate([[0], np.cumsum([len(x) + PAD for x in texts])])[:-1]
            best: dict[tuple[Any, int], tuple[int, int, int, int]] = {}
            for block in blocks:
                items = block.value
                lookup = items.vocabulary.get
                parts = [gap]
                for x in texts:
                    parts += [np.array([lookup(w, 0) for w in x], dtype=np.int64), gap]
                k, p, words, edits = _passages(items, np.concatenate(parts), min_words, per_edit)
                docs = np.searchsorted(starts, p + words // 2, "right") - 1
                for x in zip(items.owner[k].tolist(), docs.tolist(), words.tolist(), edits.tolist(), items.start[k].tolist(), (p - starts[docs]).tolist()):
                    pair, passage = (items.names[x[0]], x[1]), (x[2], -x[3], x[4], x[5])
                    if pair not in best or best[pair][:2] < passage[:2]:
                        best[pair] = passage
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # a worker holds one block at a time
            found = list(best.items())
            numbers = {c: pa.array([x[i] for _, x in found], pa.int32()) for c, i in (("item_start", 2), ("doc_start", 3), ("words", 0))}
            return pa.record_batch(
                {"item_id": pa.array([i for (i, _), _ in found], item_type), "doc_id": pa.array([ids[d] for (_, d), _ in found], doc_type), **numbers, "edits": pa.array([-x[1] for _, x in found], pa.int32())}
            )

        for b in batches:
            doc_type = b.column("id").type
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                x = words_of(text)
                if len(x) < SEED:
                    continue
                ids.append(doc)
                texts.append(x)
                size += len(x)
                if size >= SHARD_WORDS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return run


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, min_words: int = 25, words_per_edit: int = 8
) -> DataFrame:
    """``(item_id, doc_id, item_start, doc_start, words, edits)``: the longest passage (up to 48 words beyond a verbatim
    run to either side) of an item in a document, once for each pair that has one.

    Ids keep their types. Positions count words from 0. Items shorter than ``min_words`` words match nothing; null and empty texts neither.
    Rows with a repeated document id give one row each.
    """
    if min_words < SEED:
        raise ValueError(f"min_words must be at least {SEED}")
    sc = docs.sparkSession.sparkContext
    kinds = {name: df.schema[c].dataType for name, df, c in (("item_id", items, item_id), ("doc_id", docs, doc_id))}
    schema = ", ".join([*(f"{name} {kind.simpleString()}" for name, kind in kinds.items()), "item_start int, doc_start int, words int, edits int"])
    corpus = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    blocks, block, size = [], [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        w = words_of(r.t)
        if len(w) >= min_words:
            block.append((r.i, w))
            size += len(w)
        if size >= BLOCK_WORDS:
            blocks.append(sc.broadcast(_Items(block)))
            block, size = [], 0
    blocks += [sc.broadcast(_Items(block))] if block else []
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)
    return corpus.mapInArrow(_search(blocks, to_arrow_type(kinds["item_id"]), min_words, words_per_edit), schema)


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The documents that hold no reported passage."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
