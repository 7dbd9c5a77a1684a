"""The bibliography stage: normalise, validate, find duplicates, match attachments to files, report."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.similarity import norm_key
from ..functions.text import declared_filename, file_name, first_non_blank, non_blank, normalise_authors, normalise_doi, parse_year, strip_extension
from ..runtime import cut_lineage


def entries_to_meta(entries: DataFrame) -> DataFrame:
    """Bibliography entries ``(citekey, entry_type, fields map)`` as library rows."""
    f = lambda name: F.col("fields")[name]
    return entries.select(
        "citekey", F.lower(first_non_blank("entry_type", F.lit("misc"))).alias("entry_type"), f("title").alias("title"),
        normalise_authors(f("author")).alias("authors"), parse_year(f("year")).alias("year"),
        first_non_blank(f("journal"), f("booktitle"), f("publisher"), f("institution"), f("school")).alias("venue"),
        normalise_doi(f("doi")).alias("doi"), f("abstract").alias("abstract"), declared_filename(f("file")).alias("declared_file"),
        F.lit(None).cast("string").alias("pdf_path"),
    )


def problems(readable: Column | None = None) -> Column:
    """Blocking problems of a library row, as an array; ``readable`` tells of a row with a file whether that can be read."""
    no_file = ~F.coalesce(non_blank("declared_file"), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(non_blank("citekey"), F.lit(False)), "missing citekey"),
            F.when(~F.coalesce(non_blank("title"), F.lit(False)), "missing title"),
            F.when(no_file, "no attachment declared"),
            F.when(~no_file & F.col("pdf_path").isNull(), F.concat(F.lit("attachment not found: "), "declared_file")),
            F.when(F.col("pdf_path").isNotNull() & ~F.coalesce(F.lit(True) if readable is None else readable, F.lit(True)), F.concat(F.lit("PDF is not readable: "), "pdf_path")),
        )
    )


def warnings() -> Column:
    """Flaws of a library row that don't keep it out, as an array."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(non_blank("authors"), F.lit(False)), "missing author"),
            F.when(F.col("year").isNull(), "missing year").when(~F.col("year").between(1900, 2100), F.concat(F.lit("implausible year: "), F.col("year").cast("string"))),
            F.when(~F.coalesce(non_blank("venue"), F.lit(False)), "missing venue"),
            F.when(~F.coalesce(non_blank("doi"), F.lit(False)), "missing DOI"),
        )
    )


def first_wins_duplicates(rows: DataFrame, pos: str, citekey: str = "citekey", doi: str = "doi", title: str = "title") -> DataFrame:
    """Adds ``duplicate_of``: the citekey that used the row's DOI first or, for rows no DOI decides, its title first.

    Order is ``pos``. A row registers its title only if no earlier row had its DOI; rows kept out for other reasons
    register as well. Only keys of several rows are numbered, after an aggregation with map-side combining finds the
    first row of each key, so a hot key costs a join and no window over all its rows.
    """
    keyed = rows.withColumns({"__d": F.lower(doi), "__t": norm_key(F.col(title))})
    first_doi = keyed.where("__d is not null").groupBy("__d").agg(F.min(F.struct(F.col(pos).alias("p"), F.col(citekey).alias("k"))).alias("__fd"))
    with_doi = keyed.join(first_doi, "__d", "left").withColumn("__dup", F.when(F.col("__fd.p") < F.col(pos), F.col("__fd.k")))
    first_title = with_doi.where("__dup is null and __t is not null").groupBy("__t").agg(F.min(F.struct(F.col(pos).alias("p"), F.col(citekey).alias("k"))).alias("__ft"))
    by_title = F.when(F.col("__dup").isNull() & (F.col("__ft.p") < F.col(pos)), F.col("__ft.k"))
    return with_doi.join(first_title, "__t", "left").withColumn("duplicate_of", F.coalesce("__dup", by_title)).select(*rows.columns, "duplicate_of")


def _named(rows: DataFrame, config: Config) -> DataFrame:
    """Library rows with their place in the order of claiming, normalised stem and title, and what a fuzzy match probes."""
    stem, head = norm_key(strip_extension("declared_file")), norm_key("title")
    named = rows.select("citekey", "title", "declared_file").where("citekey is not null").distinct()
    turn = F.struct(F.col("declared_file").isNull().alias("bare"), F.col("citekey").alias("k"), F.col("declared_file").alias("d"), F.col("title").alias("t"))
    return named.select("citekey", turn.alias("turn"), stem.alias("stem"), head.alias("head"), F.coalesce(stem, head).alias("probe"))


#: Names in one group of the fuzzy comparison, pairs scored together, and files of a probe's list beside two for each row that asks.
FUZZY_ROWS, FUZZY_FILES, FUZZY_PAIRS, FUZZY_LIST = 4_000, 5_000, 100_000, 32
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
_FREE = 1 << 62


def _codes(names: list[str], width: int) -> np.ndarray:
    """The characters of names by number, from 1; 0 after the end."""
    table_ = np.zeros(128, np.uint8)
    table_[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
    out = np.zeros((len(names), width), np.uint8)
    for i, x in enumerate(names):
        got = table_[np.frombuffer(x[:width].encode(), np.uint8)]
        out[i, : len(got)] = got
    return out


def _places(codes: np.ndarray) -> np.ndarray:
    """``[word, character, name]``: the places of a character in a name as bits of 64-bit words."""
    n, width = codes.shape
    out, at = np.zeros((max(1, -(-width // 64)), len(_SYMBOLS) + 1, n), np.uint64), np.arange(n)
    for k in range(width):
        out[k // 64, codes[:, k], at] |= np.uint64(1 << (k % 64))
    out[:, 0] = 0
    return out


def _alike(a: np.ndarray, a_at: np.ndarray, places: np.ndarray, b_at: np.ndarray, sizes: np.ndarray, equal: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(which, score)`` of the pairs ``(a[a_at], b[b_at])`` whose Jaro-Winkler reaches the threshold, as ``jaro_winkler``
    has it. All of ``a`` have one length and no ``b`` counts beyond it; places are taken as bits, all pairs at a time.
    ``equal`` counts equal first characters up to four."""
    length = a.shape[1]
    reach, words = max(0, length // 2 - 1), -(-length // 64)
    sign = 0xFFFF_FFFF_FFFF_FFFF

    def lowest(masks: list[np.ndarray]) -> list[np.ndarray]:
        out, found = [], None
        for m in masks:
            low = m & (~m + np.uint64(1))
            out.append(low if found is None else np.where(found, np.uint64(0), low))
            found = m != 0 if found is None else found | (m != 0)
        return out

    used = [np.zeros(len(a_at), np.uint64) for _ in range(words)]
    hits = np.zeros((length, len(a_at)), bool)
    for i in range(length):
        window = ((1 << min(length, i + reach + 1)) - 1) & ~((1 << max(0, i - reach)) - 1)
        c = a[a_at, i]
        low = lowest([places[w, c, b_at] & np.uint64(window >> (64 * w) & sign) & ~used[w] for w in range(words)])
        for w in range(words):
            used[w] |= low[w]
            hits[i] |= low[w] != 0
    m = hits.sum(axis=0).astype(np.float64)

    def winkler(m, swapped, sizes, equal):
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.where(m > 0, (m / length + m / sizes + (m - swapped) / m) / 3, 0.0)
        return base + equal * 0.1 * (1 - base)

    keep = np.flatnonzero(winkler(m, 0.0, sizes, equal) >= threshold)
    a_at, b_at, hits, used = a_at[keep], b_at[keep], hits[:, keep], [u[keep] for u in used]
    differ = np.zeros(len(keep), np.int64)
    for i in range(length):
        low = lowest(used)
        same = np.zeros(len(keep), bool)
        for w in range(words):
            same |= (places[w, a[a_at, i], b_at] & low[w]) != 0
            used[w] ^= np.where(hits[i], low[w], np.uint64(0))
        differ += hits[i] & ~same
    score = winkler(m[keep], differ / 2, sizes[keep], equal[keep])
    good = (score >= threshold) & (score > 0)
    return keep[good], score[good]


def _compared(probes: pd.DataFrame, files: pd.DataFrame, threshold: float):
    """``(probe's row, scores, files' rows)`` of probes and the files they may get whose names, cut to the probe's length, are alike.

    Only pairs are scored whose letters in common allow the threshold: with ``m`` matching letters Jaro is at most
    ``(m / |a| + m / |b| + 1) / 3``, and each of up to four equal first letters adds at most a tenth of what it lacks.
    """
    order = sorted((len(p), i) for i, p in enumerate(probes["probe"]) if p)
    if not order or not len(files):
        return
    codes = _codes(list(files["norm"]), order[-1][0])
    full, places, holder = np.array([len(x) for x in files["norm"]]), _places(codes), files["holder"].to_numpy()
    first, after, fid = probes["first"].to_numpy(), probes[["unlike", "last"]].to_numpy(), files["fid"].to_numpy()
    needs = np.array([(threshold - 0.1 * k) / (1 - 0.1 * k) for k in range(5)])
    letters, each = np.zeros((len(_SYMBOLS) + 1, len(files)), np.uint16), np.arange(len(files))
    done = at = 0
    while at < len(order):
        length = order[at][0]
        members = []
        while at < len(order) and order[at][0] == length:
            members.append(order[at][1])
            at += 1
        for k in range(done, length):
            letters[codes[:, k], each] += 1
        done = length
        sizes = np.minimum(full, length)
        share = (1 / length + 1 / np.maximum(sizes, 1)) / 3
        a = _codes([probes["probe"].iloc[i] for i in members], length)
        pending, count = [], 0

        def scored(pending, a=a, sizes=sizes, members=members):
            a_at, b_at, equal = (np.concatenate(x) for x in zip(*pending))
            which, score = _alike(a, a_at, places, b_at, sizes[b_at], equal, threshold)
            a_at, b_at = a_at[which], b_at[which]
            for k in np.unique(a_at):
                mine = a_at == k
                i = members[k]
                yield i, score[mine], b_at[mine]

        for k, i in enumerate(members):
            mine = np.bincount(a[k], minlength=len(_SYMBOLS) + 1)[:, None].astype(np.uint16)
            own = np.flatnonzero(mine[:, 0])
            most = np.minimum(letters[own], mine[own]).sum(axis=0, dtype=np.uint16) * share + 1 / 3
            near = np.flatnonzero((most >= needs[4] - 1e-9) & (holder > first[i]) & (sizes > 0))
            equal = np.cumprod(codes[near, : min(4, length)] == a[k, :4], axis=1).sum(axis=1)
            fits = most[near] >= needs[equal] - 1e-9
            if fits.any():
                pending.append((np.full(fits.sum(), k), near[fits], equal[fits]))
                count += fits.sum()
            if count >= FUZZY_PAIRS:
                yield from scored(pending)
                pending, count = [], 0
        if pending:
            yield from scored(pending)


def _fuzzy(asked: DataFrame, disk: DataFrame, threshold: float) -> DataFrame:
    """``(probe, part, fids, more, unlike, last)``: the next files of each probe by likeness, then path.

    ``asked(probe, first, part, most, unlike, last)`` are distinct probes that are compared with all files
    ``disk(fid, norm, holder)``, in blocks of both: of the files after ``(unlike, last)`` and not held by a row before
    ``first``, the best ``most``; ``more`` tells whether others follow.
    """
    n_asked, n_files = asked.count(), disk.count()
    groups, blocks = max(1, -(-n_asked // FUZZY_ROWS)), max(1, -(-n_files // FUZZY_FILES))

    def compare(key, probes: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        fid, start, last, most = files["fid"].to_numpy(), probes["unlike"].to_numpy(), probes["last"].to_numpy(), probes["most"].to_numpy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, score, which in _compared(probes, files, threshold):
            ids = fid[which]
            later = (-score > start[i]) | (-score == start[i]) & (ids > last[i])
            unlike, ids = (np.concatenate(x) for x in zip((-score[later], ids[later]), *[best[i]] if i in best else []))
            # one more than asked for tells that others follow
            order = np.lexsort((ids, unlike))[: most[i] + 1]
            best[i] = unlike[order], ids[order]
        at = np.repeat(np.array(list(best), np.int64), [len(x[0]) for x in best.values()])
        unlike, ids = (np.concatenate([np.array([], kind), *x]) for kind, x in zip((np.float64, np.int64), list(zip(*best.values())) or ((), ())))
        return pd.DataFrame({"probe": probes["probe"].to_numpy(object)[at], "unlike": unlike, "fid": ids})

    left = asked.withColumns({"g": F.pmod(F.xxhash64("probe"), F.lit(groups)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = disk.select("fid", "norm", "holder", F.pmod(F.xxhash64("fid"), F.lit(blocks)).cast("int").alias("b")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    alike = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(compare, "probe string, unlike double, fid long")
    found = alike.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("unlike", "fid"))).alias("l"))
    listed = asked.join(found, "probe", "left").withColumns({"kept": F.slice(F.coalesce("l", F.array().cast("array<struct<unlike:double,fid:bigint>>")), F.lit(1), F.col("most").cast("int"))})
    end = F.try_element_at("kept", F.lit(-1))
    return listed.select(
        "probe", "part", F.transform("kept", lambda x: x["fid"]).alias("fids"), F.coalesce(F.size("l") > F.col("most"), F.lit(False)).alias("more"),
        F.coalesce(end["unlike"], "unlike").alias("unlike"), F.coalesce(end["fid"], "last").alias("last"),
    )


class _Desk:
    """Files by name, of which the free ones are given out: by the smaller size, then the smaller number."""

    def __init__(self, fids: np.ndarray, norms: list[str], sizes: np.ndarray):
        by_name = sorted(range(len(norms)), key=lambda i: (norms[i], i))
        self.fids, self.norms, n = fids[by_name].tolist(), [norms[i] for i in by_name], len(norms)
        by_size = np.lexsort((np.arange(n), sizes))
        place = np.empty(n, np.int64)
        place[by_size] = np.arange(n)
        self.n, self.none = n, n
        self.by_rank = np.empty(n, np.int64)  # place in the order of names of the file of each rank
        self.by_rank[place[by_name]] = np.arange(n)
        self.at = {f: i for i, f in enumerate(self.fids)}
        # least rank of the free files in each range: leaves from n on, a node above two
        tree = np.full(2 * max(n, 1), n, np.int64)
        tree[n : 2 * n] = place[by_name]
        self.tree = tree.tolist() if n else [0, 0]
        for i in range(n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        self.start: dict[str, int] = {}
        self.stop: dict[str, int] = {}
        for i, x in enumerate(self.norms):
            self.start.setdefault(x, i)
            self.stop[x] = i + 1
        self.in_order, self.next = sorted(range(n), key=self.fids.__getitem__), 0

    def best(self, lo: int, hi: int) -> int:
        """The least rank among the free files of a range; ``none`` if there is none."""
        tree, out = self.tree, self.none
        lo, hi = lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                out = min(out, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = min(out, tree[hi])
            lo, hi = lo >> 1, hi >> 1
        return out

    def beginning(self, name: str) -> int:
        """The least rank among the free files whose names begin so."""
        lo = bisect_left(self.norms, name)
        return self.best(lo, bisect_left(self.norms, name + "~", lo))

    def free(self, place: int) -> bool:
        return self.tree[self.n + place] < self.none

    def take(self, place: int) -> int:
        i = self.n + place
        self.tree[i] = self.none
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        return self.fids[place]

    def claim(self, stem: str | None, head: str | None, lists: dict[str, tuple[list[int], bool]], n: int) -> tuple[int | None, str | None, bool]:
        """(file, how, whether the row has to ask for files alike) of the next row."""
        if stem is not None and (at := self.start.get(stem)) is not None and self.free(at):
            return self.take(at), "exact", False
        if stem is not None and len(stem) >= n and (rank := self.beginning(stem)) < self.none:
            return self.take(self.by_rank[rank]), "prefix", False
        if head is not None and len(head) >= n:
            # a file name that the title starts with is one of the title's beginnings
            shorter = (self.best(at, self.stop[x]) for x in (head[:k] for k in range(len(head))) if (at := self.start.get(x)) is not None)
            rank = min(self.beginning(head), min(shorter, default=self.none))
            if rank < self.none:
                return self.take(self.by_rank[rank]), "title", False
        probe = head if stem is None else stem
        if probe is None or not self.n:
            return None, None, False
        if not probe:  # like every name cut to nothing
            while self.next < self.n and not self.free(self.in_order[self.next]):
                self.next += 1
            return (self.take(self.in_order[self.next]), "fuzzy", False) if self.next < self.n else (None, None, False)
        if probe not in lists:
            return None, None, True
        fids, more = lists[probe]
        for f in fids:
            if self.free(at := self.at[f]):
                return self.take(at), "fuzzy", False
        return None, None, more


def _clerk(n: int):
    """Batches of files, lists of files alike and rows, in this order, to ``(id, fid, how, asks)`` of the rows."""

    def run(batches):
        parts, lists, desk = [], {}, None
        for b in batches:
            c = b.to_pydict()
            files = int(np.searchsorted(c["kind"], 1))
            parts.append((np.array(c["id"][:files], np.int64), c["a"][:files], np.array(c["size"][:files], np.int64)))
            listed = int(np.searchsorted(c["kind"], 2))
            for k in range(files, listed):
                lists[c["a"][k]] = (lists.get(c["a"][k], ([], False))[0] + c["fids"][k], c["more"][k])
            if listed == len(c["kind"]):
                continue
            if desk is None:
                desk = _Desk(np.concatenate([x[0] for x in parts]), [x for p in parts for x in p[1]], np.concatenate([x[2] for x in parts]))
            out = [desk.claim(c["a"][k], c["b"][k], lists, n) for k in range(listed, len(c["kind"]))]
            fid, how, asks = zip(*out)
            yield pa.record_batch({"id": pa.array(c["id"][listed:], pa.int64()), "fid": pa.array(fid, pa.int64()), "how": pa.array(how, pa.string()), "asks": pa.array(asks, pa.bool_())})

    return run


#: Rows and files that the driver settles by itself.
AT_ONCE = 100_000


def _settled(named: DataFrame, answers: DataFrame, disk: DataFrame, n: int, at_once: bool) -> DataFrame:
    """``(id, fid, how, asks)``: the rows one after the other, each with its best free file by names, then by its probe's list.

    One task holds the files' names and the lists; rows pass through it in their order and each takes some look-ups, so
    no row's candidates are written down. Rows that the names leave without a file and whose list is not there, or ends
    before all files alike, get none and ask.
    """
    void = lambda kind: F.lit(None).cast(kind)
    columns = {"kind": F.lit(0), "id": F.col("fid"), "a": F.col("norm"), "b": void("string"), "size": F.col("size"), "fids": void("array<long>"), "more": void("boolean")}
    lists = {"kind": F.lit(1), "id": F.col("part").cast("long"), "a": F.col("probe"), "b": void("string"), "size": void("int"), "fids": F.col("fids"), "more": F.col("more")}
    rows = {"kind": F.lit(2), "id": F.col("id"), "a": F.col("stem"), "b": F.col("head"), "size": void("int"), "fids": void("array<long>"), "more": void("boolean")}
    each = [df.select(*(x.alias(c) for c, x in of.items())) for df, of in ((disk, columns), (answers, lists), (named, rows))]
    told, schema = reduce(DataFrame.unionByName, each), "id long, fid long, how string, asks boolean"
    if at_once:
        got = list(_clerk(n)(told.orderBy("kind", "id").toArrow().to_batches()))
        return named.sparkSession.createDataFrame(pa.Table.from_batches(got), schema) if got else named.sparkSession.createDataFrame([], schema)
    return cut_lineage(told.repartition(1).sortWithinPartitions("kind", "id").mapInArrow(_clerk(n), schema))


def claim_files(rows: DataFrame, files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``(citekey, pdf_path, how)``: files matched to library rows, each file at most once.

    The cascade is exact name, declared name as prefix, title as prefix either way, then Jaro-Winkler; rows with a
    declared file choose first, then by citekey. Only rows that names leave without a file are compared with all files.
    As their finds take files from later rows, those may come to ask as well: rows are settled anew until none asks. A file
    once held by an earlier row is out of a later one's reach for good. Rows equal in citekey, title and declared file
    are one row; rows without citekey take no part.
    """
    numbered = F.monotonically_increasing_id()  # in the order of the sorted table
    disk = files.where("path is not null").select("path").distinct().orderBy("path").select(numbered.alias("fid"), "path")
    base = file_name("path")
    disk = cut_lineage(disk.select("fid", "path", F.length(base).alias("size"), F.coalesce(norm_key(strip_extension(base)), F.lit("")).alias("norm")))
    named = cut_lineage(_named(rows, config).orderBy("turn").select(numbered.alias("id"), "citekey", "stem", "head", "probe"))
    at_once = named.count() + disk.count() <= AT_ONCE
    firsts = named.where("probe is not null").groupBy("probe").agg(F.min("id").alias("first"))
    answers = named.sparkSession.createDataFrame([], "probe string, part int, fids array<long>, more boolean, unlike double, last long")
    while True:
        held = _settled(named, answers, disk, config.min_probe_chars, at_once)
        asking = held.where("asks")
        if asking.isEmpty():
            found = held.join(disk.select("fid", "path"), "fid", "left")
            return named.join(found, "id").select("citekey", F.col("path").alias("pdf_path"), "how")
        so_far = answers.groupBy("probe").agg(F.max("part").alias("part"), F.max_by(F.struct("unlike", "last"), "part").alias("end"))
        asked = named.join(asking.select("id"), "id").groupBy("probe").agg(F.greatest(F.count("*") * 2 + FUZZY_LIST, F.lit(1)).alias("most")).join(firsts, "probe").join(so_far, "probe", "left")
        asked = cut_lineage(asked.select("probe", "first", "most", (F.coalesce("part", F.lit(0)) + 1).alias("part"), F.coalesce("end.unlike", F.lit(-2.0)).alias("unlike"), F.coalesce("end.last", F.lit(-1)).cast("long").alias("last")))
        holders = disk.join(held.where("fid is not null").select("fid", F.col("id").alias("holder")), "fid", "left").withColumn("holder", F.coalesce("holder", F.lit(_FREE)))
        answers = cut_lineage(answers.unionByName(_fuzzy(asked, holders, config.fuzzy_threshold)))


def unclaimed(files: DataFrame, resolved: DataFrame) -> DataFrame:
    used = resolved.where(F.col("pdf_path").isNotNull()).select(F.col("pdf_path").alias("path")).distinct()
    return files.select("path").join(used, "path", "left_anti")


def report(rows: DataFrame, pos: str, readable: Column | None = None) -> DataFrame:
    """``(citekey, problems, warnings, duplicate_of, valid)`` of resolved library rows; a duplicate is a problem as well."""
    flagged = first_wins_duplicates(rows, pos)
    dup = F.when(F.col("duplicate_of").isNotNull(), F.array(F.concat(F.lit("duplicate of "), "duplicate_of"))).otherwise(F.array().cast("array<string>"))
    all_problems = F.concat(problems(readable), dup)
    ok = F.size(all_problems) == 0
    return flagged.select(pos, "citekey", all_problems.alias("problems"), F.when(ok, warnings()).otherwise(F.array().cast("array<string>")).alias("warnings"), "duplicate_of", ok.alias("valid"))


def summary(reported: DataFrame) -> DataFrame:
    """One row ``(total, valid, invalid, duplicates, with_warnings)``."""
    return reported.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count("duplicate_of").alias("duplicates"), F.count_if(F.size("warnings") > 0).alias("with_warnings"),
    )


def report_lines(reported: DataFrame, pos: str, unclaimed_files: DataFrame) -> DataFrame:
    """``(part, at, line)``: the report as text for people, in the order of ``part`` and ``at``.

    Parts with rows begin with a heading that counts them: 0 the totals, 1 rejected rows, 2 rows with warnings,
    3 duplicates, 4 files without a row.
    """
    rows = [
        (1, "not valid", "  rejected", F.concat(F.lit("    - "), "citekey", F.lit(": "), F.array_join("problems", ", "))),
        (2, "valid and size(warnings) > 0", "  accepted with warnings", F.concat(F.lit("    ~ "), "citekey", F.lit(": "), F.array_join("warnings", ", "))),
        (3, "duplicate_of is not null", "  duplicates", F.concat(F.lit("    - "), "citekey", F.lit(" duplicates "), "duplicate_of")),
    ]
    listed = reported.withColumn("citekey", F.coalesce("citekey", F.lit("?")))
    each = [listed.where(which).select(F.lit(part).alias("part"), F.lit(head).alias("head"), F.col(pos).cast("string").alias("key"), F.col(pos).cast("long").alias("at"), line.alias("line")) for part, which, head, line in rows]
    each.append(unclaimed_files.select(F.lit(4).alias("part"), F.lit("  PDFs on disk with no bib entry").alias("head"), F.col("path").alias("key"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("    - "), file_name("path")).alias("line")))
    body = reduce(DataFrame.unionByName, each)
    heads = body.groupBy("part", "head").count().select("part", F.lit("").alias("key"), F.lit(-1).cast("long").alias("at"), F.concat("head", F.lit(" ("), "count", F.lit("):")).alias("line"))
    total = summary(reported).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(-1).cast("long").alias("at"), F.concat(F.lit("BibTeX library: "), "valid", F.lit(" ingestable / "), "total", F.lit(" total")).alias("line"))
    return total.unionByName(heads).unionByName(body.drop("head")).orderBy("part", "at", "key", "line").select("part", "at", "line")


def exact_matches(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``(citekey, path)``: files whose normalised stem is that of a declared file, the first by path."""
    by_stem = files.select("path", norm_key(strip_extension(file_name("path"))).alias("stem")).groupBy("stem").agg(F.min("path").alias("path"))
    wanted = rows.where(F.col("declared_file").isNotNull()).select("citekey", norm_key(strip_extension("declared_file")).alias("stem"))
    return wanted.join(by_stem, "stem").select("citekey", "path")


def prefix_matches(rows: DataFrame, files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``(citekey, path)``: the shortest file name that starts with the declared stem of at least ``min_probe_chars``.

    The theta join is made an equality join on the first ``min_probe_chars`` characters.
    """
    n = config.min_probe_chars
    f = files.select("path", F.length(file_name("path")).alias("len"), norm_key(strip_extension(file_name("path"))).alias("disk")).withColumn("head", F.substring("disk", 1, n))
    w = rows.select("citekey", norm_key(strip_extension("declared_file")).alias("stem")).where(F.length("stem") >= n).withColumn("head", F.substring("stem", 1, n))
    fits = w.join(f, "head").where(F.col("disk").startswith(F.col("stem")))
    return fits.groupBy("citekey").agg(F.min(F.struct("len", "path")).alias("m")).select("citekey", F.col("m.path").alias("path"))
