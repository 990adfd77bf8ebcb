"""Near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles. Under a hash, every stretch of a text has a min-hash, found
at its centre; all stretches with one centre form a compact window (l, c, r): they begin in l..c and end
in c..r. The windows are the nodes of the Cartesian tree over the hashes. Only windows of at least
``MIN_WORDS`` words matter; their centres are the minima of sliding windows of that length (about 2 in
47 shingles), and the tree is built over these alone.

Stretches of two texts that are near-duplicates share the min-hash under most of the ``HASHES`` hashes,
so their windows meet under the shingle at the centre. Windows that meet are told apart by the runs of words in
which they agree around the centre: runs of 47 words at every third place that holds the centre, of 23 words at
every sixth, of 10 words before and after. Of the windows that share a run, each is linked to the first in the order of
(document, position), or to the one before it if all until then are in its own document: a star, never all pairs. A window goes with the longest runs it shares with any other.
Two texts that share 50 words share a run of 47 at one place at least, and so does each of them with its leader
there; so excerpts that are too short for a passage don't hide a longer repetition (unless they hold 47 to 49 words
of it at every such place). Keys of very many windows are worked on run by run instead of key by key. Of a
document's links those go on that are needed for each of its words with a run of MIN_WORDS to have a source, and
all whose centre has none. Equal texts are one beforehand: a copy repeats the one with the smallest id as a whole.

Links of one pair of documents on one diagonal are joined over all hashes to an interval
that bounds the passage. Within it the exact extent is found and verified: shingles in common count +1,
others -4, stretches of greatest sum are passages if they have MIN_WORDS words and their shingle sets a
Jaccard similarity of 0.8 or more, else the parts on both sides of their longest gap are tried.

A passage is reported where it repeats, with the place where it stands first: ``doc_id, start_word,
end_word`` (exclusive), ``n_words, source_doc_id, source_start, source_end, similarity``. A document may
repeat itself; a stretch that overlaps its own repetition is cut into pieces as long as its shift (or the least multiple
of it that has MIN_WORDS), each of which repeats the first one; fewer than WIDTH words over and over are no passage.

Defined cases: a null text is an empty one; texts of under MIN_WORDS words have no passages; whole texts
are read; equal texts repeat the one with the smallest id; an empty table gives an empty result.
Repeated rows are one document; different texts under one id are compared each, and what is found in any
of them is reported under the id; rows without an id have no passages and are no source.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import as_signed, batch_of, cut, map_rows, mixed, only_needed, shingle_hashes, spread_join, table, word_hashes, words_of
from driftline.plans.storage import drop_path, materialize

WIDTH = 5
#: What a shingle that isn't in common costs, low enough for no passage at the least similarity to fall apart.
_PENALTY = 4
#: How far diagonals of one passage may be apart: words put in or left out.
_SLACK = 10
MIN_WORDS = 50
SIMILARITY = 0.8
#: Hashes; a passage at the least similarity has no centre in common with probability 0.2^HASHES.
HASHES = 4
_SPAN = MIN_WORDS - WIDTH + 1
_SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Shingles that are worked on together; their places fit into the low bits of the ordering. Longer texts are cut
#: into segments that overlap enough for every stretch of _SPAN to lie in one.
SEGMENT, _OVERLAP = 1 << 20, 2 * _SPAN
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def centres(order: np.ndarray, span: int) -> np.ndarray:
    """Places of the minima of all windows of ``span`` values, ascending."""
    n = len(order)
    if n < span:
        return np.empty(0, np.int64)
    blocks = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = order
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    at = (least & _PLACE).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def compact_windows(order: np.ndarray, walls: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``span`` places; none reaches over a wall.

    ``order``: distinct values, walls the smallest of all. The Cartesian tree over the centres is built
    with a stack: what stands on it to the left is smaller.
    """
    c = np.union1d(centres(order, span), walls)
    values, places = order[c].tolist(), c.tolist()
    left, right = [0] * len(places), [len(order) - 1] * len(places)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else 0
        stack.append(i)
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    keep = ~np.isin(c, walls) & (r - l + 1 >= span)
    return l[keep], c[keep], r[keep]


_WINDOW = [("key", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]

#: Runs around a centre: (words, places before the centre where they begin), the longest first.
RUNS = [(47, tuple(range(0, 43, 3))), (23, (0, 6, 12, 18)), (10, (0, 5))]
_SLOTS = [(words, back, tier) for tier, (words, backs) in enumerate(RUNS) for back in backs]
_SLOT_LO = np.array([-back for _, back, _ in _SLOTS], np.int64)
_SLOT_HI = np.array([words - back for words, back, _ in _SLOTS], np.int64)
_SLOT_WORDS = _SLOT_HI - _SLOT_LO
#: Windows of one key from which they are worked on run by run.
HOT_KEY = 500_000
#: Windows whose runs are compared together, at least.
_TOGETHER = 100_000


def _windows_of(ids: list, offsets: list[int], lasts: list[bool], rows: list[np.ndarray], hashes: int) -> pa.RecordBatch | None:
    """Windows of some segments of texts, given as shingles; each is followed by a wall."""
    starts = np.cumsum([0] + [len(r) + 1 for r in rows])
    walls = starts[1:] - 1
    flat = np.zeros(starts[-1], np.uint64)
    for s, r in zip(starts, rows):
        flat[s : s + len(r)] = r
    place = np.arange(len(flat), dtype=np.uint64)
    found = []
    for seed in _SEEDS[:hashes]:
        order = (mixed(flat ^ seed) | np.uint64(1 << _PLACE_BITS)) & ~_PLACE | place
        order[walls] = place[walls]
        found.append(compact_windows(order, walls, _SPAN))
    l, c, r = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(c, kind="stable")
    l, c, r = l[by], c[by], r[by]
    if len(c):
        first = np.flatnonzero(np.diff(c, prepend=-1))
        l, c, r = np.minimum.reduceat(l, first), c[first], np.maximum.reduceat(r, first)
    row = np.searchsorted(starts, c, side="right") - 1
    off, last = np.array(offsets, np.int64)[row], np.array(lasts, bool)[row]
    s, e = starts[row], walls[row]
    # a centre where two segments overlap belongs to one of them
    own = ((off == 0) | (c - s >= _OVERLAP // 2)) & (last | (e - c > _OVERLAP // 2))
    if not own.any():
        return None
    l, c, r, row, s, off = (x[own] for x in (l, c, r, row, s, off))
    columns = [as_signed(flat[c]), np.array(ids, np.int64)[row], *((x - s + off).astype(np.int32) for x in (c, l, r))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _WINDOW)], names=[n for n, _ in _WINDOW])


def window_rows(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """``key, doc_id, c, l, r``: compact windows, by shingles of their document. ``key`` is the shingle at the centre."""

    def make():
        def step(ids, texts):
            out, some, n = [], [], 0

            def done():
                nonlocal some, n
                if some and (b := _windows_of(*map(list, zip(*some)), hashes)) is not None:
                    out.append(b)
                some, n = [], 0

            for i, t in zip(ids, texts):
                s = shingle_hashes(word_hashes(words_of(t)), WIDTH)
                for at in range(0, max(len(s) - _OVERLAP, 1), SEGMENT - _OVERLAP):
                    part = s[at : at + SEGMENT]
                    if len(part) < _SPAN:
                        continue
                    if n + len(part) + 1 > max(1 << 18, SEGMENT + 1):
                        done()
                    some.append((i, at, at + SEGMENT >= len(s), part))
                    n += len(part) + 1
            done()
            return out

        return step

    return map_rows(docs, ["doc_id", "text"], make, "key long, doc_id long, c int, l int, r int")


def run_marks(words: np.ndarray, c: np.ndarray) -> np.ndarray:
    """16 bits of the hash of each run of words around the centres, (centres, slots); 0 where the text doesn't hold it.

    A run's hash is a polynomial over its words, from prefix sums modulo 2^64.
    """
    n = len(words)
    power, back = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words) * power[:n])])
    at = c[:, None] + _SLOT_LO
    whole = (at >= 0) & (at + _SLOT_WORDS <= n)
    at = np.where(whole, at, 0)
    hashes = (sums[np.minimum(at + _SLOT_WORDS, n)] - sums[at]) * back[at]
    return np.where(whole, np.maximum(mixed(hashes) >> np.uint64(48), 1), 0).astype(np.uint16)


_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n at least of the base and of its inverse; they grow with the longest text a worker has met."""
    if len(_TABLES[0]) <= n:
        size = max(2 * n, 1 << 12)
        for k, base in enumerate((_BASE, _INVERSE)):
            _TABLES[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base))])
    return _TABLES


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MARKED = [*_WINDOW, ("marks", pa.binary())]


def _with_marks(by_doc: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows of ``by_doc(doc_id, w array<struct<key, c, l, r>>)``, one a row, with the marks of their runs."""

    def run(batches):
        for batch in cut(batches):
            ids, ws, ts = (batch.column(i) for i in range(3))
            columns = []
            for i, t in enumerate(ts.to_pylist()):
                w = ws[i].values
                c = w.field("c").to_numpy()
                marks = run_marks(word_hashes(words_of(t)), c.astype(np.int64))
                columns.append((w.field("key").to_numpy(), np.full(len(c), ids[i].as_py(), np.int64), c, w.field("l").to_numpy(), w.field("r").to_numpy(), marks))
            if columns:
                *plain, marks = (np.concatenate(x) for x in zip(*columns))
                size = marks.shape[1] * 2
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(marks), [None, pa.py_buffer(np.ascontiguousarray(marks, "<u2"))])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(plain, _MARKED)] + [fixed.cast(pa.binary())], names=[n for n, _ in _MARKED])

    joined = by_doc.join(texts, "doc_id").select("doc_id", "w", "text")
    return joined.mapInArrow(run, "key long, doc_id long, c int, l int, r int, marks binary")


_LINK = [("first", pa.int64()), ("doc_id", pa.int64()), ("shift", pa.int32()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("run_lo", pa.int32()), ("run_hi", pa.int32())]
_LINK_SCHEMA = "first long, doc_id long, shift int, c int, lo int, hi int, run_lo int, run_hi int"


def _stars(key: np.ndarray, doc: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, marks: np.ndarray) -> pa.RecordBatch | None:
    """Links of windows of whole keys to the first ones that share their longest runs."""
    by = np.lexsort((c, doc))
    key, doc, c, l, r, marks = key[by], doc[by], c[by], l[by], r[by], marks[by]
    open_ = np.ones(len(key), bool)
    found, cores = [], []
    for tier in range(len(RUNS)):
        here, slots = [], []
        for k, (_, _, t) in enumerate(_SLOTS):
            if t != tier:
                continue
            own = np.flatnonzero(marks[:, k])
            run = mixed(key[own].view(np.uint64) ^ (marks[own, k].astype(np.uint64) << np.uint64(32) | np.uint64(k + 1)))
            order = np.argsort(run, kind="stable")
            at, run = own[order], run[order]
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, np.int64)
            first = at[np.repeat(start, np.diff(np.append(start, len(at))))]
            first = np.where(doc[first] == doc[at], np.concatenate([at[:1], at[:-1]]), first)  # within a document the one before
            first[start] = at[start]
            keep = (first != at) & open_[at]
            f, m = first[keep], at[keep]
            lo, hi = np.minimum(c[m] - l[m], c[f] - l[f]), np.minimum(r[m] - c[m], r[f] - c[f])
            wide = lo + hi + 1 >= _SPAN - _SLACK  # both windows hold any passage around this centre
            here.append(f[wide].astype(np.int64) << 32 | m[wide])
            slots.append(np.full(len(here[-1]), k))
        at, runs = np.concatenate(here), np.concatenate(slots)
        by = np.argsort(at, kind="stable")
        at, runs = at[by], runs[by]
        start = np.flatnonzero(np.diff(at, prepend=-1))
        pairs = at[start]
        open_[pairs & 0xFFFFFFFF] = False
        found.append(pairs)
        # the words of all runs shared with this leader: they hold the centre, so they are one run
        cores.append(np.stack([np.minimum.reduceat(_SLOT_LO[runs], start), np.maximum.reduceat(_SLOT_HI[runs], start)]) if len(pairs) else np.empty((2, 0), np.int64))
        needed = _needed(pairs & 0xFFFFFFFF, *cores[-1])
        found[-1], cores[-1] = pairs[needed], cores[-1][:, needed]
    pairs, core = np.concatenate(found), np.concatenate(cores, axis=1)
    if not len(pairs):
        return None
    f, m = pairs >> 32, pairs & 0xFFFFFFFF
    lo, hi = c[m] - np.minimum(c[m] - l[m], c[f] - l[f]), c[m] + np.minimum(r[m] - c[m], r[f] - c[f])
    columns = [doc[f], doc[m], c[m] - c[f], c[m], lo, hi, c[m] + core[0], c[m] + core[1]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _LINK)], names=[n for n, _ in _LINK])


def _needed(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of windows ``m`` with shared runs a..b, less those whose run lies within the window's longest one of MIN_WORDS and more."""
    by = np.lexsort((np.arange(len(m)), a - b, m))
    start = np.flatnonzero(np.diff(m[by], prepend=-1))
    longest = np.repeat(by[start], np.diff(np.append(start, len(by))))
    inside = (a[by] >= a[longest]) & (b[by] <= b[longest]) & (by != longest) & (b[longest] - a[longest] >= MIN_WORDS)
    return np.sort(by[~inside])


def _cold_links(marked: DataFrame) -> DataFrame:
    """Links from windows with marks, key by key in the tasks that hold them: bounds ``lo, hi`` by shingles, the run of words
    that both texts share for sure around the centre ``c``."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def arrays(table):
            key, doc, c, l, r = (table.column(i).to_numpy() for i in range(5))
            return key, doc, c, l, r, np.frombuffer(b"".join(table.column(5).to_pylist()), "<u2").reshape(len(key), -1)

        def together(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            end = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last key may go on
            held = table.slice(end).to_batches()
            return _stars(*arrays(table.slice(0, end))) if end else None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= _TOGETHER and (out := together(False)) is not None:
                    yield out
        if held and (out := together(True)) is not None:
            yield out

    dealt = marked.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _LINK_SCHEMA)


def _hot_links(marked: DataFrame) -> DataFrame:
    """The same for keys of very many windows: leaders by aggregates that combine before the shuffle, joined back in parts."""
    slots = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(_SLOTS) - 1)), lambda k: F.substring("marks", 2 * k + 1, F.lit(2))))
    every = marked.select("key", "doc_id", "c", "l", "r", slots.alias("k", "mark")).where(F.col("mark") != F.lit(b"\0\0"))
    of_slot = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("k") + 1)
    every = every.select(F.xxhash64("key", "k", "mark").alias("run"), of_slot(t for _, _, t in _SLOTS).alias("tier"), of_slot(_SLOT_LO).alias("a"), of_slot(_SLOT_HI).alias("b"), "doc_id", "c", "l", "r")
    leads = materialize(every.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "c", "l", "r")).alias("f")).where("n > 1"), "leaders")
    met = spread_join(every, leads.select("run", "f"), "run", "doc_id", counts=leads).where("doc_id <> f.doc_id OR c <> f.c")
    left, right = F.least(F.col("c") - F.col("l"), F.col("f.c") - F.col("f.l")), F.least(F.col("r") - F.col("c"), F.col("f.r") - F.col("f.c"))
    met = met.where(left + right + 1 >= _SPAN - _SLACK).select(
        "tier", F.col("f.doc_id").alias("first"), "doc_id", (F.col("c") - F.col("f.c")).alias("shift"), "c", (F.col("c") - left).alias("lo"), (F.col("c") + right).alias("hi"), "a", "b"
    )
    met = materialize(met.groupBy("tier", "first", "doc_id", "shift", "c", "lo", "hi").agg((F.col("c") + F.min("a")).alias("run_lo"), (F.col("c") + F.max("b")).alias("run_hi")), "met")
    best = met.groupBy("doc_id", "c").agg(F.min("tier").alias("tier"))
    return met.join(best, ["doc_id", "c", "tier"]).select(*(n for n, _ in _LINK))


def sources(first: np.ndarray, shift: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, run_lo: np.ndarray, run_hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, shift, lo, hi): which links of one document are worth verifying.

    Links on one diagonal with shared runs of MIN_WORDS and more are sure. Diagonals that share most words for sure
    come first, and one whose sure words all have a source already is left out. Of the other links those
    go on whose centre lies in no sure run.
    """
    by = np.lexsort((run_lo, shift, first))
    first, shift, c, lo, hi, run_lo, run_hi = (x[by] for x in (first, shift, c, lo, hi, run_lo, run_hi))
    start = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 0) | (np.diff(shift) != 0)]))
    end = np.append(start[1:], len(first))
    sure = run_hi - run_lo >= MIN_WORDS
    words = np.add.reduceat(np.where(sure, run_hi - run_lo, 0), start)
    offset = int(min(run_lo.min(), 0))
    covered = np.zeros(int(run_hi.max()) - offset + 1, bool)
    kept: dict[int, np.ndarray] = {}
    for g in np.lexsort((first[start], -words))[: int(np.count_nonzero(words))].tolist():
        new = False
        for i in (start[g] + np.flatnonzero(sure[start[g] : end[g]])).tolist():
            part = covered[run_lo[i] - offset : run_hi[i] - offset]
            if not part.all():
                new = True
                part[:] = True
        if new:
            kept[g] = np.arange(start[g], end[g])
    bare = ~covered[c - offset]
    for g in range(len(start)):
        if g not in kept and len(left := start[g] + np.flatnonzero(bare[start[g] : end[g]])):
            kept[g] = left
    return [(int(first[start[g]]), int(shift[start[g]]), int(lo[k].min()), int(hi[k].max())) for g, k in kept.items()]


def _chosen(found: DataFrame) -> DataFrame:
    """``first, doc_id, spans array<struct<shift, lo, hi>>`` of the links of whole documents that :func:`sources` keeps."""
    schema = pa.schema([("first", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("shift", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])))])

    def run(batches):
        for batch in cut(batches):
            rows = []
            for i in range(batch.num_rows):
                w = batch.column(1)[i].values
                by: dict[int, list] = {}
                for f, s, lo, hi in sources(*(w.field(n).to_numpy().astype(np.int64) for n in _KEPT)):
                    by.setdefault(f, []).append({"shift": s, "lo": lo, "hi": hi})
                doc = batch.column(0)[i].as_py()
                rows += [{"first": f, "doc_id": doc, "spans": spans} for f, spans in by.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    grouped = found.groupBy("doc_id").agg(F.collect_list(F.struct(*_KEPT)).alias("w"))
    return grouped.mapInArrow(run, "first long, doc_id long, spans array<struct<shift: int, lo: int, hi: int>>")


_KEPT = ["first", "shift", "c", "lo", "hi", "run_lo", "run_hi"]


def links(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``first, doc_id, spans array<struct<shift, lo, hi>>``: what may repeat what, for each pair of
    documents the diagonals (place in doc_id less place in first) with bounds by shingles of doc_id.

    A window has a link for each place of its runs at most, so a row's spans are bounded by the length of its document."""
    spark = windows.sparkSession
    counts = materialize(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = spread_join(windows, counts, "key", "doc_id", counts=counts)
    shared = materialize(shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "c", "l", "r", (F.col("n") > HOT_KEY).alias("hot"))).alias("w")), "shared")
    drop_path(spark, windows)

    def of(hot: bool) -> DataFrame:
        some = shared.select("doc_id", F.filter("w", lambda x: x["hot"] == hot).alias("w")).where(F.size("w") > 0)
        return _with_marks(some, only_needed(texts, some.select("doc_id")))

    found = materialize(_cold_links(of(False)), "links")
    if not counts.where(F.col("n") > HOT_KEY).isEmpty():
        found = found.union(_hot_links(of(True)))
    chosen = materialize(_chosen(found), "chosen")
    for t in (shared, found):
        drop_path(spark, t)
    return chosen


def clusters(spans: list[tuple[int, int, int]], slack: int = _SLACK) -> list[tuple[int, int, int, int]]:
    """(lo, hi, least shift, greatest shift): spans that overlap or nearly touch, on diagonals close together.

    Clusters still within reach are found by the bands of diagonals they cover, so the work grows with the spans."""
    out: list[list[int]] = []
    near: dict[int, list[int]] = {}  # band of diagonals -> the last cluster that covers it
    width = 2 * slack
    for shift, lo, hi in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        found = None
        for band in range((shift - slack) // width, (shift + slack) // width + 1):
            c = near.get(band)
            if c is not None and lo <= c[1] + slack + WIDTH and c[2] - slack <= shift <= c[3] + slack:
                found = c
                break
        if found is None:
            found = [lo, hi, shift, shift]
            out.append(found)
        else:
            found[0], found[1], found[2], found[3] = min(found[0], lo), max(found[1], hi), min(found[2], shift), max(found[3], shift)
        near[shift // width] = found
    return [tuple(c) for c in out]


def passages(source: np.ndarray, copy: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, similarity) of verified passages, by shingles, ends exclusive.

    Where the texts agree, place k of the copy is expected at k or a little later in the source.
    """
    if len(source) < 1 or len(copy) < _SPAN:
        return []
    by = np.argsort(source, kind="stable")
    at = np.minimum(np.searchsorted(source[by], copy), len(source) - 1)
    place = by[at]
    hit = source[place] == copy
    if len(by) > 1 and (np.diff(source[by]) == 0).any():  # of equal shingles the one next to the diagonal counts
        x, free = np.arange(len(copy)), hit.copy()
        for d in range(_SLACK + 1):
            on = np.flatnonzero(free & (x + d < len(source)))
            on = on[source[on + d] == copy[on]]
            place[on], free[on] = on + d, False
            if not free.any():
                break
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=-1, append=-1))
    runs = [(a, b, 1 if hit[a] else -_PENALTY) for a, b in zip(edges.tolist(), edges[1:].tolist())]
    out, todo, k = [], [], 0
    while k < len(runs):
        if runs[k][2] < 0:
            k += 1
            continue
        total = best = 0
        end, j = k, k
        while j < len(runs):
            a, b, w = runs[j]
            total += w * (b - a)
            if total > best:
                best, end = total, j
            if total <= 0:
                break
            j += 1
        todo.append((k, end))
        k = end + 1
    while todo:
        k, end = todo.pop()
        lo, hi = runs[k][0], runs[end][1]
        if hi - lo < _SPAN:
            continue
        inside = np.arange(lo, hi)[hit[lo:hi]]
        shift = place[inside] - inside
        near = place[inside][np.abs(shift - np.sort(shift)[len(shift) // 2]) <= 2 * _SLACK]
        s, e = int(near.min()), int(near.max()) + 1
        p, q = np.unique(copy[lo:hi]), np.unique(source[s:e])
        common = len(np.intersect1d(p, q, assume_unique=True))
        similarity = common / (len(p) + len(q) - common)
        if similarity >= SIMILARITY:
            out.append((lo, hi, s, e, similarity))
        elif end > k:  # its parts on both sides of the longest gap may do
            gap = max(range(k + 1, end, 2), key=lambda i: runs[i][1] - runs[i][0])
            todo += [(k, gap - 1), (gap + 1, end)]
    return sorted(out)


_CUT = [("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("source_doc_id", pa.int64()), ("source_lo", pa.int64()), ("words", pa.binary())]
_FOUND = [(n, pa.int64()) for n in ("doc_id", "start_word", "end_word", "n_words", "source_doc_id", "source_start", "source_end")] + [("similarity", pa.float64())]
_FOUND_SCHEMA = ", ".join(f"{n} {'double' if n == 'similarity' else 'long'}" for n, _ in _FOUND)


def _cut(first, doc, spans, texts):
    """The words of the first document that each possible passage may cover."""
    rows, known, words = [], None, []
    for f, d, ss, t in zip(first, doc, spans, texts):
        if f != known:
            known, words = f, words_of(t)
        for lo, hi, least, most in clusters([(s["shift"], s["lo"], s["hi"]) for s in ss]):
            a, b = max(0, lo - most), hi - least + WIDTH
            rows.append((d, lo, hi, f, a, b" ".join(words[a:b])))
    return batch_of(_CUT, dict(zip([n for n, _ in _CUT], zip(*rows)))) if rows else None


def _verify(doc, lo, hi, source, source_lo, words, texts):
    rows, known, own = [], None, None
    for d, a, b, f, fa, w, t in zip(doc, lo, hi, source, source_lo, words, texts):
        if d != known:
            known, own = d, shingle_hashes(word_hashes(words_of(t)), WIDTH)
        there = shingle_hashes(word_hashes(w.split()), WIDTH)
        for s, e, x, y, similarity in passages(there, own[a : b + 1]):
            start, end = a + s, a + e + WIDTH - 1
            fs, fe = fa + x, fa + y + WIDTH - 1
            if f == d and fe > start:
                rows += _pieces(d, own, start, end, fs)
                continue
            rows.append((d, start, end, end - start, f, fs, fe, similarity))
    return batch_of(_FOUND, dict(zip([n for n, _ in _FOUND], zip(*rows)))) if rows else None


def _pieces(doc: int, own: np.ndarray, start: int, end: int, first: int) -> list[tuple]:
    """A stretch of words start..end that overlaps its source (from ``first`` on) as pieces of the length of the shift, or of
    the least multiple of it that has MIN_WORDS."""
    rows, period = [], start - first
    if period < WIDTH:
        return rows
    shift = period * -(-MIN_WORDS // period)
    start = first + shift
    source = np.unique(own[first : first + shift - WIDTH + 1])
    for at in range(start, end - MIN_WORDS + 1, shift):
        to = min(at + shift, end)
        there = source if to - at == shift else np.unique(own[first : first + to - at - WIDTH + 1])
        here = np.unique(own[at : to - WIDTH + 1])
        common = len(np.intersect1d(here, there, assume_unique=True))
        similarity = common / (len(here) + len(there) - common)
        if similarity >= SIMILARITY:
            rows.append((doc, at, to, to - at, doc, first, first + to - at, similarity))
    return rows


def repeated_passages(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Every passage that repeats an earlier one in ``docs(doc_id, text)``; see above."""
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    keyed = named.withColumn("digest", F.sha2("text", 256))
    rows = keyed.where("digest IS NOT NULL").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    same = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("rows").alias("n"), F.max("rows").alias("rows")).where("n > 1"), "copies")
    if same.isEmpty():
        return _passages_of(named, hashes)
    every = spread_join(keyed, same.select("digest", "first"), "digest", "doc_id", "left", counts=same)
    copies = materialize(every.where("doc_id <> first").select("doc_id", "first"), "copies").distinct()
    texts = only_needed(named, copies.select("doc_id"), absent=True).union(
        only_needed(named, copies.select("doc_id")).join(copies, "doc_id", "left_anti").select("doc_id", "text")
    )
    if not same.where("rows > 1").isEmpty():  # repeated rows are one document
        twice = materialize(spread_join(keyed, same.where("rows > 1").select("digest"), "digest", "doc_id", "left_semi", counts=same).select("doc_id", "text").distinct(), "repeated")
        texts = only_needed(texts, twice.select("doc_id"), absent=True).union(only_needed(texts, twice.select("doc_id")).join(twice.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")).union(
            twice.join(copies, "doc_id", "left_anti").select("doc_id", "text")
        )
    return _passages_of(texts, hashes).union(_whole(only_needed(named, copies.select("doc_id")).join(copies, "doc_id")))


def _whole(copies: DataFrame) -> DataFrame:
    """Passages of texts that are equal to that of ``first``: the whole of it."""

    def make():
        def step(ids, firsts, texts):
            rows = [(i, 0, n, n, f, 0, n, 1.0) for i, f, n in zip(ids, firsts, (len(words_of(t)) for t in texts)) if n >= MIN_WORDS]
            return batch_of(_FOUND, dict(zip([n for n, _ in _FOUND], zip(*rows)))) if rows else None

        return step

    return map_rows(copies, ["doc_id", "first", "text"], make, _FOUND_SCHEMA).distinct()


def _passages_of(texts: DataFrame, hashes: int) -> DataFrame:
    """The passages of documents of which no two are equal."""
    found = links(materialize(window_rows(texts, hashes), "windows"), texts)
    first, other = found.select("first").distinct(), found.select("doc_id").distinct()
    with_first = spread_join(found, only_needed(texts, first).select(F.col("doc_id").alias("first"), "text"), "first", "doc_id")
    pieces = map_rows(with_first, ["first", "doc_id", "spans", "text"], lambda: _cut, ", ".join(f"{n} {'binary' if n == 'words' else 'long'}" for n, _ in _CUT))
    both = pieces.join(only_needed(texts, other), "doc_id")
    return map_rows(both, [*(n for n, _ in _CUT), "text"], lambda: _verify, _FOUND_SCHEMA).distinct()


_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans and the white space after each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        start, end = places[a][0], places[b][0] if b < len(places) else len(text)
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (columns as they are) with the passages of ``spans`` cut out and ``n_chars`` set anew;
    documents of which no word is left go. Only texts that have spans are shuffled."""
    names = docs.columns
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("_spans"))
    maybe = only_needed(docs, by_doc.select("doc_id"))
    others = only_needed(docs, by_doc.select("doc_id"), absent=True)
    joined = maybe.join(by_doc, "doc_id", "left").select(*names, "_spans")
    t, n = names.index("text"), names.index("n_chars")

    def run(batches):
        for batch in cut(batches):
            texts, cuts = batch.column(t).to_pylist(), batch.column(len(names)).to_pylist()
            new = [without_spans(x, [(s["start_word"], s["end_word"]) for s in c]) if c else x for x, c in zip(texts, cuts)]
            keep = pa.array([not c or _WORD.search(x) is not None for x, c in zip(new, cuts)])
            counts = [len(x) if c else k for x, c, k in zip(new, cuts, batch.column(n).to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[t], columns[n] = pa.array(new, columns[t].type), pa.array(counts, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return others.select(*names).union(joined.mapInArrow(run, docs.schema))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all repeated passages of all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
