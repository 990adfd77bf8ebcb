"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents longer than a window give full windows first; what is left of each is cut into items of a
quarter of a window at most, small enough for windows to come out even. The items of a
block are dealt to m windows by differencing: every item begins as a partial partition of its own, and
the two partial partitions with the greatest spread are merged again and again, the fullest windows of
one with the emptiest of the other, so that opposing imbalances cancel. m begins at the least count that
could hold the items and rises by one whenever a window exceeds the capacity.

As pieces may be cut, the near-equal windows are then levelled: the emptiest one is dissolved and its
tokens fill up the others. What doesn't fill a window passes to the next block of the task; at its end
the rest is cut at powers of two, which need no padding.

Every task packs what it reads, so there is no shuffle, and ids of sequences are unique by the number
of the task's partition.

Defined cases: a null text is an empty one (the end id alone); strings of the tokenizer's added tokens become those
tokens, as the library does it; texts are never cut off; repeated rows
are packed each; ties of spread go by age; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import Generations, batch_of, map_rows, quiet_threads, table

CAPACITY = 2048
#: Items that are dealt to windows together.
BLOCK = 1024
#: Words in the cache of a worker.
CACHE = 1_200_000
#: A word that is one token and is set between others.
_MARK = "|"
_TASK_BITS = 40


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of the items in each of m windows."""
    heap, pairs = [], []  # pairs: items under an inner node, by node - len(sizes)
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        spread = sizes[i] if m > 1 else 0
        heap.append((-spread, len(heap), np.array([sizes[i]], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    age, n = len(heap), len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        k, l = len(a), len(b)
        if k + l <= m:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            both = k + l - m  # windows in which both partitions have items
            sums, nodes = np.zeros(m, np.int64), np.empty(m, np.int64)
            sums[:k], nodes[:k] = a, x
            sums[m - l :] += b[::-1]
            ry = y[::-1]
            nodes[k:] = ry[both:]
            at = np.arange(k - both, k)
            pairs.extend(zip(nodes[at].tolist(), ry[:both].tolist()))
            nodes[at] = np.arange(n + len(pairs) - both, n + len(pairs))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == m else 0))
        heapq.heappush(heap, (-spread, age, sums, nodes))
        age += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                items.append(v)
            else:
                todo += pairs[v - n]
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of whole items, none over the capacity (no item may be)."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    m = -(-sum(sizes) // capacity) or 1
    while True:
        found = differencing(sizes, m)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        m += 1


class WordTokens(Generations):
    """Packed ids of words between ASCII white space, which this tokenizer drops and never joins over."""

    def __init__(self, path: str, most: int = CACHE):
        super().__init__(most)
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer looks for before it splits words; texts that may hold one are encoded whole.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _each(self, keys: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([k.decode("utf-8", "replace") for k in keys], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def find(self, keys: list[bytes]) -> list[bytes]:
        """Many words are encoded as one text, with a mark between them, which is much cheaper."""
        out = []
        sign = _MARK.encode()
        for at in range(0, len(keys), 2000):
            part = keys[at : at + 2000]
            text = (b" " + sign + b" ").join(part)
            ids = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if any(sign in k for k in part) or len(ends) != len(part) - 1:
                out += self._each(part)
                continue
            data, ends = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            out += [data[4 * a + 4 : 4 * b] for a, b in zip(ends, ends[1:])]
        return out

    def packed(self, texts: list[str | None], end: bytes) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if t and any(a in low for low in (t.lower(),) for a in self.added)}
        words = [[] if i in whole else ascii_words(t) for i, t in enumerate(texts)]
        out = [b"".join(v) + end for v in self.values_of(words)]
        for i in whole:
            out[i] = self._each([texts[i].encode("utf-8", "replace")])[0] + end
        return out


def ascii_words(text: str | None) -> list[bytes]:
    """Words in UTF-8. A-Z become lower case, as the tokenizer does it, unless marks are there that
    could combine with a letter before that."""
    data = text.encode("utf-8", "replace") if text else b""
    return (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


_SCHEMA = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
COLUMNS = [n for n, _ in _SCHEMA]


class Packer:
    """Packs the documents of one task. A piece is (doc_id, doc_tokens, start, packed ids)."""

    def __init__(self, tokens, task: int, capacity: int = CAPACITY, block: int = BLOCK, end_id: int = 1):
        self.tokens, self.capacity, self.block = tokens, capacity, block
        self.end_id = np.array([end_id], "<u4").tobytes()
        self.next = task << _TASK_BITS
        self.items: list[tuple] = []
        self.rows: list[tuple] = []

    def __call__(self, ids, texts):
        whole = 4 * self.capacity
        for doc, data in zip(ids, self.tokens.packed(texts, self.end_id)):
            n = len(data) // 4
            full = len(data) // whole * whole
            for at in range(0, full, whole):
                self.put([(doc, n, at // 4, data[at : at + whole])])
            part = max(1, whole // 16) * 4
            self.items += [(doc, n, at // 4, data[at : min(at + part, len(data))]) for at in range(full, len(data), part)]
            if len(self.items) >= self.block:
                self.flush()
        return self.taken()

    def put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, n, start, data in pieces:
            length = len(data) // 4
            self.rows.append((doc, start, length, zlib.crc32(data), n, self.next, offset))
            offset += length
        self.next += 1

    def taken(self):
        rows, self.rows = self.rows, []
        return batch_of(_SCHEMA, dict(zip(COLUMNS, zip(*rows)))) if rows else None

    def flush(self) -> None:
        """Deal the items out, level the windows, and keep what doesn't fill one."""
        items, self.items = self.items, []
        sizes = [len(x[3]) // 4 for x in items]
        dealt = [[items[i] for i in w] for w in windows(sizes, self.capacity)]
        dealt.sort(key=lambda w: sum(len(x[3]) for x in w))
        # from both ends: the emptiest windows are dissolved into the room of the fullest
        low, spare = 0, []
        for high in range(len(dealt) - 1, -1, -1):
            if high < low:
                break
            window = dealt[high]
            room = self.capacity - sum(len(x[3]) for x in window) // 4
            while room:
                if not spare:
                    if low >= high:
                        break
                    spare, low = dealt[low], low + 1
                doc, n, start, data = spare.pop()
                cut = data[: 4 * room]
                window.append((doc, n, start, cut))
                room -= len(cut) // 4
                if len(cut) < len(data):
                    spare.append((doc, n, start + len(cut) // 4, data[len(cut) :]))
            if room:
                self.items += window
            else:
                self.put(window)
        self.items += spare

    def end(self):
        if self.items:
            self.flush()
        rest, self.items = self.items, []
        left = sum(len(x[3]) for x in rest) // 4
        while left:
            size = min(self.capacity, 1 << left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, n, start, data = rest.pop()
                cut = data[: 4 * room]
                window.append((doc, n, start, cut))
                room -= len(cut) // 4
                if len(cut) < len(data):
                    rest.append((doc, n, start + len(cut) // 4, data[len(cut) :]))
            self.put(window)
            left -= size
        return self.taken()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text)``."""

    def make():
        from pyspark import TaskContext

        return Packer(word_tokens(path), TaskContext.get().partitionId(), capacity, block)

    return map_rows(docs, ["doc_id", "text"], make, ", ".join(f"{c} long" for c in COLUMNS))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: pack all documents into windows of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
