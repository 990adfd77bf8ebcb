"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of its encoding. The table of these
last tokens is all that is stored: reading it backwards gives the encoding of any prefix, appending
bytes extends it exactly, and after an edit only the entries from the edit on are made anew, until they
agree with the old ones again.

A token may follow another only if the pair, encoded on its own by the merge ranks, stays that pair.

Defined cases: a null text is an empty one (no ids); texts are never cut; repeated rows are encoded
alike; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import Generations, batch_of, map_rows, table

#: Unicode White_Space, spelled out: the `re` module's \s has other members.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs with the space before them, and runs of white space, parted as the tokenizer's pattern parts them.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Two of them together, or one that is neither a space nor a line end.
_ODD = re.compile(f"[{_WS}][{_WS}]|[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Entries of the caches of a worker.
CACHE = 800_000


class Vocabulary:
    """Byte strings with ranks; a rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        #: Finds every token in a byte string, read as Latin-1, by where it ends.
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Parts of a short byte string after merging the pair of least rank again and again, while more
        than ``until`` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens that merging
        its own bytes doesn't give."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = self.merged(data, 2) if len(data) > 1 else []
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def may_begin(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged together, end as the pair (a, b); -1 for a is the begin.

        The merges within a and within b go on independently as long as none runs over the border.
        Undoing them from the last one on gives every state of the border there ever was: the tokens
        that touched it, and the rank that came next on either side. A merge over the border comes
        first if its rank is lower than those ranks (on the left, at equal rank, the left one wins).
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._may_follow(a, b) if a >= 0 else self.may_begin(b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        if not (self.may_begin(a) and self.may_begin(b)):
            return False
        ranks, tokens, split = self.ranks, self.tokens, self.split
        limit = None  # rank of the merge that was undone last, and whether it stood on the left
        while True:
            over = ranks.get(tokens[a] + tokens[b])
            if over is not None and (limit is None or over < limit):
                return False
            left, right = split(a), split(b)
            # merges are undone in the reverse of their order: greatest rank first, and of equal ones the right one
            if left is not None and (right is None or a > b):
                # it merged at rank a; a border merge of that rank would stand to its right, so come later
                a, limit = left[1], a
            elif right is not None:
                # a border merge of the same rank stands to its left, so comes first
                b, limit = right[0], b + 1
            else:
                return True


class PrefixTable:
    """``last[i]``: the last token of the encoding of the first i bytes (``last[0]`` is -1)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exactly the table of the longer bytes; nothing before the end changes."""
        v, done = self.v, len(self.data)
        data = self.data + data
        begin = max(0, done - v.longest)
        lengths, pairs, may_follow = v.lengths, v.pairs, v.may_follow
        last = self.last
        last.extend([None] * (len(data) - done))
        for k, b in v.automaton.iter(data[begin:].decode("latin-1")):
            k += begin + 1
            if last[k] is None and (j := k - lengths[b]) >= 0:
                a = last[j]
                if a is None:
                    raise ValueError("the vocabulary lacks a byte")
                ok = pairs.get(a << 20 | b)
                if ok or ok is None and may_follow(a, b):
                    last[k] = b
        if last[-1] is None:
            raise ValueError("the vocabulary lacks a byte")
        self.data = data

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start..end; entries before ``start`` stay, those after it are refilled until
        they repeat the old ones for as long as the longest token. Returns how many were made anew."""
        tokens = self.v.tokens
        longest = self.v.longest
        old_last, shift = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        table = PrefixTable.__new__(PrefixTable)
        table.v, table.data, table.last = self.v, self.data[:start], self.last[: start + 1]
        made, same, at = 0, 0, start
        step = max(64, longest)
        while at < len(data):
            upto = min(len(data), at + step)
            table.append(data[at:upto])
            for i in range(at + 1, upto + 1):
                made += 1
                was = i - shift
                agrees = i > start + len(new) and was > end and old_last[was] == table.last[i]
                same = same + 1 if agrees else 0
                # the encoding of all later prefixes hangs on the last `longest` entries alone
                if same > longest and i - len(tokens[table.last[i]]) >= start + len(new):
                    table.last = table.last[: i + 1] + old_last[was + 1 :]
                    self.data, self.last = data, table.last
                    return made
            at = upto
        self.data, self.last = data, table.last
        return made

    def ids(self, upto: int | None = None) -> list[int]:
        """Encoding of the first ``upto`` bytes (all, if None)."""
        at, out, tokens = len(self.data) if upto is None else upto, [], self.v.tokens
        while at:
            out.append(self.last[at])
            at -= len(tokens[out[-1]])
        return out[::-1]


class Encoder(Generations):
    """Text to ids: the parts between single spaces are looked up, new ones split by the pattern and encoded.

    A part that begins with a line end follows it directly; any other follows a space. Texts with other
    runs of white space are parted by an expression that keeps such runs as the pattern does.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, most: int = CACHE):
        super().__init__(most)
        self.v = vocabulary
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\s", f"[{_WS}]").replace(r"\S", f"[^{_WS}]"))

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.v.ranks.get(data)
        if whole is not None:  # as the library does: a piece that is a token is that token
            return [whole]
        return PrefixTable(self.v, data).ids()

    def chunk(self, chunk: str) -> bytes:
        ids = [i for p in self.pattern.findall(chunk) for i in self.piece(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def find(self, keys: list) -> list[bytes]:
        chunk = self.chunk
        return [chunk(k[0]) if isinstance(k, tuple) else chunk(k if k[0] == "\n" else " " + k) for k in keys]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(v) for v in self.values_of([parts_of(t) for t in texts])]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()


def parts_of(text: str | None) -> list:
    """Keys of the cache: strings as :class:`Encoder` tells, or exact chunks in tuples."""
    if not text:
        return []
    if _ODD.search(text) or text[0] in " \n" or text[-1] in " \n":
        return [(c,) for c in _CHUNK.findall(text)]
    parts = text.replace("\n", " \n").split(" ")
    return [(parts[0],), *parts[1:]]


def decode(vocabulary: Vocabulary, ids) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every row."""
    schema = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]

    def make():
        enc = encoder(path, pattern)
        return lambda ids, texts: batch_of(schema, {"doc_id": ids, "ids": [np.frombuffer(b, "<i4") for b in enc.packed(texts)]})

    return map_rows(docs, [id_column, text], make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary`` of rows from :func:`encode_documents`; null ids are none."""
    schema = [("doc_id", pa.int64()), ("data", pa.binary())]

    def make():
        v = encoder(path, pattern).v
        return lambda ids, rows: batch_of(schema, {"doc_id": ids, "data": [decode(v, r or []) for r in rows]})

    return map_rows(encoded, ["doc_id", "ids"], make, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes that the ids decode to, of every row."""
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def make():
        enc = encoder(path, pattern)

        def step(ids, texts):
            packed = enc.packed(texts)
            back = [decode(enc.v, np.frombuffer(b, "<u4").tolist()) for b in packed]
            return batch_of(schema, {
                "doc_id": ids,
                "n_tokens": [len(b) // 4 for b in packed],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in packed],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            })

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: encode every document, decode the ids, and give both digests."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
