"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a set of word shingles, a signature of 480 min-hashes (one byte of each is kept for
   comparison) and 40 band keys of 6 of them each. At a similarity of 0.8 a pair misses all bands
   with probability (1 - 0.8^6)^40 = 6e-6.
2. Texts of equal sets are one class, represented by its smallest id; only representatives go on.
3. In every bucket (band, key) the smallest member leads. Pairs (leader, member) are linear in the
   bucket. They are compared by batches of the signature; after each batch a pair goes if the posterior
   probability that its similarity reaches the threshold is below ``MISS``. Survivors are compared
   exactly, on the full sets. Links are joined to components.
4. Buckets whose members are all in one component are done: whatever pairs are left in them cannot
   change the components. The members of the others are compared across components, in groups of buckets that
   share members: dealt to blocks of bounded size, pairs are made, pruned and compared exactly within
   one task, which keeps count of components and gives only links that join two of them. So no such link is
   lost, and the links that leave the tasks are fewer than the members.
5. Components of both kinds of links are the result.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and
is its own component; with fewer words than the width, the whole sequence is one shingle; texts are read
whole; repeated rows are in one class; an empty table gives an empty result. Rows without an id are linked with
nothing and have no component; of different texts under one id any one may stand for all in the comparison
of signatures. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import as_signed, batch_of, map_rows, mixed, only_needed, shingle_set, spread_join, table, word_hashes, words_of
from driftline.operators.components import connected_components
from driftline.plans.storage import drop_path, materialize

BANDS, ROWS = 40, 6
#: Min-hashes; the bands use the first ones, all of them are compared.
HASHES = 480
#: Hashes that are compared before the next decision.
BATCH = 48
#: Posterior probability of reaching the threshold below which a pair is dropped.
MISS = 1e-6
#: Members and bytes of a block, on the average, in the comparison across components.
BLOCK, BLOCK_BYTES = 2048, 16_000_000
#: Members up to which a group of buckets that share members is worked on as a whole; a larger one bucket by bucket.
GROUP = 16_384
#: Pairs whose signatures are compared together.
PAIRS = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240501))
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash over the set (not empty)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):  # in blocks that stay in the processor's cache
        np.minimum(out, (x[at : at + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, (texts, BANDS); equal only for one band."""
    s = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(ROWS):
        h = mixed(h ^ s[:, :, r]) + np.uint64(0x9E3779B97F4A7C15)
    return mixed(h)


@lru_cache(8)
def least_matches(threshold: float, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared bytes, a pair with fewer than m equal ones is dropped.

    Prior: every similarity alike. A byte is equal with probability s + (1 - s) / 256.
    """
    s = np.linspace(0, 1, 2001)
    p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    high = s >= threshold - 1e-9
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        while m <= n:
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[high].sum() / w.sum() >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray, threshold: float, at: np.ndarray | None = None, to: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of rows a[at], b[to] of two byte matrices (texts, HASHES) outlast all batches; by default row by row."""
    at = np.arange(len(a)) if at is None else at
    to = np.arange(len(b)) if to is None else to
    alive = np.arange(len(at))
    equal = np.zeros(len(at), np.int32)
    before = 0
    for n, m in least_matches(threshold):
        x, y = np.ascontiguousarray(a[:, before:n]), np.ascontiguousarray(b[:, before:n])
        equal[alive] += np.count_nonzero(x[at[alive]] == y[to[alive]], axis=1).astype(np.int32)
        alive = alive[equal[alive] >= m]
        before = n
    return alive


_SIG = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig, bands``; the last three are null for an empty set."""

    def make():
        def step(ids, texts):
            sets = [shingle_set(word_hashes(words_of(t)), width) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = np.stack([signature(sets[i]) for i in full]) if full else np.empty((0, HASHES), np.uint32)
            keys, low = as_signed(band_keys(sigs)).tolist(), (sigs >> 8).astype(np.uint8)
            out = {"doc_id": ids, "n_shingles": [len(s) for s in sets]}
            out |= {k: [None] * len(ids) for k in ("set_key", "sig", "bands")}
            for k, i in enumerate(full):
                out["set_key"][i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                out["sig"][i], out["bands"][i] = low[k].tobytes(), keys[k]
            return batch_of(_SIG, out)

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HASHES)


_PAIR = [("a", pa.int64()), ("b", pa.int64())]


def _prune(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that outlast the comparison of their signatures."""
    both = spread_join(pairs, sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a", "b").join(
        sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b"
    )

    def make():
        def step(a, b, x, y):
            keep = survive(_bytes(x), _bytes(y), threshold).tolist()
            return batch_of(_PAIR, {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}) if keep else None

        return step

    return map_rows(both, ["a", "b", "x", "y"], make, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs whose full sets have den * intersection >= num * union."""
    texts = only_needed(docs.select("doc_id", "text"), pairs.select("a").union(pairs.select("b")))
    both = spread_join(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a", "b").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b"
    )

    def make():
        def step(a, b, x, y):
            sets: dict[int, np.ndarray] = {}

            def of(i, text):
                if i not in sets:
                    sets[i] = shingle_set(word_hashes(words_of(text)), width)
                return sets[i]

            keep = []
            for k in range(len(a)):
                p, q = of(a[k], x[k]), of(b[k], y[k])
                common = len(np.intersect1d(p, q, assume_unique=True))
                if den * common >= num * (len(p) + len(q) - common):
                    keep.append(k)
            return batch_of(_PAIR, {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}) if keep else None

        return step

    return map_rows(both, ["a", "b", "x", "y"], make, "a long, b long")


class Joined:
    """Components of some nodes, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.names, self.of = np.unique(labels, return_inverse=True)

    def join(self, i: int, j: int) -> bool:
        """Whether the nodes were apart until now."""
        a, b = self.of[i], self.of[j]
        if a != b:
            self.of[self.of == b] = a
        return bool(a != b)


def common_counts(ps: list[np.ndarray], qs: list[np.ndarray], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ps[at] and qs[to], sets as sorted arrays.

    Pairs that are many for their sets are counted as a product of 0/1 matrices over the values that both sides
    have (exact: no count reaches 2^24), few ones pair by pair.
    """
    rows, row = np.unique(at, return_inverse=True)
    cols, col = np.unique(to, return_inverse=True)
    lengths = [np.array([len(s[i]) for i in own]) for s, own in ((ps, rows), (qs, cols))]
    single = int(lengths[0][row].sum() + lengths[1][col].sum())
    whole = [np.concatenate([s[i] for i in own]) for s, own in ((ps, rows), (qs, cols))]
    if single < 4 * sum(map(len, whole)):
        return np.array([len(np.intersect1d(ps[i], qs[j], assume_unique=True)) for i, j in zip(at.tolist(), to.tolist())], np.int64)
    shared = np.intersect1d(*whole)
    if single * 20 < len(rows) * len(cols) * len(shared) / 16:
        return np.array([len(np.intersect1d(ps[i], qs[j], assume_unique=True)) for i, j in zip(at.tolist(), to.tolist())], np.int64)
    counts = np.zeros((len(rows), len(cols)), np.float32)
    places = []
    for flat, n in zip(whole, lengths):
        k = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        hit = shared[k] == flat if len(shared) else np.zeros(len(flat), bool)
        places.append((np.repeat(np.arange(len(n)), n)[hit], k[hit]))
    for low in range(0, len(shared), 4096):
        sides = []
        for (owner, k), n in zip(places, lengths):
            here = (k >= low) & (k < low + 4096)
            m = np.zeros((len(n), min(4096, len(shared) - low)), np.float32)
            m[owner[here], k[here] - low] = 1
            sides.append(m)
        counts += sides[0] @ sides[1].T
    return counts[row, col].astype(np.int64)


def _links_of(ps: list, qs: list | None, bucket: int | None, threshold: float, num: int, den: int) -> list[tuple[int, int]]:
    """Verified links between members of two blocks (or of one, if ``qs`` is None) that join components; at most
    one fewer than there are members. A member has ``doc_id, comp, sig, bands, shingles``."""
    same = qs is None
    qs = ps if same else qs
    ids = [[m["doc_id"] for m in s] for s in (ps, qs)]
    sigs = [_bytes(m["sig"] for m in s) for s in (ps, qs)]
    sets = [[np.frombuffer(m["shingles"], np.uint64) for m in s] for s in (ps, qs)]
    sizes = [np.array([len(x) for x in s]) for s in sets]
    bands = [np.array([m["bands"] for m in s]) for s in (ps, qs)] if bucket is not None else None
    n = len(ps)
    parts = Joined(np.array([m["comp"] for m in (ps if same else ps + qs)]))
    off = 0 if same else n
    out = []
    step = max(1, PAIRS // max(len(qs), 1))
    for first in range(0, n, step):
        own = np.arange(first, min(first + step, n))
        apart = parts.of[own][:, None] != parts.of[off : off + len(qs)][None, :]
        if same:
            apart &= own[:, None] < np.arange(n)[None, :]
        small, large = np.minimum.outer(sizes[0][own], sizes[1]), np.maximum.outer(sizes[0][own], sizes[1])
        at, to = np.nonzero(apart & (den * small >= num * large))
        at += first
        alive = survive(sigs[0], sigs[1], threshold, at, to)
        at, to = at[alive], to[alive]
        if bands is not None and len(at):  # a pair counts in the bucket of its first common band
            x, y = bands[0][at], bands[1][to]
            k = (x == y).argmax(axis=1)
            keep = (x[np.arange(len(x)), k] == bucket) & (y[np.arange(len(y)), k] == bucket)
            at, to = at[keep], to[keep]
        for low in range(0, len(at), 1 << 15):
            u, v = at[low : low + (1 << 15)], to[low : low + (1 << 15)]
            still = parts.of[u] != parts.of[off + v]
            u, v = u[still], v[still]
            if not len(u):
                continue
            common = common_counts(sets[0], sets[1], u, v)
            hit = den * common >= num * (sizes[0][u] + sizes[1][v] - common)
            for i, j in zip(u[hit].tolist(), v[hit].tolist()):
                if parts.join(i, off + j):
                    out.append((ids[0][i], ids[1][j]))
    return out


def _across(members: DataFrame, threshold: float, num: int, den: int) -> DataFrame:
    """``a, b``: links that join components within units, of ``unit, bucket, doc_id, comp, sig, bands, shingles``.

    A unit's members are dealt to blocks of bounded size by a hash, and each block meets each block of its unit once.
    Pairs are made, pruned and compared exactly within that one task, and only links that join two of its
    components leave it, so the rows grow with the members. ``bucket`` is null for a whole group.
    """
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("shingles") + 1000) / BLOCK_BYTES))
    sizes = members.groupBy("unit").agg(size.cast("int").alias("blocks"))
    dealt = spread_join(members, sizes, "unit", "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("unit", "bucket", "blocks", "block").agg(F.collect_list(F.struct("doc_id", "comp", "sig", "bands", "shingles")).alias("p"))
    blocks = materialize(blocks, "blocks")
    drop_path(members.sparkSession, members)
    left = blocks.select("unit", "bucket", "block", "p", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("to"))
    right = blocks.select("unit", F.col("block").alias("to"), F.col("p").alias("q"))
    alone, two = left.where("block = to"), left.where("block < to").join(right, ["unit", "to"])
    both = alone.select("bucket", "p", F.lit(None).cast(right.schema["q"].dataType).alias("q")).union(two.select("bucket", "p", "q"))

    def make():
        def step(bucket, p, q):
            found = [x for k, ps, qs in zip(bucket, p, q) for x in _links_of(ps, qs, k, threshold, num, den)]
            return batch_of(_PAIR, dict(zip("ab", zip(*found)))) if found else None

        return step

    return map_rows(both, ["bucket", "p", "q"], make, "a long, b long", rows=1)


def _with_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: the full sets, as sorted 64-bit integers, of the documents in ``ids(doc_id)``."""
    schema = [("doc_id", pa.int64()), ("shingles", pa.binary())]

    def make():
        def step(own, texts):
            return batch_of(schema, {"doc_id": own, "shingles": [shingle_set(word_hashes(words_of(t)), width).tobytes() for t in texts]})

        return step

    texts = only_needed(docs.select("doc_id", "text"), ids).join(ids, "doc_id", "left_semi")
    return map_rows(texts, ["doc_id", "text"], make, "doc_id long, shingles binary")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    Texts are linked if den * intersection >= num * union of their sets of ``width``-word shingles;
    ``component_id`` is the smallest id that links reach.
    """
    threshold = num / den
    sigs = materialize(signatures(docs.select("doc_id", "text"), width), "signatures")
    classes = sigs.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    chosen = sigs.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    reps = materialize(chosen.select("doc_id", "sig", "bands").dropDuplicates(["doc_id"]), "representatives")
    members = reps.select("doc_id", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    shared = materialize(members.join(leaders, "key"), "buckets")  # only members of buckets of two and more
    pairs = materialize(shared.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    likely = materialize(_prune(pairs, reps, threshold), "likely")
    drop_path(docs.sparkSession, pairs)
    links = materialize(verify(likely, docs, width, num, den), "links")
    comps = materialize(connected_components(links, src="a", dst="b"), "components")

    placed = shared.join(comps.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select(
        "key", "doc_id", "lead", F.coalesce("label", "doc_id").alias("comp")
    )
    mixed_keys = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key")
    rest = materialize(placed.join(mixed_keys, "key", "left_semi"), "open")
    drop_path(docs.sparkSession, shared)
    if not rest.isEmpty():
        units = _units(rest, reps, docs, width)
        drop_path(docs.sparkSession, reps)
        more = materialize(_across(units, threshold, num, den), "links")
        comps = materialize(connected_components(links.union(more), src="a", dst="b"), "components")

    final = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "n", "rep", F.coalesce("label", "rep").alias("component"))
    changed = final.where("n > 1 OR component <> rep")  # any other class is one document that is linked with nothing
    out = spread_join(sigs.select("doc_id", "n_shingles", "set_key"), changed.select("set_key", "component"), "set_key", "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _units(rest: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Members of open buckets ``rest(key, doc_id, lead, comp)`` in the units in which they are compared: groups of
    buckets that share members, or single buckets where a group has over GROUP members."""
    grouped = connected_components(rest.where("doc_id <> lead"), src="lead", dst="doc_id").select(F.col("node").alias("doc_id"), F.col("label").alias("unit"))
    grouped = materialize(grouped, "groups")
    large = grouped.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("unit", F.lit(True).alias("large"))
    member = rest.join(spread_join(grouped, large, "unit", "doc_id", "left"), "doc_id")
    bucket = F.when(F.col("large"), F.col("key"))
    member = member.select("doc_id", "comp", F.coalesce(F.concat(F.lit("bucket "), bucket), F.concat(F.lit("group "), "unit")).alias("unit"), bucket.alias("bucket")).distinct()
    ids = rest.select("doc_id").distinct()
    return materialize(member.join(reps.select("doc_id", "sig", "bands"), "doc_id").join(_with_sets(ids, docs, width), "doc_id"), "units")


def deduplicate(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group: the one with the smallest id, with all columns of ``docs``. Rows without
    an id can't be told apart by it: they are all kept."""
    named = docs.where("doc_id IS NOT NULL")
    kept = near_duplicates(named, width, num, den).where("kept").select("doc_id")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))


def expected_miss(similarity: float) -> float:
    """Probability that a pair shares no band."""
    return math.pow(1 - math.pow(similarity, ROWS), BANDS)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of all documents by 2-word shingles, at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2)
