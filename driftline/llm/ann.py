"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of ``BOOKS`` full-dimensional codebooks, fitted one after
another to the residuals of a bounded sample. Encoding is a beam search over the books. Of each vector the
index holds the codes, the squared norm of the sum, and the factor that projects the vector on it.
The words of the first book part the vectors into cells. A search makes a lookup table of inner products of the query
with all words once, scores the codes of the cells nearest to the query (and to its neighbours in a batch) by
adding table entries, and ranks the best candidates again with the original vectors in double precision. How many
cells are probed follows from the sample: as many as hold PROBED of the true neighbours of its own vectors, so
all of them where vectors have no clusters.

Equal vectors are one class, so copies cost one entry: a class is searched by its smallest id and put
in place of it afterwards, of which only the k + 1 smallest ids can matter. Queries and codes meet in
blocks of bounded size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do vectors of another width than most; equal scores go to the smaller id; with fewer vectors than
k all are returned; an empty table gives an empty result; repeated rows are one, rows without an id none;
one id with several vectors stands for each of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import batch_of, cut, table
from driftline.plans.storage import materialize

BOOKS, WORDS, BEAM = 24, 256, 4
#: Vectors that the codebooks are fitted to, at most.
SAMPLE = 10_000
#: Candidates of a query that are ranked again: so many up to MANY vectors, then in proportion to the root of their number.
DEPTH, MANY = 300, 50_000
#: Share of the sample's true neighbours that the probed cells must hold, and the vectors of the sample that ask.
PROBED, ASKING = 0.995, 500
#: Queries that share a lookup table.
BATCH = 64
#: Vectors and queries in a block.
CODE_BLOCK, QUERY_BLOCK = 65_536, 2_048


@dataclass
class Codebooks:
    words: np.ndarray  # (BOOKS, WORDS, d)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each row, (n, BOOKS), by beam search over the residuals."""
        out = [self._encode(x[i : i + 2048], beam) for i in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.empty((0, len(self.words)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        rest, codes = x[:, None, :], np.empty((n, 1, 0), np.uint8)
        for book in self.words:
            k, b = len(book), rest.shape[1]
            cost = np.einsum("ij,ij->i", book, book) - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, b, k)
            cost += np.einsum("nbd,nbd->nb", rest, rest)[:, :, None]
            flat = cost.reshape(n, b * k)
            keep = min(beam, b * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            if keep > 1:
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1), 1)
            row, word = best // k, best % k
            rest = np.take_along_axis(rest, row[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0, :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.words))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks from residual k-means, one book after another."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    out = []
    for _ in range(books):
        k = min(words, len(rest))
        book = rest[rng.choice(len(rest), k, replace=False)]
        for _ in range(rounds):
            near = np.argmin(np.einsum("ij,ij->i", book, book) - 2 * rest @ book.T, axis=1)
            count = np.bincount(near, minlength=k)
            by = np.argsort(near, kind="stable")
            full = np.flatnonzero(count)
            sums = np.add.reduceat(rest[by], (np.cumsum(count) - count)[full], axis=0)
            book[full] = sums / count[full, None]
            empty = np.flatnonzero(count == 0)
            if len(empty):
                book[empty] = rest[rng.choice(len(rest), len(empty))]
        near = np.argmin(np.einsum("ij,ij->i", book, book) - 2 * rest @ book.T, axis=1)
        rest -= book[near]
        out.append(book)
    return Codebooks(np.stack(out))


def cell_order(books: Codebooks, queries: np.ndarray) -> np.ndarray:
    """Cells of each query, nearest first."""
    return np.argsort(-(queries @ books.words[0].T), axis=1, kind="stable")


def probes_of(books: Codebooks, sample: np.ndarray, k: int = 20) -> int:
    """The least number of cells that hold PROBED of the k nearest in the sample of vectors spread over it."""
    cells = books.encode(sample)[:, 0]
    asking = np.unique(np.linspace(0, len(sample) - 1, min(ASKING, len(sample))).astype(np.int64))
    ranks = np.argsort(cell_order(books, sample[asking]), axis=1)
    score = sample[asking] @ sample.T
    score[np.arange(len(asking)), asking] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(books.words[0])
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rank = np.sort(np.take_along_axis(ranks, cells[near].astype(np.int64), 1).ravel())
    return int(rank[math.ceil(PROBED * len(rank)) - 1]) + 1


def depth_of(n: int) -> int:
    """Candidates of a query among ``n`` vectors: as their number grows, more of them lie as near as the codes can tell."""
    return math.ceil(DEPTH * math.sqrt(max(1.0, n / MANY)))


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v array<double>`` of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select("vec_id", v.alias("v")).where((F.size("v") > 0) & F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    width = kept.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return kept.where(F.size("v") == (width["w"] if width else 0))


_INDEX = [("rep", pa.int64()), ("codes", pa.binary()), ("norm", pa.float32()), ("factor", pa.float32())]


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A column of lists of one width as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def build_index(classes: DataFrame, books: Codebooks) -> DataFrame:
    """``rep, codes, norm, factor`` of every row of ``classes(rep, v)``."""

    def run(batches):
        for batch in cut(batches, 4096):
            x = matrix(batch.column(1), np.float32)
            codes = books.encode(x)
            y = books.decode(codes)
            norm = np.einsum("ij,ij->i", y, y)
            factor = np.einsum("ij,ij->i", x, y) / np.maximum(norm, 1e-30)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32()), pa.array(factor, pa.float32())], names=[n for n, _ in _INDEX]
            )

    return classes.select("rep", "v").mapInArrow(run, "rep long, codes binary, norm float, factor float")


def _scored(books: Codebooks, queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, factor: np.ndarray, depth: int, metric: str, probes: int | None = None):
    """(query, candidates, scores) of each query by lookup tables, ``depth`` candidates at most; a greater score is nearer."""
    cells = cell_order(books, queries)[:, : probes or len(books.words[0])]
    by_cell = np.argsort(codes[:, 0], kind="stable")
    ends = np.searchsorted(codes[by_cell, 0], np.arange(len(books.words[0]) + 1))
    asked = np.argsort(cells[:, 0], kind="stable")  # queries of one cell share most of theirs
    for at in range(0, len(queries), BATCH):
        some = asked[at : at + BATCH]
        own = np.concatenate([by_cell[ends[c] : ends[c + 1]] for c in np.unique(cells[some]).tolist()])
        if not len(own):
            continue
        lut = np.ascontiguousarray(np.einsum("mkd,qd->mkq", books.words, queries[some], optimize=True))
        here = codes[own]
        score = lut[0][here[:, 0]]
        for m in range(1, len(lut)):
            score += lut[m][here[:, m]]
        if metric == "ip":
            score *= factor[own, None]
        else:
            score = 2 * score - norm[own, None]
        score = np.ascontiguousarray(score.T)
        most = min(depth, len(own))
        best = np.argpartition(score, len(own) - most, axis=1)[:, len(own) - most :]
        yield from zip(some.tolist(), own[best], np.take_along_axis(score, best, 1))


_CAND = [("query_id", pa.int64()), ("rep", pa.int64()), ("about", pa.float32())]


def candidates(queries: DataFrame, index: DataFrame, books: Codebooks, depth: int = DEPTH, metric: str = "ip", probes: int | None = None) -> DataFrame:
    """``query_id, rep`` of the ``depth`` best codes of every query, in ``queries(query_id, v)``."""

    def blocked(df: DataFrame, key: str, size: int, name: str, split: int = 1) -> DataFrame:
        blocks = max(1, -(-df.count() // size))
        rows = df.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias(f"{name}_block")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        if split > 1:
            parts = F.transform(F.sequence(F.lit(0), F.lit(split - 1)), lambda i: F.filter(name, lambda x, k: k % split == i))
            rows = rows.withColumn(name, F.explode(parts)).where(F.size(name) > 0)
        return rows.repartition(blocks * split)  # a task for each pair of parts, however many partitions the shuffle had

    q, c = blocked(queries, "query_id", QUERY_BLOCK, "q", 8), blocked(index, "rep", CODE_BLOCK, "c")
    met = q.crossJoin(c)  # every query against every vector, block by block

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qs, cs = batch.column(0)[i].values, batch.column(1)[i].values
                x = matrix(qs.field("v"), np.float32)
                codes = np.frombuffer(b"".join(cs.field("codes").to_pylist()), np.uint8).reshape(len(cs), -1)
                norm, factor = (cs.field(k).to_numpy(zero_copy_only=False) for k in ("norm", "factor"))
                ids, reps = qs.field("query_id").to_numpy(), cs.field("rep").to_numpy()
                found = list(_scored(books, x, codes, norm, factor, depth, metric, probes))
                if found:
                    own = np.repeat(ids[[k for k, _, _ in found]], [len(b) for _, b, _ in found])
                    yield batch_of(_CAND, {"query_id": own, "rep": reps[np.concatenate([b for _, b, _ in found])], "about": np.concatenate([s for _, _, s in found]).astype(np.float32)})

    found = met.select("q", "c").mapInArrow(run, "query_id long, rep long, about float")
    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "rep")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= depth).select("query_id", "rep")


_NEAR = [("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())]


def rerank(cands: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """``query_id, rep, score``: the inner product of the original vectors, summed in order in double precision."""
    both = cands.join(classes, "rep").join(queries.withColumnRenamed("v", "w"), "query_id")

    def run(batches):
        for batch in cut(batches, 8192):
            x, y = matrix(batch.column(2)), matrix(batch.column(3))
            score = np.zeros(len(x))
            for j in range(x.shape[1]):
                score += x[:, j] * y[:, j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=[n for n, _ in _NEAR])

    return both.select("query_id", "rep", "v", "w").mapInArrow(run, "query_id long, rep long, score double")


def search(rows: DataFrame, is_query, k: int = 20, depth: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of ``rows(vec_id, embedding)`` by inner product to
    each row for which the condition ``is_query`` holds, itself left out."""
    spark = rows.sparkSession
    vectors = materialize(usable(rows).where("vec_id IS NOT NULL").distinct(), "vectors")
    classes = materialize(vectors.groupBy("v").agg(F.min("vec_id").alias("rep")).select("rep", "v"), "classes")
    schema = "query_id long, rank int, vec_id long, score double"
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    # hashes are even, so this is about `sample` rows; the limit makes it a bound
    part = classes.where(F.pmod(F.xxhash64("rep"), F.lit(max(n, 1))) < sample).select("v").limit(sample)
    vecs = [np.asarray(r["v"], np.float32) for r in part.toLocalIterator()] or [np.asarray(classes.first()["v"], np.float32)]
    books = fit(np.stack(vecs))
    probes = probes_of(books, np.stack(vecs), k)
    index = materialize(build_index(classes, books), "index")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    exact = materialize(rerank(candidates(queries, index, books, depth or depth_of(n), probes=probes), queries, classes), "nearest")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    near = exact.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query_id", "rep", "score")
    # of a class of copies only the k + 1 smallest ids can be among the nearest (one may be the query)
    copies = vectors.join(classes.select("rep", "v"), "v").select("rep", "vec_id")
    few = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("rep", "vec_id")
    final = near.join(few, "rep").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
