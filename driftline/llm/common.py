"""What the training-data operators share: tables, batches of texts, words and hashes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.plans.storage import materialize

#: Rows in an Arrow batch: few, as one text may be very long.
BATCH_ROWS = 1000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Run a Python function over batches of ``columns``, of ``rows`` rows at most.

    ``make()`` is called once in each task and gives a function from lists (one for each column)
    to a dict of column values; it may build state that is bounded in size. The engine bounds its batches
    by bytes; they are cut further here, so no setting of the session is touched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in cut(batches, rows):
            out = step(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            if out is not None:
                yield from (out if isinstance(out, list) else [out])
        end = getattr(step, "end", None)
        if end is not None and (out := end()) is not None:
            yield out

    return df.select(*columns).mapInArrow(run, schema)


def cut(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most and one at least."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z in lower case (bytes know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Generations(dict):
    """A cache bounded in entries: when full, what wasn't asked for lately goes.

    Subclasses define ``find(keys)``, the values of keys that aren't known yet; None is no value.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def values_of(self, lists: list[list]) -> list[list]:
        """The values of the keys in each list."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        get = self.get
        found = [list(map(get, keys)) for keys in lists]
        gaps = [(k, [i for i, v in enumerate(vs) if v is None]) for k, vs in enumerate(found) if None in vs]
        if gaps:
            todo = {lists[k][i] for k, at in gaps for i in at}
            if self.old:
                old = self.old
                known = {key: old[key] for key in todo if key in old}
                self.update(known)
                todo.difference_update(known)
            if todo:
                new = list(todo)
                self.update(zip(new, self.find(new)))
            for k, at in gaps:
                keys, vs = lists[k], found[k]
                for i in at:
                    vs[i] = self[keys[i]]
        return found

    def find(self, keys: list) -> list:
        raise NotImplementedError


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise: a bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, from the words' hashes, in order of position."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mixed(out + _GOLD) ^ hashes[k : n + k]
    return mixed(out + _GOLD)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width`` (but some), the whole sequence as one."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashes, min(width, len(hashes))))


#: Marks in the filter of :func:`only_needed`, at most.
MARKS = 1 << 20


def only_needed(rows: DataFrame, ids: DataFrame, id_column: str = "doc_id", absent: bool = False) -> DataFrame:
    """Rows whose id may be in the one column of ``ids``, found before any shuffle of the rows; the
    others, if ``absent``.

    What is broadcast are the ids' hashes modulo MARKS, so never more than MARKS integers; rows that
    pass by chance (all, if there are very many ids) are left to the join that follows.
    """
    mark = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(MARKS)).cast("int")
    marks = ids.toDF("_id").select(mark("_id").alias("_mark")).distinct()
    return rows.withColumn("_mark", mark(id_column)).join(F.broadcast(marks), "_mark", "left_anti" if absent else "left_semi").drop("_mark")


#: Rows of one key from which :func:`spread_join` splits it, and into how many parts.
HOT, PARTS = 1000, 32


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows.join(few, key, how)`` for a ``few`` with one row a key, where a key may hold any share of ``rows``.

    Keys of over HOT rows are dealt to PARTS parts by a hash of the column ``by``; their rows in ``few`` are repeated
    for each part. What is broadcast are the hot keys' hashes modulo MARKS, so never more than MARKS integers;
    keys that share a mark with a hot one are dealt alike on both sides. ``counts(key, n)`` has the rows of each key;
    without it ``rows`` is read twice. The hot keys are found at once; without any this is a plain join.
    """
    mark = F.pmod(F.xxhash64(F.col(key)), F.lit(MARKS)).cast("int")
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    often = counts.where((F.col("n") > HOT) & F.col(key).isNotNull())
    often = materialize(often.select(mark.alias("_mark")).distinct().withColumn("_hot", F.lit(True)), "hot")
    if often.isEmpty():
        return rows.join(few, key, how)
    often = F.broadcast(often)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(by)), F.lit(PARTS))).otherwise(0).cast("int")
    left = rows.withColumn("_mark", mark).join(often, "_mark", "left").withColumn("_part", part).drop("_mark", "_hot")
    every = F.sequence(F.lit(0), F.when(F.col("_hot"), PARTS - 1).otherwise(0))
    right = few.withColumn("_mark", mark).join(often, "_mark", "left").withColumn("_part", F.explode(every)).drop("_mark", "_hot")
    return left.join(right, [key, "_part"], how).drop("_part")


def quiet_threads() -> None:
    """One thread for each Python worker: Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def batch_of(schema: list[tuple[str, pa.DataType]], values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[n], t) for n, t in schema], names=[n for n, _ in schema])
