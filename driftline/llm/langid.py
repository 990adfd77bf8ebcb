"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (n from 1 to 3, words padded by
one blank), most frequent first. A document's own list is compared to each profile: every n-gram of it
costs the distance between its two ranks, or the most there is if the profile lacks it. The language
with the least sum (out-of-place distance) is predicted.

Counting covers all learned documents: tasks count, counts are summed by a shuffle, and only the
profiles (languages x profile size) come to the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing
could be learned; documents with a null text or language aren't learned from; equal counts are ordered
by n-gram, equal distances by language; repeated rows count as often as they stand there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import batch_of, map_rows, table

#: n-grams in a language's profile and in a document's list.
PROFILE = 400
#: Distinct n-grams that a task may gather before it passes its counts on.
FLUSH = 500_000

#: What parts words: all but letters and the marks that combine with them.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (21 bits a character, in order) and their counts."""
    if not text or not _LETTER.search(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = _NOT_LETTERS.sub(" ", text.lower())
    c = np.frombuffer(f" {flat.strip()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    blank = c == 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    # no n-gram runs over a blank between words
    return np.unique(np.concatenate([c[~blank], two, three[~blank[1:-1]]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, ties by n-gram."""
    if len(grams) > most:  # all that can be among them, ties of the last one included
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:most]


class _Counter:
    """Sums counts by (language, n-gram) within a task, in bounded memory."""

    schema = [("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]

    def __init__(self):
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, texts, langs):
        by: dict[str, list] = {}
        for t, lang in zip(texts, langs):
            if t is not None and lang is not None:
                by.setdefault(lang, []).append(ngrams(t))
        for lang, found in by.items():
            if lang in self.sums:
                found.append(self.sums[lang])
            grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            self.sums[lang] = grams, np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)
        if sum(len(g) for g, _ in self.sums.values()) > FLUSH:
            return self.end()
        return None

    def end(self):
        sums, self.sums = self.sums, {}
        rows = [(lang, *x) for lang, (g, n) in sums.items() for x in zip(g.tolist(), n.tolist())]
        return batch_of(self.schema, dict(zip(("lang", "gram", "n"), zip(*rows)))) if rows else None


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages in ``docs(text, lang)``."""
    counted = map_rows(docs, ["text", "lang"], _Counter, "lang string, gram long, n long")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "k").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Predictor:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.tables = []
        for lang in self.langs:
            order = np.argsort(profiles[lang])
            self.tables.append((profiles[lang][order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 (at the greatest distance) to 1 (the profile itself)."""
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        places = np.arange(len(own))
        best = None
        for lang, (grams, ranks) in zip(self.langs, self.tables):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            apart = np.where(grams[at] == own, np.minimum(np.abs(ranks[at] - places), self.size), self.size)
            total = int(apart.sum())
            if best is None or total < best[0]:
                best = total, lang
        return best[1], 1.0 - best[0] / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], columns: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """``columns`` of ``docs`` (bigint), with ``lang_pred`` and ``score`` from ``text``."""
    columns = columns or ["doc_id"]
    schema = [(c, pa.int64()) for c in columns] + [("lang_pred", pa.string()), ("score", pa.float64())]

    def make():
        one = Predictor(profiles, size)

        def step(texts, *ids):
            found = [one(t) for t in texts]
            return batch_of(schema, dict(zip(columns, ids)) | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

        return step

    return map_rows(docs, ["text", *columns], make, ", ".join(f"{c} long" for c in columns) + ", lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learn from four of five documents, predict all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
