"""Quality by importance resampling: ratio of hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dirlog.llm.base import bounded, sized, stored

#: Buckets of the hashed n-grams, labelled rows learned from at most, words whose codes a worker keeps.
BUCKETS, LABELLED, CACHE = 1 << 15, 20_000, 200_000
#: Tasks that add up the tasks' counts.
PARTS = 32
#: Of ten labelled rows so many set the threshold and take no part in the target model.
HELD_OUT = 2

RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)")


def shape(word: str) -> str:
    """Letters and digits as runs, other characters as they are."""
    return RUNS.sub(lambda m: "A" if m[1] else "a" if m[2] else "0", word)


def code(word: str) -> int:
    """Hash of the word in the upper half, of its shape in the lower."""
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram, of one array for each of its places."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of a text's word 1- and 2-grams and shape 1- to 3-grams (a repeated word has a shape of its own)."""
    if not len(codes):
        return np.zeros(0, np.int32)
    word, form = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    form[1:] += (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(33)
    n = [np.full(len(codes), i, np.uint64) for i in range(5)]
    return np.concatenate([mixed(n[0], word), mixed(n[1][1:], word[:-1], word[1:]), mixed(n[2], form), mixed(n[3][1:], form[:-1], form[1:]), mixed(n[4][2:], form[:-2], form[1:-1], form[2:])])


class Words:
    """Codes of words from a bounded cache."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def grams(self, texts: list[str]) -> list[np.ndarray]:
        found = [t.split() for t in texts]
        new = {w for words in found for w in words}.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = {w for words in found for w in words}
        self.known.update((w, code(w)) for w in new)
        get = self.known.__getitem__
        return [grams(np.fromiter(map(get, words), np.uint64, len(words))) for words in found]


def labelled(labels: DataFrame, id: str, quality: str, limit: int) -> dict[int, tuple[int, bool]]:
    """(quality, held out) of up to ``limit`` labelled ids, chosen by a hash; the lowest of several labels counts."""
    rows = labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(F.col(quality).cast("int")).alias("q"))
    order = F.xxhash64(F.lit(1), "id")
    return {r.id: (r.q, r.h < HELD_OUT) for r in rows.orderBy(order, "id").limit(limit).select("id", "q", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(10)).alias("h")).collect()}


def fit(docs: DataFrame, known: dict[int, tuple[int, bool]], id: str, text: str) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket; raw counts cover all documents, target those labelled good."""
    good = docs.sparkSession.sparkContext.broadcast({i for i, (q, held) in known.items() if q == 1 and not held})

    def count(batches):
        counts, words = np.zeros((2, BUCKETS), np.int64), Words()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for block in sized(texts):
                found = words.grams(texts[block])
                counts[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                if chosen := [g for i, g in zip(ids[block], found) if i in good.value]:
                    counts[1] += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    def add(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                counts += np.frombuffer(part, np.int64).reshape(counts.shape)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    # One row a task, added up by PARTS tasks and then by one, which reads no more than PARTS rows of half a MB.
    parts = docs.select(id, text).mapInArrow(count, "counts binary").repartition(PARTS).mapInArrow(add, "counts binary")
    total = parts.coalesce(1).mapInArrow(add, "counts binary").first()
    counts = np.frombuffer(total.counts, np.int64).reshape(2, BUCKETS).astype(np.float64) if total else np.zeros((2, BUCKETS))
    share = (counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(share[1] / share[0])


def scored(docs: DataFrame, ratio: np.ndarray, text: str, name: str) -> DataFrame:
    """Adds the log weight: sum of the log ratios of a text's n-grams; 0 for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        words = Words()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            out = [float(held.value[g].sum()) for block in sized(texts) for g in words.grams(texts[block])]
            yield batch.append_column(name, pa.array(out, pa.float64()))

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def threshold(scores: np.ndarray, quality: np.ndarray) -> float:
    """The score that best parts good from bad by balanced accuracy; -inf without both.

    Of the scores that do so equally well it is the nearest to 0, where target and raw text are as likely,
    but for a tenth of the gap between the neighbouring labels.
    """
    if not len(scores) or quality.min() == quality.max():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], quality[order] == 1
    right = np.concatenate(([0], np.cumsum(~good) / (~good).sum())) + 1 - np.concatenate(([0], np.cumsum(good) / good.sum()))
    lo, hi = np.concatenate(([s[0] - 1], s)), np.concatenate((s, [s[-1] + 1]))
    best = (right >= right[hi > lo].max() - 1e-12) & (hi > lo)
    cuts = np.clip(0, lo + (hi - lo) / 10, hi - (hi - lo) / 10)[best]
    return float(cuts[np.abs(cuts).argmin()])


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by narrowing histograms: each pass is a partial count of 1024 bins."""
    x = F.col(column)
    lo, hi, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    if k >= n or lo is None:
        return -np.inf
    while lo < hi:
        inside = rows.where((x >= lo) & (x <= hi))
        step = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / 1024)), F.lit(1023))
        for r in inside.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy(F.desc("bin")).collect():
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return float(lo)


def gumbel_key(id: str, weight: str, seed: int) -> Column:
    """The weight plus Gumbel noise that depends on seed, id and weight only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id).cast("long"), weight), 11) + 0.5) / float(1 << 53)
    return F.col(weight) - F.log(-F.log(u))


def learn(docs: DataFrame, labels: DataFrame, k: int | None, seed: int, limit: int, id: str, text: str, quality: str) -> tuple[np.ndarray, float, DataFrame]:
    """(log ratios of the buckets, the k-th largest key, (id, log_weight) of every row)."""
    known = labelled(labels, id, quality, limit)
    rows = bounded(docs).select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ratio = fit(rows, known, "id", "text")
    scores = stored(scored(rows, ratio, "text", "log_weight").drop("text"))
    if k is None:
        held = [i for i, (_, h) in known.items() if h]
        ids = docs.sparkSession.createDataFrame(list(zip(held)), "id long")
        found = scores.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("log_weight").alias("s")).collect() if held else []
        cut = threshold(np.array([r.s for r in found]), np.array([known[r.id][0] for r in found]))
        k = scores.where(F.col("log_weight") >= cut).count()
    edge = kth_largest(scores.select(gumbel_key("id", "log_weight", seed).alias("key")), "key", k) if k else np.inf
    return ratio, edge, scores


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, limit: int = LABELLED, id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """(id, log_weight, gumbel_key, kept) of every row: the k rows with the largest log weight plus Gumbel noise are kept.

    Learned from at most ``limit`` labelled rows (quality 1: target); the raw model counts all documents.
    Without ``k`` it is the number of rows whose log weight reaches the threshold that best parts the held-out
    labels, so what is rejected is the share that the labels call bad. Without labels of both kinds all rows are kept.
    Null texts have weight 0. Rows that tie at the k-th key are all kept; noise depends on seed, id and weight only.
    """
    _, edge, scores = learn(docs, labels, k, seed, limit, id, text, quality)
    keyed = scores.withColumn("gumbel_key", gumbel_key("id", "log_weight", seed))
    return keyed.select(F.col("id").alias(id), "log_weight", "gumbel_key", (F.col("gumbel_key") >= edge).alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, limit: int = LABELLED, id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``importance_resample`` keeps, all columns as they are.

    Scores are worked out again where the rows lie, so no text is shuffled.
    """
    ratio, edge, _ = learn(docs, labels, k, seed, limit, id, text, quality)
    name = "log_weight"
    while name in docs.columns:
        name = f"_{name}"
    return scored(docs, ratio, text, name).where(gumbel_key(id, name, seed) >= edge).drop(name)
