"""Periodic runs: stretches of words that repeat with a period, found word by word on sparse diagonals.

Word i lies on diagonal (lag) q where word i - q is the same; consecutive matches on a diagonal make a stretch that
repeats with period q. A text is read once. Earlier occurrences of a word open diagonals, each further match makes an
open diagonal longer, and one that ends is a run at once if it is long enough.

A run of period q, with 2^k <= q < 2^(k+1), matches at 2 q consecutive words at least, so one of them has a number
divisible by 2^(k+1). Diagonals are therefore opened only there, with the matches before counted back: of all earlier
occurrences of a word, about n log n in a text are looked at instead of a number that grows with its square.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_of(words: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch with smallest period q and at least max(least, exponent * q) words that neither neighbour
    extends with that period; exponent must be 3 or more.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    n = len(words)
    far = n // exponent
    # Diagonal 1 needs so many matches itself; further ones need 4 at least.
    step = 4 if max(least, exponent) > 4 else 2
    places: dict = defaultdict(list)
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}

    def end(lag: int, i: int) -> None:
        first = active.pop(lag)
        length = i - first + lag
        if length >= max(least, exponent * lag):
            at = (first - lag, length)
            found[at] = min(lag, found.get(at, lag))

    for i, word in enumerate(words):
        if active:
            for lag in [q for q in active if words[i - q] != word]:
                end(lag, i)
        before = places[word]
        if not i % step:
            reach = min(far, (i & -i) - 1)
            # Two periods q < lag of one stretch of q + lag words at least have a common divisor as period of both: where
            # q matches lag words back, lag only repeats it, and its run is found there. Few diagonals match q words.
            whole = [(q, i - s + 1) for q, s in active.items() if i - s + 1 > q]
            for j in reversed(before):
                lag = i - j
                if lag > reach:
                    break
                if lag in active:
                    continue
                # Counting back stops where a shorter period is known to cover the stretch.
                stop = min((q for q, m in whole if q < lag <= m), default=n)
                first = i
                while first > lag and i - first + 1 < stop and words[first - 1] == words[first - 1 - lag]:
                    first -= 1
                if i - first + 1 < stop:
                    active[lag] = first
                    if i - first + 1 > lag:
                        whole.append((lag, i - first + 1))
            if whole and len(active) > 1:
                for lag in [q for q, s in active.items() if any(p < q <= m and i - s + 1 >= p for p, m in whole)]:
                    del active[lag]
        before.append(i)
    for lag in list(active):
        end(lag, n)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are left when each run keeps its first period only; a word in several runs goes if any drops it."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g] if runs else words


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its words without the repeats.

    Words are parted by blanks, tabs and line ends; collapsed joins those left by one space. A null or empty text has
    no words, no runs and an empty collapsed text; null ids and repeated rows are rows like others. Of overlapping
    runs each is listed. A text is one row of one task, whatever its length; other columns are not read.
    """

    def find(batches):
        for batch in batches:
            sizes, runs, kept = [], [], []
            for t in batch.column(1).to_pylist():
                # bytes.split() parts at blank, tab, line feed, vertical tab, form feed and carriage return.
                words = (t or b"").split()
                own = runs_of(words, exponent, least)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(b" ".join(collapsed(words, own)))
            left = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), left], ["id", "n_words", "runs", "collapsed"])

    rows = bounded(docs).select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(find, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id)


def looped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Plants repetition: with h = crc32(id) and g = h div 10, the words of texts with h % 10 = 0 repeat from word a = g % n on.

    Word i >= a becomes word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8); words are then joined by one space.
    Rows with a null id, without words, or with another h stay as they are.
    """
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    out = docs.select(F.col(id), F.col(text), words.alias("words"), F.floor(h / 10).cast("long").alias("g"))
    out = out.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return out.select(F.col(id), F.when(F.col("a").isNotNull(), planted).otherwise(F.col(text)).alias(text))


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row a text: number of runs, its longest run (ties: smallest start, then period), digests of runs and collapsed text."""
    first: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("first", first).select(
        F.col(id), F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.period")).alias("period"),
        F.expr("1000 * first.length div -first.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
