"""Quality rules by robust outliers: minimum-covariance-determinant estimates per language and source, all in columns.

Statistics of each text become four rates: the logarithm of the mean word length, and the square roots of the shares of
symbols, repeated lines and words in repeated windows, as whole numbers of 1/1024, so that sums over them are exact in any
order. For each language and source the estimate starts from medians and median deviations and is concentrated: rows are
counted by bands of their Mahalanobis distance, and mean and covariance of the nearest three quarters are the next estimate
(each such step lowers the determinant). Last, rows within the 97.5 % distance are weighed once more. A text beyond the
distance that one clean text in a million would reach is rejected. A step is one partial aggregation whose result has a few
hundred bands a group, however many rows a group has.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlog.llm.base import stored

#: Blanks, tab, line feed, vertical tab, form feed and carriage return part words.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window, levels of a rate, bands of distance in each factor of e, rows that an estimate asks for, steps.
WINDOW, UNIT, BANDS, LEAST_ROWS, STEPS = 8, 1024, 32, 100, 5
#: Rates, and the deviation of each below which differences do not count, so that a rate that is zero in most texts has one.
RATES, FLOORS = ("word_length", "symbols", "dup_lines", "repeats"), (0.05, 0.04, 0.08, 0.08)
#: Groups up to which their estimates are broadcast: a few hundred bytes each.
BROADCAST_GROUPS = 20_000
GROUP = ["g_lang", "g_source"]
P = range(len(RATES))


def chi_square(x: float, k: int) -> float:
    """Probability that a sum of k squared normal numbers is x at most."""
    a, y = k / 2, x / 2
    term = total = 1.0
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= y / (a + n)
        total += term
    return math.exp(a * math.log(y) - y - math.lgamma(a + 1)) * total if y > 0 else 0.0


def chi_square_at(share: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < share else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is multiplied by."""
    k = len(RATES)
    return share / chi_square(chi_square_at(share, k), k + 2)


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, g_lang, g_source) of every row.

    Words of windows are compared by 64-bit hashes of the eight words. Groups are the columns' values after a mark, so
    that null is a group of its own.
    """
    named = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(g) for c, g in ((lang, "g_lang"), (source, "g_source"))])
    out = named.withColumn("words", F.array_remove(F.split("text", BLANK), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    out = out.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    out = out.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, F.expr(f"transform(sequence(1, cast(n_words as int) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")))
    # Only texts in which a window repeats sort their windows.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    out = out.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("starts", F.expr("sort_array(transform(filter(sorted, (s, k) -> s.h <=> get(sorted, k - 1).h or s.h <=> get(sorted, k + 1).h), s -> s.i))"))
    covered = F.expr(f"aggregate(transform(starts, (s, k) -> least({WINDOW}, coalesce(get(starts, k + 1) - s, {WINDOW}))), 0L, (n, x) -> n + x)")
    return out.select(
        F.col("doc_id").alias(id), "n_words", F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", *GROUP,
    )


def rates(stats: DataFrame) -> DataFrame:
    """Adds x0 to x3: the rates as whole numbers of 1/UNIT; null where a text has no words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.when(F.col(b) > 0, F.col(b)))
    made = (F.log(F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return stats.withColumns({f"x{i}": F.rint(c * UNIT).cast("long") for i, c in enumerate(made)})


def small(df: DataFrame) -> DataFrame:
    """One row a group: broadcast after it is counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def sums() -> list[Column]:
    """Rows, sums and sums of products of the rates: whole numbers."""
    x = [F.col(f"x{i}") for i in P]
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in P], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in P for j in P if j <= i]]


def solved(est: DataFrame) -> DataFrame:
    """(group, n, m0.., a00..) of (group, n, m0.., c00..): the inverse of the covariance's lower triangular root, floors added."""
    col = F.col
    for j in P:
        rest = [col(f"l{j}{k}") * col(f"l{j}{k}") for k in range(j)]
        est = est.withColumn(f"l{j}{j}", F.sqrt(reduce(lambda a, b: a - b, rest, F.greatest(col(f"c{j}{j}"), F.lit(0.0)) + (FLOORS[j] * UNIT) ** 2)))
        for i in range(j + 1, len(P)):
            est = est.withColumn(f"l{i}{j}", reduce(lambda a, b: a - b, [col(f"l{i}{k}") * col(f"l{j}{k}") for k in range(j)], col(f"c{i}{j}")) / col(f"l{j}{j}"))
    for i in P:
        est = est.withColumn(f"a{i}{i}", 1 / col(f"l{i}{i}"))
        for j in range(i):
            est = est.withColumn(f"a{i}{j}", -reduce(add, [col(f"l{i}{k}") * col(f"a{k}{j}") for k in range(j, i)]) / col(f"l{i}{i}"))
    return stored(est.select(*GROUP, "n", *[f"m{i}" for i in P], *[f"a{i}{j}" for i in P for j in P if j <= i]))


def from_sums(summed: DataFrame, share: float) -> DataFrame:
    n, by = F.col("n"), consistency(share)
    mean = summed.withColumns({f"m{i}": F.col(f"s{i}") / n for i in P})
    return solved(mean.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * by for i in P for j in P if j <= i}))


def first_estimate(rows: DataFrame) -> DataFrame:
    """Medians, and squares of 1.4826 median deviations: exact, since a rate has a few thousand levels at most."""
    middle = stored(rows.groupBy(*GROUP).agg(F.count("*").alias("n"), *[F.median(f"x{i}").alias(f"m{i}") for i in P]).where(F.col("n") >= LEAST_ROWS))
    off = rows.join(small(middle), GROUP).groupBy(*GROUP).agg(F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in P], *[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in P])
    return solved(off.withColumns({f"c{i}{j}": F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0) for i in P for j in P if j <= i}))


def squared_distance() -> Column:
    z = [reduce(add, [F.col(f"a{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in P]
    return reduce(add, [F.pow(c, 2) for c in z])


def concentrated(rows: DataFrame, est: DataFrame, share: float) -> DataFrame:
    """The next estimate: that of the nearest ``share`` of each group, up to the end of the band in which it is reached."""
    banded = rows.join(small(est), GROUP).withColumn("band", F.floor(F.log(squared_distance() + 1e-9) * BANDS))
    summed = banded.groupBy(*GROUP, "band").agg(*sums())
    inner, whole = Window.partitionBy(*GROUP).orderBy("band"), Window.partitionBy(*GROUP)
    summed = summed.withColumn("before", F.sum("n").over(inner) - F.col("n")).withColumn("all", F.sum("n").over(whole))
    names = [c for c in summed.columns if c[0] in "nsq"]
    return from_sums(summed.where(F.col("before") < share * F.col("all")).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in names]), share)


def estimates(rows: DataFrame, share: float = 0.75, last: float = 0.975) -> DataFrame:
    """One row for each group of LEAST_ROWS rows or more: its mean and the inverse root of its covariance."""
    est = first_estimate(rows)
    for _ in range(STEPS):
        est = concentrated(rows, est, share)
    near = rows.join(small(est), GROUP).where(squared_distance() <= chi_square_at(last, len(P))).groupBy(*GROUP).agg(*sums())
    return from_sums(near, last)


def quality_rules(docs: DataFrame, chance: float = 1e-6, least_words: int = 20, most_repeats: int = 30, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    A text fails outright with fewer than ``least_words`` words or more than ``most_repeats`` hundredths of its words in
    repeated windows; the others are the rows that estimates are made of, and ``chance`` is the part of clean texts that
    the distance may reject. Sources with fewer than LEAST_ROWS such rows are estimated together for each language; where
    these are too few as well, none is rejected and distance is null. Length itself rejects no text. Null texts
    have no words and fail; null languages and sources are groups of their own; repeated rows count as often as they
    occur and are judged alike; a text is one row of one task, whatever its length. Other columns are not read.
    """
    stats = rates(statistics(docs, id, text, lang, source))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed))
    sizes = stored(stats.where("not base_failed").groupBy(*GROUP).agg(F.count("*").alias("rows")))
    pooled = stats.join(small(sizes), GROUP, "left").withColumn("g_source", F.when(F.col("rows") >= LEAST_ROWS, F.col("g_source")).otherwise("+"))
    est = estimates(pooled.where("not base_failed").select(*GROUP, *[f"x{i}" for i in P]))
    judged = pooled.join(small(est.drop("n")), GROUP, "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(squared_distance())))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(chi_square_at(1 - chance, len(P))), F.lit(True))
    return judged.select(id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
