"""Hard negatives by threshold joins: an index that leaves out what suffix norms cover, thresholds lowered until windows fill.

Vectors become whole numbers. Anchors and rows lie in blocks by hash, and each pair of an anchor block and a row block is
one task. There the dimensions are put in order of their energy. At a threshold tau, a row is indexed up to the dimension
from which on the norm of its rest is below tau: an anchor a that shares less than that with it scores below tau |a|.
Scores are added up over the indexed part alone; pairs whose sum and the product of the remaining norms stay below tau |a|
are passed over, the others completed. Anchors with a window that is not full yet go on with half the threshold, the last
time with none, so each block returns exactly its best rows for each window, and the best of those are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlog.llm.base import stored

#: Rows of a block of rows and of anchors, dimensions indexed at once, thresholds as parts of the longest row's norm.
ROWS, ANCHORS, STEP, LEVELS = 4096, 512, 8, (0.5, 0.25, 0.125)


def whole_numbers(vectors: DataFrame, scale: int, relabel: Column, id: str, vector: str) -> DataFrame:
    """(key, id, label, v array<long>, dim, norm) of the rows that take part: floor(scale * x) of each component as a double."""
    x = F.col("v")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), relabel.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(fit)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")))
    return rows.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v", F.size("v").alias("dim"))


def stacked(vectors: pd.Series) -> np.ndarray:
    """Rows of a matrix in a type in which sums of products are exact in any order: of norms below 2^12, 2^26, or neither."""
    x = np.stack([np.asarray(v, np.int64) for v in vectors])
    most = float(np.square(x.astype(np.float64)).sum(axis=1).max(initial=0))
    return x.astype(np.float32 if most < 1 << 23 else np.float64) if most < 1 << 52 else x


def suffixes(x: np.ndarray) -> np.ndarray:
    """Norms of the rest of each row from each dimension on; the last column is zero."""
    y = np.square(x.astype(np.float64))
    return np.sqrt(np.concatenate([np.cumsum(y[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


def scores_from(a: np.ndarray, y: np.ndarray, rest_a: np.ndarray, rest_y: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, known): known marks at least the pairs with a score of tau |a| or more; their scores are exact."""
    if tau <= 0:
        return a @ y.T, np.ones((len(a), len(y)), bool)
    dim = y.shape[1]
    # Indexed dimensions of each row, in whole steps; rows with more of them come first, so a step's index is a slice.
    cut = np.minimum(dim, -(-(rest_y >= tau).sum(axis=1) // STEP) * STEP)
    order = np.argsort(-cut, kind="stable")
    cut, y, rest_y = cut[order], y[order], rest_y[order]
    sums = np.zeros((len(a), len(y)), a.dtype)
    for d in range(0, dim, STEP):
        n = int((cut > d).sum())
        if not n:
            break
        sums[:, :n] += a[:, d : d + STEP] @ y[:n, d : d + STEP].T
    left = rest_a[:, cut] * rest_y[np.arange(len(y)), cut][None, :]
    i, j = np.nonzero(sums + left * (1 + 1e-9) + 1e-6 >= tau * rest_a[:, :1])
    # Completed by groups of equal cut, whose remaining dimensions are the same.
    for c in np.unique(cut[j]):
        if c < dim:
            at = np.flatnonzero(cut[j] == c)
            for part in np.array_split(at, -(-len(at) // 100_000)):
                sums[i[part], j[part]] += (a[i[part], c:] * y[j[part], c:]).sum(axis=1)
    known, back = np.zeros(sums.shape, bool), np.argsort(order)
    known[i, j] = True
    return sums[:, back], known[:, back]


def best(asked: pd.DataFrame, rows: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """The first k rows of the block for each window of each anchor: (key, window, other, other_id, score).

    asked: one row an anchor, with windows, a list of (least, most) scores as whole numbers. ``same`` asks for the
    anchor's label, else for other labels; the anchor itself never counts. Higher scores first, ties by smaller id.
    """
    rows = rows.sort_values(["id", "label", "key"], ignore_index=True)
    both = stacked(pd.concat([asked["v"], rows["v"]]))
    order = np.argsort(-np.square(both.astype(np.float64)).sum(axis=0), kind="stable")
    a, y = both[: len(asked), order], both[len(asked) :, order]
    rest_a, rest_y = suffixes(a), suffixes(y)
    keys, ids, labels = (rows[c].to_numpy() for c in ("key", "id", "label"))
    longest = float(rest_y[:, 0].max(initial=0))
    open_ = np.arange(len(asked))
    out: list[tuple] = []
    for tau in [p * longest for p in LEVELS] + [0.0]:
        scores, known = scores_from(a[open_], y, rest_a[open_], rest_y, tau)
        left = []
        for at, row in enumerate(open_.tolist()):
            anchor = asked.iloc[row]
            fit = known[at] & ((labels == anchor["label"]) == same) & (keys != anchor["key"])
            # Below the threshold not all rows are known, so nothing below it counts before the last pass.
            floor = np.ceil(tau * rest_a[row, 0]) if tau else None
            own, done = [], True
            for w, bounds in enumerate(anchor["windows"]):
                least, most = (None if pd.isna(x) else int(x) for x in bounds)
                low = least if floor is None or (least is not None and least >= floor) else floor
                mine = fit.copy()
                if low is not None:
                    mine &= scores[at] >= low
                if most is not None:
                    mine &= scores[at] <= most
                found = np.flatnonzero(mine)
                if floor is not None and len(found) < k and low != least:
                    done = False
                    break
                found = found[np.argsort(-scores[at, found], kind="stable")[:k]]
                own += [(anchor["key"], w, keys[j], ids[j], int(scores[at, j])) for j in found]
            if done:
                out += own
            else:
                left.append(row)
        open_ = np.array(left, int)
        if not left:
            break
    return pd.DataFrame(out, columns=["key", "window", "other", "other_id", "score"])


def searched(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, window, other, other_id, score, rank) over all rows; anchors: (key, id, label, v, dim, windows)."""
    blocks = {n: max(1, -(-d.count() // size)) for n, d, size in (("block", rows, ROWS), ("group", anchors, ANCHORS))}
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks["block"]))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks["group"] - 1).cast("long"))))
    asked = anchors.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(blocks["group"]))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks["block"] - 1).cast("long"))))

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # An empty side has nothing to compare.
        return best(left, right, same, k) if len(left) and len(right) else best_none()

    found = asked.groupBy("group", "block", "dim").cogroup(dealt.groupBy("group", "block", "dim")).applyInPandas(task, "key long, window int, other long, other_id long, score long")
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_none() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "window", "other", "other_id", "score")})


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, relabel: Column | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being whole inner products.

    ``anchors`` is a condition on column id. An anchor's positives are its first rows of the same label, a positive's
    negatives the first rows of other labels whose score is between ``least`` and ``most`` hundredths of the positive's,
    both included; so positives with a negative score have none. Higher scores come first, ties by smaller id.
    Rows with a null id, label or vector, or a null or non-finite component, take no part; empty vectors score 0 with each
    other, and vectors of different lengths are not compared. Repeated rows are rows of their own, also as anchors. Inner
    products must fit 64 bits. ``relabel`` gives the label to use (default: the column). Other columns are not read.
    """
    rows = stored(whole_numbers(vectors, scale, F.col(label) if relabel is None else relabel, id, vector))
    chosen = stored(rows.where(anchors))
    free = F.array(F.array(F.lit(None).cast("long"), F.lit(None).cast("long")))
    near = stored(searched(rows, chosen.withColumn("windows", free), same=True, k=positives))
    # Whole bounds: the smallest score with 100 score >= least * positive, the largest with 100 score <= most * positive.
    low, high = F.expr(f"-((-{least} * score - pmod(-{least} * score, 100)) div 100)"), F.expr(f"({most} * score - pmod({most} * score, 100)) div 100")
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", F.array(low, high).alias("w")))).alias("ws")).select("key", F.col("ws.w").alias("windows"))
    found = searched(rows, chosen.join(windows, "key"), same=False, k=negatives)
    pairs = near.select("key", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(chosen.select("key", F.col("id").alias("anchor_id")), "key").join(found.select("key", "window", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "window"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql(anchors: int = 100) -> str:
    """The query's contract as plain SQL: every anchor beside every row."""
    return f"""
with fit as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from fit a join fit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % {anchors} = 0),
positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, p.positive_id, p.positive_score, s.other_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank
  from positive p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
where rank <= 10
"""
