"""Mixing sources to target weights: exact block quotas, dealt to output shards by a hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlog.llm.base import stored

#: Weights of the sources in code-point order, repeating; part of all sizes to share; most times a source may be taken.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a block at most, blocks in all at least, and blocks of an output shard.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_BLOCKS = 500_000, 4096, 64
#: Rows of the table of dealt blocks up to which it is broadcast; beyond it is joined by shuffle.
BROADCAST_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, size): SHARE of the sum dealt by weight, none above CAP times its size.

    What is above is reshared by weight until none is: the level at which the capped and the others add up.
    One row a source, so the windows run over few rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("size") * CAP)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def split(seed: int, quotas: np.ndarray, shards: int, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shard of each dealt block: the block of a source with that rank among the source's quota.

    A node of the tree holds shards lo to hi and its sources' counts; what of them goes to its left half is a
    multivariate hypergeometric draw, seeded by the node, so every task finds the same numbers and works out
    only the nodes that its own blocks pass.
    """
    out = np.zeros(len(rank), np.int32)
    total = int(quotas.sum())
    todo = [(0, shards, quotas.astype(np.int64), np.arange(len(rank)), rank.astype(np.int64))]
    while todo:
        lo, hi, counts, at, r = todo.pop()
        if hi - lo == 1 or not len(at):
            out[at] = lo
            continue
        mid = (lo + hi) // 2
        wanted = total * mid // shards - total * lo // shards
        left = np.random.default_rng((seed, lo, hi)).multivariate_hypergeometric(counts, wanted, method="marginals")
        first = r < left[source[at]]
        todo.append((lo, mid, left, at[first], r[first]))
        todo.append((mid, hi, counts - left, at[~first], r[~first] - left[source[at[~first]]]))
    return out


def place(id: str, text: str, seed: int) -> Column:
    """A row's place in its source's random order, from 0 to 2**32 - 1, the same in every run.

    The text counts as the id does: rows with equal or null ids and different texts lie apart.
    """
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id), F.col(text)), 32)


def dealt(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) of rows (source, size, place).

    sources: source, source_size, target, n_blocks, whole passes, edge (rows placed below it are taken once
    more). blocks: source, block, copies (one for each pass: pass number and output shard).
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    t = targets(sizes)
    block_words = F.greatest(F.least(F.sum("size").over(Window.partitionBy()) / LEAST_BLOCKS, F.lit(float(BLOCK_WORDS))), F.lit(1.0))
    t = t.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("size") / block_words)).cast("long"))
    t = t.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int"))
    t = stored(t.withColumn("rest", F.col("target") - F.col("whole") * F.col("size")))

    # Where the last pass ends: by blocks, then by places within the one block that holds the edge.
    block = F.shiftright(F.col("place") * F.col("n_blocks"), 32)
    info = t.select(F.col("source").alias("s"), "n_blocks", "rest")
    joined = rows.join(F.broadcast(info) if t.count() <= BROADCAST_ROWS else info, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block)
    hist = stored(joined.groupBy("source", "block", "rest").agg(F.sum("size").alias("size")))
    run = Window.partitionBy("source").orderBy("block")
    ends = hist.withColumn("end", F.sum("size").over(run)).where("end > rest").groupBy("source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("end") + F.col("size")).alias("left")), "block").alias("e"))
    ends = ends.select(F.col("source").alias("s"), "e.block", "e.left")
    near = joined.drop("s").join(ends, F.col("source").eqNullSafe(F.col("s")) & (joined["block"] == ends["block"])).groupBy("source", "place", "left").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("place")
    near = near.withColumn("end", F.sum("size").over(run)).where("end - size / 2 <= left").groupBy("source").agg((F.max("place") + 1).alias("edge"))
    first = F.floor((F.col("block") * F.pow(F.lit(2.0), F.lit(32)) + F.col("n_blocks") - 1) / F.col("n_blocks")).cast("long")
    a, b, c = t.alias("a"), ends.alias("b"), near.alias("c")
    sources = a.join(b, F.col("a.source").eqNullSafe(F.col("b.s")), "left").join(c, F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    edge = F.when(F.col("b.block").isNull(), F.lit(0)).otherwise(F.coalesce("c.edge", first)).cast("long")
    sources = stored(sources.select("a.source", F.col("a.size").alias("source_size"), "a.target", "a.n_blocks", "a.whole", edge.alias("edge")))

    # One row for each block and pass, ranked in a random order within its source, and dealt by the tree.
    last = F.shiftright((F.col("edge") - 1) * F.col("n_blocks"), 32) + F.when(F.col("edge") > 0, 1).otherwise(0)
    quota = (F.col("whole") * F.col("n_blocks") + F.when(F.col("edge") > 0, last).otherwise(0)).cast("long")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nodes = stored(sources.withColumn("quota", quota).withColumn("index", F.row_number().over(order) - 1))
    quotas = np.array([r.quota for r in nodes.orderBy("index").select("quota").toLocalIterator()], np.int64)
    shards = max(1, -(-int(quotas.sum()) // SHARD_BLOCKS))
    held = rows.sparkSession.sparkContext.broadcast(quotas)
    draws = nodes.where("quota > 0").select("source", "index", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("draw"))
    draws = draws.select("source", "index", (F.col("draw") / F.col("n_blocks")).cast("int").alias("pass"), F.pmod("draw", "n_blocks").alias("block"))
    draws = draws.withColumn("rank", F.row_number().over(Window.partitionBy("index").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "pass", "block")) - 1)

    def deal(batches):
        for b in batches:
            shard = split(seed, held.value, shards, np.asarray(b.column("index")), np.asarray(b.column("rank")))
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("block"), b.column("pass"), pa.array(shard)], ["source", "block", "pass", "shard"])

    draws = draws.mapInArrow(deal, "source string, block long, pass int, shard int")
    return sources, stored(draws.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("copies")))


def with_copies(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (array of pass and shard, empty if not taken) to rows with source and place."""
    small = blocks.count() <= BROADCAST_ROWS and sources.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    s = sources.select(F.col("source").alias("_s"), "source_size", "target", "n_blocks", "whole", "edge")
    b = blocks.select(F.col("source").alias("_b"), F.col("block").alias("_block"), "copies")
    out = rows.join(hint(s), F.col("source").eqNullSafe(F.col("_s")))
    at = F.shiftright(F.col("place") * F.col("n_blocks"), 32)
    out = out.join(hint(b), F.col("source").eqNullSafe(F.col("_b")) & (at == F.col("_block")), "left")
    taken = F.filter("copies", lambda c: (c["pass"] < F.col("whole")) | (F.col("place") < F.col("edge")))
    empty = F.array().cast("array<struct<pass:int,shard:int>>")
    return out.withColumn("copies", F.coalesce(taken, empty)).drop("_s", "_b", "_block", "n_blocks", "whole", "edge")


def mix_plan(docs: DataFrame, seed: int = 0, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, copies) of every row.

    size is the number of words (null text: 0), taken the words that the mix takes, a whole number of times the
    size, and copies the output shard of each time. Sources are strings; a null source is one more, last in
    order. A source of size 0 has target 0. Each source's taken words differ from its target by about half a
    document at most. Rows with equal ids and texts share their place, so the
    difference is about half of what they hold together; the same seed gives the same mix.
    """
    rows = stored(docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), place(id, text, seed).alias("place")))
    out = with_copies(rows, *dealt(rows, seed))
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mixture(docs: DataFrame, seed: int = 0, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as taken, by output shard and in random order within one.

    Rows of size 0 follow their block like others. Columns stay those of ``docs``.
    """
    names = docs.columns
    held = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), place(id, text, seed).alias("place"))
    rows = stored(docs.select(F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), place(id, text, seed).alias("place")))
    sources, blocks = dealt(rows, seed)
    out = with_copies(held, sources, blocks).select("row", "place", F.explode("copies").alias("copy"))
    out = out.repartition("copy.shard").sortWithinPartitions("copy.shard", F.xxhash64(F.lit(seed + 1), "place", "copy.pass"))
    return out.select(*[F.col("row")[c].alias(c) for c in names])
