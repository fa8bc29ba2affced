"""Embedding near-duplicates: rotated binary codes estimate inner products, bounds decide what is recomputed.

Each distinct vector is turned and coded once: its signs, the factor that corrects estimates made from them, and
the turned vector in 8 bits, which the signs of others are held against. Only these are dealt to pairs of blocks.
Vectors lie in blocks around pivots; a pair of blocks is compared where their caps (pivot and widest angle) leave
room for a close pair, so every pair of vectors is either excluded by the triangle inequality of angles or estimated
once: in clustered data few block pairs are left, in evenly spread data all of them. The vectors themselves follow
only for rows of which some estimate is in doubt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded, components, stored

#: Rows of a block at least, bytes of its vectors at most, blocks aimed at between, cells of an estimate matrix, and standard errors of slack.
LEAST_ROWS, BLOCK_BYTES, BLOCKS, CELLS, ERRORS = 1024, 32 << 20, 8, 1 << 22, 6.0
#: Blocks up to which their table is broadcast.
BROADCAST_BLOCKS = 20_000


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))[0]


def encoded(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs as packed bits, correction factors, turned vectors in 8 bits, their scales) of unit vectors.

    The factor is the inner product of a turned vector and its code, the signs over sqrt(dim): a cosine with another
    vector is estimated by the sum of signs times levels, times the scale, over factor and sqrt(dim).
    """
    turned = units @ rotation(units.shape[1], seed)
    factors = np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])
    scales = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned >= 0, axis=1), factors, np.rint(turned / scales[:, None]).astype(np.int8), scales


def sums(signs: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Signs times levels of all rows with all rows: whole numbers, which single precision holds exactly in any order."""
    ones = np.unpackbits(signs, axis=1, count=levels.shape[1]).astype(np.float32) * 2 - 1
    return ones @ levels.astype(np.float32).T


def slack(factors: np.ndarray, dim: int, least: float) -> np.ndarray:
    """How far estimates from these codes may be off: ERRORS standard errors of the code, at cosine ``least``, and of 8-bit levels.

    The estimate of a cosine c is unbiased with a standard error of sqrt((1 - f^2) / f^2) sqrt((1 - c^2) / (dim - 1)).
    """
    code = np.sqrt(np.maximum(0, 1 - factors**2)) / factors * np.sqrt((1 - least**2) / max(1, dim - 1))
    return ERRORS * np.hypot(code, 1 / (127 * np.sqrt(12) * factors)) + 1e-5


def unit_vectors(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, unit binary, dim): unit vectors as doubles; unit is null where a vector is null, empty, zero or not finite."""

    def make(batches):
        for batch in batches:
            units, dims = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(1)
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else np.zeros(1)
                ok = bool(x.any())
                units.append((x / np.linalg.norm(x) + 0.0).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], ["id", "unit", "dim"])

    return rows.select(F.col(id).cast("long"), F.col(vector)).mapInArrow(make, "id long, unit binary, dim int")


def coded(classes: DataFrame, seed: int) -> DataFrame:
    """Adds signs, factor, levels and scale to (key, first, copies, unit, dim, cell, near), worked out once."""
    names = classes.columns

    def make(batches):
        for batch in batches:
            units, dims = batch.column("unit").to_pylist(), np.asarray(batch.column("dim"))
            out: list = [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(-1, d)
                for i, s, f, v, c in zip(at.tolist(), *encoded(x, seed)):
                    out[i] = (s.tobytes(), float(f), v.tobytes(), float(c))
            if out:
                made = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.float64(), pa.binary(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "signs", "factor", "levels", "scale"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(make, f"{schema}, signs binary, factor double, levels binary, scale double")


def in_blocks(classes: DataFrame, seed: int) -> DataFrame:
    """Adds block, near (cosine to the block's pivot) and the codes. The pivots are as many vectors, by hash, as blocks are aimed at.

    A pivot is collected for each block: n / (rows of a block) vectors, a few MB for a thousand million rows.
    """
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    aim = int(np.clip(-(-n // BLOCKS), LEAST_ROWS, max(LEAST_ROWS, BLOCK_BYTES // (8 * (dim or 1)))))
    chosen = [(r.dim, np.frombuffer(r.unit)) for r in classes.orderBy(F.xxhash64("unit"), "key").limit(max(1, n // aim)).select("dim", "unit").collect()]
    dims = {d: [i for i, (e, _) in enumerate(chosen) if e == d] for d, _ in chosen}
    held = classes.sparkSession.sparkContext.broadcast({d: (np.array(at), np.stack([chosen[i][1] for i in at])) for d, at in dims.items()})

    def assign(batches):
        for batch in batches:
            cell, near = [], []
            for u, d in zip(batch.column("unit").to_pylist(), batch.column("dim").to_pylist()):
                at, pivots = held.value.get(d, (None, None))
                c = pivots @ np.frombuffer(u) if at is not None else None
                k = int(c.argmax()) if c is not None else -1
                cell.append(int(at[k]) if c is not None else -d)
                near.append(float(c[k]) if c is not None else -1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(near, pa.float64())], [*batch.schema.names, "cell", "near"])

    rows = coded(classes.mapInArrow(assign, "key long, first long, copies long, unit binary, dim int, cell long, near double"), seed)
    rows = stored(rows)
    tiles = rows.groupBy("cell").agg(F.ceil(F.count("*") / aim).alias("tiles"))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles"))
    return rows.join(F.broadcast(tiles) if tiles.count() <= BROADCAST_BLOCKS else tiles, "cell").withColumn("block", F.col("cell") * (1 << 24) + tile).drop("tiles")


def block_pairs(blocks: DataFrame, pivots: DataFrame, least: float) -> DataFrame:
    """(a, b) of blocks, a not after b, of one dimension, whose caps may hold vectors with cosine of ``least``.

    One row a block: the table is small against the rows, and each task takes some of its rows against all of it.
    """
    caps = blocks.groupBy("block", "cell", "dim").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near") - 1e-12))).alias("wide"))
    caps = stored(caps.join(pivots, "cell", "left").select("block", "dim", "wide", "pivot"))
    a, b = (caps.select(F.col("block").alias(x), "dim", F.col("wide").alias(f"wide_{x}"), F.col("pivot").alias(f"pivot_{x}")) for x in "ab")
    dot = F.aggregate(F.zip_with("pivot_a", "pivot_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("wide_a") - F.col("wide_b")
    hint = F.broadcast if caps.count() <= BROADCAST_BLOCKS else (lambda x: x)
    return a.repartition("a").join(hint(b), "dim").where(F.col("a") <= F.col("b")).where(F.coalesce(gap <= float(np.arccos(least)) + 1e-6, F.lit(True)) | (F.col("a") == F.col("b"))).select("a", "b")


def compared(a: pd.DataFrame, b: pd.DataFrame, same: bool, least: float):
    """Pairs of two blocks, in tiles: yields (rows of a, rows of b, whether the estimate leaves a doubt).

    Pairs whose estimate lies ERRORS standard errors below ``least`` are passed over; as far above it they are links.
    """
    signs, levels = (np.frombuffer(b"".join(x), t).reshape(len(x), -1) for x, t in ((a["signs"], np.uint8), (b["levels"], np.int8)))
    scales = b["scale"].to_numpy().astype(np.float32)
    unit = a["factor"].to_numpy() * np.sqrt(levels.shape[1])
    off = slack(a["factor"].to_numpy(), levels.shape[1], least)
    low, high = (((least + x * off) * unit).astype(np.float32) for x in (-1, 1))
    height = max(64, CELLS // max(1, len(b)))
    for top in range(0, len(a), height):
        part = slice(top, top + height)
        start = top if same else 0
        found = sums(signs[part], levels[start:]) * scales[None, start:]
        i, j = np.nonzero(found >= low[part, None])
        doubt = found[i, j] <= high[part][i]
        i, j = i + top, j + start
        if same:
            keep = i < j
            i, j, doubt = i[keep], j[keep], doubt[keep]
        yield i, j, doubt


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of connected rows after further links: the smallest row that each reaches."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        labels = new[labels]


def in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, bool]:
    """Rows of the first block, then of the second, each by key; where the second begins; whether both are one."""
    pdf = pdf.sort_values(["second", "key"], ignore_index=True)
    n = int((~pdf["second"]).sum())
    return pdf, n, n == len(pdf)


def sure(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of two blocks' codes, one row for each vector that has a partner: links beyond doubt, and whether some are in doubt."""
    pdf, n, same = in_order(pdf)
    copies, labels = pdf["copies"].to_numpy(), np.arange(len(pdf))
    found, doubtful = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
    for i, j, doubt in compared(pdf[:n], pdf if same else pdf[n:], same, least):
        j = j + (0 if same else n)
        doubtful[i[doubt]] = doubtful[j[doubt]] = True
        i, j = i[~doubt], j[~doubt]
        np.add.at(found, i, copies[j])
        np.add.at(found, j, copies[i])
        labels = merge_labels(labels, i, j)
    at = np.flatnonzero((found > 0) | doubtful)
    own = pdf.iloc[at]
    keys = pdf["key"].to_numpy()
    return pd.DataFrame({"a": own["a"], "b": own["b"], "second": own["second"], "key": keys[at], "n": found[at], "root": keys[labels[at]], "doubt": doubtful[at]})


def exact(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The links among the pairs in doubt, from the vectors in doubles: one row for each vector that has one."""
    pdf, n, same = in_order(pdf)
    units = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
    copies, labels, found = pdf["copies"].to_numpy(), np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
    for i, j, doubt in compared(pdf[:n], pdf if same else pdf[n:], same, least):
        i, j = i[doubt], j[doubt] + (0 if same else n)
        close = np.concatenate([np.einsum("ij,ij->i", units[i[k : k + 50_000]], units[j[k : k + 50_000]]) >= least for k in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
        i, j = i[close], j[close]
        np.add.at(found, i, copies[j])
        np.add.at(found, j, copies[i])
        labels = merge_labels(labels, i, j)
    at = np.flatnonzero(found)
    keys = pdf["key"].to_numpy()
    return pd.DataFrame({"key": keys[at], "n": found[at], "root": keys[labels[at]]})


def links(classes: DataFrame, least: float, seed: int) -> DataFrame:
    """(key, n, root): for each block pair and row with links in it, their number and a row they connect it with.

    A task holds the codes of two blocks, then the vectors of those of their rows that are in doubt, and returns one
    row for each of theirs, never pairs.
    """
    blocks = stored(in_blocks(classes, seed))
    firsts = blocks.groupBy("cell").agg(F.max_by("unit", "near").alias("unit"))

    def unpack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array([np.frombuffer(u).tolist() for u in b.column("unit").to_pylist()], pa.list_(pa.float64()))], ["cell", "pivot"])

    # A pivot is a row itself and so the row nearest to it; cells without one (cell < 0) are never left out.
    pivots = firsts.where("cell >= 0").mapInArrow(unpack, "cell long, pivot array<double>")
    pairs = stored(block_pairs(blocks, pivots, least))
    partners = pairs.select(F.col("a").alias("block"), "a", "b").union(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b"))
    hint = F.broadcast if partners.count() <= BROADCAST_BLOCKS else (lambda x: x)
    dealt = blocks.join(hint(partners), "block").withColumn("second", F.col("block") != F.col("a"))
    # The first block of a pair shows its signs, the second its levels; a block beside itself needs both.
    shown = dealt.select("a", "b", "second", "key", "copies", *[F.when(c, F.col(x)).alias(x) for x, c in (("signs", ~F.col("second")), ("factor", ~F.col("second")), ("levels", F.col("second") | (F.col("a") == F.col("b"))), ("scale", F.col("second") | (F.col("a") == F.col("b"))))])
    found = stored(shown.groupBy("a", "b").applyInPandas(lambda pdf: sure(pdf, least), "a long, b long, second boolean, key long, n long, root long, doubt boolean"))
    asked = found.where("doubt").select("a", "b", "second", "key").join(blocks.select("key", "copies", "unit", "signs", "factor", "levels", "scale"), "key")
    checked = asked.groupBy("a", "b").applyInPandas(lambda pdf: exact(pdf, least), "key long, n long, root long")
    return found.where("n > 0").select("key", "n", "root").union(checked)


def near_vectors(vectors: DataFrame, least: float = 0.9, seed: int = 0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: rows link where the cosine in doubles is ``least`` or more.

    Equal vectors make one class before any comparison. Vectors that are null, empty, zero or hold null or
    non-finite numbers link with nothing, and vectors of different lengths never link. n_links counts rows;
    component_id is the smallest id reachable. Rows with a null id count as links and connect others; the smallest
    id of theirs is that of their component, null where it has none, and they are never kept.
    """
    # A vector's digest stands for it wherever rows are brought together; the vector itself is shuffled once.
    rows = stored(unit_vectors(bounded(vectors), id, vector).withColumn("digest", F.unhex(F.sha2("unit", 256))))
    classes = rows.where("unit is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("key"), "first", "copies", "unit", "dim", "digest"))
    found = stored(links(classes.drop("digest"), least, seed))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("key"), F.col("component_id").alias("label"))
    named = classes.drop("unit").join(counts, "key", "left").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = stored(named.select("digest", "first", "label", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_id = named.groupBy("label").agg(F.min("first").alias("component_id"))
    out = rows.select("id", "digest").join(named.join(least_id, "label").select("digest", "n_links", "component_id", F.lit(True).alias("linked")), "digest", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
