"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

``near_duplicates`` links fingerprints that differ in few bits, by blocks of which close pairs must share one.
``near_texts`` links texts whose shingle sets are similar: wide fingerprints propose, the sets confirm.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import Forest, bounded, components, spanning, stored

#: A-Z to a-z and every white-space byte to a space; bytes of longer UTF-8 characters stay.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")
#: Rows of a bucket above which it is dealt out in tiles, rows of a tile, and h values summed at once.
LARGE, TILE, HASHES = 4096, 2048, 200_000


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash over XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(found) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = hashes[i : i + HASHES]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def with_fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long. A null text counts as empty."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return bounded(docs).select(id, text).mapInArrow(make, f"id {kind}, fp long")


def masks(n: int, bits: int) -> list[int]:
    """Masks of the pigeonhole blocks: fingerprints that differ in at most ``bits`` bits agree under one of them.

    The 64 bits are cut into bits + k blocks, and every k of them make a mask, k the least for which a
    bucket of n evenly spread fingerprints would hold fewer than four.
    """
    for k in range(1, 9):
        cuts = [64 * i // (bits + k) for i in range(bits + k + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        if n < 4 * 2 ** (64 * k // (bits + k)):
            break
    return [sum(c) for c in combinations(blocks, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_pairs(fps: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) that connect all ids whose fingerprints differ in at most ``bits`` bits.

    fps: (id long, fp long), fingerprints distinct. A block pair of rows gives a spanning forest of its
    links, not all of them: components need no more. Buckets above LARGE rows, found by a partial count,
    are dealt out as pairs of tiles of about TILE rows, so no task holds a bucket.
    """
    rows = stored(fps.select("id", "fp"))
    chosen = masks(rows.count(), bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(chosen)])).alias("b")
    keyed = rows.select("id", "fp", keys).select("id", "fp", "b.m", "b.key")
    counts = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(counts, ["m", "key"])
    tiles = F.ceil(F.col("n") / TILE)
    own: Column = F.pmod(F.xxhash64("fp"), tiles)
    small = keyed.where(f"n <= {LARGE}").select("m", "key", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("own"), "id", "fp")
    hot = keyed.where(f"n > {LARGE}").select("m", "key", "id", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    hot = hot.select("m", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "fp")
    dealt = small.union(hot).repartition("m", "key", "a", "b").sortWithinPartitions("m", "key", "a", "b", "own", "id")
    return dealt.mapInArrow(lambda batches: link_blocks(batches, bits), "u long, v long")


def link_blocks(batches, bits: int):
    """Rows sorted by block come in; the links of each block go out. Holds one block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        names = [np.asarray(rows.column(c)) for c in ("m", "key", "a", "b")]
        last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))
        if len(last):
            cut = int(last[-1]) + 1
            yield linked(rows.slice(0, cut), bits)
            held = rows.slice(cut).to_batches()
    if held:
        yield linked(pa.Table.from_batches(held), bits)


def linked(rows: pa.Table, bits: int) -> pa.RecordBatch:
    names = [np.asarray(rows.column(c)) for c in ("m", "key", "a", "b")]
    ids, fps = np.asarray(rows.column("id")), np.asarray(rows.column("fp")).view(np.uint64)
    new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(ids)))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    small = sizes <= 32
    block = np.repeat(np.where(small, np.arange(len(starts)), -1), sizes)
    at = np.flatnonzero(block >= 0)
    for d in range(1, 32):
        at = at[at + d < len(ids)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= bits]
        us.append(hit)
        vs.append(hit + d)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    forest = Forest(len(ids)) if len(u) > len(starts) else None
    if forest is not None:
        keep = np.fromiter((forest.unite(a, b) for a, b in zip(u.tolist(), v.tolist())), bool, len(u))
        u, v = u[keep], v[keep]
    u, v = [u], [v]
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        f = fps[s : s + n]
        near = np.concatenate([np.bitwise_count(f[i : i + 256, None] ^ f[None, :]) <= bits for i in range(0, n, 256)])
        np.fill_diagonal(near, False)
        tree = np.array(spanning(near), np.int64).reshape(-1, 2) + s
        u.append(tree[:, 0])
        v.append(tree[:, 1])
    u, v = np.concatenate(u), np.concatenate(v)
    return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp long, fingerprint, component_id, kept) of every row.

    Rows link where their fingerprints differ in at most ``bits`` bits; component_id is the smallest id
    reachable and kept marks the row that bears it. Equal fingerprints (exact copies, rows without words)
    make one class before any comparison. Ids are integers; rows with a null id link through their text,
    connect others and are never kept; component_id is null where no row of a component has an id. Repeated rows come back repeated.
    """
    marked = stored(with_fingerprint(docs, id, text, words).select(F.col("id").cast("long").alias("id"), "fp"))
    # A class has a key of its own, so that one without any id links others too.
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("first")).withColumn("key", F.monotonically_increasing_id()))
    labels = components(close_pairs(classes.select(F.col("key").alias("id"), "fp"), bits)).select(F.col("id").alias("key"), F.col("component_id").alias("label"))
    named = stored(classes.join(labels, "key", "left").select("fp", "first", F.coalesce("label", "key").alias("label")))
    reached = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fp", "component_id")
    out = marked.join(reached, "fp")
    return out.select(F.col("id").alias(id), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


# ----- near copies by similarity of shingle sets -----

#: 64-bit words of a wide fingerprint and of its part that goes into buckets, rows aimed at in a bucket, share of pairs
#: at the least similarity that some block is to join, standard deviations of slack in distances, and one of how many
#: rows counts the large buckets.
WORDS, SHOWN, ROWS, RECALL, SLACK, COUNTED = 8, 2, 16, 0.995, 3.0, 32
#: Shingles of a set up to which its links are found through shared shingles, exactly, and rows of a shingle's tile.
SMALL, SMALL_ROWS = 32, 512
#: Rows of a family that a task compares at most, and shingles of its sets.
FAMILY_ROWS, FAMILY_SHINGLES = 1024, 1_000_000
#: Rows up to which the table of large buckets, and that of texts to be read again, is broadcast.
BROADCAST_ROWS, ASKED_ROWS = 20_000, 200_000


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Distinct XXH64 (seed 42) of the word shingles, ascending; of all words where there are fewer; none without words."""
    found = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    n = len(found) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n))


def wide_fingerprint(shingle_set: np.ndarray) -> np.ndarray:
    """WORDS independent 64-bit SimHashes of a set, each over its own mixing of the shingles' hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(shingle_set), HASHES // 64):
        h = shingle_set[i : i + HASHES // 64, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingle_set), bitorder="little").view(np.uint64)


def with_sets(texts: DataFrame, words: int, keep: int) -> DataFrame:
    """(id, th, whole, n, wide, small) of (id, th, text): hash of the text's shingle set, the set's size, its wide fingerprint and, up to ``keep`` shingles, the set."""

    def make(batches):
        for batch in batches:
            sets = [shingles(t or "", words) for t in batch.column(2).to_pylist()]
            whole = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            wide = pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())
            small = pa.array([s.view(np.int64) if len(s) <= keep else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole), pa.array([len(s) for s in sets], pa.int32()), wide, small], ["id", "th", "whole", "n", "wide", "small"])

    kind = texts.schema[0].dataType.simpleString()
    return texts.mapInArrow(make, f"id {kind}, th long, whole long, n int, wide binary, small array<long>")


def differing(least: float) -> float:
    """Probability that fingerprints of sets with that Jaccard similarity differ in a bit (for sets of equal size)."""
    return float(np.arccos(2 * least / (1 + least)) / np.pi)


def farthest(words: int, least: float) -> int:
    """Bits in which so many words of close sets' fingerprints differ, SLACK standard deviations above the mean."""
    p, n = differing(least), 64 * words
    return int(n * p + SLACK * np.sqrt(n * p * (1 - p)))


def blocks(n: int, least: float) -> np.ndarray:
    """Blocks of the wide fingerprint, one a row: places of the bits that rows must share to meet there.

    Sets of similarity ``least`` differ in 15 bits of a hundred, far too many for blocks of which every close pair must
    share one. So the blocks are drawn at random: their bits are as many as leave about ROWS of n unrelated rows
    together, and there are so many that a pair at the least similarity, even where its fingerprints differ by a
    standard deviation more than they should, meets in one with probability RECALL. Closer pairs meet more often.
    """
    apart = differing(least)
    agree = 1 - apart - np.sqrt(apart * (1 - apart) / (64 * WORDS))
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / ROWS)), 8, 40))
    count = int(np.ceil(np.log(1 - RECALL) / np.log(1 - agree**bits)))
    rng = np.random.default_rng(0)
    return np.stack([rng.choice(64 * WORDS, bits, replace=False) for _ in range(count)])


def in_blocks(classes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(t, key, id, n, fp0, fp1): each of (whole, n, wide) once in every block, with the first words of its fingerprint."""

    def make(batches):
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            bits = np.unpackbits(wide, axis=1, bitorder="little")
            keys = np.zeros((len(bits), len(chosen)), np.int64)
            for i in range(chosen.shape[1]):
                keys = keys << 1 | bits[:, chosen[:, i]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * len(chosen), pa.int32()), pa.array(keys.reshape(-1)))
            shown = [pa.array(wide.view(np.int64)[:, i].copy()) for i in range(SHOWN)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *shown, lists], ["id", "n", "fp0", "fp1", "keys"])

    rows = classes.select("whole", "n", "wide").mapInArrow(make, "id long, n int, fp0 long, fp1 long, keys array<long>")
    return rows.select("id", "n", "fp0", "fp1", F.posexplode("keys").alias("t", "key"))


def in_tiles(classes: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Rows by bucket (t, key), those of large buckets once for each pair of tiles (a, b) that holds their own.

    Which buckets are large is told from one of COUNTED rows: it decides where rows are compared, not whether.
    """
    some = in_blocks(classes.where(F.pmod(F.xxhash64("whole"), F.lit(COUNTED)) == 0), chosen).groupBy("t", "key").agg(F.ceil(F.count("*") * COUNTED / TILE).alias("tiles"))
    large = stored(some.where(F.col("tiles") * TILE > LARGE))
    hint = F.broadcast if large.count() <= BROADCAST_ROWS else (lambda x: x)
    rows = in_blocks(classes, chosen).join(hint(large), ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return in_pairs(rows, ["t", "key"], ["id", "n", "fp0", "fp1"])


def in_pairs(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of each group cut into its number of ``tiles`` by id, once for each pair of tiles that holds their own; sorted."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select(*group, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", *columns)
    return rows.repartition(*group, "a", "b").sortWithinPartitions(*group, "a", "b", "own", "id")


def by_group(batches, group: tuple[str, ...], work):
    """Rows sorted by group come in; ``work`` gets tables of whole groups with the groups' bounds, and gives links. Holds one group at a time."""
    held: list[pa.RecordBatch] = []

    def edges(rows: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.asarray(rows.column(c))[1:] != np.asarray(rows.column(c))[:-1] for c in group], axis=0)) + 1

    def done(rows: pa.Table, inner: np.ndarray):
        found = work(rows, np.concatenate(([0], inner, [rows.num_rows])))
        u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if len(inner := edges(rows)):
                yield done(rows.slice(0, int(inner[-1])), inner[:-1])
                held = rows.slice(int(inner[-1])).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield done(rows, edges(rows))


def alike(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs may reach the least similarity: by their sizes and the shown words of their fingerprints."""
    a, b = n[i], n[j]
    far = np.bitwise_count(fp[0][i] ^ fp[0][j]) + np.bitwise_count(fp[1][i] ^ fp[1][j])
    return (far <= farthest(SHOWN, least)) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-6)


def proposals(rows: pa.Table, bounds: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all alike rows of each bucket: all pairs in buckets of up to 32 rows, in larger ones stars.

    The row with the most alike rows is a star's centre, again and again among those in no star yet.
    """
    ids, n = np.asarray(rows.column("id")), np.asarray(rows.column("n"))
    fp = [np.asarray(rows.column(f"fp{i}")).view(np.uint64) for i in range(SHOWN)]
    sizes = np.diff(bounds)
    block = np.repeat(np.where(sizes <= 32, np.arange(len(sizes)), -1), sizes)
    out = []
    at = np.flatnonzero(block >= 0)
    for d in range(1, 32):
        at = at[at + d < len(ids)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            break
        hit = at[alike(fp, n, at, at + d, least)]
        out.append((ids[hit], ids[hit + d]))
    for s, size in zip(bounds[:-1][sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        every = np.arange(s, s + size)
        near = np.concatenate([alike(fp, n, every[i : i + 256, None], every[None, :], least) for i in range(0, size, 256)])
        left, degree = np.ones(size, bool), near.sum(axis=1)
        while True:
            centre = int(np.where(left, degree, 0).argmax())
            if not left[centre] or degree[centre] < 2:
                break
            left[centre] = False
            star = np.flatnonzero(near[centre] & left)
            left[star] = False
            # A row whose alike rows are all in stars joins one of them: the one with the most alike rows itself.
            star = star if len(star) else np.where(near[centre] & (every != s + centre), degree, 0).argmax(keepdims=True)
            out.append((np.full(len(star), ids[s + centre]), ids[s + star]))
    return out


def confirmed(rows: pa.Table, bounds: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of each family, confirmed by the sets: closest fingerprints first, and only between rows not yet connected."""
    ids, n = np.asarray(rows.column("id")), np.asarray(rows.column("n"))
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").slice(s, e - s).to_pylist()]
        wide = np.frombuffer(b"".join(rows.column("wide").slice(s, e - s).to_pylist()), np.uint64).reshape(-1, WORDS)
        size, own = n[s:e], np.asarray(rows.column("own"))[s:e]
        two = own[0] != own[-1]
        i, j, far = [], [], []
        for k in range(e - s - 1):
            d = np.bitwise_count(wide[k + 1 :] ^ wide[k]).sum(axis=1, dtype=np.int32)
            may = (d <= farthest(WORDS, least)) & (np.minimum(size[k + 1 :], size[k]) >= least * np.maximum(size[k + 1 :], size[k]) - 1e-6)
            # Rows of one tile meet where it is paired with itself.
            hit = np.flatnonzero(may & (own[k + 1 :] != own[k]) if two else may)
            i.append(np.full(len(hit), k, np.int32))
            j.append((hit + k + 1).astype(np.int32))
            far.append(d[hit])
        i, j, far = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (i, j, far))
        order = np.argsort(far, kind="stable")
        i, j, forest, links = i[order], j[order], Forest(e - s), []
        for top in range(0, len(i), 4096):
            roots = np.array([forest.root(x) for x in range(e - s)])
            a, b = i[top : top + 4096], j[top : top + 4096]
            for x, y in zip(a[roots[a] != roots[b]].tolist(), b[roots[a] != roots[b]].tolist()):
                if forest.root(x) != forest.root(y) and similar(sets[x], sets[y], least):
                    forest.unite(x, y)
                    links.append((x, y))
        at = np.array(links, np.int64).reshape(-1, 2) + s
        out.append((ids[at[:, 0]], ids[at[:, 1]]))
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets (ascending) is ``least`` or more, exactly."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common + 1e-9 >= least * (len(both) - common)


def small_links(classes: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect all classes (whole, n, small) that hold SMALL shingles or fewer with all they are close to.

    Exact. Of two sets of similarity ``least`` or more each holds a shingle of the other among its first
    n - least * n + 1, when all sets are put in one order. The order is by the number of sets that hold a shingle, rarest
    first, so few sets meet in a common one; where many do, they are dealt out as pairs of tiles.
    """
    items = classes.where("small is not null").select("whole", "n", F.explode("small").alias("s"))
    held = items.groupBy("s").agg(F.count("*").alias("held")).where("held > 1")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "s")))
    sets = items.join(held, "s", "left").groupBy("whole", "n").agg(order.alias("order"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-6).cast("int") + 1
    fronts = stored(sets.select(F.col("whole").alias("id"), "n", F.col("order.s").alias("small"), F.explode(F.slice("order", F.lit(1), first)).alias("at")).where("at.held > 1").select("id", "n", "small", "at.s"))
    met = fronts.groupBy("s").agg(F.count("*").alias("rows"), F.min("n").alias("least")).where(f"rows > 1 and least <= {SMALL}")
    rows = fronts.join(met.select("s", F.ceil(F.col("rows") / SMALL_ROWS).alias("tiles")), "s")
    return in_pairs(rows, ["s"], ["id", "n", "small"]).mapInArrow(lambda b: by_group(b, ("s", "a", "b"), lambda r, s: in_common(r, s, least)), "u long, v long")


def in_common(rows: pa.Table, bounds: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of each group of small sets, whose common shingles are counted by matrix products."""
    ids, n = np.asarray(rows.column("id")), np.asarray(rows.column("n")).astype(np.int64)
    flat = rows.column("small").combine_chunks().flatten().to_numpy()
    ends = np.concatenate(([0], np.cumsum(n)))
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        at, size = np.repeat(np.arange(e - s), n[s:e]), n[s:e]
        found, code, times = np.unique(flat[ends[s] : ends[e]], return_inverse=True, return_counts=True)
        # Shingles of one row alone are in no pair; the others are numbered anew and go in parts.
        number = np.cumsum(times > 1) - 1
        two = times[code] > 1
        at, code = at[two], number[code[two]]
        common = np.zeros((e - s, e - s), np.float32)
        for top in range(0, int((times > 1).sum()), 4096):
            part = (code >= top) & (code < top + 4096)
            held = np.zeros((e - s, min(4096, int((times > 1).sum()) - top)), np.float32)
            held[at[part], code[part] - top] = 1
            common += held @ held.T
        linked = common + 1e-6 >= least * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        links = np.array(spanning(linked), np.int64).reshape(-1, 2) + s
        out.append((ids[links[:, 0]], ids[links[:, 1]]))
    return out


def sets_of(asked: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the asked classes (whole, first: a row's id and th): their texts are read again. texts: (id, th, text)."""

    def make(batches):
        for batch in batches:
            out = [shingles(t or "", words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "shingles"])

    asked = stored(asked.select("whole", F.col("first.id").alias("_id"), F.col("first.th").alias("_th")))
    hint = F.broadcast if asked.count() <= ASKED_ROWS else (lambda x: x)
    mine = (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id"))
    return bounded(texts).join(hint(asked), mine).select("whole", "text").mapInArrow(make, "id long, shingles binary").dropDuplicates(["id"])


def near_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, th, component_id) of every row; th is Spark's XXH64 of the text.

    Rows link where the Jaccard similarity of their sets of word shingles is ``least`` or more. Wide SimHash
    fingerprints are cut into random blocks; rows that share a block and differ in few bits make families, and within a
    family every link is confirmed by the sets themselves: no false link, and few missing ones (see ``blocks``). In small
    sets single shingles turn many bits, so pairs with one of SMALL or fewer are joined exactly (``small_links``). Equal
    sets (exact copies, rows without words, null texts) are one class before any comparison; repeated rows come back
    repeated. Large buckets and large families are dealt out as pairs of tiles.
    """
    texts = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text"))
    rows = stored(with_sets(bounded(texts), words, int(SMALL / least + 1e-6)))
    classes = stored(rows.groupBy("whole").agg(F.min(F.struct("id", "th")).alias("first"), *(F.first(c).alias(c) for c in ("n", "wide", "small"))))
    large = classes.where(F.col("n") > SMALL)
    met = in_tiles(large, blocks(large.count(), least)).mapInArrow(lambda b: by_group(b, ("t", "key", "a", "b"), lambda r, s: proposals(r, s, least)), "u long, v long")
    family = stored(components(met.distinct()).select(F.col("id").alias("whole"), F.col("component_id").alias("family")))
    members = stored(classes.join(family, "whole"))
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / FAMILY_ROWS, F.sum("n") / FAMILY_SHINGLES)).alias("tiles"))
    compared = members.join(sizes, "family").withColumnRenamed("whole", "id").drop("first").join(sets_of(members, texts, words), "id")
    near = in_pairs(compared, ["family"], ["id", "n", "wide", "shingles"]).mapInArrow(lambda b: by_group(b, ("family", "a", "b"), lambda r, s: confirmed(r, s, least)), "u long, v long")
    label = components(near.union(small_links(classes, least))).select(F.col("id").alias("whole"), "component_id")
    out = rows.join(label, "whole", "left")
    return out.select(F.col("id").alias(id), "th", F.coalesce("component_id", "whole").alias("component_id"))
