"""Lexical retrieval packing: a sharded BM25 inverted index fills each seed's window with unused neighbours."""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dirlog.llm.base import bounded, stored

#: Tokens of a sequence, the id that ends a document, rows of a shard of the index at most, and BM25's constants.
LENGTH, END_ID, SHARD_ROWS, K1, B = 2048, 1, 2048, 1.2, 0.75
#: Clusters at most, rests that they are fitted on at most, places of the hashed vectors, rounds of fitting, and terms
#: of a seed that are looked up, those that tell most.
CLUSTERS, SAMPLE, PLACES, ROUNDS, TERMS = 1024, 20_000, 128, 4, 48
#: Ids are below this.
IDS = 50_258
#: What two libraries might read differently: the special token's string, white space but blanks and line feeds, newer letters.
SPECIAL = "<|endoftext|>"
WHITE = [c for c in map(chr, range(0x250)) if c.isspace() and c not in " \n"]
PLAIN = re.compile(r"[\x00-\u024f]*")


@lru_cache(1)
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(1)
def merges() -> tiktoken.Encoding:
    """The tokenizer's merges in a library that is quicker at them; refused where the two do not agree."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c) and c not in WHITE]
    probe = "".join(f"{c}{c.upper()} it{c}s  {c}1{c}2\n{c}{d}" for c, d in zip(letters, letters[7:] + letters[:7]))
    if quick.encode_ordinary(probe) != tokenizer().encode(probe, add_special_tokens=False).ids:
        raise ValueError("byte_bpe_50k: the two libraries' ids differ")
    return quick


def encode(text: str) -> np.ndarray:
    """The tokenizer's ids of the whole text, without special tokens added; what may differ goes to the tokenizer itself."""
    same = SPECIAL not in text and PLAIN.fullmatch(text) and not any(c in text for c in WHITE)
    return np.array(merges().encode_ordinary(text) if same else tokenizer().encode(text, add_special_tokens=False).ids, np.uint16)


def crc(ids: np.ndarray) -> int:
    """Of the ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


#: A whole window of a document has its checksum and no ids; the rest of one has its ids; df has document frequencies.
TOKENS = "doc_id long, start long, length int, doc_tokens long, crc long, ids binary, df array<int>"


def tokenise(batches):
    """Windows and rests of documents, and at the end the task's document frequencies of ids."""
    df = np.zeros(IDS, np.int32)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), np.uint16(END_ID))
            held = np.zeros(IDS, bool)
            held[ids] = True
            df += held
            for at in range(0, len(ids), LENGTH):
                part = ids[at : at + LENGTH]
                rows.append((doc_id, at, len(part), len(ids), crc(part), None if len(part) == LENGTH else part.tobytes(), None))
        if rows:
            yield as_batch(rows)
    yield as_batch([(None, None, None, None, None, None, df)])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "doc_tokens", "crc", "ids", "df"])


class Index:
    """BM25 inverted index of one shard: per id the rows that hold it and what it adds to their scores."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t[np.argsort(-idf[t], kind="stable")[:TERMS]] for t in (t[idf[t] > 0] for t, _ in found)]
        term = np.concatenate([t for t, _ in found])
        tf = np.concatenate([n for _, n in found]).astype(np.float64)
        row = np.repeat(np.arange(len(docs)), [len(t) for t, _ in found])
        size = np.array([len(d) for d in docs])[row]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_length))
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order].astype(np.int32), weight[order]
        self.bounds = np.searchsorted(term[order], np.arange(IDS + 1))
        self.n = len(docs)

    def scores(self, i: int) -> np.ndarray:
        """Of every row against row i as a query."""
        terms = self.terms[i]
        a, n = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        if not n.sum():
            return np.zeros(self.n)
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.bincount(self.row[at], self.weight[at], self.n)


def ranked(rows: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """The ``best`` rows with the smallest score, ties by place."""
    if best < len(rows):
        cut = np.partition(score, best)[best]
        at = np.flatnonzero(score <= cut)
        rows, score = rows[at], score[at]
    return rows[np.argsort(score, kind="stable")[:best]]


def fill(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start in it, length, sequence, offset) that use every id of every row once.

    A seed, the longest row that is left, is followed by its unused neighbours by score; the one that does
    not fit is cut, and its rest seeds the next sequence. Only the last sequence of a shard is not full.
    """
    index = Index(docs, idf, mean_length)
    left = np.array([len(d) for d in docs])
    at = np.zeros(len(docs), np.int64)
    todo = np.argsort(-left, kind="stable").tolist()[::-1]
    out: list[tuple[int, int, int, int, int]] = []
    sequence, cut, unused = 0, -1, np.ones(len(docs), bool)
    while True:
        while todo and not unused[todo[-1]]:
            todo.pop()
        if cut < 0 and not todo:
            return out
        seed = cut if cut >= 0 else todo.pop()
        order = None
        offset, k, row, cut = 0, 0, seed, -1
        while row >= 0:
            n = int(min(left[row], LENGTH - offset))
            out.append((row, int(at[row]), n, sequence, offset))
            unused[row] = False
            left[row] -= n
            at[row] += n
            offset += n
            if left[row]:
                cut = row
                break
            if offset == LENGTH:
                break
            if order is None or k == len(order) < n_left:
                if order is None:
                    others = np.flatnonzero(unused)
                    score, n_left, best = -index.scores(seed)[others], len(others), 64
                order = ranked(others, score, best)
                best *= 16
            row, k = (int(order[k]), k + 1) if k < len(order) else (-1, k)
        sequence += 1


def hashed(idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, signed weight) of each term in the vectors of texts; the weight is the square of what it tells."""
    h = np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(41)).astype(np.int64) % PLACES, np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0) * idf**2


def vector(ids: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vector of a text: its terms' weights added up in their places."""
    out = np.bincount(place[ids], weight[ids], PLACES)
    return (out / (np.linalg.norm(out) + 1e-9)).astype(np.float32)


def clusters(vectors: np.ndarray, n: int) -> np.ndarray:
    """Centres of n clusters of unit vectors, by ROUNDS of spherical k-means from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, n).astype(int)]
    for _ in range(ROUNDS if n > 1 else 0):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(own, vectors[:, j], n) for j in range(vectors.shape[1])], axis=1)
        centres = np.where(np.bincount(own, minlength=n)[:, None] > 0, sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9), centres).astype(np.float32)
    return centres


def sharded(rests: DataFrame, n: int, idf) -> DataFrame:
    """Adds shard to rests (row, ids): rows that speak of the same are together, SHARD_ROWS of them at most.

    Clusters are fitted on a bounded sample, by hash; every row goes to the nearest centre. A cluster that holds more
    than a shard may, for instance of a frequent language or once CLUSTERS are too few, is cut by hash.
    """
    spark = rests.sparkSession
    part = int(min(1.0, SAMPLE / max(1, n)) * 2**31)

    def vectors_of(batches):
        terms = hashed(idf.value[0])
        for batch in batches:
            out = [vector(np.frombuffer(x, np.uint16), *terms) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([v.tobytes() for v in out], pa.binary())], ["row", "v"])

    sample = rests.where(F.pmod(F.xxhash64("row"), F.lit(2**31)) <= part).mapInArrow(vectors_of, "row long, v binary")
    vectors = np.array([np.frombuffer(r.v, np.float32) for r in sample.orderBy(F.xxhash64(F.lit(5), "row"), "row").limit(SAMPLE).collect()], np.float32).reshape(-1, PLACES)
    centres = spark.sparkContext.broadcast(clusters(vectors, int(np.clip(n * 2 // SHARD_ROWS, 1, min(CLUSTERS, max(1, len(vectors)))))) if len(vectors) else np.zeros((1, PLACES), np.float32))

    def assign(batches):
        terms = hashed(idf.value[0])
        for batch in batches:
            if batch.num_rows:
                v = np.stack([vector(np.frombuffer(x, np.uint16), *terms) for x in batch.column("ids").to_pylist()])
                yield batch.append_column("cluster", pa.array((v @ centres.value.T).argmax(axis=1).astype(np.int32)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema)
    rows = stored(rests.mapInArrow(assign, f"{schema}, cluster int"))
    parts = rows.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
    out = rows.join(F.broadcast(parts), "cluster")
    return out.withColumn("shard", F.col("cluster").cast("long") * (1 << 24) + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("cluster", "parts")


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): pieces that hold every id of every text once.

    A null text counts as empty: its one id is the end. Whole windows of long documents are sequences of their
    own; what is left of documents is dealt to shards by content, each with its own index under the document
    frequencies of all documents. Ids are integers; repeated rows are packed each, null ids stay null.
    """
    rows = bounded(docs).select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokens = stored(rows.mapInArrow(tokenise, TOKENS).withColumn("row", F.monotonically_increasing_id()))
    pieces, rests = tokens.where("length is not null and ids is null"), tokens.where("ids is not null")
    stats = rests.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    total = tokens.where("start = 0").count()
    df = np.zeros(IDS)
    for r in tokens.where("df is not null").select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).where("n > 0").collect():
        df[r.pos] = r.n
    idf = np.maximum(0, np.log((total - df + 0.5) / (df + 0.5)))
    held = rows.sparkSession.sparkContext.broadcast((idf, stats.mean or 1.0))

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        ids = [np.frombuffer(x, np.uint16) for x in pdf["ids"]]
        found = fill(ids, *held.value)
        row = np.array([f[0] for f in found])
        own = pdf.iloc[row].reset_index(drop=True)
        at, n, seq, offset = (np.array([f[k] for f in found], np.int64) for k in range(1, 5))
        sums = [crc(ids[r][a : a + m]) for r, a, m in zip(row.tolist(), at.tolist(), n.tolist())]
        return pd.DataFrame({"doc_id": own["doc_id"], "start": own["start"] + at, "length": n, "ids_crc32": sums, "doc_tokens": own["doc_tokens"], "sequence_id": ((int(key[0]) << 14) + seq) * 2 + 1, "offset": offset})

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = sharded(rests.select("row", "doc_id", "start", "doc_tokens", "ids"), stats.n, held).groupBy("shard").applyInPandas(pack_shard, out)
    whole = pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(packed).withColumnRenamed("doc_id", id)
