"""Token counts without shuffling pre-tokens: a broadcast table of frequent lengths, then worker caches.

The vocabulary is a SentencePiece BPE model whose normaliser is the identity and of whose pieces none
holds the word mark after another character. Merges therefore never cross the place before a run of
word marks, nor a line feed (no piece holds one), and a text's count is the sum of the counts of such
pre-tokens. ``checked`` refuses a model for which this does not hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded, sized

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*|[^{MARK}\n]+")
#: Entries of the broadcast table, of each task's summary, of a worker's cache, characters cut at once.
FREQUENT, SUMMARY, CACHE, CHUNK = 65_536, 8_192, 200_000, 1_000_000


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def checked(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, if its counts add up over pre-tokens."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) or model.normalize(" a  b\n ") != f"{MARK}{MARK}a{MARK}{MARK}b\n{MARK}":
        raise ValueError(f"{path}: counts of pre-tokens do not add up to those of whole texts")
    return model


def parts(text: str) -> Iterator[str]:
    """The marked text in parts of bounded size that begin at pre-tokens."""
    text, at = MARK + text.replace(" ", MARK), 0
    while at < len(text):
        end = at + CHUNK
        while 0 < end < len(text) and not (text[end] == MARK and text[end - 1] != MARK):
            end = text.find(MARK, end + 1)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def lengths(model: sentencepiece.SentencePieceProcessor, pre: list[str]) -> list[int]:
    """The library adds one mark before a text, but to an empty one: taken off where the pre-token begins with its own."""
    marked = [p[0] == MARK for p in pre]
    got = model.encode([p[m:].replace(MARK, " ") if m else p if p[0] == "\n" else "\n" + p for p, m in zip(pre, marked)], num_threads=1)
    return [1 if p == MARK else len(ids) - (0 if m else 1 if p[0] == "\n" else 2) for ids, p, m in zip(got, pre, marked)]


def frequent(docs: DataFrame, text: str, n: int) -> list[str]:
    """The n most frequent pre-tokens of all texts, by bounded summaries of each task (they only steer speed)."""

    def summary(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in parts(t or ""):
                    seen.update(PRE_TOKEN.findall(part))
                    if len(seen) > 32 * SUMMARY:
                        seen = Counter(dict(seen.most_common(8 * SUMMARY)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_pydict({"pre": pa.array([k for k, _ in top], pa.string()), "n": pa.array([v for _, v in top], pa.int64())})

    found = docs.select(text).mapInArrow(summary, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return [r.pre for r in found.orderBy(F.desc("n"), "pre").limit(n).collect()]


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 4096, path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty, 0 tokens.

    Rows are not grouped: repeated rows come back repeated, a null id stays null, other columns are
    ignored. Counts equal the library's on the whole text, without begin or end tokens.
    """
    path, docs = path or model_path(), bounded(docs)
    pre = [p for p in frequent(docs, text, FREQUENT) if "\0" not in p]
    lens = lengths(checked(path), pre) if pre else []
    known = docs.sparkSession.sparkContext.broadcast(("\0".join(pre), np.array(lens, np.uint32)))

    def count(batches):
        model, (keys, lens) = checked(path), known.value
        table = dict(zip(keys.split("\0"), lens.tolist()))
        cache = dict(table)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[int] = []
            for block in sized(texts):
                found = [[PRE_TOKEN.findall(p) for p in parts(t)] if t else [] for t in texts[block]]
                seen = {p for f in found for part in f for p in part}
                if len(cache) + len(new := seen.difference(cache)) > len(table) + CACHE:
                    cache = dict(table)
                    new = seen.difference(cache)
                if new := list(new):
                    cache.update(zip(new, lengths(model, new)))
                get = cache.__getitem__
                out += [sum(sum(map(get, part)) for part in f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    counted = docs.select(id, text).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
