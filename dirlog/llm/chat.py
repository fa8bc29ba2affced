"""Chat formatting on token level: segments encoded apart, reserved ids spliced in, loss masks by prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded

#: Control strings of the template and the reserved ids that stand for them, after the vocabulary's own.
START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50_257, 50_258
#: Tokens after which a long conversation goes on in a further row.
PART = 65_536
#: The id of a line feed, which ends a turn.
NEWLINE = [198]

#: Anything that could be read as the opening of a control string, with the marks already put in.
OPENING = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash between < and | more: no control string is left; ``unescape`` takes it off again."""
    return OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def read_role(line: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(line))


@lru_cache(1)
def codec() -> tiktoken.Encoding:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_turns(batches):
    """Each turn's segments (role line, escaped text) as ids, apart from each other; rows stay where they are."""
    code = codec()
    for batch in batches:
        roles = [code.encode_ordinary(role_line(r or "")) for r in batch.column("role").to_pylist()]
        texts = [code.encode_ordinary(escape(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array([r == "assistant" for r in batch.column("role").to_pylist()]), pa.array(roles, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int32()))],
            ["conv_id", "turn", "learned", "role_ids", "text_ids"],
        )


def assemble(batches):
    """Turns sorted by conversation come in; token sequences with loss spans go out, long ones in parts.

    The ids of a part are its segments laid end to end; the prefix sums of the segments' lengths say where
    each begins, and those of learned texts are the loss spans.
    """
    key, part, done, turns = object(), 0, 0, []

    def flush(last: bool):
        lengths = np.array([n for _, r, t in turns for n in (1, len(r), len(t), 1, 1)], np.int64)
        ends = np.cumsum(lengths)
        ids = np.empty(int(ends[-1]), np.int32)
        pieces = [x for _, r, t in turns for x in ([START_ID], r, t, [END_ID], NEWLINE)]
        np.concatenate([np.asarray(x, np.int32) for x in pieces], out=ids)
        text_ends = ends[2::5]
        spans = [(int(e - n), int(e)) for (learned, _, _), e, n in zip(turns, text_ends, lengths[2::5]) if learned and n]
        return key, part, done, len(turns), ids, [a for a, _ in spans], [b for _, b in spans], last

    out: list[tuple] = []
    held, waiting = 0, 0
    for batch in batches:
        for conv, learned, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "learned", "role_ids", "text_ids"))):
            if turns and (conv != key or held >= PART):
                out.append(flush(conv != key))
                waiting += held
                part, done, turns, held = (part + 1, done + held, [], 0) if conv == key else (0, 0, [], 0)
            if waiting > 16 * PART:
                yield as_batch(out)
                out, waiting = [], 0
            key = conv
            turns.append((learned, role, text))
            held += 3 + len(role) + len(text)
    if turns:
        out.append(flush(True))
    yield as_batch(out)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 8
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "first_token", "n_turns", "ids", "loss_starts", "loss_ends", "is_last"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, first_token, n_turns, ids, loss_starts, loss_ends, is_last) of conversations given by turns.

    turns: conv_id, turn, role, text. Null texts and roles count as empty, a null turn comes first, ties go
    by the ids of role and text, repeated rows stay; rows with a null conv_id make one conversation. Texts are encoded
    where the rows lie; a conversation is then read in order, one turn at a time, and written in parts of
    about PART tokens, so no task holds a whole long one.
    """
    rows = bounded(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    coded = rows.mapInArrow(encode_turns, "conv_id long, turn long, learned boolean, role_ids array<int>, text_ids array<int>")
    sorted_rows = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    return sorted_rows.select("conv_id", "learned", "role_ids", "text_ids").mapInArrow(assemble, "conv_id long, part int, first_token long, n_turns int, ids array<int>, loss_starts array<int>, loss_ends array<int>, is_last boolean")


def turns_of(ids: np.ndarray) -> Iterator[tuple[str, str]]:
    """(role, text as escaped) of every turn, read from the reserved ids and the ids between them."""
    code = codec()
    for a, b in zip(np.flatnonzero(ids == START_ID).tolist(), np.flatnonzero(ids == END_ID).tolist()):
        role, _, text = code.decode(ids[a + 1 : b].tolist()).partition("\n")
        yield role, text


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its stored sequences say: turns, text under the loss mask, formatted length.

    Takes the result of ``format_conversations`` in its order (parts of a conversation follow each other).
    """

    def read(batches):
        code = codec()
        rows: list[tuple] = []
        n, chars, loss_chars, every, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv, ids, starts, ends, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_starts", "loss_ends", "is_last"))):
                ids = np.array(ids, np.int64)
                for role, text in turns_of(ids):
                    n += 1
                    chars += len(START) + len(role) + 1 + len(text) + len(END) + 1
                    every.update(f"{read_role(role)}\n{unescape(text)}\n".encode())
                for a, b in zip(starts, ends):
                    text = unescape(code.decode(ids[a:b].tolist()))
                    loss_chars += len(text)
                    loss.update(text.encode())
                if last:
                    rows.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n, chars, loss_chars, every, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                rows = []

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
