"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further tokens.

Tokens are tagged O (outside), B (begin) or I (inside) from their shape, their own word, the words beside
them and a class of the whole text; sequences are lines, decoded by Viterbi. The field is trained on a bounded
sample of documents in which what the fixed patterns find is the truth.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import bounded, stored

# Fixed values of the contract: kinds in order, patterns, and least lengths of what the last group matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
#: A text without a match of this holds no fixed secret; for the vectorised first look.
LOOK = r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|(?i:passw|secret|token|api_?key)"

#: Documents trained on, half of them with fixed secrets; tokens kept on each side; words known; steps; penalty.
SAMPLE, AROUND, WORDS, STEPS, PENALTY = 2000, 8, 256, 120, 0.02
CACHE = 200_000
#: Documents that are looked through for training texts, for each of SAMPLE; characters of a training text at most.
LOOKED_AT, TEXT = 64, 20_000
#: Words of the fixed patterns, marks beside values, words that stand in for both, and characters of made-up values.
KEY_WORD, MARKS = re.compile(r"(?i)passw(?:or)?d|secret|token|api_?key|api"), {"=", ":", '"', "'"}
OTHER_WORDS, VALUES = ("see", "value", "given", "the", "note", "is"), (string.ascii_letters + string.digits, string.hexdigits[:16])
TOKEN = re.compile(r"\n|[\w+/.\-]+|[^\w\s+/.\-]")

Span = tuple[int, int, int, int]  # start, end, index of the kind, start of the secret value


def fixed(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind; ordered by start, then kind."""
    out = [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Classes of tokens: line ends, marks, plain words by case, then what digits, capitals, small letters and signs make up.
LINE, MARK, WORD, UPPER, MIXED, OTHER = range(6)
#: Values of each part of a shape: class, length, changes between digits and others, variety of characters.
PARTS = (OTHER + 16, 7, 4, 4)


def shape(token: str) -> int:
    """The parts of a token's shape as one number below the product of PARTS."""
    if token == "\n":
        return LINE * 112
    if len(token) == 1 and not token.isalnum():
        return MARK * 112
    digits, upper = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    if not digits and len(token) < 20 and token.replace(".", "").isalpha():
        return (WORD if upper <= 1 else UPPER if upper == len(token) else MIXED) * 112
    letters = sum(c.isalpha() for c in token)
    kind = OTHER + (digits > 0) + 2 * (upper > 0) + 4 * (letters > upper) + 8 * (digits + letters < len(token))
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())
    length = sum(len(token) > n for n in (3, 7, 11, 15, 23, 31))
    return ((kind * 7 + length) * 4 + sum(changes > n for n in (1, 4, 8))) * 4 + sum(entropy > n for n in (2, 3, 3.6))


def parts_of(shapes: np.ndarray) -> list[np.ndarray]:
    return list(np.unravel_index(shapes, PARTS))


def file_class(tokens: list[str]) -> int:
    """0 to 3 by the share of tokens that assign or hold digits."""
    n = sum(t in ("=", ":") or t[0].isdigit() for t in tokens)
    return int(np.searchsorted([0.002, 0.02, 0.1], n / max(1, len(tokens))))


class Field:
    """Weights of the field: parts of the shape, own word, word before, word after, file (each x 3 tags), steps between tags."""

    def __init__(self, words: dict[str, int], weights: dict[str, np.ndarray]):
        self.words, self.weights = words, weights
        self.form = sum(weights[f"part{i}"][p] for i, p in enumerate(parts_of(np.arange(math.prod(PARTS)))))
        self.known: dict[str, int] = {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        """Shape and word of each token in one number; a word that is not known is 0."""
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set(tokens)
        n = len(self.words) + 1
        self.known.update((t, shape(t) * n + self.words.get(t.lower(), 0)) for t in new)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens))

    def scores(self, codes: np.ndarray, file: int) -> np.ndarray:
        """Tokens x 3: of each tag from the token and its neighbours."""
        w = self.weights
        form, word = np.divmod(codes, len(self.words) + 1)
        out = self.form[form] + w["own"][word] + w["file"][file]
        out[1:] += w["before"][word[:-1]]
        out[:-1] += w["after"][word[1:]]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Token runs tagged as secret. A line is decoded only where some token could be worth tagging at all.

        A run tagged B or I gains at most the sum of its tokens' gains over O, each with the best step, and the
        best way out; if no token of a line has a positive such gain, its best tagging is all O.
        """
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        codes = self.codes(tokens)
        scores, step = self.scores(codes, 0), self.weights["step"]
        scores += (self.weights["file"].max(axis=0) - self.weights["file"][0])[None]
        spare = self.weights["file"][:, 0].max() - self.weights["file"][:, 0].min()
        bonus = max(0.0, step[:, 1:].max() - step[0, 0]) + max(0.0, step[1:, 0].max() - step[0, 0]) + spare
        hot = np.flatnonzero(scores[:, 1:].max(axis=1) - scores[:, 0] + bonus > 0)
        if not len(hot):
            return []
        scores = self.scores(codes, file_class(tokens))
        places = [m.span() for m in TOKEN.finditer(text)]
        breaks = np.concatenate(([-1], np.flatnonzero(np.fromiter((t == "\n" for t in tokens), bool, len(tokens))), [len(tokens)]))
        out = []
        for line in np.unique(np.searchsorted(breaks, hot) - 1).tolist():
            a, b = int(breaks[line]) + 1, int(breaks[line + 1])
            start = -1
            for i, tag in enumerate([*viterbi(scores[a:b], step), 0], a):
                if start >= 0 and tag != 2:
                    out.append((places[start][0], places[i - 1][1]))
                    start = -1
                if tag and start < 0:
                    start = i
        return out


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """The best tags of one sequence; I follows B or I only, by the weights of the steps."""
    if not len(scores):
        return []
    best, back = scores[0] + [0, 0, -1e9], []
    for s in scores[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + s
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def examples(texts: list[str]) -> list[tuple[list[str], list[int], int]]:
    """(tokens, tags, class of the text) of the tokens around each fixed secret and each token that is no plain word."""
    out = []
    for text in texts:
        places = [m.span() for m in TOKEN.finditer(text)]
        tokens = [text[a:b] for a, b in places]
        tags = np.zeros(len(tokens), np.int64)
        starts = np.array([a for a, _ in places], np.int64)
        for _, end, _, value in fixed(text):
            inside = np.arange(np.searchsorted(starts, value), np.searchsorted(starts, end))
            tags[inside] = 2
            tags[inside[:1]] = 1
        near = np.zeros(len(tokens) + 1, np.int64)
        for i in np.flatnonzero((tags > 0) | np.fromiter((len(t) > 1 and not t.isalpha() for t in tokens), bool, len(tokens))).tolist():
            near[max(0, i - AROUND)] += 1
            near[min(len(tokens), i + AROUND + 1)] -= 1
        on = np.concatenate(([0], np.cumsum(near[:-1]) > 0, [0])) * 1
        on[1:-1][np.fromiter((t == "\n" for t in tokens), bool, len(tokens))] = 0
        edge = np.flatnonzero(np.diff(on))
        file = file_class(tokens)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            for c in range(a, b, 4 * AROUND):
                out.append((tokens[max(0, c - 1) : min(b, c + 4 * AROUND) + 1], tags[c : min(b, c + 4 * AROUND)].tolist(), c > 0, file))
    return out


def disguised(example: tuple, rng: random.Random) -> tuple:
    """The example as it stands, or without its key word, its marks of assignment or its own value.

    What the fixed patterns find always stands beside one of their words and looks alike. So that the field learns more
    than those, four fifths of the examples have ordinary words instead of the key words, half of these instead of
    marks and quotes too, and half of them values drawn anew: other lengths, all letters and digits or hexadecimal ones.
    """
    tokens, tags, led, file = example
    how = rng.randrange(5)
    if not how or not any(tags):
        return example
    tagged = [0] * led + tags + [0] * (len(tokens) - led - len(tags))
    beside = {i + d for i, tag in enumerate(tagged) if tag for d in range(-4, 3)}
    out = []
    for i, (t, tag) in enumerate(zip(tokens, tagged)):
        if tag and len(t) >= 12 and how % 2 == 0:
            t = "".join(rng.choices(rng.choice(VALUES), k=rng.randrange(16, 45)))
        elif not tag and (KEY_WORD.fullmatch(t) or how > 2 and i in beside and t in MARKS):
            t = rng.choice(OTHER_WORDS)
        out.append(t)
    return out, tags, led, file


def train(texts: list[str]) -> Field | None:
    """Maximum likelihood with a quadratic penalty, by forward-backward over all examples at once; None without secrets."""
    found = examples(texts)
    if not any(any(tags) for _, tags, _, _ in found):
        return None
    quiet, rng = [e for e in found if not any(e[1])], random.Random(0)
    found = [disguised(e, rng) for e in found if any(e[1])][:SAMPLE] + quiet[:: max(1, len(quiet) // SAMPLE)]
    near = Counter()
    for tokens, tags, led, _ in found:
        for i, tag in enumerate(tags):
            if tag:
                near.update(t.lower() for t in tokens[max(0, i + led - 2) : i + led + 2] if len(t) < 16 and not any(c.isdigit() for c in t))
    common = sorted((w for w, n in near.items() if n >= 3), key=lambda w: (-near[w], w))[:WORDS]
    words = {w: i for i, w in enumerate(common, 1)}
    longest, count = max(len(e[1]) for e in found), len(found)
    size = {f"part{i}": n for i, n in enumerate(PARTS)} | {"own": len(words) + 1, "before": len(words) + 1, "after": len(words) + 1, "file": 4}
    at = {k: np.zeros((count, longest), np.int64) for k in size}
    gold, mask = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for e, (tokens, tags, led, file) in enumerate(found):
        n, led = len(tags), int(led)
        word = [words.get(t.lower(), 0) for t in tokens]
        own = tokens[led : led + n]
        for i, part in enumerate(parts_of(np.array([shape(t) for t in own]))):
            at[f"part{i}"][e, :n] = part
        at["own"][e, :n] = word[led : led + n]
        at["before"][e, 1 - led : n] = word[: led + n - 1]
        at["after"][e, : len(word) - led - 1][: n] = word[led + 1 : led + 1 + n]
        at["file"][e] = file
        gold[e, :n], mask[e, :n] = tags, True
    w = {k: np.zeros((n, 3)) for k, n in size.items()} | {"step": np.zeros((3, 3))}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    barred = np.zeros((3, 3))
    barred[0, 2] = -1e9
    for t in range(1, STEPS + 1):
        scores = sum(w[k][at[k]] for k in size)
        step = w["step"] + barred
        forward = [scores[:, 0] + [0, 0, -1e9]]
        for i in range(1, longest):
            new = np.logaddexp.reduce(forward[-1][:, :, None] + step, axis=1) + scores[:, i]
            forward.append(np.where(mask[:, i, None], new, forward[-1]))
        total = np.logaddexp.reduce(forward[-1], axis=1)
        grad = {k: np.zeros_like(x) for k, x in w.items()}
        after, slip = np.zeros((count, 3)), np.zeros((count, longest, 3))
        for i in range(longest - 1, -1, -1):
            on = mask[:, i]
            p = np.exp(forward[i] + after - total[:, None])
            p[np.arange(count), gold[:, i]] -= 1
            p[~on] = 0
            slip[:, i] = p
            if i:
                way = np.exp(forward[i - 1][:, :, None] + step + (scores[:, i] + after)[:, None, :] - total[:, None, None])
                grad["step"] += way[on].sum(axis=0)
                np.subtract.at(grad["step"], (gold[on, i - 1], gold[on, i]), 1)
                after = np.where(on[:, None], np.logaddexp.reduce(step + (scores[:, i] + after)[:, None, :], axis=2), after)
        for k, n in size.items():
            grad[k] = np.stack([np.bincount(at[k].ravel(), slip[:, :, y].ravel(), n) for y in range(3)], axis=1)
        for k in w:
            g = grad[k] + PENALTY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    w["step"] = w["step"] + barred
    return Field(words, w)


def likely(text: Column) -> Column:
    return text.rlike(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|(?i:passw(?:or)?d|secret|token|api_?key)[\"']? *[:=]")


def training_texts(docs: DataFrame, id: str, text: str, sample: int) -> list[str]:
    """Up to ``sample`` texts by a hash of the id, half of them likely to hold fixed secrets, of TEXT characters at most.

    They are sought among LOOKED_AT times as many documents, again by hash, so that on large data few texts are
    looked at; the texts themselves are read once it is known which.
    """
    n = docs.count()
    if not n:
        return []
    part = int(min(1.0, LOOKED_AT * sample / n) * 2**31)
    rows = docs.select(F.xxhash64(F.lit(3), id).alias("h"), F.col(text).cast("string").alias("t")).where((F.pmod("h", F.lit(2**31)) < part) & F.length("t").between(1, TEXT))
    seen = stored(rows.select("h", likely(F.col("t")).alias("y")))
    chosen = [r.h for y in (True, False) for r in seen.where(F.col("y") == y).select("h").distinct().orderBy("h").limit(max(1, sample // 2)).collect()]
    wanted = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
    return [r.t for r in rows.join(F.broadcast(wanted), "h").orderBy("h", "t").limit(sample).collect()]


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, secrets array<struct<start, end, kind, value>>) of every row, ordered by start, then kind.

    Code points, end exclusive; value is where the secret itself begins. The fixed patterns' spans are all
    there; spans of the field that touch none of them are added as kind crf. Null texts have no secrets.
    ``sample`` bounds the documents that the field is trained on; without secrets among them nothing is added.
    """
    scan = scanner(docs, id, text, sample)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.int64())])

    def find(batches):
        for ids, texts, spans in scan(batches, 1):
            found = [[{"start": s, "end": e, "kind": KINDS[k], "value": at} for s, e, k, at in row] for row in spans]
            yield pa.RecordBatch.from_arrays([ids.column(0), pa.array(found, pa.list_(span))], ["id", "secrets"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(find, f"id {kind}, secrets array<struct<start:long,end:long,kind:string,value:long>>").withColumnRenamed("id", id)


def scanner(docs: DataFrame, id: str, text: str, sample: int):
    """A function for tasks: (batches, place of the text) to (batch, texts, spans of each)."""
    field = train(training_texts(bounded(docs), id, text, sample))
    held = docs.sparkSession.sparkContext.broadcast((field.words, field.weights) if field else None)

    def scan(batches, place: int):
        model = Field(*held.value) if held.value else None
        for batch in batches:
            texts = batch.column(place).to_pylist()
            look = pc.match_substring_regex(batch.column(place), LOOK).to_pylist()
            yield batch, texts, [spans_of(t or "", bool(first), model) for t, first in zip(texts, look)]

    return scan


def spans_of(text: str, first: bool, model: Field | None) -> list[Span]:
    """Fixed spans (none without the first look's match) and those of the field that touch none of them, in order."""
    base = fixed(text) if first else []
    more = [(a, b, 3, a) for a, b in model.spans(text) if not any(a < e and s < b for s, e, _, _ in base)] if model else []
    return sorted(base + more, key=lambda x: (x[0], x[2]))


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with every secret value in the text replaced by ``mark``; other columns stay, null texts too."""
    scan, place = scanner(docs, id, text, sample), docs.columns.index(text)

    def clean(batches):
        for batch, texts, spans in scan(batches, place):
            out = []
            for t, found in zip(texts, spans):
                at, kept = 0, []
                for start, end in sorted((value, end) for _, end, _, value in found):
                    if end > at:
                        kept += [t[at : max(at, start)], mark if start >= at else ""]
                        at = end
                out.append("".join([*kept, t[at:]]) if found else t)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, pa.string()))

    return docs.mapInArrow(clean, docs.schema)


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of spans: n_assign, n_access, n_hex, n_crf, base_sha256, spans."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("secrets", lambda s: s["kind"] != "crf"), written), ",")
    names = [c for c in found.columns if c != "secrets"]
    return found.select(*names, *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("secrets", written), ",").alias("spans"))
