"""Periodic runs against every pair of word and period, and the query against a plain version of its contract."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from dirlog.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, least=6):
    """Each period from the shortest on, word by word; a stretch belongs to its smallest period."""
    found, names = {}, {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    for q in range(1, len(words) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids[q:] == ids[:-q], [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start + q >= max(least, exponent * q):
                found.setdefault((start, end - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc, text, plant):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *first, 1000 * first[1] // first[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(4000):
        n = rng.randint(0, 70)
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, a = rng.randint(1, 8), rng.randrange(n)
            for i in range(a + p, n):
                words[i] = words[i - p]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(n)] = "z"
        assert periodic.runs_of(words) == plain_runs(words), words


def test_long_texts_take_little_more_than_their_length():
    rng, start = random.Random(4), time.time()
    assert periodic.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of(list("ab") * 100_000) == [(0, 200_000, 2)]
    periodic.runs_of([rng.randint(0, 3) for _ in range(100_000)])
    assert time.time() - start < 60


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_text(queries.op12_periodic_runs(spark, SF).collect())
    assert got == by_text(plain_row(r.doc_id, r.text, True) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a " * 6, "a b\x0bc\x0c" * 9 + "   ", "日 本 " * 8, "x " * 5_000, "a b " * 5 + "c " * 7]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(4, texts[4]), (4, texts[4]), (None, texts[5]), (10**15, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "n_words", "words", "g", "n", "a", "p", "id")})
    for plant in (False, True):
        found = periodic.digest(periodic.find_runs(periodic.looped(docs) if plant else docs))
        assert by_text(found.collect()) == by_text(plain_row(*r, plant) for r in rows)
    assert periodic.digest(periodic.find_runs(periodic.looped(docs.limit(0)))).count() == 0
