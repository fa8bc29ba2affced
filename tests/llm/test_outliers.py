"""Quality rules against plain Python: statistics text by text, estimates in numpy from the same definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from dirlog.llm import outliers, queries

SF = "/root/testdata/sf0.01"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split(outliers.BLANK, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n), len(lines)


def plain_estimate(x):
    floors = np.diag([(f * outliers.UNIT) ** 2 for f in outliers.FLOORS])
    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2) + floors
    distance = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    for _ in range(outliers.STEPS):
        bands = np.floor(np.log(distance() + 1e-9) * outliers.BANDS)
        near = x[bands <= np.sort(bands)[math.ceil(0.75 * len(x)) - 1]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.consistency(0.75) + floors
    near = x[distance() <= outliers.chi_square_at(0.975, 4)]
    mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.consistency(0.975) + floors
    return distance()


def plain_verdicts(docs):
    rows = [(r.doc_id, r.lang, r.source, *plain_statistics(r.text)) for r in docs.collect()]
    groups, out = defaultdict(list), []
    sizes = Counter((r[1], r[2]) for r in rows if not r[3][5])
    for r in rows:
        if r[3][5]:
            out.append((r[0], *r[3], False, None))
        else:
            groups[r[1], ("own", r[2]) if sizes[r[1], r[2]] >= outliers.LEAST_ROWS else "pooled"].append(r)
    cut = math.sqrt(outliers.chi_square_at(1 - 1e-6, 4))
    for own in groups.values():
        x = np.rint([[1024 * math.log(s[1] / s[0]), 1024 * math.sqrt(s[2] / s[1]), 1024 * math.sqrt(s[3] / n), 1024 * math.sqrt(s[4] / s[0])] for *_, s, n in own])
        d = np.sqrt(plain_estimate(x)) if len(own) >= outliers.LEAST_ROWS else [None] * len(own)
        out += [(r[0], *r[3], v is None or v <= cut, v) for r, v in zip(own, d)]
    return sorted(out, key=lambda r: (str(r[0]), r[1:5]))


def same(got, plain):
    got = sorted(map(tuple, got.collect()), key=lambda r: (str(r[0]), r[1:5]))
    assert [r[:8] for r in got] == [r[:8] for r in plain]
    assert all((a[8] is None) == (b[8] is None) and (a[8] is None or abs(a[8] - b[8]) < 1e-6 * (1 + b[8])) for a, b in zip(got, plain))


def test_chi_square():
    # With 2 and 4 degrees there are closed forms.
    assert abs(outliers.chi_square(3.0, 2) - (1 - math.exp(-1.5))) < 1e-12
    assert abs(outliers.chi_square(9.0, 4) - (1 - math.exp(-4.5) * 5.5)) < 1e-12
    assert abs(outliers.chi_square(outliers.chi_square_at(0.975, 4), 4) - 0.975) < 1e-12


def test_query_equals_plain_version(spark):
    same(queries.op13_quality_rules(spark, SF), plain_verdicts(spark.read.parquet(f"{SF}/documents.parquet")))


def test_plan_has_no_python(spark):
    plan = queries.op13_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def made(seed=1):
    """A hot source, a pooled language and one too small to judge, with texts of symbols and of repeated lines among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(4, 9)))
    rows = [(i, clean(), "en", "hot") for i in range(400)] + [(1000 + i, clean(), "de", f"s{i % 3}") for i in range(150)] + [(2000 + i, clean(), None, None) for i in range(30)]
    rows += [(3000 + i, " ".join("#$%" + word() + "|<>" for _ in range(40)), "en", "hot") for i in range(60)] + [(4000 + i, "\n".join([word()] * 3 + [word() for _ in range(4)] * 4) + clean(), "de", "s1") for i in range(9)]
    return rows


def test_planted_outliers_go_and_clean_texts_stay(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in outliers.quality_rules(docs).collect()}
    assert not any(v for k, v in got.items() if k >= 3000)
    assert all(v for k, v in got.items() if k < 3000)
    same(outliers.quality_rules(docs), plain_verdicts(docs))


def test_odd_rows(spark):
    texts = [None, "", " \t\n\x0b", "a", "a " * 19, "a " * 20, "a b c d e f g h " * 2 + "x y " * 30, "日本 語😀 " * 9 + "ü" * 9, "\r\n".join(["one two"] * 12), "#" * 70_000, "w " * 30_000, " ".join(map(str, range(50_000)))]
    rows = [(i, t, [None, "en"][i % 2], ["s", None, "t"][i % 3]) for i, t in enumerate(texts)] + made(2)[:200]
    rows += [rows[5], rows[5], rows[30], rows[30], (None, texts[11], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = docs.withColumns({c: F.lit("clash") for c in ("words", "lines", "n", "x0", "m0", "g_lang", "kept", "n_words", "distance", "rows")})
    same(outliers.quality_rules(clash), plain_verdicts(docs))
    assert outliers.quality_rules(docs.limit(0)).count() == 0
