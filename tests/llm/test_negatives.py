"""Hard negatives against SQL over all pairs, and each level of the threshold join against the plain scores."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dirlog.llm import negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_sql(embeddings, anchors=100):
    con = duckdb.connect()
    con.register("embeddings", embeddings) if not isinstance(embeddings, str) else con.sql(f"create view embeddings as from '{embeddings}'")
    return sorted(con.sql(f"select {', '.join(COLUMNS)} from ({negatives.sql(anchors)})").fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, queries.op11_hard_negatives(spark, f"/root/testdata/{sf}").select(COLUMNS).collect()))
    assert got and got == by_sql(f"/root/testdata/{sf}/embeddings.parquet")


@pytest.mark.parametrize("skew", [False, True])
@pytest.mark.parametrize("size", [1, 3_000, 3_000_000_000_000])
def test_scores_known_at_each_threshold(size, skew):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(300, 37)) * (0.8 ** np.arange(37) if skew else 1) * 60 * np.sqrt(size)
    both = negatives.stacked(pd.Series(list(np.floor(x).astype(np.int64))))
    a, y = both[:50], both[50:]
    plain = np.array([[sum(int(p) * int(q) for p, q in zip(u, v)) for v in y] for u in a], dtype=object)
    ra, ry = negatives.suffixes(a), negatives.suffixes(y)
    for tau in (0.5, 0.25, 0.05, 0.0):
        scores, known = negatives.scores_from(a, y, ra, ry, tau * ry[:, 0].max())
        assert all(int(s) == p for s, p in zip(scores[known], plain[known]))
        assert known[plain.astype(float) >= tau * ry[:, 0].max() * ra[:, :1]].all()
        assert not (skew and tau == 0.5) or known.mean() < 0.5


def test_small_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(1).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5], i % 3) for i in range(40)] + [(400 + i, [0.0, 0.0, 0.0], i % 2) for i in range(20)]
    rows += [(500, None, 1), (510, [1.0, None, 1.0], 1), (520, [float("nan"), 1.0, 1.0], 1), (530, [float("inf"), 1.0, 1.0], 2), (540, [1.0, 1.0, 1.0], None), (None, [9.0, 9.0, 9.0], 1), (550, [], 1), (560, [1.0], 1), (570, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("id", "key", "score", "rank", "block", "v")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, relabel=label)
    frame = df.select("vec_id", "embedding", "label").toArrow()
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == by_sql(frame, 10)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [0.5], 2), (1, [0.5], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1, 1, 65536, 32768)] * 2 + [(0, 0, 2, 1, 65536, 32768)] * 2
