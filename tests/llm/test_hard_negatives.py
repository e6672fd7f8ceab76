"""Hard negatives: the pruned index and the operator against plain loops, and the query against SQL."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickflow.llm import catalog, hard_negatives
from wickflow.llm.hard_negatives import PrunedIndex, find_negatives, find_positives


def brute(rows, asks, positives=5, negatives=5, low=80, high=100):
    good = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in good:
        if not asks(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in good if b[0] != a[0])
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            inside = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    cells = [(i, v, label, 0.5, 3) for i, v, label in rows]
    return spark.createDataFrame(cells, "vec_id long, embedding array<float>, label int, score double, `query_id` int").repartition(3)


def shown(found):
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def rows_of(seed, n=500, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dims))
    rows = [(i, (centres[i % 9] + (i % 4) * rng.standard_normal(dims)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 2) for i in range(40)]  # one vector in two labels, many times
    odd = [None, [], [0.0] * dims, [1.0, None], [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [2.0], [-x for x in rows[0][1]]]
    rows += [(1000 + 10 * k, v, 1) for k, v in enumerate(odd)] + [(1100, rows[3][1], None), (None, rows[3][1], 1), rows[7], (20, rows[9][1], 2), (1120, [1e5] * dims, 77)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, seed):
    rows = rows_of(seed)
    want = brute(rows, lambda i: i % 20 == 0)
    assert shown(hard_negatives.mine(frame(spark, rows), "vec_id % 20 = 0")) == want and len(want) > 200


def test_other_limits_and_empty_tables(spark):
    rows = rows_of(3, 80, 3, 2)
    got = hard_negatives.mine(frame(spark, rows), "vec_id < 30", positives=2, negatives=7, low=50, high=90)
    assert shown(got) == brute(rows, lambda i: i < 30, 2, 7, 50, 90)
    assert shown(hard_negatives.mine(frame(spark, rows).limit(0), "true")) == []
    assert shown(hard_negatives.mine(frame(spark, rows), "false")) == []


def test_query_against_sql(spark, tmp_path):
    rows = [(i, v, label and label % 10) for i, v, label in rows_of(4, 900, 8, 10) if i is not None and v and len(v) == 8]
    rows = list({r[0]: r for r in rows}.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = catalog.op13_hard_negatives(spark, str(tmp_path)), con.execute(catalog.oracle_sql()["op13_hard_negatives"])
    assert [c[0] for c in want.description] == got.columns
    assert shown(got) == sorted(want.fetchall()) and got.count() > 50


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 8, 20, 33]), st.sampled_from([0.0, 0.3, 0.7, 0.95]), st.sampled_from([1, 300, 10**9]))
def test_pruned_index_finds_all(seed, dims, share, size):
    rng = np.random.default_rng(seed)
    weights = rng.random(dims) ** 3
    rows = (rng.standard_normal((50, dims)) * weights * size).astype(np.int64)
    asked = np.vstack([rows[:5], (rng.standard_normal((4, dims)) * size).astype(np.int64)])
    full = asked.astype(object) @ rows.T.astype(object)
    least = np.array([share * max(full[k]) - (share == 0) for k in range(len(asked))], np.float64)
    index = PrunedIndex(rows)
    a, y, scores = index.search(index.fit(asked), least)
    want = {(i, j, full[i, j]) for i in range(len(asked)) for j in range(50) if full[i, j] >= least[i]}
    assert {(int(i), int(j), int(s)) for i, j, s in zip(a, y, scores)} == want and len(a) == len(want)


def test_high_thresholds_leave_dimensions_out():
    rng = np.random.default_rng(5)
    rows = np.round(rng.standard_normal((400, 64)) * 256 * 0.8 ** np.arange(64)).astype(np.int64)
    index = PrunedIndex(rows)
    tails = hard_negatives.suffix_norms(index.fit(rows[:8]))
    deep = index.depths(tails, np.full(8, 1.0))
    shallow = index.depths(tails, 0.9 * tails[:, 0] ** 2)
    assert shallow.mean() < 0.5 * deep.mean() and (shallow <= deep).all()


@pytest.mark.parametrize("seed", range(4))
def test_one_block(seed):
    """Lowered thresholds end with what a plain sort gives, also where a block has few rows or none in the window."""
    rng = random.Random(seed)
    rows = [([rng.randint(-9, 9) for _ in range(5)], [100 + 10 * k + j for j in range(rng.randint(1, 6))], rng.randint(0, 1)) for k in range(rng.choice([1, 5, 60]))]
    anchors = [([rng.randint(-9, 9) for _ in range(5)], q, [rng.randint(-50, 200) for _ in range(3)]) for q in range(6)]
    table = pa.table({"v": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "label": pa.array([r[2] for r in rows], pa.int64())})
    asked = pa.table({"v": pa.array([a[0] for a in anchors], pa.list_(pa.int64())), "query_id": pa.array([a[1] for a in anchors], pa.int64()), "label": pa.array([0] * 6, pa.int64()), "scores": pa.array([a[2] for a in anchors], pa.list_(pa.int64()))})
    positives, negatives = [], []
    for v, q, scores in anchors:
        every = sorted((-sum(x * y for x, y in zip(v, r[0])), i, r[2]) for r in rows for i in r[1])
        positives += [(q, -s, i) for s, i, _ in every[:6]]
        for p in set(scores):
            negatives += [(q, p, -s, i) for s, i, label in [x for x in every if x[2] and 80 * p <= -100 * x[0] <= 100 * p][:5]]
    assert sorted(tuple(r.values()) for r in find_positives(6, asked, table).to_pylist()) == sorted(positives)
    assert sorted(tuple(r.values()) for r in find_negatives(5, 80, 100, asked, table).to_pylist()) == sorted(negatives)
