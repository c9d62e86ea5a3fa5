"""What the vector join sends, and that its product in single precision decides nothing."""

import numpy as np
import pytest

from ledgerlens.llm import grid_join


def brute_links(x):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    return ((u @ u.T >= 0.95).sum(1) - 1).tolist()


@pytest.mark.parametrize("block,many", [(32, 3), (512, 60)])
def test_no_block_is_shuffled(spark, monkeypatch, block, many):
    """Small blocks with few links, and a dense group: blocks are written once and read by the tasks that compare them."""
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(600 // many, 24)), many, 0) + rng.normal(size=(600, 24)) * 0.1).astype(np.float32)
    seen, write = [], grid_join.materialize
    monkeypatch.setattr(grid_join, "materialize", lambda df: seen.append(df) or write(df))
    monkeypatch.setattr(grid_join, "BLOCK", block)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in grid_join.near_duplicates(df).collect()}
    assert [got[i] for i in range(600)] == brute_links(x.astype(np.float64)) and sum(got.values()) > 600
    links = next(df for df in seen if df.columns == ["rep", "links", "root"])
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan


def test_links_at_the_bound_are_decided_in_double_precision(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        u, w = np.linalg.qr(rng.normal(size=(40, 2)))[0].T
        cos = 0.95 + (1 if i % 2 else -1) * 10.0 ** -(7 + i % 4)
        rows += [u * 3, (cos * u + np.sqrt(1 - cos * cos) * w) * 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in grid_join.near_duplicates(df).collect()}
    assert [got[i] for i in range(120)] == [i // 2 % 2 for i in range(120)]
