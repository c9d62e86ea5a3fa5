"""De-duplicated exposure: clusters against union-find, amounts by hand."""

import random

import pytest

from ledgerlens.operators.exposure import cluster_exposure, connected, with_exposure

PAIRS = "row_id_1 string, amount_1 decimal(18,2), row_id_2 string, amount_2 decimal(18,2)"


def roots(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_union_find(spark, seed):
    rng = random.Random(seed)
    n = 80
    edges = [(f"{rng.randrange(n):03d}", f"{rng.randrange(n):03d}") for _ in range(rng.choice([20, 45, 90]))]
    edges = [(a, b) for a, b in edges if a != b]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]   # a long path
    edges += [("hub", f"s{i:03d}") for i in range(60)]
    got = {r["node"]: r["cluster"] for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == roots(edges)


def test_exposure_counts_each_surplus_payment_once(spark):
    # four copies of one payment (six pairs), a pair of near amounts, two negative ones
    from decimal import Decimal as D

    four = [("a1", "100.00"), ("a2", "100.00"), ("a3", "100.00"), ("a4", "100.00")]
    pairs = [(x, D(m), y, D(n)) for i, (x, m) in enumerate(four) for y, n in four[i + 1:]]
    pairs += [("b1", D("50.00"), "b2", D("50.40")), ("c1", D("-7.00"), "c2", D("-5.00"))]
    frame = spark.createDataFrame(pairs, PAIRS)
    got = {r["cluster"]: (r["payments"], r["total"], r["largest"], r["exposure"]) for r in cluster_exposure(frame).collect()}
    assert got == {"a1": (4, D("400.00"), D("100.00"), D("300.00")), "b1": (2, D("100.40"), D("50.40"), D("50.00")),
                   "c1": (2, D("-12.00"), D("-5.00"), D("-7.00"))}
    by_pair = {(r["row_id_1"], r["row_id_2"]): r["exposure"] for r in with_exposure(frame).collect()}
    assert len(by_pair) == len(pairs) and sum(by_pair.values()) == D("343.00")
    # a2, a3 and a4 stand first in a pair with a1, the payment that was due
    assert by_pair["a1", "a2"] == by_pair["a1", "a4"] == D("100.00") and by_pair["a2", "a3"] == 0


def test_no_duplicates(spark):
    frame = spark.createDataFrame([], PAIRS)
    assert cluster_exposure(frame).collect() == [] and with_exposure(frame).collect() == []
