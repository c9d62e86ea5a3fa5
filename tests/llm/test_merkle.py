"""Merkle proofs against a plain statement of the tree, and the defined results of odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, size int, digest string, block long, leaf string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "t", 1, 2, "d", 3, "l") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([sha("".join(low[i : i + 8])) for i in range(0, len(low), 8)])
    return out


def brute(rows):
    """Result rows in any order, from rows (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])) if r[0] is not None else (False, 0, leaf(r, r[1])))
        trees[name] = levels_of([leaf(r, r[1]) for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    root, out = top[-1][0], []
    for place, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded, beside = leaf(r, text), []
            for tree, i in ((trees[name], at), (top, place)):
                for nodes in tree[:-1]:
                    start = i - i % 8
                    run = nodes[start : start + 8]
                    beside += run[: i - start] + run[i - start + 1 :]
                    folded = sha("".join([*run[: i - start], folded, *run[i - start + 1 :]]))
                    i //= 8
            out.append((r[0], leaf(r, r[1]), trees[name][-1][0], root, sha("".join(beside)), folded, folded == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in merkle.proofs(frame(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def test_proofs_of_several_tiers(spark):
    # en has more than one superblock of 4,096 leaves; 9 and 65 leaves leave a last run of one node
    rows = [(3 * i, f"Text {i} UPPER" if i % 2 else f"text {i}", "en", f"s{i % 3}", i) for i in range(4_200)]
    rows += [(10**15 + i, f"Zwei {i}", "de", None, None) for i in range(65)] + [(-i, f"Neuf {i}", "fr", "s", i) for i in range(9)]
    rows += [(7, "Only one", "xx", "s", 1)]
    got = check(spark, rows)
    tampered = [r for r in got if not r[6]]
    assert 0.1 < len(tampered) / len(got) < 0.4


def test_many_languages(spark):
    check(spark, [(i, f"T{i}", f"l{i % 70}", "s", i) for i in range(300)])


def test_odd_rows(spark):
    rows = [(None, "A null id", "en", "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (3, "Same", "en", "s", 4), (3, "Same", "en", "s", 4),
            (3, "Other", "en", "s", 5), (2**62 + 1, "Ünï — CODE" + "x" * 50_000, "", "s", 9), (None, None, None, None, None), (12, "UPPER", "-", "=", -3)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(12, "UPPER", "en", "s", 5)], [(5, "a", None, None, None)]])
def test_a_single_leaf_is_the_root(spark, rows):
    got = check(spark, rows)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_empty_table_and_manifest(spark):
    assert merkle.proofs(frame(spark, [])).collect() == [] and merkle.manifest(frame(spark, [])).collect() == []
    rows = [(i, f"t{i}", [None, "b", "a"][i % 3], "s", i) for i in range(30)]
    got = {r["lang"]: r for r in merkle.manifest(frame(spark, rows)).collect()}
    want = {name: next(x for x, r in zip(brute([r for r in rows if r[2] == name]), rows))[2] for name in (None, "a", "b")}
    assert {k: (r["documents"], r["subroot"]) for k, r in got.items()} == {k: (10, v) for k, v in want.items()}
    assert {r["root"] for r in got.values()} == {sha(want[None] + want["a"] + want["b"])}


def test_positions_follow_the_order(spark):
    rows = spark.range(0, 5_000, 1, 7).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("tree"), (F.col("id") * 7919 % 5_000).alias("key"))
    got = merkle.numbered(rows, ["key"]).collect()
    for tree in ("x", "y"):
        mine = sorted((r["key"], r["pos"], r["size"]) for r in got if r["tree"] == tree)
        assert [p for _, p, _ in mine] == list(range(2_500)) and {s for _, _, s in mine} == {2_500}
