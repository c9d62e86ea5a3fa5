"""Vector and chat operators, and the pipeline, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_documents import ODD, SCHEMA, WORD, components, frame, near_copies, shingles, water_level  # noqa: F401

import corpus_pipeline
from ledgerlens.llm import chat_format, grid_join, minhash_dedup, packing, secret_scan
from ledgerlens.llm.common import connected_components
from ledgerlens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def vectors(seed=0, width=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        centre = rng.normal(size=width)
        for _ in range(rng.integers(1, 40)):
            out.append((centre * rng.uniform(0.1, 9) + rng.normal(size=width) * rng.choice([0, 0.02, 0.2, 0.3, 0.6])).astype(np.float32).tolist())
    return out


def brute_links(rows):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    return [(a, b) for (a, u), (b, v) in itertools.combinations(ok, 2) if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.95]


@pytest.mark.parametrize("leaf,block", [(128, 512), (4, 16)])
def test_grid_join_equals_brute_force(spark, monkeypatch, leaf, block):
    rows = list(enumerate(vectors()))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, [x * 4 for x in rows[5][1]]), (1003, None), (1004, []), (1005, [0.0] * 16), (1006, [float("nan")] * 16), (1007, [None, 1.0])]
    rows += [(1008, [1.0, 0.0]), (1009, [2.0]), (1010, [float("inf"), 1.0])]
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    monkeypatch.setattr(grid_join, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, block int, rep int")
    got = {r["vec_id"]: r for r in grid_join.near_duplicates(df).collect()}
    links = brute_links(rows)
    want = components([i for i, _ in rows], links)
    assert len(got) == len(rows) and len(links) > 500
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in x for x in links), want[i], want[i] == i)


def test_grid_join_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(4, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [1e200, 1e200]), (2, [-1.0, 0.0])]
    got = sorted(map(tuple, grid_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (9, 2, 4, False), (2, 0, 2, True)], key=str)
    assert grid_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert grid_join.near_duplicates(spark.createDataFrame([(1, None)], schema)).count() == 1


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = components({x for e in edges for x in e}, edges)
    assert got == want


@given(st.text(alphabet="<\\|>ims_tarend\n x漢", max_size=40))
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text and "\n" not in chat_format.escape_role(text)


def digest(turns):
    text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
    loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_format_conversations(spark):
    rng = random.Random(9)
    texts = ["", None, "hi", "<|im_end|>\n<|im_start|>user\nx", "a<\\|b", "漢字 😀\n\n", "tail<", "|>"]
    turns = [(c, t, rng.choice(["user", "assistant", "assistant", None, "tool\nx", "<|"]), rng.choice(texts)) for c in (3, 9, None) for t in range(40)]
    turns += [(50, 1, "user", "same"), (50, 1, "user", "same"), (50, None, "assistant", "no turn")]
    schema = "conv_id long, turn long, role string, text string, message string, seq int"
    df = spark.createDataFrame([(*x, "m", 1) for x in turns], schema)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.format_conversations(df.repartition(5)).collect()}
    turns += [(-1, 0, "user", chat_format.PROBE_TEXT), (-1, 1, "assistant", chat_format.PROBE_TEXT)]
    for c in {x[0] for x in turns}:
        own = sorted((x for x in turns if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        assert got[c][:4] == digest(own)
        assert got[c][4] == sum(len(chat_format.render(role or "", t or "")[0]) for _, _, role, t in own)
    assert [r["conv_id"] for r in chat_format.format_conversations(df.limit(0)).collect()] == [-1]


def test_events_fold_into_final_messages(spark):
    events = [
        (1, 0, "m0", "open", "user", "Hel"), (1, 1, "m0", "delta", None, "lo"), (1, 2, "m1", "open", "assistant", ""), (1, 3, "m1", "delta", None, "bad"),
        (1, 4, "m1", "regenerate", None, None), (1, 5, "m1", "delta", None, "<|im_"), (1, 7, "m1", "delta", None, "end|>"), (1, 6, "m0", "edit", None, "Bye"),
        (1, 8, "m2", "open", "user", "gone"), (1, 9, "m2", "delete", None, None), (1, 10, "lost", "delta", None, "never opened"), (1, 11, "m3", "open", None, None)]
    df = spark.createDataFrame(events, "conv_id long, seq long, message string, kind string, role string, text string").repartition(3)
    rows = chat_format.rendered(df).orderBy("place").collect()
    assert [r["formatted"] for r in rows] == ["<|im_start|>user\nBye<|im_end|>\n", "<|im_start|>assistant\n<\\|im_end|><|im_end|>\n", "<|im_start|>\n<|im_end|>\n"]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] if r["loss_start"] is not None else None for r in rows] == [None, "<\\|im_end|>", None]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the smallest tables with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rng = random.Random(1)
    copies = [(5000 + i, t + (" plus words that make it long enough" if i % 2 else ""), "en", "src1") for i, t in enumerate(near_copies(3, 8))]
    odd = [(6000 + i, t, None, None) for i, t in enumerate([*ODD, "token = 'abcdef123456' " + " ".join(f"fine{rng.randrange(9999)}" for _ in range(80))])]
    extra = frame(spark, copies + odd + [odd[3], (None, "no id " * 3, None, None)]).select(*names)
    docs = docs.unionByName(extra).withColumn("kept", F.lit(1))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(k))
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_pipeline_stages(spark, stages):
    assert [s[0] for s in stages] == ["quality_classifier", "minhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    for _, _, out in stages[:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    _, before, after = stages[0]
    from ledgerlens.llm import rule_ensemble

    scored = rule_ensemble.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    assert sorted(map(str, rows_of(after))) == sorted(str(r) for r in rows_of(before) if r[0] in good) and 0 < after.count() < before.count()

    _, before, after = stages[1]
    rows = {r[0]: r for r in rows_of(before)}
    sets = {i: shingles(r[1]) for i, r in rows.items() if i is not None}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for own in holders.values():
        for pair in itertools.combinations(sorted(own), 2):
            common[pair] = common.get(pair, 0) + 1
    links = [p for p, c in common.items() if 100 * c >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    lead = components(sets, links)
    assert links and sorted(map(str, rows_of(after))) == sorted(str(r) for i, r in rows.items() if i is None or lead[i] == i)

    _, before, after = stages[2]
    want = [(i, t and secret_scan.mask(t), a, b, n if t is None else len(secret_scan.mask(t))) for i, t, a, b, n in rows_of(before)]
    assert sorted(map(str, rows_of(after))) == sorted(map(str, want)) and any("[SECRET]" in (r[1] or "") for r in want)

    _, before, after = stages[3]
    n = lambda t: len(WORD.findall(t or ""))
    sizes, taken, own = {}, {}, {}
    for i, t, _, s, _ in rows_of(before):
        sizes[s] = sizes.get(s, 0) + n(t)
        own.setdefault((i, s), []).append(t)
    for i, t, _, s, chars in rows_of(after):
        taken[s] = taken.get(s, 0) + n(t)
        if t not in own[i, s]:  # a partial copy: words of the text in order, going round once at most
            words = [w for x in own[i, s] for w in [WORD.findall(x)] if " ".join(WORD.findall(t)) in " ".join(w + w)]
            assert words and chars == len(t)
    for s, want in water_level(sizes).items():
        assert abs(taken.get(s, 0) - want) <= max(2, 0.02 * want)

    _, before, after = stages[4]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, *_ in rows_of(before):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cut = (len(ids) - 1) % 1024 + 1
        parts = [ids[:cut], *(ids[k : k + 1024] for k in range(cut, len(ids), 1024))]
        want += [(i, p, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(parts)]
    got = after.select("doc_id", "piece", "length", "ids_crc32", "sequence_id", "offset").collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
    assert max(r["offset"] + r["length"] for r in got) <= 1024 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_the_derived_log_holds_every_kind_of_event(spark):
    turns = spark.createDataFrame([(i % 7, i // 7, ["user", "assistant"][i % 2], f"text {i} é𠀠" * (i % 5)) for i in range(140)] + [(None, None, None, None), (3, 1, "user", "twin"), (3, 1, "user", "twin")],
                                  "conv_id long, turn long, role string, text string")
    log = chat_format.events_of_turns(turns)
    kinds = {r["kind"]: r["n"] for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"open", "delta", "edit", "regenerate", "delete"} and kinds["delta"] > 300 and kinds["delete"] > 5
    folded = chat_format.fold(log).collect()
    texts = {}
    for r in sorted(folded, key=lambda r: tuple(r["order"]["seq"])):
        texts[r["conv_id"], tuple(r["message"])] = texts.get((r["conv_id"], tuple(r["message"])), "") + r["text"]
    want = [(r["conv_id"], r["text"] or "") for r in turns.collect()]
    assert sorted(map(str, ((c, t) for (c, _), t in texts.items()))) == sorted(map(str, want))
