"""The mixed documents against the shares that the mix gives every row, without regard to how texts meet them."""

import io
import random
import re
from collections import Counter, defaultdict
from contextlib import redirect_stdout

import pytest

from ledgerlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard long, rounds long, class string"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(seed):
    rng = random.Random(seed)
    out = [(i, " ".join(f"w{i}x{k}" for k in range(int(rng.paretovariate(1) * 4))), "en", rng.choice(["a", "a", "a", "B", "c", "é", None])) for i in range(300)]
    out += [(400, None, "en", "a"), (401, "", None, "zz"), (402, "tiny text here", "en", "yy"), (None, "x y", "en", "a"), (None, "x z", "en", "a"), (None, "x y", "en", "a")]
    if seed % 2:  # rows that repeat doc_id and size, enough of them to hold an end of a run
        out += [(5, f"again{k % 3} " * 7, "en", s) for s in ("a", "B", "only") for k in range(150)]
    return [(i, t, lang, s, len(t or ""), -1, -2, -3, "z") for i, t, lang, s in out]


@pytest.mark.parametrize("seed", range(4))
def test_copies_follow_the_shares(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame(data, SCHEMA)
    shares = mixing.mix(docs, seed=seed).collect()
    got = mixing.mixture(docs.select(*NAMES), seed=seed).repartition(3).collect()
    texts = defaultdict(Counter)
    for i, t, lang, s, *_ in data:
        texts[i, s, len(WORD.findall(t or ""))][t] += 1
    # whole and partial copies that each (doc_id, source, size) must have
    want_whole, want_part = Counter(), defaultdict(list)
    for r in shares:
        key = (r["doc_id"], r["source"], r["size"])
        want_whole[key] += r["rounds"] + (r["run_words"] == r["size"]) if r["size"] else 0
        if 0 < r["run_words"] < r["size"]:
            want_part[key].append((r["run_start"], r["run_words"]))
    by_text = {(t, key[0], key[1]): key for key, own in texts.items() for t in own}
    got_whole, parts = Counter(), []
    for r in got:
        if (key := by_text.get((r["text"], r["doc_id"], r["source"]))) is not None:
            got_whole[key] += 1
        else:
            parts.append(r)
    assert got_whole == +want_whole
    assert len(parts) == sum(len(v) for v in want_part.values()) and parts
    for r in parts:
        words = tuple(WORD.findall(r["text"]))
        options = [(key, share) for key, v in want_part.items() if key[:2] == (r["doc_id"], r["source"]) for share in v
                   if any(tuple((WORD.findall(t) * 2)[share[0] : share[0] + share[1]]) == words for t in texts[key])]
        assert options and r["n_chars"] == len(r["text"])
        want_part[options[0][0]].remove(options[0][1])
    # where rows share an id and a size, no text is taken more often than its rows may be
    for key, own in texts.items():
        for t, n in own.items():
            assert sum(r["text"] == t and r["doc_id"] == key[0] and r["source"] == key[1] for r in got) <= 3 * n


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame(rows(0)[:300], SCHEMA).select(*NAMES)
    out = io.StringIO()
    with redirect_stdout(out):
        mixing.mixture(docs).explain("formatted")
    plan = out.getvalue()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
