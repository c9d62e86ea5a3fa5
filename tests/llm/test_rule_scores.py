"""Scores of the rule ensemble, recomputed from plain statistics, its rules and its weights."""

import math
import random
import re
from collections import Counter

from ledgerlens.llm import rule_ensemble

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, label double, score double, n_words long, predicted int, features string"
ODD = [None, "", " \t\n", "one", "ÜN ü é中 𠀠", "x" * 60_000, "w | " * 20_000, "same line\nsame line\n\nOther!? 42", "A.B,c;d:" * 30, "tab\tand\x0bfeed\x0c."]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    of = lambda chars_in: sum(c in chars_in for c in text)
    upper, small = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    where = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if where[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / max(b, 1)
    return dict(zip(rule_ensemble.STATISTICS, [
        n, share(chars, n), share(of("#*$%&|<>"), n), share(of("|"), n), share(upper, upper + small), share(of("0123456789"), chars), share(of("!?"), n),
        share(of(".,;:"), n), share(len(repeated), n), share(len(lines) - len(set(lines)), len(lines)), share(len(set(map(lower, words))), n), share(n, len(lines))]))


def corpus():
    rng = random.Random(3)
    out = []
    for i in range(300):
        if i % 3 == 0:
            out.append("\n".join(" ".join(f"w{rng.randrange(99)}{rng.choice(['%%%', '###', ' |', ''])}" for _ in range(12)) for _ in range(5)))
        elif i % 3 == 1:
            out.append(" ".join(f"word{rng.randrange(999)}" for _ in range(60)) + ". " + "Also this! " * rng.randrange(4))
        else:
            out.append("\n".join(f"Line {rng.randrange(5)} of it" for _ in range(20)) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") * 4 for _ in range(80)))
    return out + ODD


def test_every_score_follows_from_rules_and_weights(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", -1.0, 9.0, -5, 7, "f") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 1), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    measured = rule_ensemble.statistics(docs)
    for r in measured.collect():
        want = plain_statistics(texts[r["doc_id"]])
        assert all(math.isclose(r[c], want[c], rel_tol=1e-12, abs_tol=1e-12) for c in rule_ensemble.STATISTICS), (r, want)
    model = rule_ensemble.fit(measured, labels)
    assert len(model.rules) >= 3 and any(len(rule.conditions) > 1 for rule, _ in model.rules)
    monkeypatch.setattr(rule_ensemble, "fit", lambda *_: model)
    got = {r["doc_id"]: r for r in rule_ensemble.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        values = plain_statistics(t)
        total = model.intercept
        for rule, weight in model.rules:
            if all((values[name] > threshold) == above for name, above, threshold in rule.conditions):
                total += weight
        want = 1 / (1 + math.exp(-total))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9) and got[i]["predicted"] == int(want >= 0.7)
    assert len({round(r["score"], 6) for r in got.values()}) > 3
