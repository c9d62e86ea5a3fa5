"""Token alignment against a pair loop over plain tokenizers, and the defined results of odd rows."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import token_alignment
from ledgerlens.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, chunk long, pairs string, n_a int, best boolean, count long"
ODD = [None, "", " ", "   ", " \t\n x", "one", "<|endoftext|> and <s> </s>", "▁ is written", "a　b x", "中文字符 𠀠𠁀", "é ½ ﬁ don't 'll", "\x00\x01", "x" * 5000, "=" * 777 + "a" * 3331,
       "word " * 3000, "line\n" * 50]


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "en", 1, "p", 2, True, 3) for i, t in rows], SCHEMA)


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        self.byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}

    def groups(self, text):
        """[(ids of A, ids of B)] of the text."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        names = [self.b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        out, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = bisect_left(ends_a, end) + 1, bisect_left(ends_b, end) + 1
            out.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, rows):
    links = {}
    cut = [plain.groups(t) for _, t in rows]
    for i, groups in enumerate(cut):
        links[i] = [(x, y) for a, b in groups for x in a for y in b]
    count = Counter(p for i in links for p in set(links[i]))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in cut[i])
        out.append((doc_id, sum(len(a) for a, _ in cut[i]), sum(len(b) for _, b in cut[i]), len(cut[i]), len(links[i]),
                    sum(count[p] == top[p[0]] for p in links[i]), sum(count[p] for p in links[i]), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count, top


def some_texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "a", "\n", "é", "　", "▁", "中文", "<|endoftext|>", "<s>", "don't", "'ll", "123456", "\t", "ﬁ", "foo", "=====", "aaaaaaaaaaaaaaaa", " ", "𠀠", "़क", "½", " the", " alignment", " unusually"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def check(spark, plain, rows, chunk_bytes=token_alignment.CHUNK_BYTES):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = [tuple(r[c] for c in names) for r in token_alignment.aligned_documents(frame(spark, rows), A, B, chunk_bytes).collect()]
    want, count, top = brute(plain, rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    return count, top


def test_equals_pair_loop_in_many_chunks(spark, plain):
    texts = ODD + some_texts(300, 1)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "one two"), (None, None)]
    # a batch of texts is worked on as one, so chunks can't be smaller than that
    assert token_alignment.align(frame(spark, rows).repartition(9), A, B, 500).select("chunk").distinct().count() >= 9
    count, top = check(spark, plain, rows, 500)
    assert len(count) > 150 and max(top.values()) > 20


def test_the_corpus_table(spark, plain):
    rows = list(enumerate(some_texts(60, 2) + ["one two three"] * 5))
    _, count, top = brute(plain, rows)
    got = {(r["id_a"], r["id_b"]): (r["count"], r["best"]) for r in token_alignment.correspondences(frame(spark, rows), A, B).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_empty_table_and_texts_without_tokens(spark, plain):
    assert token_alignment.aligned_documents(frame(spark, []), A, B).collect() == []
    check(spark, plain, [(1, None), (2, ""), (3, "▁")])


def test_galloping_finds_what_bisection_finds():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 700, 5000):
        ends = np.unique(rng.integers(1, 4 * n, n))
        ends = np.append(ends, 4 * n)
        wanted = np.sort(rng.integers(1, 4 * n + 1, n))
        right = np.searchsorted(ends, wanted)
        low = np.maximum(right - rng.integers(0, 1 + len(ends) // 2, n), 0)
        assert (token_alignment.gallop(wanted, ends, low) == right).all()


def test_groups_with_many_links_are_made_of_distinct_ids(monkeypatch):
    aligned = object.__new__(token_alignment.Aligned)
    rng = np.random.default_rng(5)
    aligned.a, aligned.b = rng.integers(0, 9, 300), rng.integers(0, 9, 280)
    aligned.to_a, aligned.to_b = np.array([10, 200, 300]), np.array([15, 120, 280])
    aligned.size_a, aligned.size_b = np.diff(aligned.to_a, prepend=0), np.diff(aligned.to_b, prepend=0)
    aligned.groups = np.array([0, 2, 3])
    some = [x.tolist() for x in aligned.links(100)]
    monkeypatch.setattr(token_alignment, "GROUP_LINKS", 10**9)
    assert some == [x.tolist() for x in aligned.links(100)]
    want = Counter((int(g == 2), int(x) * 100 + int(y)) for g in range(3) for x in aligned.a[aligned.to_a[g] - aligned.size_a[g] : aligned.to_a[g]]
                   for y in aligned.b[aligned.to_b[g] - aligned.size_b[g] : aligned.to_b[g]])
    assert {(t, p): n for t, p, n in zip(*some)} == want
