"""Alignment against brute force over single tokens, with the libraries that the contract names."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from loomgraph.llm import alignment
from loomgraph.llm.queries import split_pattern, tokenizer_path

PATHS = [tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern(), tokenizer_path("piece_bpe_32k.model")]
ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\r\nlines\n\n", "▁mark", "a ▁ b", "<|endoftext|> <s></s> <0x41> <unk>", "日本語の文 😀👩‍👩‍👧 ﬁ é", "\x00nul", "x" * 500, "ab" * 300,
    "don't we'll 12345 678 9.0", "﻿bom", "ÀÉ ß ①\xa0 ​", "١٢٣ ภาษา नमस्ते", "aaaa bbbb aaaa bbbb aaaa", "the the the the", "Ⅷ½ŉ \U0010ffff",
]


def byte_level():
    """Byte of each character of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Reference:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
        self.alphabet = byte_level()

    def tokens(self, text):
        ids_a, ids_b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.alphabet[c] for c in self.a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            return [], []
        return [(i, len(x)) for i, x in zip(ids_a, bytes_a, strict=True)], [(i, len(x)) for i, x in zip(ids_b, bytes_b, strict=True)]

    def groups(self, text):
        """[(ids of A, ids of B)], by walking along both sides."""
        a, b = self.tokens(text) if text else ([], [])
        out, i, j = [], 0, 0
        while i < len(a):
            left, right, x, y = [], [], 0, 0
            while not left or x != y:
                if x <= y:
                    left.append(a[i][0])
                    x += a[i][1]
                    i += 1
                else:
                    right.append(b[j][0])
                    y += b[j][1]
                    j += 1
            out.append((left, right))
        return out

    def expected(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        count = collections.Counter(p for _, gs in found for p in {(x, y) for a, b in gs for x in a for y in b})
        best = {}
        for (a, _), n in count.items():
            best[a] = max(best.get(a, 0), n)
        out = []
        for i, gs in found:
            links = [(x, y) for a, b in gs for x in a for y in b]
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
            digest = hashlib.sha256(text.encode()).hexdigest() if gs else ""
            out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
        return out


@pytest.fixture(scope="module")
def reference():
    return Reference()


def rows():
    rng = random.Random(3)
    words = ["river", "stone", "Wolken", "été", "日本", "zq", "1999", "—", "naïve", "foo_bar", "\n", "ĳ"]
    out = [*ODD, *(" ".join(rng.choice(words) + rng.choice(["", "s", ",", "!?"]) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(40)]
    return [*enumerate(out), (3, "a repeated id"), (3, "a repeated id"), (None, "without an id"), (None, None)]


def collected(df):
    return [tuple(r) for r in df.collect()]


def same(found, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_groups_join_both_sides(reference):
    """The walk pairs every token of B too."""
    for _, text in rows():
        a, b = reference.tokens(text) if text else ([], [])
        gs = reference.groups(text)
        assert [x for g in gs for x in g[0]] == [i for i, _ in a] and [x for g in gs for x in g[1]] == [i for i, _ in b]


@pytest.mark.parametrize("head", [0, 50, 1 << 19])
def test_equals_brute_force(spark, monkeypatch, reference, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id bigint, text string, row int, pairs string").repartition(3)
    out = alignment.aligned_documents(docs, *PATHS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(collected(out), reference.expected(data))


def test_blocks_and_wide_groups_give_the_same(monkeypatch, reference):
    texts = [t or "" for _, t in rows()]
    monkeypatch.setattr(alignment, "PAIRS", 7)
    monkeypatch.setattr(alignment, "WIDE", 3)
    found = alignment.align(texts, *PATHS)
    radix = len(alignment.piece_model(PATHS[2])[1].lengths)
    for i, text in enumerate(texts):
        links = collections.Counter((x, y) for a, b in reference.groups(text) for x in a for y in b)
        low, high = found["pair_at"][i : i + 2]
        assert {divmod(int(p), radix): n for p, n in zip(found["pairs"][low:high], found["times"][low:high].tolist(), strict=True)} == links


def test_wide_group_of_many_tokens():
    """A group of 3,000 x 2,000 tokens is counted without its 6 million pairs."""
    a, b = np.arange(3000) % 11, np.arange(2000) % 7
    doc, pair, times = alignment.document_pairs(np.zeros(3000, np.int64), a, np.zeros(2000, np.int64), b, np.array([4]), 32)
    assert (doc == 4).all() and len(pair) == 77 and times.sum() == 6_000_000


def test_partial_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 5)
    lists = [[1, 2, 3], [2, 3], [], None, *([i] for i in range(50)), [3]]
    found = spark.createDataFrame([(x,) for x in lists], "pairs array<bigint>").coalesce(1)
    expected = collections.Counter(p for x in lists for p in x or [])
    assert dict(alignment.pair_counts(found).collect()) == expected


def test_encoders_agree_on_all_code_points(reference):
    """The rank file gives the ids of the tokenizer file."""
    enc = alignment.byte_bpe.encoding(*PATHS[:2])
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f" a{chr(c)}1{chr(c)} {chr(c)}" for c in points[i : i + 64])
        if i % (64 * 40) == 0 or points[i] < 0x3000:
            assert enc.encode_ordinary(text) == reference.a.encode(text, add_special_tokens=False).ids


def test_ends_are_segmented():
    ids = pa.array([[0, 1], [], [1, 1, 0]], pa.list_(pa.int32()))
    ends = alignment.token_ends(ids, np.array([2, 3]))
    assert ends["doc"].to_pylist() == [0, 0, 2, 2, 2] and ends["end"].to_pylist() == [2, 5, 3, 6, 8]


def test_empty_table(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).count() == 0
