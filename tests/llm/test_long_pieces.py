import hashlib
import random
import time

import pytest

from docloom.llm import bpe


def digest(c, texts):
    return [(len(x) // 4, hashlib.sha256(x).hexdigest()) for x in c.encode(texts)]


def strings(seed, n):
    r = random.Random(seed)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "the", "aeiou", "éèàçüß", "中文字符日本語", "0123456789", "=-_*#", "aB"]
    return ["".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randint(250, 1500))) for i in range(n)]


@pytest.mark.parametrize("segment", [3, 64])
def test_long_pieces_equal_the_public_library(monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    monkeypatch.setattr(bpe, "LONG", 4 * segment)
    c, r = bpe.ByteBpe(bpe.default_ranks()), random.Random(segment)
    texts = [*strings(segment, 45), "a" * 3001, " " * 2999 + "x", "ab" * 777, "the" * 500, "".join(r.choice(["ing", "tion", "er", "un", "q"]) for _ in range(900))]
    assert digest(c, texts) == bpe.reference_digest(bpe.default_ranks(), texts)


def test_time_of_a_piece_grows_with_its_length():
    c, r = bpe.ByteBpe(bpe.default_ranks()), random.Random(6)
    c.encode(["warm up zqxj"])
    piece = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    began = time.time()
    got = digest(c, [piece])
    assert time.time() - began < 20
    assert got == bpe.reference_digest(bpe.default_ranks(), [piece])
