import random

import numpy as np
import pytest

from palimpsest.llm import jaccard

PARTS = ["a", "B", "é", " ", "\n", "\t\x0b\x0c\r", "x" * 63, "X" * 64, "x" * 65, "y" * 70, "\x1c", "Ab", "\ud800", "zq", "\xa0"]


@pytest.mark.parametrize("block", [7, 1 << 22])
def test_sets_equal_a_plain_split(monkeypatch, block):
    monkeypatch.setattr(jaccard, "_BLOCK", block)
    pick = random.Random(block)
    by_set, by_hash = {}, {}
    for _ in range(1500):
        text = "".join(pick.choices(PARTS, k=pick.randrange(0, 40)))
        words = text.encode("utf-8", "surrogatepass").lower().split()
        width = min(4, len(words))
        plain = frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()
        found = jaccard.ngram_set(text, 4)
        assert len(found) == len(plain) and bool(np.all(found[1:] > found[:-1]))
        assert by_set.setdefault(plain, found.tobytes()) == found.tobytes()
        assert by_hash.setdefault(found.tobytes(), plain) == plain
    assert len(jaccard.ngram_set(None, 4)) == 0
