import random

from palimpsest.operators import treematch
from palimpsest.sources.parsing import parse
from palimpsest.sources.rules import LANGUAGES
from palimpsest.sources.trees import bytes_at


def test_a_best_mapping_of_small_subtrees_is_found_once(monkeypatch):
    asked = []
    found = treematch.edit_distance
    monkeypatch.setattr(treematch, "edit_distance", lambda *a: asked.append(a) or found(*a))
    treematch._FORMS.clear()
    before = '<div><p class="a">one</p><ul><li>x</li></ul></div><h1>t</h1>'
    after = '<div><p class="b">two</p><ol><li>x</li></ol></div><h1>t</h1>'

    def mapping(left: str, right: str) -> list[int]:
        return treematch.match(parse(left, "html"), parse(right, "html"), LANGUAGES["html"]).to.tolist()

    first, n = mapping(before, after), len(asked)
    assert n and mapping(before, after) == first and len(asked) == n
    treematch._FORMS.clear()
    assert mapping(before, after) == first and len(asked) == 2 * n


def test_a_remembered_mapping_minds_the_side_of_a_pair_and_the_rules():
    rng = random.Random(3)

    def text(depth: int = 0) -> str:
        if depth == 3 or rng.random() < 0.3:
            return rng.choice(('"a"', '"b"', "1", "null"))
        if rng.random() < 0.5:
            return "[" + ", ".join(text(depth + 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ", ".join(f'"{rng.choice("abc")}": {text(depth + 1)}' for _ in range(rng.randint(0, 3))) + "}"

    for _ in range(300):
        a, b = parse(text(), "json"), parse(text(), "json")
        warm = treematch.match(a, b).to.tolist()
        treematch._FORMS.clear()
        cold = treematch.match(a, b).to.tolist()
        assert warm == cold


def test_places_in_bytes():
    text = "aé€\U0001f600z"
    at = bytes_at(text)
    assert [at(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
