import numpy as np

from palimpsest.llm import toxicity


def test_scores_do_not_depend_on_how_many_entries_are_added_up_at_once(monkeypatch):
    rng = np.random.default_rng(4)

    def vector() -> toxicity.Vector:
        terms = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
        raw = rng.random(len(terms)) + 0.1
        return terms, raw / np.sqrt(raw @ raw)

    rows, queries = [vector() for _ in range(150)], [vector() for _ in range(40)]
    for dense_from in (0.1, 1.0):
        index = toxicity.Index(rows, 16, dense_from)
        monkeypatch.setattr(toxicity, "ENTRIES", 10**9)
        whole = index.nearest(queries, 5)
        monkeypatch.setattr(toxicity, "ENTRIES", 7)
        assert index.nearest(queries, 5) == whole


def test_a_worker_gives_back_what_making_the_index_took(monkeypatch):
    given: list[int] = []
    monkeypatch.setattr(toxicity, "release", lambda: given.append(1))
    counts = (np.array([0, 1]), np.array([1, 2]))
    model = toxicity.Model(toxicity.Settings(), toxicity.Terms(toxicity.pa.array(["a", "b"], toxicity.pa.large_string()), toxicity.Settings()), np.ones(2))
    model.held = (counts[0].astype(np.int32), counts[1].astype(np.int32), np.array([2]))
    assert model.searchable() is model.searchable() and len(given) == 1
