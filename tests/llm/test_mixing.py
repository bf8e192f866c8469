import pytest
from conftest_helpers import words

from gradeframe.llm import mixing


def targets_of(sizes):
    """Plain resharing, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    rest, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        free -= over
    return out


def test_taken_words_meet_targets(docs):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = targets_of(sizes)
    got = mixing.mix_taken(docs).collect()
    assert len(got) == len(rows)
    assert sorted(repr((r.doc_id, r["size"])) for r in got) == sorted(repr((r.doc_id, len(words(r.text)))) for r in rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r["size"] * r.taken % max(r["size"], 1) == 0
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(by) == sorted((sizes[s], round(want[s], 6)) for s in sizes)
    for (_, target), taken in by.items():
        assert sum(taken) == pytest.approx(target, abs=max(30, 0.02 * target, max(taken) / 4))      # a quarter of the longest, taken twice


def test_rates_are_tilted_exponentially(docs):
    """The odds of the rates of a source are exp(lambda size / mean): log odds are linear in size, and rates meet the target."""
    import math
    rates = mixing.mix_rates(docs).collect()
    for source in {r.source for r in rates}:
        mine = [r for r in rates if r.source == source and r["size"] > 0]
        target = mine[0].target
        assert sum(r.rate * r["size"] * r.n for r in mine) == pytest.approx(target, rel=1e-5)
        if 0 < target < 2 * mine[0].source_size:
            slopes = {round(math.log(r.rate / (2 - r.rate)) / r["size"], 7) for r in mine if 1e-6 < r.rate < 2 - 1e-6 and r["size"] > 5}
            assert len(slopes) <= 1 or max(slopes) - min(slopes) < 1e-5


def test_documents_repeat_as_taken(docs, empty):
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    taken = sum(r.taken for r in mixing.mix_taken(docs).collect())
    rows = mix.collect()
    assert sum(len(words(r.text)) for r in rows) == taken
    again = mixing.mix_documents(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix_taken(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
