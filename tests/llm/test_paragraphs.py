import random

from conftest_helpers import words

from gradeframe.llm import paragraphs


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = {d: some(rng.randint(60, 300)) for d in range(80)}
    planted = {}
    for k in range(12):
        passage = some(rng.randint(51, 70))
        for d in rng.sample(range(60), 3):
            at = rng.randint(0, len(texts[d]))
            texts[d][at:at] = passage
            planted.setdefault(d, []).append(" ".join(passage))
    rows = [(d, " ".join(w)) for d, w in texts.items()]
    # paragraphs that differ in a word or two, and one that is too different
    near = some(90)
    for k, at in enumerate((None, 20, 70)):
        w = list(near)
        if at:
            w[at] = "changed"
        rows.append((200 + k, " ".join(some(40)) + "\n" + " ".join(w) + "\n" + " ".join(some(40))))
    far = list(near)
    far[::6] = ["else"] * len(far[::6])
    rows.append((210, " ".join(far)))
    return rows, planted


def test_planted_passages(table):
    rows, planted = corpus()
    got = paragraphs.repeated_passages(table(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got}
    assert found == set(planted) | {200, 201, 202}
    texts = {d: words(t, lower=True) for d, t in rows}
    for d, passages in planted.items():
        spans = [set(range(r.start, r.stop)) for r in got if r.doc_id == d]
        for p in passages:
            p = p.split(" ")
            at = next((i for i in range(len(texts[d])) if texts[d][i:i + len(p)] == p), None)
            assert at is None or any(len(s & set(range(at, at + len(p)))) >= 20 for s in spans)
    # the near paragraphs are one class, of which the first occurrence stays
    near = sorted((r.doc_id, r.removed) for r in got if r.doc_id >= 200 and r.n_words >= 90)
    assert near == [(200, False), (201, True), (202, True)]


def test_near_paragraphs_against_all_pairs(table):
    """Every pair of lines with Jaccard similarity 0.8 is connected, and linked pairs reach it."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    lines = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(4):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.randint(0, 2)):
                w[k] = rng.choice(vocab)
            lines.append(" ".join(w))
    df = table(list(enumerate(lines)), "doc_id long, text string")
    unit = {}
    for r in paragraphs.units(df).where("start = 0").collect():
        if r.stop == len(lines[r.doc_id].split()):
            unit[r.doc_id] = r.unit
    sets = {unit[d]: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in enumerate(lines))}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(a, b) >= 0.8]

    def closure(edges):
        root = {u: u for u in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            u, v = sorted((find(a), find(b)))
            root[v] = u
        return find

    want = closure(pairs)
    for tile in (2048, 2):                  # with tiles of two, buckets are cut and compared in pairs of tiles
        links = [(r.a, r.b) for r in paragraphs.near_paragraphs(df, tile=tile).collect()]
        got = closure(links)
        assert all(want(a) == want(b) for a, b in links)
        assert len(pairs) > 20 and sum(got(a) == got(b) for a, b in pairs) >= 0.99 * len(pairs)


def test_odd_rows(docs, empty):
    got = paragraphs.repeated_passages(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(len(words(r.text)))
    assert got and all(0 <= r.start < r.stop <= max(texts[r.doc_id]) and r.n_words == r.stop - r.start >= 20 for r in got)
    assert {101, 102} <= {r.doc_id for r in got if r.removed} and 104 not in {r.doc_id for r in got}
    assert paragraphs.repeated_passages(empty).count() == 0
