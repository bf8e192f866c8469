import random

import numpy as np
import pytest
import xxhash
from conftest_helpers import words

from gradeframe.llm import simhash


def fingerprint(text):
    w = words(text, lower=True)
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {f: find(f) for f in fps}


def test_components(docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    root = closure({f for _, f in rows}, 3)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(repr((d, f"{f:016x}", least.get(root[f]))) for d, f in rows)
    got = sorted(repr(tuple(r)) for r in simhash.simhash_components(docs).collect())
    assert got == want


def family(seed, n=120):
    """Chains of fingerprints that drift by a few bits, so that components have more than one step."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    return sorted(set(out))


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_buckets(radius):
    fps = np.array(family(radius), np.uint64)
    a, b = simhash.bucket_edges(fps[:, None], np.full(len(fps), 2), np.zeros(len(fps), int), radius, cells=97)
    a, b = fps[a], fps[b]
    want = closure([int(f) for f in fps], radius)
    got = {int(f): int(f) for f in fps}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        u, v = sorted((find(x), find(y)))
        got[v] = u
    assert {f: find(f) for f in got} == want


def test_tiles_lose_no_link(spark):
    """A bucket far over the tile size, cut into many tiles, gives the same components."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | set(family(9, 40)))
    signed = [(f - (1 << 64) if f >> 63 else f,) * 2 for f in fps]
    edges = simhash.near_edges(spark.createDataFrame(signed, "id long, f0 long"), tile=16)
    from gradeframe.llm.graph import components
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    want = closure(fps, 3)
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps})
    assert groups(got) == groups(want)


def test_dedup_keeps_one_of_each(docs, empty):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    comps = simhash.simhash_components(docs, simhash.NEAR_COPY).where("doc_id IS NOT NULL").select("component_id").distinct()
    named = kept.where("doc_id IS NOT NULL")
    assert sorted(r[0] for r in named.select("doc_id").collect()) == sorted(r[0] for r in comps.collect())
    unnamed = {r.text for r in kept.where("doc_id IS NULL").collect()}
    assert unnamed == {r.text for r in docs.where("doc_id IS NULL").collect()} - {r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_near_copies_are_found(spark, table):
    """Edited copies whose five-word shingles have Jaccard similarity 0.8: nine in ten at least share a component with their
    original, and unrelated texts never do."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    rows, pairs, number = [], [], 0
    for _ in range(150):
        base = [rng.choice(vocab) for _ in range(rng.randint(80, 500))]
        rows.append((number, " ".join(base)))
        near = list(base)
        for k in rng.sample(range(len(near)), max(1, len(near) // 48)):
            near[k] = rng.choice(vocab)
        rows.append((number + 1, " ".join(near)))
        sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (base, near)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            pairs.append((number, number + 1))
        number += 2
    comp = {r.doc_id: r.component_id for r in simhash.simhash_components(table(rows, "doc_id long, text string"), simhash.NEAR_COPY).collect()}
    assert len(pairs) > 80 and sum(comp[a] == comp[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(c in (d, d - d % 2) for d, c in comp.items())


def near_family(rng, vocab, n, share):
    """A text and an edited copy of it, and the Jaccard similarity of their five-word shingles."""
    base = [rng.choice(vocab) for _ in range(n)]
    near = list(base)
    for k in rng.sample(range(n), max(1, round(n * share))):
        near[k] = rng.choice(vocab)
    sets = [{tuple(w[k:k + 5]) for k in range(n - 4)} for w in (base, near)]
    return " ".join(base), " ".join(near), len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_links_are_verified(table):
    """Pairs of Jaccard similarity 0.6 to 0.95: those under 0.8 are never linked, those from 0.8 up nearly always."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(900)]
    rows, near, far = [], [], []
    for k in range(500):
        a, b, j = near_family(rng, vocab, rng.randint(150, 400), rng.uniform(0.01, 0.055))
        if 0.6 <= j <= 0.95:
            (near if j >= 0.8 else far).append((2 * k, 2 * k + 1))
            rows += [(2 * k, a), (2 * k + 1, b)]
    comp = {r.doc_id: r.component_id for r in simhash.simhash_components(table(rows, "doc_id long, text string"), simhash.NEAR_COPY).collect()}
    assert len(near) > 80 and len(far) > 80
    assert not [p for p in far if comp[p[0]] == comp[p[1]]]
    assert sum(comp[a] == comp[b] for a, b in near) >= 0.97 * len(near)


def test_exact_links_whatever_the_tiles(table, monkeypatch):
    """Families around one text, with links between their members only: components equal those of all pairs, in one tile or many."""
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocab) for _ in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for k in rng.sample(range(200), rng.randint(0, 5)):
            t[k] = rng.choice(vocab)
        texts.append(t)
    sets = [{tuple(w[k:k + 5]) for k in range(196)} for w in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = {i: min(k for k in range(60) if root[k] == root[i]) for i in range(60)}
    assert len(set(want.values())) > 1
    t = table([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for most in (1024, 16):
        monkeypatch.setattr(simhash.verified_edges, "__defaults__", (most, 1 << 20))
        assert {r.doc_id: r.component_id for r in simhash.simhash_components(t, simhash.NEAR_COPY).collect()} == want


def test_rows_of_one_id_with_unlike_texts(table):
    """Each group keeps one row, also where rows of one doc_id are in different groups; repeated rows are one."""
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(900)]
    a, b, c = (" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b + " "), (2, c), (3, c), (0, a)]
    got = sorted((r.doc_id, r.text) for r in simhash.simhash_dedup(table(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, a), (1, b), (2, c)])


def test_documents_without_an_id_are_deduplicated_too(table):
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(900)]) for _ in range(60)) for _ in range(3))
    rows = [(None, a), (4, a), (None, a), (None, b), (None, b), (7, c)]
    got = sorted(((r.doc_id, r.text) for r in simhash.simhash_dedup(table(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(4, a), (7, c), (None, b)], key=repr)


def test_contraction_changes_no_component(spark, table):
    """Large and small groups of near copies: contracting the first tables gives the components of all tables at once, by few edges."""
    from gradeframe.llm.graph import components
    rng = random.Random(5)
    rows = []
    for members in [400] + [3] * 40 + [1] * 100:
        base = rng.getrandbits(128)
        for _ in range(members):
            f = base
            for b in rng.sample(range(128), rng.randint(0, 14)):
                f ^= 1 << b
            rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f & (1 << 64) - 1, f >> 64)))
    fps = spark.createDataFrame([(k, *r) for k, r in enumerate(sorted(set(rows)))], "id long, f0 long, f1 long").cache()
    like = simhash.NEAR_COPY
    want = {r.node: r.root for r in components(simhash.near_edges(fps, like, tile=64)).collect()}
    got = {r.node: r.root for r in simhash.near_roots(fps, like).collect()}
    assert got == {k: want.get(k, k) for k in range(fps.count())} and len(set(got.values())) < len(got) // 2
    rooted = fps.join(spark.createDataFrame(list(got.items()), "id long, label long"), "id")
    assert simhash.near_edges(rooted, like, tables=slice(simhash.FIRST_TABLES, None)).count() == 0


def test_cells_are_never_broadcast(spark, table):
    """Spark sizes the cells of all tables of keys like the rows that they are dealt out of: a small table is no reason to collect them."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "-1b")
    path = table([(k, k * 7919, k * 104729) for k in range(50)], "id long, f0 long, f1 long")
    labelled = path.select("id", "f0", "f1", (path["id"] % 40).alias("label"))
    for fps, like in ((labelled, simhash.NEAR_COPY), (path, simhash.Likeness())):
        plan = simhash.near_edges(fps, like)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_merged_edges_connect_the_same():
    rng = np.random.default_rng(1)
    batches = [(rng.integers(0, 400, 50), rng.integers(0, 400, 50)) for _ in range(6)]

    def groups(edges):
        root = {k: k for k in range(400)}
        for a, b in edges:
            x, y = root[a], root[b]
            for k, r in root.items():
                root[k] = min(x, y) if r in (x, y) else r
        return root

    flat = [(int(a), int(b)) for x, y in batches for a, b in zip(x, y)]
    for most in (1, 120, 1 << 20):
        out = [(a, b) for batch in simhash.merged(iter(batches), most) for a, b in zip(*batch.to_pydict().values())]
        assert groups(out) == groups(flat) and len(out) <= len(flat)
    assert list(simhash.merged(iter([]))) == []
