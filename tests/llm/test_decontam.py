from conftest_helpers import words

from gradeframe.llm import decontam


def shingles(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & have) >= threshold * len(want) - 1e-9:
                out.add((d, i, len(want & have), len(want)))
    return out


def test_contained_items(spark, docs, table):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    long = next(t for d, t in texts if d == 100)
    w = words(long)
    whole, near, far = w[50:80], w[300:330], w[500:530]
    items = [(1, " ".join(whole)), (2, " ".join(near[:15] + ["changed"] + near[15:])), (3, " ".join(far[::-1])), (4, "one TWO"), (5, None), (6, " \n"),
             (1, " ".join(w[4000:4012])), (None, " ".join(w[600:700])), (7, "one two three"), (8, " ".join(w[700:1300]))]
    items += [items[0]]
    got = decontam.contained_items(docs, table(items, "item_id long, text string")).collect()
    want = brute(texts, set(items))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got} == want
    assert {(100, 1), (100, None), (108, 4), (100, 8)} <= {(d, i) for d, i, *_ in want}


def test_threshold_edge_is_found(table):
    """Exactly four fifths of the shingles in common, missing ones chosen at random: no item is lost by its sketch."""
    import random
    rng = random.Random(4)
    items, docs = [], []
    for k in range(40):
        n = rng.choice((10, 15, 20, 40, 65))
        words_ = [f"i{k}w{j}" for j in range(n + 4)]
        items.append((k, " ".join(words_)))
        keep = sorted(rng.sample(range(n), round(0.8 * n)))
        docs.append((k, "\n".join(" ".join(words_[j:j + 5]) + f" x{j} y z" for j in keep)))
    got = decontam.contained_items(table(docs, "doc_id long, text string"), table(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k) for k in range(40)]


def test_decontaminate(docs, empty, table):
    item = next(r.text for r in docs.collect() if r.doc_id == 5)
    items = table([(1, item)], "item_id long, text string")
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    leaks = [r.doc_id for r in decontam.contained_items(docs, items).collect()]
    assert 5 in leaks and left.count() == docs.count() - len(leaks)
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(docs, items.where("false")).count() == docs.count()


def test_shared_wording_of_items_makes_no_candidates(spark, table):
    """Items and documents of one question template: candidates grow with the documents, not with documents times items."""
    template = [f"t{j}" for j in range(20)]
    items = [(k, " ".join(template + [f"i{k}w{j}" for j in range(14)])) for k in range(120)]
    docs = [(d, " ".join([f"d{d}x{j}" for j in range(10)] + template + [f"d{d}y{j}" for j in range(10)])) for d in range(150)]
    docs += [(1000 + k, f"before {text} after") for k, text in items[:7]]
    docs, items = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    _, least = decontam.sketches(items)
    probes = docs.selectExpr("doc_id", "text").withColumn("h", decontam.shingles_of(decontam.F.col("text"))).selectExpr("doc_id", "explode(h) AS h")
    assert probes.join(least, "h").select("doc_id", "item").distinct().count() == 7
    got = decontam.contained_items(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1000 + k, k) for k in range(7)]
