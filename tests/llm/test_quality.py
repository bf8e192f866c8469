from collections import Counter

from conftest_helpers import words

from gradeframe.llm import quality


def base(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k:k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_measures(docs):
    got = sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                            for r in quality.quality_measures(docs).collect())))
    want = []
    for r in docs.collect():
        b = base(r.text)
        want.append(repr((r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])))
    assert got == sorted(want)


def brute_dup_chars(text, n):
    """Characters of words inside later copies of n-word windows."""
    w, seen, inside = words(text), set(), set()
    for k in range(len(w) - n + 1):
        gram = tuple(w[k:k + n])
        if gram in seen:
            inside |= set(range(k, k + n))
        seen.add(gram)
    return sum(len(w[k]) for k in inside)


def test_repetition_coverage(docs):
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in quality.quality_measures(docs).where("doc_id IS NOT NULL").collect():
        assert r.dup_ngram_chars == [brute_dup_chars(texts[r.doc_id], n) for n in quality.NGRAM_LIMITS]


def test_verdicts(table):
    plain = " ".join(f"w{i}" for i in range(80))
    rows = [(1, plain, "s"), (2, "w " * 49, "s"), (3, plain + "\n" + plain, "s"), (4, (plain + " once more the same line of words\n") * 1, "s"),
            (5, "\n".join([plain] + ["this line is said again and again here"] * 6), "s")]
    kept = {r.doc_id: r.kept for r in quality.quality_measures(table(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_filter_keeps_columns(docs, empty):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_measures(docs).where("kept").count()
    assert quality.quality_measures(empty).count() == 0 and quality.quality_filter(empty).count() == 0
