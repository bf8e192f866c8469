import random
import re
from collections import Counter

import pytest
from conftest_helpers import make_docs

from gradeframe.llm import phrases

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, top=2000, share=100):
    """The definition, phrase by phrase, in Python integers."""
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i:i + n])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), f in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * f >= share * candidates[lang, p[i:i + n]]:
                    dropped.add((lang, p[i:i + n]))
    out = []
    for lang in {k[0] for k in candidates}:
        mine = []
        for (where, p), a in candidates.items():
            if where == lang and (where, p) not in dropped:
                score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def prose(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "a", "mañana", "x\x1cy", "new", "york", "city", "hall", "日本", "it's", "b\x00c", "\U0001F600"] + [f"w{i}" for i in range(30)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(rng.randint(0, 120)):
            out.append(rng.choice(("New York City Hall", "new\tyork", "of the")) if rng.random() < 0.15 else rng.choice(vocab[:8] if rng.random() < 0.5 else vocab))
            out.append(rng.choice((" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " - ", "\r\n", "!")))
        rows.append((d, "".join(out), rng.choice(("en", "fr", None, "und", "en"))))
    rows += [(500, "ab " * 3000, "en"), (501, None, "fr"), (502, "", None), (503, " \t.\n", "de"), (504, "one", "en"), rows[3], rows[3], (None, rows[4][1], "en")]
    return rows


def run(df, **k):
    return sorted(tuple(r) for r in phrases.collocations(df, **k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, share, top", [(4, 100, 2000), (2, 70, 2000), (15, 100, 5), (1, 100, 50)])
def test_against_the_definition(table, least, share, top, monkeypatch):
    monkeypatch.setattr(phrases.gather, "__defaults__", (300,))            # many windows
    rows = prose()
    assert run(table(rows, SCHEMA, extra=("phrase", "c", "n", "range", "words")), least=least, share=share, top=top) == brute(rows, least, top=top, share=share)


def test_many_ranges_lack_their_beginnings(spark, table):
    """Ranges that start in the middle of one word's phrases still find the counts of the open ones."""
    rows = [(i, f"hub a{i % 40} b{i % 40} c{i % 3}. x{i % 7} y{i % 40} hub", "en") for i in range(600)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(table(rows, SCHEMA), least=5) == brute(rows, 5)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_full_filter_changes_nothing(table):
    rows = prose(seed=8, n=60)
    assert run(table(rows, SCHEMA), least=3, max_bits=128) == brute(rows, 3)


def test_products_beyond_64_bits(spark):
    n, c = 3 * 10 ** 16 + 7, 9 * 10 ** 15 + 1
    rows = [(c, n, 3, [c + 5, c + 11], [c + 2, 10 ** 16 + 3]), (c, n, 2, [c], [c]), (1, n, 3, [10 ** 9, 10 ** 9], [10 ** 9, 10 ** 9])]
    got = spark.createDataFrame(rows, "c long, n long, depth int, starts array<long>, ends array<long>").select(phrases.lowest_cut().alias("x")).collect()
    for (c, n, d, s, e), r in zip(rows, got):
        assert tuple(r.x) == min((1000 * c * n // (s[k - 1] * e[d - k - 1]), k) for k in range(1, d))


def test_empty_and_unusual_tables(table):
    assert run(table([], SCHEMA)) == []
    assert run(table([(1, None, None), (2, "", "en")], SCHEMA)) == []
    rows = [(r[0], r[1], None) for r in make_docs()]
    assert run(table(rows, SCHEMA), least=3) == brute(rows, 3)
    assert run(table(rows, SCHEMA), least=3, longest=2) == brute(rows, 3, longest=2)


def test_no_window_is_held_while_the_next_is_gathered():
    import weakref

    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"text": [f"a b{i} c d"], "lang": ["en"]}) for i in range(4)]
    seen = []

    def watched():
        for b in batches:
            assert all(ref() is None for ref in seen)
            yield b

    for g in phrases.gather(watched(), window=1):
        assert g.start.dtype == g.end.dtype == "int32"
        seen.append(weakref.ref(g.data))
        del g
    assert len(seen) == 4


def test_a_task_hands_on_a_phrase_once_for_many_windows():
    import pyarrow as pa
    window = [("en", "a", 1, 2), ("en", "a b", 2, 1), ("fr", "a", 1, 3), ("en", "", 0, 9)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "phrase", "depth", "c"), r)) for r in window],
                                       pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("depth", pa.int32()), ("c", pa.int64())]))
    for most in (1000, 20, 5, 1):
        out = list(phrases.merged(iter([batch] * 50), most))
        assert all(b.schema == batch.schema for b in out)
        total = Counter()
        for r in (r for b in out for r in b.to_pylist()):
            total[r["lang"], r["phrase"], r["depth"]] += r["c"]
        assert total == {r[:3]: 50 * r[3] for r in window}
        assert sum(b.num_rows for b in out) == (4 if most > 5 else 4 * 25 if most == 5 else 4 * 50)
    assert list(phrases.merged(iter([]))) == []
