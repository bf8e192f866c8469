import re

import numpy as np
import xxhash

from gradeframe.llm import lines

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def norm(line):
    return tuple(WORDS.findall(line.lower()))


def simhash(ws):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """Removed (row, line) pairs, links over all pairs of distinct lines."""
    said = [(d, k, n, norm(line)) for k, (d, text) in enumerate(rows) for n, line in enumerate((text or "").split("\n")) if text is not None and norm(line)]
    distinct = sorted({s[3] for s in said})
    sims = np.array([simhash(w) for w in distinct], np.uint64)
    root = {w: w for w in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(sims[:i] ^ sims[i]) <= 3):
            b = distinct[j]
            if edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    seen, gone = set(), []
    for d, k, n, w in sorted(said, key=lambda s: (s[0] is not None, s[0], s[1], s[2])):
        if find(w) in seen:
            gone.append((d, n))
        seen.add(find(w))
    return sorted(map(repr, gone)), len(said), sum(len({w for w in distinct if find(w) == g}) > 1 for g in {find(w) for w in distinct})


def variants():
    """A family of near lines around one frequent line, chains, and lines too far apart, over the given odd texts."""
    base = [f"word{i}" for i in range(60)]
    out = [" ".join(base)] * 5
    for k in range(25):
        w = list(base)
        w[k * 2] = "other"
        out.append(" ".join(w))
    out += [" ".join(base[k:] + base[:k]) for k in (1, 20)] + ["", "--- ***", "Short line!", "short LINE", "x " * 1500, "x " * 1500 + "y"]
    return out


def test_groups_against_all_pairs(docs, table):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id < 100 or r.doc_id > 101]
    rows += [(200 + k, line) for k, line in enumerate(variants())] + [(300, "\n".join(variants()))]
    df = table(rows, "doc_id long, text string", ("words", "line", "pos"))
    want, n, fuzzy = brute(rows)
    got = lines.line_groups(df).collect()
    assert len(got) == n and fuzzy >= 1
    # repeated rows with equal ids are interchangeable, so compare without the row
    assert sorted(repr((r.doc_id, r.pos)) for r in got if r.removed) == want


def test_report_and_texts(docs, empty):
    report = lines.line_report(docs).collect()
    assert all(r.n_removed == len(r.removed_lines) <= r.n_lines for r in report)
    clean = lines.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    count = lambda df: sum(bool(norm(x)) for r in df.collect() if r.text is not None for x in r.text.split("\n"))
    assert count(docs) - count(clean) == sum(r.n_removed for r in report)
    assert lines.line_report(empty).count() == 0 and lines.dedup_lines(empty).count() == 0


def test_no_python_on_the_plan(docs):
    plan = lines.occurrences(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_bit_of_the_simhash(table):
    """Bits 0 to 63, of lines on both sides of what the small counters hold."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(n))) for k, n in enumerate((1, 2, 3, 8, 33, 127, 509, 510, 511, 512, 3000))]
    rows += [(50, "same " * 510), (51, "same " * 511), (52, "a b " * 255)]
    got = {r.doc_id: r.sim % (1 << 64) for r in lines.occurrences(table(rows, "doc_id long, text string")).collect()}
    assert got == {d: simhash(norm(text)) for d, text in rows}


def test_lines_near_in_simhash_only_are_not_compared_with_each_other(table, monkeypatch):
    """Lines that one frequent word makes near: the tests of the second step do not grow with the square of their number,
    and links among them, in long and short lines, are those of all pairs."""
    rows = [(k, " ".join(f"the {x}{k}" for x in "pqrstuvw") + " the the") for k in range(150)]
    rows += [(200 + k, " ".join([f"u{k}", f"t{k}"] + ["the"] * 4 + [f"s{k}"] * 4 + ["the"] * 12)) for k in range(60)]
    rows += [(300 + k, " ".join(["the"] * 6 + [f"a{k // 2}b{i}" if i % 8 or k % 2 else "other" for i in range(5)] + ["the"] * 10)) for k in range(60)]
    rows += [(400 + k, "the " * (k + 1)) for k in range(12)]
    rows += [(500 + k, " ".join(f"{x}{k // 2}" for x in "abcdefghij"[:: -1 if k % 2 else 1])) for k in range(40)]
    sizes, kept = {}, lines.staged

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(lines, "staged", counted)
    got = lines.line_groups(table(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.pos)) for r in got if r.removed) == brute(rows)[0]
    assert sizes["line-crowd"] > 0 and sizes["line-again"] < 16000         # all pairs are over 50 000


def _counts(monkeypatch):
    sizes, kept = {}, lines.staged

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(lines, "staged", counted)
    return sizes


def test_near_lines_of_unlike_lengths_are_no_candidates(table, monkeypatch):
    """Lines that are near in SimHash but differ too much in their numbers of words are neither read again nor tested."""
    rows = [(k, "the " * n) for k, n in enumerate((1, 2, 4, 7, 12, 20, 33, 60, 100, 160, 600))]
    rows += [(100 + k, " ".join(["of"] * n + [f"z{k}"])) for k, n in enumerate((3, 8, 15, 25, 40))]
    sizes = _counts(monkeypatch)
    got = lines.line_groups(table(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and not any(r.removed for r in got) and brute(rows)[0] == []
    assert sizes["line-tested"] == sizes["line-again"] == 0


def test_linked_lines_do_not_meet_again(table, monkeypatch):
    """One line that fails with the common one sends its value to the second test, where only lines of different groups meet."""
    rows = [(k, " ".join(["the"] * 20 + [f"a{k}"])) for k in range(40)]
    rows += [(100 + k, " ".join(["the"] * 12 + [f"z{k}y{i}" for i in range(9)])) for k in range(2)]
    rows += [(200 + k, " ".join(["the"] * 12 + [f"z0y{i}" for i in range(8)] + [f"x{k}"])) for k in range(3)]
    sizes = _counts(monkeypatch)
    got = lines.line_groups(table(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.pos)) for r in got if r.removed) == brute(rows)[0]
    assert sizes["line-crowd"] == len(rows) and sizes["line-again"] < 300      # all pairs are 990
