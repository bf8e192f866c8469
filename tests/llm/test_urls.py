import random
import re

from gradeframe.llm import urls

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(LOW), m[2]) if m else ("", "")


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits or not host:
        return host, path, None, "allow"
    top = max(fits, key=lambda f: (f[0], f[1], f[2], f[3] == "block"))
    return host, path, top[2], top[3]


ODD = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/x?q#f", "http://a.example.net/en", "http://x.org/fr/1", "http://xorg/fr/",
       "http://example.com/de/", "http://notexample.com/de/", "http://de.example.com/de?x", "x://é.net/\n", "http://user@example.net:80/", "a://b.net/c://d.org/fr/", "http://a..net/",
       "http://.net/", "http://example.net./en/", "http://net-/x", "http://net0.net/a"]


def test_given_rules(spark, table, empty):
    rows = list(enumerate(ODD)) + [(None, "http://q.net/"), (7, ODD[7])]
    got = urls.judge_urls(table(rows, "page_id long, url string", ("host", "path", "rule")), urls.rule_table(spark))
    want = [(i, *brute(u, urls.RULES)) for i, u in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = table([], "page_id long, url string")
    assert urls.judge_urls(none, urls.rule_table(spark)).count() == 0


def test_many_nested_rules(spark, table):
    rng = random.Random(7)
    labels = ["a", "b", "c-d", "net", "org", "x1"]
    name = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = sorted({(rng.choice(("block", "allow")), name(rng.randint(1, 4)), rng.choice(("/", "/a", "/a/", "/a/b/", ""))) for _ in range(150)})
    rows = [(i, f"http://{name(rng.randint(1, 6))}{rng.choice(('', '/', '/a', '/ab', '/a/b/c', '/q'))}") for i in range(1500)]
    got = urls.judge_urls(table(rows, "page_id long, url string"), urls.rule_table(spark, rules))
    # one rule per host and path: the blocking one
    kept = {(h, p): "block" if ("block", h, p) in rules else v for v, h, p in rules}
    want = [(i, *brute(u, [(v, h, p) for (h, p), v in kept.items()])) for i, u in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_without_rules(spark, table):
    got = urls.judge_urls(table([(1, "http://a.net/")], "page_id long, url string"), urls.rule_table(spark).where("false"))
    assert [tuple(r) for r in got.collect()] == [(1, "a.net", "/", None, "allow")]
