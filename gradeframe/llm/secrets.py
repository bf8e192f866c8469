"""Secret scan of whole texts with column expressions only.

Patterns find assignments, access keys and long hex strings. On top of them a sliding window of WINDOW characters runs over
candidate strings of each character class; the Shannon entropy of the window follows from counts that change by one character
in and one out per step. Where windows reach the class's limit, the stretch from the first of them to the end of the last is
a span of its own kind. A candidate ends where something on the allow-list begins, and the next one begins behind its first
character; so what is random beside a placeholder is scanned like any other string.

Spans count code points, ends exclusive. Of each kind they are found from the left without overlap; matches that are too
short are dropped after matching, with the text that they used. Edge cases: a null text is the empty text; repeated rows and
null doc_ids give a row each; spans of different kinds may overlap or be equal and are ordered by start, then kind; extra
columns are ignored; an empty table gives an empty result.
"""

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import once
from ..functions.text import bind


class Pattern(NamedTuple):
    kind: str
    regex: str
    group: int      # the group whose length counts
    least: int


WINDOW = 24
#: Fixed patterns, in the order of kinds.
BASE = (
    Pattern("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # shorter runs of these two hold no later match either: their least length may stand in the pattern
    Pattern("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    Pattern("hex", r"([0-9a-f]{16,})", 1, 16),
)
#: Known not to be secrets: placeholders and runs of the alphabet or of one character. One group at most is in all of them.
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme", r"(?i)01234567|abcdefgh", r"(.)\1{7}")


class Charset(NamedTuple):
    kind: str
    chars: str      # a class of characters, in brackets
    bits: float     # entropy limit of a window
    needs: tuple[str, ...]

    def candidates(self, allowed: tuple[str, ...]) -> str:
        """Runs of the class of WINDOW characters or more in which nothing on the allow-list begins."""
        cut = "|".join(re.sub(r"^\(\?i\)(.*)$", r"(?i:\1)", p) for p in allowed)
        return f"(?={self.chars}{{{WINDOW}}})(?:" + (f"(?!{cut})" if cut else "") + f"{self.chars}){{{WINDOW},}}+"

    @property
    def regex(self) -> str:
        return self.candidates(ALLOWED)


#: Words of prose stay below these limits: 24 characters of random hex have about 3.4 bits each, of random base64 4.3, of random
#: base32 and of random lower case and digits about 4.1. Letters beyond F tell the last two from hex.
CHARSETS = (
    Charset("entropy_hex", "[0-9A-Fa-f]", 3.1, ("[0-9]", "[A-Fa-f]")),
    Charset("entropy_base64", "[A-Za-z0-9+/_-]", 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
    Charset("entropy_lower", "[a-z0-9]", 3.7, ("[0-9]", "[g-z]")),
    Charset("entropy_upper", "[A-Z0-9]", 3.7, ("[0-9]", "[G-Z]")),
)

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _starts(text: Column, regex: str, hits: Column) -> Column:
    """Start of each hit (there is one at least): the lengths of the gaps and hits before it.

    Sums run inside rows of about the root of the number of hits and over the rows, as an array that grows hit by hit is copied
    at each of them.
    """
    gaps = F.transform(F.split(text, regex, -1), F.length)
    steps = F.slice(F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("hit")), F.lit(1), F.size(hits))

    def running(items: Column, first: Column, before, size) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda acc, s: F.struct(
            (acc["at"] + size(s)).alias("at"), F.array_append(acc["out"], acc["at"] + before(s)).alias("out")), lambda acc: acc["out"])

    def by_rows(s: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(s))).cast("int")
        count = F.ceil(F.size(s) / width).cast("int")
        return bind(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(s, k * width + 1, width)), in_rows)

    def in_rows(rows: Column) -> Column:
        sizes = F.transform(rows, lambda r: F.aggregate(r, F.lit(0), lambda n, s: n + s["gap"] + s["hit"]))
        firsts = running(sizes, F.lit(0), lambda n: F.lit(0), lambda n: n)
        return F.flatten(F.zip_with(rows, firsts, lambda r, first: running(r, first, lambda s: s["gap"], lambda s: s["gap"] + s["hit"])))

    return bind(steps, by_rows)


def _matches(text: Column, p: Pattern, number: int) -> Column:
    whole = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    if p.group == 1:                                 # the group is the whole match: short ones need no second look
        found = bind(whole, lambda hits: F.when(F.exists(hits, lambda h: F.length(h) >= p.least), F.zip_with(
            hits, _starts(text, p.regex, hits), lambda h, s: F.struct(s.alias("start"), F.lit(number).alias("kind"), (s + F.length(h)).alias("stop")))))
    else:
        def with_groups(hits: Column) -> Column:
            sized = F.arrays_zip(_starts(text, p.regex, hits).alias("s"), F.transform(hits, F.length).alias("n"),
                                 F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)), F.length).alias("g"))
            good = F.filter(sized, lambda m: m["g"] >= p.least)
            return F.transform(good, lambda m: F.struct(m["s"].alias("start"), F.lit(number).alias("kind"), (m["s"] + m["n"]).alias("stop")))

        found = bind(whole, lambda hits: F.when(F.size(hits) > 0, with_groups(hits)))
    kept = F.filter(found, lambda m: m["stop"] - m["start"] >= p.least) if p.group == 1 else found
    return F.coalesce(kept.cast(_SPAN), F.array().cast(_SPAN))


def hot_stretch(s: Column, bits: float, window: int = WINDOW) -> Column:
    """Struct (start, stop) of the stretch of ``s`` covered by windows whose entropy is at least ``bits``; start -1 if none.

    The sum of c log2 c over the counts c of the window's characters changes by two terms per step; entropy is
    log2(window) minus that sum over window.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    limit = window * (math.log2(window) - bits) + 1e-9
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)

    def step(code_array: Column):
        def run(acc: Column, i: Column) -> Column:
            new, old = F.get(code_array, i), F.coalesce(F.get(code_array, i - window), F.lit(-1))
            leaving = F.when(i >= window, old).otherwise(-1)

            def counted(counts: Column) -> Column:
                now, was = F.get(counts, new), F.get(counts, leaving)
                plus = F.get(term, now + 1) - F.get(term, now)
                # the leaving character is counted after the new one came in
                left = was + F.when(leaving == new, 1).otherwise(0)
                minus = F.when(leaving >= 0, F.get(term, left) - F.get(term, left - 1)).otherwise(0.0)
                total = acc["sum"] + plus - minus
                hot = (i >= window - 1) & (total <= limit)
                return F.struct(
                    F.transform(counts, lambda v, k: v + F.when(k == new, 1).otherwise(0) - F.when(k == leaving, 1).otherwise(0)).alias("counts"),
                    total.alias("sum"),
                    F.when(hot & (acc["start"] < 0), i - window + 1).otherwise(acc["start"]).alias("start"),
                    F.when(hot, i + 1).otherwise(acc["stop"]).alias("stop"))

            return bind(acc["counts"], counted)
        return run

    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    return bind(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), zero, step(c), lambda acc: F.struct(
        acc["start"].alias("start"), acc["stop"].alias("stop"))))


def _entropy(text: Column, c: Charset, number: int, allowed: tuple[str, ...], window: int) -> Column:
    def suspicious(s: Column) -> Column:
        test = F.lit(True)
        for needed in c.needs:
            test = test & s.rlike(needed)
        return test

    regex = c.candidates(allowed)

    def spans(hits: Column) -> Column:
        placed = F.zip_with(hits, _starts(text, regex, hits), lambda h, s: F.struct(h.alias("h"), s.alias("s")))
        hot = F.transform(F.filter(placed, lambda m: suspicious(m["h"])),
                          lambda m: F.struct(m["s"].alias("s"), hot_stretch(m["h"], c.bits, window).alias("x")))
        return F.transform(F.filter(hot, lambda m: m["x"]["start"] >= 0), lambda m: F.struct(
            (m["s"] + m["x"]["start"]).alias("start"), F.lit(number).alias("kind"), (m["s"] + m["x"]["stop"]).alias("stop")))

    found = bind(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: F.when(F.exists(hits, suspicious), spans(hits)))
    return F.coalesce(found.cast(_SPAN), F.array().cast(_SPAN))


def secret_spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, charsets: tuple[Charset, ...] = CHARSETS,
                 window: int = WINDOW) -> DataFrame:
    """doc_id and ``found``: all spans of each text as an array of (start, kind, stop), sorted; kinds are numbered as in BASE and
    then ``charsets``."""
    text = F.col("text")
    parts = [_matches(text, p, k) for k, p in enumerate(BASE)]
    parts += [_entropy(text, c, len(BASE) + k, allowed, window) for k, c in enumerate(charsets)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return once(texts, "found", F.array_sort(F.concat(*parts))).select("doc_id", "found")


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans: the spans as text, kind:start:end joined by commas."""
    names = [p.kind for p in BASE] + [c.kind for c in options.get("charsets", CHARSETS)]
    named = F.array(*map(F.lit, names))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(named, m["kind"]), m["start"], m["stop"])), ",")

    found = F.col("found")
    def number_of(kind: int) -> Column:
        return F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long")

    counts = [number_of(k).alias(f"n_{p.kind}") for k, p in enumerate(BASE)]
    base = F.filter(found, lambda m: m["kind"] < len(BASE))
    return secret_spans(docs, **options).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"))
