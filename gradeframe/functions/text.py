"""Column-level text functions. Everything here stays on the JVM side and is row-local."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as a Unicode-aware text tool sees it, for btrim and for regex classes
WS_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_RUN = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

_CJK_GAP = r"(?<=[一-鿿])[ \t]+(?=[一-鿿])"
_SPELLED_RUN = r"(?<![0-9A-Za-z])[0-9A-Za-z](?: [0-9A-Za-z]){3,}(?![0-9A-Za-z])"
_DOT_GAP = r"(?U)(?<=\d)[ \t]*\.[ \t]*(?=\d)"
# whether the rewrites find anything: without a look behind every character, and by what is rare in prose first
_CJK_PAIR = r"[一-鿿][ \t]+[一-鿿]"
_SPELLED_HINT = r" [0-9A-Za-z] [0-9A-Za-z] [0-9A-Za-z]"
_DOT_PAIR = r"(?U)\d(?:[ \t]+\.[ \t]*|\.[ \t]+)\d"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A one-element transform: without it the optimizer may copy a costly expression (a split of a
    whole document) into a lambda that runs once per line.
    """
    return F.transform(F.array(value), body)[0]


def words(values: Sequence[str]) -> Column:
    """A literal string array."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def unicode_regex(pattern: str) -> str:
    """Same meaning of \\s \\w \\d \\b as in Unicode-aware engines, on any JDK; only \\n ends a line."""
    return "(?Ud)" + pattern


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (not only spaces)."""
    return F.btrim(c, F.lit(WS_CHARS))


def canonical_ws(c: Column) -> Column:
    """Any whitespace run becomes one space; ends trimmed."""
    return F.btrim(F.regexp_replace(c, WS_RUN, " "), F.lit(" "))


def _join_spelled_runs(t: Column) -> Column:
    """Join `J a v a` -> `Java`; runs that are all upper case (`A B C D`) stay as they are."""
    pieces = F.split(t, _SPELLED_RUN, -1)
    runs = F.regexp_extract_all(t, F.lit(_SPELLED_RUN), F.lit(0))
    joined = F.transform(
        runs,
        lambda r: F.when(r.rlike("[A-Z]") & ~r.rlike("[a-z]"), r).otherwise(F.replace(r, F.lit(" "), F.lit(""))))
    return F.array_join(F.zip_with(pieces, joined, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def collapse_char_spacing(c: Column) -> Column:
    """Undo letter spacing; the two rewrites feed each other, so repeat them (at most 8 rounds)."""

    def round_(t: Column) -> Column:
        return F.regexp_replace(bind(t, _join_spelled_runs), _DOT_GAP, ".")

    closed = bind(c, lambda t: F.when(t.rlike(_CJK_PAIR), F.regexp_replace(t, _CJK_GAP, "")).otherwise(t))
    return bind(
        closed,
        lambda t: F.when(
            (t.rlike(_SPELLED_HINT) & t.rlike(_SPELLED_RUN)) | t.rlike(_DOT_PAIR),
            F.aggregate(F.sequence(F.lit(1), F.lit(8)), t, lambda acc, _: round_(acc)),
        ).otherwise(t))


def canonical(c: Column) -> Column:
    """The single form used on both sides of every quote comparison."""
    return collapse_char_spacing(canonical_ws(c))


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR become LF, the ideographic space becomes a plain one."""
    def plain(t: Column) -> Column:      # few texts hold either, and a search for one character is cheap
        return F.when(F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\u3000")),
                      F.translate(F.regexp_replace(t, "\r\n?", "\n"), "\u3000", " ")).otherwise(t)

    return bind(c, plain)


def find(text: Column, needle: Column) -> Column:
    """0-based position, -1 when absent."""
    return F.call_function("locate", needle, text) - 1


def find_from(text: Column, needle: Column, start: Column) -> Column:
    """0-based position at or after the 0-based ``start``, -1 when absent."""
    return F.call_function("locate", needle, text, (start + 1).cast("int")) - 1


def piece(text: Column, start: Column, length: Column) -> Column:
    """0-based substring with column bounds."""
    return F.substring(text, (start + 1).cast("int"), length.cast("int"))


def contains_any(text: Column, vocabulary: Column) -> Column:
    return F.exists(vocabulary, lambda w: F.contains(text, w))


def contained(vocabulary: Column, text: Column) -> Column:
    """The non-empty words of ``vocabulary`` that occur in ``text``, in vocabulary order."""
    return F.filter(vocabulary, lambda w: (w != "") & F.contains(text, w))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def ends_with_any(c: Column, characters: str) -> Column:
    return F.contains(F.lit(characters), F.right(c, F.lit(1))) & (F.length(c) > 0)


def lines_of(c: Column) -> Column:
    """Split at every kind of line break; a final break does not open another line."""
    return bind(F.split(c, LINE_BREAK, -1),
                lambda ls: F.when(F.get(ls, F.size(ls) - 1) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls))


def fold_case(c: Column) -> Column:
    """Lower case, with the letters a case-insensitive regex also takes for s, k and i."""
    return F.lower(F.translate(c, "\u017f\u212a\u0131\u0130", "skii"))


def has_anchor(text: Column, anchors: Sequence[str]) -> Column:
    """Whether any of the literal strings occurs; no anchors means always.

    A substring search is some hundred times cheaper than a Unicode regex, so it goes first.
    """
    found = F.lit(not anchors)
    for a in anchors:
        found = found | F.contains(text, F.lit(a))
    return found
