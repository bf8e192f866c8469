"""Quality rules from repetition: characters inside duplicated word n-grams and lines, found by rolling hashes.

Edge cases: a null text counts as empty (no words, base_failed); rows are judged one by one, so ties and repeated rows get
equal verdicts; extra columns pass through ``quality_filter`` and are left out of ``quality_measures``; an empty table
gives an empty result. Texts are read whole, in runs whose size is bounded by the longest text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Texts, mix, repeated, runs

#: Share of a text's word characters that later copies of n-word windows may cover, by n: above what one line said twice
#: makes in a text of MIN_WORDS words.
NGRAM_LIMITS = {5: 0.24, 7: 0.22, 10: 0.20}
#: Share of a text's word characters that later copies of lines may hold.
LINE_LIMIT = 0.30
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "dup_line_chars long, dup_ngram_chars array<long>, kept boolean")


def measure(t: Texts, limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """All measures of a run of texts."""
    lead = (t.data & 0xC0) != 0x80                               # first byte of a character
    chars = np.concatenate(([0], np.cumsum(lead & ~t.space, dtype=np.int64)))
    n_words, word_chars = t.n_words, t.per_text(lead & ~t.space)
    salt = mix(np.arange(1, t.n + 1, dtype=np.uint64))          # equal content in different texts gets different keys

    start, end, owner = t.lines()
    worded = chars[end] > chars[start]
    start, end, owner = start[worded], end[worded], owner[worded]
    later = repeated(t.hashes(start, end) + salt[owner], later_only=True)
    n_dup_lines = np.bincount(owner[later], minlength=t.n)
    dup_line_chars = np.bincount(owner[later], weights=(chars[end] - chars[start])[later], minlength=t.n).astype(np.int64)

    words, doc = t.word_hashes(), t.doc
    word_len = chars[t.end] - chars[t.start]

    def covered(n: int, later_only: bool) -> np.ndarray:
        key, at = t.ngrams(words, n)
        at = at[repeated(key + salt[doc[at]], later_only)]
        edge = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(at + n, minlength=len(words) + 1)[: len(words) + 1]
        return np.cumsum(edge)[: len(words)] > 0

    n_repeat = t.per_word_text(covered(WINDOW, False))
    dup_chars = np.stack([t.per_word_text(word_len * covered(n, True)) for n in limits], axis=1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    good = (dup_chars <= np.array(list(limits.values())) * word_chars[:, None]).all(axis=1) & (dup_line_chars <= line_limit * word_chars)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": t.per_text(_SYMBOL[t.data]), "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat, "base_failed": failed, "dup_line_chars": dup_line_chars, "dup_ngram_chars": dup_chars,
            "kept": good & ~failed}


def _measured(batch: pa.RecordBatch, column: str, limits: dict[int, float], line_limit: float) -> dict[str, pa.Array]:
    found = [measure(t, limits, line_limit) for _, _, t in runs(batch.column(column), False)]
    out = {}
    for name in found[0] if found else ():
        values = np.concatenate([m[name] for m in found])
        if values.ndim == 2:
            at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            out[name] = pa.ListArray.from_arrays(at, pa.array(values.ravel().astype(np.int64)))
        else:
            out[name] = pa.array(values if values.dtype == bool else values.astype(np.int64))
    return out


def quality_measures(docs: DataFrame, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """doc_id and the measures of each text with the verdict ``kept``."""
    kind = dict(docs.dtypes)["doc_id"]

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                cols = {"doc_id": batch.column("doc_id")} | _measured(batch, "text", limits, line_limit)
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, {MEASURES}")


def quality_filter(docs: DataFrame, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns. No shuffle."""
    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(_measured(batch, "text", limits, line_limit)["kept"])

    return docs.mapInArrow(keep, docs.schema)
