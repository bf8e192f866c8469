import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_helpers import make_docs

from gradeframe.llm import tokens
from gradeframe.llm.words import runs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    from tokenizers import Tokenizer
    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", "a", "  ", "a  b", "a \nb", "a\n\nb c\n", "x y z", "é à b  c", "<|endoftext|> a <|endoftext|>\nb <|endoftext|>", "it's 'so' 12 3.4 ...",
       "\tq\tr \x85 s", "日本 語　です", "\U0001F600 a \U0001F600", " lead trail ", "a\x1cb \x1c c", " a   b", "x\r\ny\x0bz \x0c"]


def test_segments_encode_like_whole_texts():
    texts = ODD + [r[1] for r in make_docs()]
    encode = tokens.Encoder(PATH, slots=1 << 10, store=200)           # a tiny cache: slots clash and the store starts anew
    for _ in range(2):
        got, n = map(np.concatenate, zip(*(encode(t) for _, _, t in runs(pa.array(texts, pa.string())))))
        want = ids_of(texts)
        assert n.tolist() == list(map(len, want)) and got.tolist() == [i for ids in want for i in ids]


def test_codes_are_short_and_round_trip():
    rng = np.random.default_rng(2)
    counts = np.concatenate((2 ** np.arange(30), rng.integers(0, 50, 3000)))
    lengths = tokens.code_lengths(counts)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max() <= tokens.LONGEST and (0.5 ** lengths[used].astype(float)).sum() == 1
    codes, table = tokens.canonical_codes(lengths), tokens.decoding_table(lengths)
    ids = rng.choice(np.flatnonzero(used), 70_000)
    for n in (1, 2, 127, 128, 129, 70_000):
        bits, marks = tokens.pack(ids[:n], lengths, codes)
        assert (tokens.unpack(bits, marks, n, table) == ids[:n]).all()
    assert tokens.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_limited_lengths_are_optimal_for_short_limits():
    """Against trying all length multisets that fill the code space."""
    from itertools import combinations_with_replacement
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    best = min(sum(c * n for c, n in zip(sorted(counts, reverse=True), ns)) for ns in combinations_with_replacement(range(1, 5), len(counts))
               if sum(2.0 ** -n for n in ns) <= 1)
    assert (tokens.code_lengths(counts, 4) * counts).sum() == best


def test_digests(docs, empty):
    rows = [(r.doc_id, ids) for r, ids in zip(docs.collect(), ids_of([r.text for r in docs.collect()]))]
    got = tokens.token_digests(docs, PATH).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(repr((d, len(i), crc(i))) for d, i in rows)
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    order = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert tokens.token_digests(empty, PATH).count() == 0


def test_text_ids_and_many_rows_of_one_id(spark, empty):
    texts = [r[1] for r in make_docs()]
    rows = [(f"s{k % 7}/é{k}" if k % 3 else "hot", t) for k, t in enumerate(texts)] + [(None, "none"), (None, "none at all"), ("", "empty id")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted(tokens.token_digests(docs, PATH).collect(), key=lambda r: r.start)
    want = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids_of([t for _, t in rows]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    order = [b"" if r.doc_id is None else b"x" + r.doc_id.encode() for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
