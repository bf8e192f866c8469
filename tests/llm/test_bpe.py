import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_helpers import make_docs

from gradeframe.llm import bpe
from gradeframe.llm.words import buffers

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", "  ", "a  b", "a \nb", "a\n\nb c\n", "it's 'so' 'STOP' we'll they've I'd you're 'm 't''s 'sx 'llama 'l 've", "'", "''s", " 's", "\n's", "\n\n's x'", "s'’s",
       "12 3.4 ... 5%²Ⅷ", "\tq\tr \x85 s t　u", "日本 語　です", "\U0001F600 a \U0001F600", " lead trail ", "a\x1cb \x1c c", " a   b", "x\r\ny\x0bz \x0c",
       "ée ́", "՘࢏\U00011de0", "a" * 5000, " " * 4000 + "x", "ab" * 3000, "=-" * 700, "\x00 \x00\x00", "<|endoftext|> a", "'r", "'re", "x'l", "'ll's"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.of(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def run_of(texts):
    data, at = buffers(pa.array(texts, pa.string()))
    return bpe.Bytes(data, at)


def random_texts(n, seed=6):
    rng = random.Random(seed)
    parts = ["'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", " ", "　", "a", "the", "S", "é", "ß", "日", "1", "22", "²", ".", "!?", "\U0001F600", "́", "\r\n", "-", "ing", "Qu"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_those_of_the_library(vocabulary, library):
    texts = ODD + random_texts(4000) + [r[1] or "" for r in make_docs()]
    encode = bpe.Encoder(vocabulary, slots=1 << 10, store=3000)           # a tiny cache: slots clash and the store starts anew
    for lo in list(range(0, len(texts), 500)) * 2:
        ids, n = encode(run_of(texts[lo: lo + 500]))
        want = [library.encode_ordinary(t) for t in texts[lo: lo + 500]]
        assert n.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]
        data, size = vocabulary.decode(ids)
        assert data.tobytes() == "".join(texts[lo: lo + 500]).encode() and int(size.sum()) == len(data)


def test_pieces_are_the_matches_of_the_pattern(vocabulary):
    """The cuts alone, by an encoding whose tokens are single bytes of one match at a time."""
    import regex
    kinds = bpe.character_classes()
    # the regex module knows another Unicode version, so texts hold characters that both class alike
    for text in random_texts(1500, 9) + [t for t in ODD if "՘" not in t]:
        want = [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]
        run = run_of([text])
        starts = bpe.split(run.data, run.offsets, kinds).tolist()
        ends = [len(text[:e].encode()) for e in want]
        assert [*starts[1:], len(run.data)][: len(starts)] == ends


def test_every_character_next_to_others(vocabulary, library):
    """All code points, each between a letter, a space and a mark: classes and byte merges hold for the whole of Unicode."""
    encode = bpe.Encoder(vocabulary)
    for lo in range(0, 0x110000, 0x2000):
        text = "".join(f"a{chr(c)} {chr(c)}!" for c in range(lo, lo + 0x2000) if not 0xD800 <= c < 0xE000)
        assert encode(run_of([text]))[0].tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_whole():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        assert sorted(bpe.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.PerfectHash.build(np.array([5, 5], np.uint64))


def test_every_token_is_found_by_the_first_tier(vocabulary):
    t = bpe.Bytes(vocabulary.data, vocabulary.offsets)
    start, end = vocabulary.offsets[:-1], vocabulary.offsets[1:]
    encode = bpe.Encoder(vocabulary)
    encode.merge = None                                                  # the heap is not needed
    ids, n = encode.resolve(t, start, end, t.hashes(start, end))
    assert ids.tolist() == list(range(len(start))) and (n == 1).all()


def test_digests(docs, empty, library):
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append(repr((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())))
    got = bpe.round_trip_digests(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(want) == sorted(repr(tuple(r)) for r in got)
    assert bpe.round_trip_digests(empty, PATH).count() == 0


def test_decoding_of_ids_alone(spark, vocabulary, library):
    shared = bpe.share_vocabulary(spark, PATH)
    rows = [(1, "x", library.encode_ordinary("naïve café \U0001F600")), (None, None, []), (3, "z", None), (4, "y", [0, 1, 50255])]
    df = spark.createDataFrame(rows, "doc_id long, extra string, ids array<int>").coalesce(1)
    got = {r.doc_id: r for r in bpe.decode_ids(df, shared).collect()}
    assert bytes(got[1].decoded).decode() == "naïve café \U0001F600" and got[1].extra == "x"
    assert bytes(got[None].decoded) == b"" and got[3].decoded is None and bytes(got[4].decoded) == library.decode_bytes([0, 1, 50255])
    with pytest.raises(Exception):
        bpe.decode_ids(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), shared).collect()
