from collections import Counter

import corpus_pipeline
from conftest_helpers import words

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path_factory):
    """Each stage against what its own input lets a plain program expect."""
    from gradeframe.llm import mixing, quality, simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder = docs.columns, tmp_path_factory.mktemp("stages")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "source mixing", "token output"]

    before, after = seen["quality rules"]
    bad = {r.doc_id for r in quality.quality_measures(before).where("NOT kept").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = seen["simhash near-dedup"]
    comp = simhash.simhash_components(before, simhash.NEAR_COPY).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in comp})
    texts = Counter(r.text for r in after.collect())
    assert max(texts.values()) == 1

    before, after = seen["benchmark decontamination"]
    grams = lambda t: {tuple(w[k:k + 5]) for w in [[x.lower() for x in words(t)]] for k in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in before.collect() for have in [grams(r.text)] if any(i and len(i & have) >= 0.8 * len(i) for i in items)}
    assert leaky and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaky

    before, after = seen["source mixing"]
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_taken(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({d: c for d, c in taken.items() if c})

    before, after = seen["token output"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_hand_python_small_batches(spark):
    """A stage called by itself bounds the bytes that a Python worker holds of wide rows."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    wide = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])})

    got = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 8_000_000


def test_cache_of_segments_is_small():
    import public_tokenizers

    from gradeframe.llm import tokens
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.key.nbytes + e.at.nbytes + e.n.nbytes + e.most * e.ids.itemsize <= 50 << 20
