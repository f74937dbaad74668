"""Very long texts, empty tables and columns that clash with names used inside, for every operator."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm import bpe, common, embedding, html, near, packing, pii, quality, scoring, simhash, substring, toxicity

from .test_duplicates import slow_fingerprint
from .test_labels import base_spans
from .test_quality import counts

public = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")
#: Names that the operators use for columns of their own.
CLASHING = "row node key hash spans text2 gram part prefix often sketch same fp n place block bucket tokens types sizes texts held c0 c1 group shift mask _key _text _words _once _stratum _same kept base_failed score ids decoded piece length _n _rank a b root __row __key __spans __kept __id".split()


@pytest.fixture(scope="module")
def long_docs(spark):
    draw = random.Random(6)
    words = ["river", "Über", "naïve", "it's", "12.5", "a@b.example", "10.0.0.1", "世界", "same same", "\n", "#tag"]
    long = " ".join(f"{draw.choice(words)}{draw.randrange(1000) if draw.random() < 0.5 else ''}" for _ in range(160_000))
    assert len(long) > common.STEP_CHARS
    rows = [(1, long, "en"), (2, "a short one", "en"), (3, long + " and one word more", "en"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {k: t or "" for k, t, _ in rows}, df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASHING))).repartition(2).cache()


def test_bytes_come_back(long_docs):
    texts, df = long_docs
    found = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in found} == texts


def test_spans(long_docs):
    texts, df = long_docs
    for r in pii.find(df).collect():
        assert [tuple(s) for s in r.spans if s.kind in pii.BASE] == base_spans(texts[r.doc_id])
    assert pii.mask(df).columns == df.columns


def test_counts(spark, long_docs):
    texts, df = long_docs
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    for r in quality.judge(df, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r[-1] for r in kept.collect()} <= {len(CLASHING) - 1}


def test_fingerprints_and_copies(long_docs):
    texts, df = long_docs
    got = {r.doc_id: r.fp % 2**64 for r in simhash.classes(df).collect()}
    assert got == {k: slow_fingerprint(t) for k, t in texts.items()}
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_passages(long_docs):
    texts, df = long_docs
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.strip(df, digest=True).collect()}
    sizes = {k: len(t.encode().split()) for k, t in texts.items()}
    assert got == {1: (sizes[1], 0), 2: (3, 0), 3: (sizes[3], sizes[1]), 4: (0, 0)}


def test_scores(long_docs):
    texts, df = long_docs
    got = {r[0]: r[2] for r in scoring.score(df, F.lit(False)).collect()}
    assert got == {k: len(t.encode().split()) + 1 for k, t in texts.items()}


def test_pieces(long_docs):
    tokenizers = pytest.importorskip("tokenizers")
    texts, df = long_docs
    library = tokenizers.Tokenizer.from_file(WORDS)
    sizes = {}
    for r in packing.pack(df, WORDS).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}


def test_toxicity(spark, long_docs):
    _, df = long_docs
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.classify(df, labels, F.lit(False)).collect()) == [1, 2, 3, 4]


def test_empty_tables(spark, long_docs):
    df = long_docs[1].where("1 = 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, label string, embedding array<float>, node int")
    pages = spark.createDataFrame([], T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]))
    for found in (bpe.encode(df, BYTES), scoring.score(df, F.lit(False)), html.extract(pages), quality.judge(df, labels), quality.keep_good(df, labels), substring.strip(df), substring.strip(df, digest=True), toxicity.classify(df, labels, F.lit(False)), embedding.classes(vectors), pii.find(df), pii.mask(df), simhash.classes(df), near.keep_one(df), packing.pack(df, WORDS)):
        assert found.collect() == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Session())
