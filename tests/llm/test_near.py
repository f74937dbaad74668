"""The near-copy stage against brute-force Jaccard."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import common, near, simhash

from .test_duplicates import union


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def classes(texts):
    sets = list(map(grams, texts))
    return union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])


def edited():
    """Texts with some words replaced, from few edits to many, some behind a line that all share, and exact copies."""
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(900)}"
    base = [[word() for _ in range(draw.randint(30, 160))] for _ in range(25)]
    line = [f"common{i}" for i in range(12)]
    texts = [" ".join(line + b if i % 2 else b) for i, b in enumerate(base)]
    for _ in range(150):
        b = list(draw.choice(base))
        for i in draw.sample(range(len(b)), draw.randint(0, max(1, len(b) // 25))):
            b[i] = word()
        texts.append(" ".join(line + b if draw.random() < 0.5 else b).upper())
    return [*texts, *texts[:10], "one two", "One  TWO", "two one", "", None, " \n"]


def keys_kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    return [(r.doc_id, r.text) for r in kept.collect()]


@pytest.mark.parametrize(("pairs", "often", "block", "sketched"), [(64, 16, 1 << 18, 2048), (2, 1, 200, 3)])
def test_all_near_copies_link(spark, monkeypatch, pairs, often, block, sketched):
    """Also where all meetings are groups, shingles count as common at once, and blocks hold few sets."""
    for name, value in (("PAIRS", pairs), ("OFTEN", often), ("BLOCK", block), ("SKETCHED", sketched), ("SAMPLE", 2)):
        monkeypatch.setattr(near, name, value)
    texts = edited()
    got = keys_kept(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert sorted(k for k, _ in got) == sorted(set(classes(texts)))
    assert keys_kept(spark, []) == []


def test_less_similar_texts_stay(spark):
    """Pairs whose op9 prints lie within 4 bits, but whose similarity is below 0.8."""
    draw = random.Random(5)
    texts = []
    while len(texts) < 8:
        a = [f"w{draw.randrange(5000)}" for _ in range(800)]
        b = list(a)
        for i in draw.sample(range(800), 26):
            b[i] = "changed"
        a, b = " ".join(a), " ".join(b)
        if not similar(grams(a), grams(b)) and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4:
            texts += [a, b]
    assert sorted(k for k, _ in keys_kept(spark, [(i, t, "x") for i, t in enumerate(texts)])) == list(range(8))


def test_meetings_of_many_nodes_stream():
    rows = np.array([[7] * 500 + [9] * 3, list(range(503)), list(range(503)), [10] * 503])
    batches = [pa.record_batch([pa.array(x) for x in rows[:, i : i + 40]], names=list("gapn")) for i in range(0, 503, 40)]
    found = {(a, b, g) for batch in near._meetings(iter(batches), 8) for a, b, _, _, g in zip(*(c.to_pylist() for c in batch.columns))}
    assert found == {(i, 0, True) for i in range(1, 500)} | {(501, 500, False), (502, 500, False), (502, 501, False)}


def long_texts():
    """Texts of 3,000 words, of which each has 400 in common with all others but most are its own."""
    draw = random.Random(8)
    line = [f"common{i}" for i in range(400)]
    return [" ".join(line + [f"w{draw.randrange(90000)}" for _ in range(2600)]) for _ in range(12)]


def test_sketches_tell_long_texts_apart(spark):
    """Groups of long texts that share a passage only are cut to nothing, so their sets never meet; pairs likewise."""
    sets = [near.shingles(near.words_of(t)) for t in long_texts()]
    nodes = spark.createDataFrame([(i, len(s), near.sketch(s).tolist()) for i, s in enumerate(sets)], "node long, n long, sketch array<long>")
    groups = nodes.selectExpr("0L as root", "node", "node as part", "n")
    pairs = nodes.crossJoin(nodes.toDF("b", "m", "y")).where("node > b").selectExpr("node as a", "b")
    assert pairs.count() == 66 and near.possible(pairs, nodes).count() == 0
    assert near.finer(groups, nodes).count() == 0


@pytest.mark.parametrize(("pairs", "often", "sketched"), [(64, 16, 2048), (2, 1, 3)])
def test_near_copies_with_sketches_of_two_lengths(spark, monkeypatch, pairs, often, sketched):
    """Near copies on both sides of each number of places, where one sketch is halved to meet the other."""
    for name, value in (("PAIRS", pairs), ("OFTEN", often), ("SKETCHED", sketched), ("SAMPLE", 2)):
        monkeypatch.setattr(near, name, value)
    texts = long_texts()[:4]
    for places in (1024, 2048):
        draw = random.Random(places)
        for _ in range(3):
            words = [f"v{draw.randrange(90000)}" for _ in range(places - 40)]
            texts += [" ".join(words + [f"end{draw.random()}" for _ in range(k)]) for k in (0, 40, 90, 200)]
    lengths = {len(near.sketch(near.shingles(near.words_of(t)))) for t in texts}
    assert lengths == {16, 32, 64}
    got = keys_kept(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert sorted(k for k, _ in got) == sorted(set(classes(texts)))


def test_rows_without_key(spark):
    alone, null_class, mixed = ("a row without a key and no copy", "two rows without a key are copies", "a null and a key are copies here")
    got = keys_kept(spark, [(None, alone, "x"), (None, null_class, "x"), (None, null_class, "x"), (None, mixed, "x"), (7, mixed, "x")])
    assert sorted(got, key=str) == sorted([(None, alone), (None, null_class), (7, mixed)], key=str)


def test_repeated_keys(spark):
    """One row a class, though its key is repeated: exact rows, and a second text that copies another document."""
    first, other = "the first text of a repeated key", "another text that two documents have"
    got = keys_kept(spark, [(1, first, "x"), (1, first, "x"), (1, other, "x"), (2, other, "x")])
    assert sorted(got) == [(1, other), (1, first)]


def test_prefixes_are_shuffled_once_by_node(spark, monkeypatch):
    """Where no row numbers are sent to all executors, one relation alone is written from a join of the prefixes. (Edges are, of shingles exploded before.)"""
    joined, write = [], common.written

    def written(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joined.extend(label for _ in re.findall(r"FileScan parquet \[[^\]]*\bprefix#", plan) if "Join" in plan)
        return write(df, label)

    for module in (common, near):
        monkeypatch.setattr(module, "written", written, raising=False)
    for name, value in (("SENT", 0), ("PAIRS", 2), ("OFTEN", 1), ("SAMPLE", 2)):
        monkeypatch.setattr(near, name, value)
    texts = edited()
    got = keys_kept(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert sorted(k for k, _ in got) == sorted(set(classes(texts)))
    assert [label for label in joined if label != "edges"] == ["placed"]


def test_shuffle_files_go_once_a_relation_is_written(spark):
    """Also without a collection of the driver's garbage; the session's setting stays as it was."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if "shuffle_" in (name := files.apply(i).getName())}

    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with common.temporary() as keep:
        assert len(keep(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts").collect()) == 7
    since = time.time()
    while (left := {x for x in shuffled() - before if x.endswith(".data")}) and time.time() - since < 5:
        time.sleep(0.1)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_texts_stay_in_place(spark, monkeypatch):
    """Where there are more rows than row numbers that may be sent, words of 64 of them go to the rows, which aren't shuffled."""
    monkeypatch.setattr(near, "SENT", 40)
    monkeypatch.setattr(near, "kept_rows", lambda docs: docs.where("key % 3 = 0").select(F.col("row").alias("__id")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near.keep_one(spark.range(0, 900, 1, 3).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(i, f"text {i}") for i in range(0, 900, 3)]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
