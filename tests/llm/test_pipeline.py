"""The pipeline's stages, one after another, against brute force."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from gridlark.llm import pii  # noqa: E402

from .test_near import classes  # noqa: E402
from .test_quality import counts  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(30, 300))), "en") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en") for i in range(10)]
    rows += [(200 + i, f"{rows[20 + i][1]} {passage} end{i}", "en") for i in range(5)]
    rows += [(300, "too short", "en"), (301, None, None), (302, "r " * 200, "en"), (303, rows[40][1] + " write to a.b@example.com now", "en"), (304, " ".join(f"own{i}" for i in range(40)) + " write to a.b@example.com now", "en")]
    rows = [(k, t, lang, "s", None if t is None else len(t)) for k, t, lang in rows]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def brute(rows):
    """Kept texts by doc_id after the first four stages."""
    kept = []
    for k, t, *_ in rows:
        n, _, _, _, repeated = counts(t)
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append((k, t))
    roots = classes([t for _, t in kept])
    least = {}
    for (k, _), r in zip(kept, roots):
        least[r] = min(least.get(r, k), k)
    kept = [(k, t) for k, t in kept if k in least.values()]
    owner, split = {}, [(k, t.encode().split()) for k, t in kept]
    for k, w in split:
        for i in range(len(w) - 49):
            owner[tuple(w[i : i + 50])] = min(owner.get(tuple(w[i : i + 50]), k), k)
    out = {}
    for (k, t), (_, w) in zip(kept, split):
        gone = {j for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        out[k] = pii.masked(b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t)
    return out


def test_stages(spark, corpus, tmp_path):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    want = brute(rows)
    assert {k: t for k, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())
    assert 304 in want and "<EMAIL>" in want[304] and not {100, 300, 301, 302, 303} & set(want)


def test_run(spark, corpus):
    rows, folder = corpus
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(brute(rows)) and all(r.offset + r.length <= 4096 for r in packed)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
