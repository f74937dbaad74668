"""The distributed automaton against plain counts."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import scoring

from .conftest import ROWS


@pytest.fixture(autouse=True)
def few_partitions(monkeypatch):
    """Many buckets, several to a partition."""
    monkeypatch.setattr(scoring, "PARTITIONS", 6)


class Brute:
    """Counts of n-grams as tuples, and probabilities straight from the formula."""

    def __init__(self, texts, priors):
        self.priors, self.counts, self.followed = priors, collections.Counter(), collections.Counter()
        for t in texts:
            w = ["start", *self.words(t)]
            for order in range(1, len(priors) + 2):
                for i in range(1, len(w)):
                    if i + 1 >= order:
                        gram = tuple(w[i + 1 - order : i + 1])
                        self.counts[gram] += 1
                        self.followed[gram[:-1]] += order > 1
        known = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(known.values()), len(known)

    @staticmethod
    def words(t):
        return [*(t or "").encode().lower().split(), "end"]

    def p(self, history, w):
        if not history:
            return (self.counts[w,] + 0.1) / (self.n + 0.1 * (self.v + 1))
        shorter, k, seen = self.p(history[1:], w), self.priors[len(history) - 1], self.followed[history]
        return (self.counts[(*history, w)] + k * shorter) / (seen + k) if seen else shorter

    def score(self, t):
        w = ["start", *self.words(t)]
        most = len(self.priors)
        steps = [(tuple(w[max(0, i - most) : i]), w[i]) for i in range(1, len(w))]
        return len(steps), sum(self.counts[x,] > 0 for _, x in steps), self.n, sum(math.log10(self.p((), x)) for _, x in steps), sum(math.log10(self.p(h, x)) for h, x in steps)


def rounded(rows):
    return sorted(((k, *x[:-2], *(round(y, 6) for y in x[-2:])) for k, *x in rows), key=lambda x: (str(x[0]), x[1:]))


def scored(df, held, **options):
    return [tuple(r) for r in scoring.score(df, held, **options).collect()]


@pytest.mark.parametrize("priors", [(100.0,), (3.0, 1.0), (300.0, 30.0, 10.0)])
@pytest.mark.parametrize(("block", "buckets"), [(1 << 20, 4), (200, 5000)])
def test_scores(docs, priors, block, buckets):
    size = max(1, scoring.input_bytes(docs) // buckets)
    got = scored(docs, F.coalesce(F.col("doc_id") % 4 == 0, F.lit(True)), priors=priors, block_bytes=block, bucket_bytes=size)
    held = [k is None or k % 4 == 0 for k, *_ in ROWS]
    brute = Brute([t for (_, t, *_), h in zip(ROWS, held) if not h], priors)
    assert rounded(got) == rounded((k, h, *brute.score(t)) for (k, t, *_), h in zip(ROWS, held))


def corpus(n, seed=2):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(300)], k=draw.randint(0, 60))) for _ in range(n)]


def test_repeated_rows_lie_in_several_blocks(spark):
    texts = corpus(60) + ["all the same text here"] * 300
    df = spark.createDataFrame([(7 if i >= 60 else 100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    brute = Brute(texts, scoring.PRIORS)
    got = scored(df, F.lit(False), block_bytes=500)
    assert rounded(got) == rounded((7 if i >= 60 else 100 + i, False, *brute.score(t)) for i, t in enumerate(texts))
    blocks, _ = scoring.requests(df, F.lit(False), "doc_id", "text", 4, 40, 500, 1 << 20)
    assert blocks.where(F.array_contains("keys", 7)).count() > 5


def test_rows_grow_with_the_input(spark):
    """With more buckets than a block has n-grams, and more with more input, requests grow with the input alone."""
    rows = []
    for n in (150, 600):
        df = spark.createDataFrame(list(enumerate(corpus(n))), "doc_id long, text string").coalesce(1)
        _, asked = scoring.requests(df, F.lit(False), "doc_id", "text", 4, 40, 2000, max(1, scoring.input_bytes(df) // (20 * n)))
        entries = sum(len(scoring.unpack_sorted(h)) for r in asked.collect() for h in r.hashes if h is not None)
        rows.append((asked.count(), entries))
    assert all(r <= e for r, e in rows)
    assert rows[1][0] <= 6 * rows[0][0]  # the square of the input would be 16 times


def test_texts_that_occur_twice_score_apart(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(draw.choices(words, k=60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    got = {r[0]: r[-1] / r[2] for r in scored(df, F.lit(False))}
    once = sorted(got[i] for i in range(30, 300))
    assert sum(got[i] > once[int(0.9 * len(once))] for i in range(30)) >= 27


def test_empty_table_and_no_training(docs, no_docs):
    assert scored(no_docs, F.lit(False)) == []
    rows = scored(docs, F.lit(True))
    assert len(rows) == len(ROWS) and all(r[3] == 0 and r[4] == 0 and math.isfinite(r[-1]) for r in rows)


def test_probabilities_sum_to_one():
    brute = Brute(corpus(20), (3.0, 2.0))
    words = [g[0] for g in brute.counts if len(g) == 1]
    for h in [(), ("start",), ("start", words[0]), (words[3], words[5]), *list(brute.followed)[:40]]:
        assert sum(brute.p(h, w) for w in [*words, "unknown"]) == pytest.approx(1.0)


def test_packing_of_arrays():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (scoring.unpack_sorted(scoring.pack_sorted(values)) == values).all()
    for bits in (24, 32, 44, 64):
        some, at = scoring.cuts(values >> np.uint64(64 - bits), 7, bits)
        assert some.tolist() == list(range(7)) and at[0] == 0 and at[-1] == 1000
        assert all(int(v) * 7 >> bits == b for b, x, y in zip(some, at, at[1:]) for v in values[x:y] >> np.uint64(64 - bits))
