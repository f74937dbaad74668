"""Toxicity and personal data."""

import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlark.llm import pii, toxicity

from .conftest import ROWS


def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(3)
    neutral = ["river", "table", "green", "walks", "seven", "under", "cloud", "paper"]
    rows = []
    for i in range(600):
        words = [draw.choice(neutral) + draw.choice("aeiou") for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[draw.randrange(40)] = "vile" + draw.choice("xyzqk") + draw.choice("aeiou")
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(600, None, None), (601, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(df.select("doc_id", "text", F.lit(1).alias("score")), df.select("doc_id", "toxic"), F.col("doc_id") % 5 == 0).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)


def slow_features(text):
    """The distinct n-grams of the words between their edges, hashed."""
    out = set()
    for w in (text or "").lower().split():
        s = f"<{w.strip(toxicity._EDGES)}>"
        out |= {xxhash.xxh3_64_intdigest(s[i : i + n]) % 2**toxicity.BITS for n in range(3, 7) for i in range(len(s) - n + 1)}
    return out


def slow_scores(train, labels, texts):
    """Ratios, regression and scores over a dense matrix, feature by feature."""
    rows, y = [slow_features(t) for t in train], np.array(labels, float)
    n, n1 = len(y), y.sum()
    ratios = {}
    for f in sorted(set().union(*rows)):
        there = np.array([f in r for r in rows])
        a, b = (there & (y == 1)).sum(), (there & (y == 0)).sum()
        ratio = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n - n1 + 2))
        if a + b >= 5 and abs(ratio) > 1.5:
            ratios[f] = ratio
    x = np.array([[ratios[f] * (f in r) for f in ratios] for r in rows])
    share = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    weights, bias = np.zeros(len(ratios)), 0.0
    moments = np.zeros((2, len(ratios) + 1))
    for step in range(1, 151):
        p = 1 / (1 + np.exp(-(x @ weights + bias)))
        slope = np.append(x.T @ (share * (p - y)) / n + 5 * weights / n, (share * (p - y)).mean())
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        change = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    scaled = dict(zip(ratios, weights * np.array(list(ratios.values()))))
    return [1 / (1 + math.exp(-(bias + sum(scaled.get(f, 0.0) for f in slow_features(t))))) for t in texts]


def test_toxicity_like_brute_force(spark):
    """Learnt from the rows that aren't held out, one text a key, labels of a key joined; scores of all rows, whole texts."""
    draw = random.Random(8)
    rows = []
    for i in range(160):
        words = [draw.choice(["river", "table", "green", "walks", "seven", "under"]) + draw.choice("aeiou") for _ in range(draw.randint(0, 12))]
        rows.append((i, " ".join([*words, "vile" + draw.choice("xyz")] if i % 4 == 0 else words), int(i % 4 == 0)))
    rows += [(160, None, 0), (161, "", 1), (162, "VILEX, [greena]!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.classify(df.select("doc_id", "text"), labels, F.col("doc_id") % 5 == 0).collect()
    train = [(t, 1 if k == 1 else y) for k, t, y in rows if y is not None and k % 5]
    want = dict(zip([r[0] for r in rows], slow_scores(*zip(*train), [r[1] for r in rows])))
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs, none, F.lit(False)).collect()
    assert len(got) == len(ROWS) and {r.score for r in got} == {0.5}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(t):
    digits = lambda s: [c for c in s if c in "0123456789"]
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in kinds.items() for m in re.finditer(p, t) if good(m[0])]


@pytest.mark.parametrize("letters", ["ab@.1-+% ", "0123456789-  ", "+0123456789 ().-", "012.5 ", "a@.-b1 é😀"])
def test_base_spans(letters):
    draw = random.Random(letters)
    for _ in range(4000):
        t = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == base_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("see https://example.com/a?b=1, or", "url", "https://example.com/a?b=1"),
        ("IBAN: GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("account no. 12345678 is", "account", "12345678"),
        ("SSN 123-45-6789", "ssn", "123-45-6789"),
        ('token = "a3a1b97e25e5" x', "secret", "a3a1b97e25e5"),
        ("password=b7db7aa4a5 x", "secret", "b7db7aa4a5"),
    ],
)
def test_more_kinds(text, kind, found):
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k == kind] == [found]


def test_long_digits_are_no_limit():
    for zeros in (0, 3999, 4200, 100_000):
        t = "0" * zeros + "1.2.3.4"
        assert pii.find_spans(t) == [("ip", 0, len(t))]
    assert not [s for s in pii.find_spans("9" * 5000 + ".2.3.4") if s[0] == "ip"]


@pytest.mark.parametrize("part", ["secret=", "token: ", "www.", "http://", "a@", "a.b@c.d", "+1 ", "iban ", "account no 1", "1.2.", "1-", "ssn ", "password='"])
def test_time_grows_with_the_text(part):
    """Eight times the text takes at most some sixteen times as long."""
    took = []
    for n in (3000, 24_000):
        began = time.process_time()
        pii.find_spans(part * n)
        took.append(time.process_time() - began)
    assert took[1] <= 16 * took[0] + 0.2


def test_rows(docs, no_docs):
    got = pii.find(docs).collect()
    for r in got:
        text = next(t or "" for k, t, _ in ROWS if k == r.doc_id)
        assert [tuple(s) for s in r.spans if s.kind in pii.BASE] == base_spans(text)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[1] is None and masked[11] == "mail <EMAIL> or <PHONE>, <IP>, <CARD>" and pii.mask(docs).columns == docs.columns
    assert pii.find(no_docs).count() == 0
