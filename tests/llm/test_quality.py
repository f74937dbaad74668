import collections
import math
import random
import re

from pyspark.sql import functions as F

from gridlark.llm import quality

from .conftest import ROWS


def counts(t):
    b = (t or "").encode().split()
    seen = collections.Counter(tuple(b[i : i + 5]) for i in range(len(b) - 4))
    covered = {j for i in range(len(b) - 4) if seen[tuple(b[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(b), sum(len(w.decode()) for w in b), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs):
    extra = [(20, "a b c d e f a b c d e g a b c d e", "en"), (21, "x\nx\n\ny\nx\n \n ", "en"), (22, "#*$%&|<> <b>", None), (23, "r " * 50, "en")]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(df, labels).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted((str(k), counts(t)) for k, t, _ in [*ROWS, *extra])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # no labels, no cutoffs
    assert quality.judge(df.where("1 = 0"), labels).count() == 0


def test_tail_is_exact(spark):
    cases = [(50, 0), (300, 2), (2000, 9), (2000, 30), (100000, 900)]
    got = spark.createDataFrame(cases, "n long, k long").select(F.expr(quality.TAIL.format(alpha="0.01D"))).collect()
    for (n, k), (p,) in zip(cases, got):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert p == 1.0 if k >= n * 0.01 else abs(p - want) < 1e-9 * max(1, want / 1e-6)


def brute_cutoffs(rows):
    """Cutoffs by stratum from trials (stratum, good, half, scores by rule)."""
    chosen, strata = {}, {r[0] for r in rows if r[2] == 1 and r[1]}
    tail = lambda n, k: sum(math.comb(n, i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (n - i) for i in range(k + 1))
    for stratum in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == stratum]
        good = [r[3] for r in own if r[2] == 0 and r[1]]
        bad = [r[3] for r in own if r[2] == 0 and not r[1]]
        best = []
        for rule, cuts in quality.RULES.items():
            found = []
            for step, cut in enumerate(cuts):
                k, b = sum(x[rule] > cut for x in good), sum(x[rule] > cut for x in bad)
                if b - quality.GOOD_COSTS * k > 0 and k <= quality.ALPHA * len(good):
                    found.append((b - quality.GOOD_COSTS * k, -step, cut))
            if found:
                best.append((-max(found)[0], rule, max(found)[2]))
        held, kept = [r[3] for r in own if r[2] == 1 and r[1]], {}
        for j in range(1, len(best) + 1):
            verdict = sorted(best)[:j]
            if tail(len(held), sum(any(x[rule] > cut for _, rule, cut in verdict) for x in held)) > quality.DELTA / len(strata):
                break
            kept = {rule: cut for _, rule, cut in verdict}
        if kept:
            chosen[stratum] = kept
    return chosen


def labelled(seed=4):
    """Four strata, one null: bad texts have symbols, capitals or long words; some good ones have a few of these too."""
    draw, rows = random.Random(seed), []
    for lang, n, spoiled in (("en", 2600, 0.002), ("de", 1700, 0.03), (None, 1500, 0.0), ("xx", 60, 0.0)):
        for i in range(n):
            good = draw.random() < 0.8
            words = [f"{lang}{i}w{draw.randrange(10**6)}" for _ in range(draw.randint(12, 25))]
            if draw.random() < (spoiled if good else 0.5):
                words = [w.upper() for w in words]
            if draw.random() < (spoiled if good else 0.4):
                words = [w + "$" * draw.randint(1, 4) for w in words]
            if not good and draw.random() < 0.3:
                words = [w + "long" * 4 for w in words]
            rows.append((len(rows), " ".join(words), lang, int(good)))
    return rows + [(10_000 + i, *rows[i][1:]) for i in range(300)] + rows[:50]  # copies and repeated rows


def test_cutoffs_like_brute_force(spark):
    rows = spark.createDataFrame(labelled(), "doc_id long, text string, lang string, quality int")
    labels = rows.select("doc_id", "quality").distinct()
    measured = quality.metrics(rows.drop("quality")).drop("text").cache()
    found = quality.trials(measured, labels).collect()
    assert len(found) == len({(r[1], r[2]) for r in labelled()})  # copies are one trial
    want = brute_cutoffs([(r._stratum, r._good, r._half, {x: r[x] for x in quality.RULES}) for r in found])
    got = {r._stratum: {x: r[x] for x in quality.RULES if r[x] is not None} for r in quality.cutoffs(measured, labels).collect()}
    assert got == want and len(got["en"]) >= 2 and got[None] and "xx" not in got
    chosen = {(r.doc_id, r.lang): r.kept for r in quality.verdicts(measured, quality.cutoffs(measured, labels)).collect()}
    scores = {(r.doc_id, r.lang): r for r in measured.select("doc_id", "lang", *(c.alias(x) for x, c in quality.scores().items())).collect()}
    assert all(kept == (not any(scores[k][x] > c for x, c in want.get(k[1], {}).items())) for k, kept in chosen.items())


def test_cutoffs_are_certified(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", 1) for i in range(900)]
    bad = [(1000 + i, " ".join(f"w{i}y{j}$$$" for j in range(20)), "en", 0) for i in range(100)]
    few = [(2000 + i, " ".join(f"w{i}z{j}###" for j in range(20)), "xx", 0) for i in range(30)]
    rows = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, quality int")
    got = quality.judge(rows.drop("quality"), rows.select("doc_id", "quality")).collect()
    assert all(r.kept for r in got if r.doc_id < 1000)
    assert not any(r.kept for r in got if 1000 <= r.doc_id < 2000)
    assert all(r.kept for r in got if r.doc_id >= 2000)  # too few labels to certify anything
    kept = quality.keep_good(rows.drop("quality"), rows.select("doc_id", "quality"))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 930


def test_names_that_clash(spark, docs):
    more = docs.select("*", F.lit(7).alias("_text"), F.lit(8).alias("kept"), F.lit(9).alias("_stratum"), F.lit(-1.0).alias("word_chars"))
    kept = quality.keep_good(more, spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    assert kept.columns == more.columns
    assert {(r._text, r.kept, r._stratum, r.word_chars, r.n_words) for r in kept.collect()} == {(7, 8, 9, -1.0, 2.0)}
