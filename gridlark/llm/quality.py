"""Quality rules whose cutoffs carry a guarantee, in DataFrame and SQL functions only.

Every rule is a score that is high for bad documents. The distinct labelled texts of a stratum are dealt into
two halves by a hash. One half proposes: per rule the cutoff with the best balance of bad and good rejections,
rules ordered by that balance. The other half certifies whole verdicts: the first rule alone, the first two
together and so on, each against the null hypothesis that the verdict rejects more than `alpha` of the good
documents, by the exact binomial tail at delta / strata. Every verdict rejects all that the one before does, so
testing stops at the first that fails (fixed-sequence testing; Bonferroni across strata): with probability
1 - delta no stratum loses more than alpha of its good documents to all chosen cutoffs together.

Null texts have no words and fail the base rules, as empty ones do. A null stratum is a stratum of
its own; one without enough labels has no cutoffs, so only the base rules act there. Repeated rows
are judged alike and are one trial, and so are equal texts; a text or key with several labels counts as bad if any
says so. An empty labels table leaves the base rules alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, temporary

#: Rules and their cutoffs, lenient first. A score above the cutoff rejects.
RULES: dict[str, list[float]] = {
    "symbol_ratio": [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "word_length": [20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0],
}
#: Largest share of a stratum's good documents that all cutoffs together may reject, and the chance of breaking that anywhere.
ALPHA, DELTA = 0.01, 0.05
#: Bad rejections that one good rejection outweighs.
GOOD_COSTS = 10

#: Distinct names, so that columns of the input can't clash.
_METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts, `_lines` and `_upper`; whole texts, inside the JVM.

    `_once` is never negative. Conditions on the counts ask that too: as a column without a fixed value,
    it keeps the optimizer from moving the condition below the counts, which would compute them twice.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # One-element arrays bind a value to a name: an expression named inside a lambda would run again for every element.
    first = df.withColumns({"_text": whole, "_words": words, "_kept_lines": lines})
    hashes = F.expr("transform(array(_words), w -> if(size(w) < 6, array(), transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))))[0]")
    second = first.withColumn("_hashes", hashes)
    repeated = F.expr(
        """transform(array(array_sort(transform(_hashes, (h, i) -> struct(h, i)))), s ->
             aggregate(
               array_sort(transform(filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false)), x -> x.i)),
               struct(0L as covered, -5 as last),
               (a, p) -> struct(a.covered + least(5, p - a.last) as covered, p as last),
               a -> a.covered))[0]"""
    )
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_kept_lines") - F.size(F.array_distinct("_kept_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), F.lit(0)).otherwise(repeated).cast("long"),
        "_lines": F.size("_kept_lines").cast("long"),
        "_upper": F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long"),
        "_same": F.xxhash64("_text"),
        "_once": F.monotonically_increasing_id(),
    }
    return second.withColumns(out).drop("_text", "_words", "_kept_lines", "_hashes")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """The rules' scores; documents without words or lines score 0."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbol_ratio": per(F.col("n_symbols"), n),
        "upper_ratio": per(F.col("_upper"), chars),
        "dup_line_ratio": per(F.col("n_dup_lines"), F.col("_lines")),
        "repeat_ratio": per(F.col("n_repeat_words"), n),
        "word_length": per(chars, n),
    }


#: P(Bin(n, alpha) <= k) as a running log sum; terms follow from one another, so nothing overflows.
TAIL = """
case when k >= n * {alpha} then 1D
     when k = 0 then exp(n * ln(1 - {alpha}))
     else exp(aggregate(sequence(1L, k), struct(n * ln(1 - {alpha}) as t, n * ln(1 - {alpha}) as s),
       (a, i) -> transform(array(a.t + ln((n - i + 1D) / i) + ln({alpha} / (1 - {alpha}))), t -> struct(t as t, greatest(a.s, t) + ln(1 + exp(-abs(a.s - t))) as s))[0],
       a -> a.s)) end"""


def trials(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """_stratum, _good, _half and the rules' scores of every distinct labelled text that passes the base rules."""
    judged = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_good"))
    rows = measured.where(~base_failed() & (F.col("_once") >= 0)).select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), "_same", *(c.alias(r) for r, c in scores().items()))
    distinct = rows.join(judged, "_key").groupBy("_stratum", "_same").agg((F.min("_good") == 1).alias("_good"), *(F.max(r).alias(r) for r in RULES))
    return distinct.withColumn("_half", F.pmod(F.xxhash64("_same", F.lit("half")), F.lit(2)))


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """_stratum and one column per rule: the certified cutoff, or null."""
    known = stash(trials(measured, labels, key, stratum, label), "trials")
    counts = []
    for rule, cuts in RULES.items():
        for i, cut in enumerate(cuts):
            counts += [F.count(F.when((F.col(rule) > cut) & kind, 1)).alias(f"{name}_{rule}_{i}") for name, kind in (("g", F.col("_good")), ("b", ~F.col("_good")))]
    counted = known.where("_half = 0").groupBy("_stratum").agg(F.count(F.when(F.col("_good"), 1)).alias("n"), *counts)
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cut"), F.col(f"g_{r}_{i}").alias("k"), F.col(f"b_{r}_{i}").alias("bad")) for r, cuts in RULES.items() for i, c in enumerate(cuts)))
    gain = F.col("bad") - GOOD_COSTS * F.col("k")
    proposed = counted.select("_stratum", "n", F.inline(steps)).where((gain > 0) & (F.col("k") <= alpha * F.col("n")))
    best = proposed.groupBy("_stratum", "rule").agg(F.max_by(F.struct("cut", gain.alias("gain")), F.struct(gain, -F.col("step"))).alias("best"))
    order = Window.partitionBy("_stratum").orderBy(F.desc("best.gain"), "rule")  # the rules, a few rows
    ranked = best.select("_stratum", "rule", "best.cut", F.row_number().over(order).alias("rank"))
    wide = stash(ranked.groupBy("_stratum").pivot("rule", list(RULES)).agg(F.first("cut").alias("cut"), F.first("rank").alias("rank")), "proposed")
    # The first of the ordered rules that rejects a text; the verdict of the first j rules rejects it if that is j or less.
    first = F.least(*(F.when(F.col(r) > F.col(f"{r}_cut"), F.col(f"{r}_rank")) for r in RULES))
    tried = known.where("_half = 1 and _good").join(wide.withColumnRenamed("_stratum", "_of"), F.col("_stratum").eqNullSafe(F.col("_of")), "left").withColumn("_first", first)
    tested = tried.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("_first") <= j, 1)).alias(f"k{j}") for j in range(1, len(RULES) + 1)))
    tested = tested.withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy()))  # over the strata, a few rows
    verdict = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"k{j}").alias("k")) for j in range(1, len(RULES) + 1)))
    # Rejections grow with j and the tail with them, so all verdicts before one that holds hold as well.
    holds = tested.select("_stratum", "_strata", "n", F.inline(verdict)).where(F.expr(TAIL.format(alpha=f"{alpha!r}D")) <= delta / F.col("_strata"))
    last = holds.groupBy(F.col("_stratum").alias("_of")).agg(F.max("j").alias("_last"))
    certified = wide.join(last, F.col("_stratum").eqNullSafe(F.col("_of")))
    return certified.select("_stratum", *(F.when(F.col(f"{r}_rank") <= F.col("_last"), F.col(f"{r}_cut")).alias(r) for r in RULES))


def verdicts(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with base_failed and kept. The few cutoffs are joined by stratum; their size decides how."""
    cuts = chosen.select(F.col("_stratum").alias("_of"), *(F.col(r).alias(f"_cut_{r}") for r in RULES))
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("_of")), "left")
    above = [F.coalesce(c > F.col(f"_cut_{r}"), F.lit(False)) for r, c in scores().items()]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_of", *(f"_cut_{r}" for r in RULES))


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """key, the base counts, base_failed and kept of every row."""
    measured = stash(metrics(df.select(key, stratum, text), text).drop(text), "quality")
    with temporary() as keep:
        chosen = keep(cutoffs(measured, labels, key, stratum), "cutoffs")
    return verdicts(measured, chosen, stratum).select(key, *_METRICS, "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """The rows of df that are kept, with the columns of df, whatever their names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    key, stratum, text = (names[df.columns.index(x)] for x in (key, stratum, text))
    measured = stash(metrics(df.toDF(*names), text), "quality")  # with the rows, so that nothing is counted twice
    with temporary() as keep:
        chosen = keep(cutoffs(measured, labels.withColumnRenamed(df.columns[names.index(key)], key), key, stratum), "cutoffs")
    return verdicts(measured, chosen, stratum).where("kept").select(*names).toDF(*df.columns)
