"""Quality rules whose cutoffs come from labelled holdouts, with exact binomial bounds.

1. Each text gives base counts and, from them, the metrics of ``RULES``. A rule rejects a text whose metric lies above the
   rule's cutoff in the text's stratum (its language).
2. Cutoffs may be used in a stratum only if the holdout certifies them together: with n good documents there, k of them rejected by any rule, the
   exact binomial probability of k or fewer rejections at a rate of ``risk`` must not be above the level of the test, ``delta`` divided by the number
   of strata (Bonferroni). Tested is one fixed sequence, from lax to strict: the first rule's grid, then the second's with the first at its strictest,
   and so on; testing ends at the first failure (fixed-sequence testing, which needs no correction along the sequence). With four strata and no
   good document lost that takes 217 good documents.
3. In that sequence a rule that good documents break keeps the later ones from use. So strata large enough to certify rules one by one (each at
   ``risk / rules``, level over the number of rules) get half the level for that and half for the sequence; which it is depends on n alone. Either way
   with probability 1 - delta no stratum loses more than the share ``risk`` of its good documents, all its rules taken together.
4. Of the certified cutoffs those with the most low-quality documents rejected per good one lost are used (``PENALTY`` bad ones weigh as
   much as a good one), the laxest at a tie, the sequence's at a tie with the single ones; a rule without use or certificate doesn't reject.
   ``report`` tells what the rules leave.

Holdout units are texts, not rows: exact copies count once, as good if any label calls them so.

Defined results: null texts are empty (all counts 0, base failed); null labels and labels of unknown ids don't count; an id with several labels
is good if one is; a null stratum is a stratum; without labels no cutoff is certified and the base rules decide alone. Whole texts count;
repeated rows give repeated rows; other columns are ignored or kept as they are; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import cut, extend, fresh_name, importable

SIZE = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Rule -> counts whose quotient is the metric. Grids go from lax to strict and don't depend on the data.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
GRIDS = {"symbols": [x / 200 for x in range(100, 0, -1)], "dup_lines": [x / 50 for x in range(49, 0, -1)], "repeats": [x / 200 for x in range(60, 0, -1)], "word_length": [40 * 0.97**x for x in range(60)]}
RISK, DELTA, PENALTY = 0.02, 0.05, 10
#: Rows of five columns that are broadcast at most.
STRATA = 10_000


def repeat_words(ids: np.ndarray) -> int:
    """Words inside windows of ``SIZE`` that occur twice or more; exact, by ranking windows of 2, 4 and 5 words."""
    n = len(ids) - SIZE + 1
    if n < 2:
        return 0
    two = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    _, five, times = np.unique(four[:n] * (int(ids.max()) + 1) + ids[SIZE - 1 :], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[five] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + SIZE, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> dict[str, int]:
    """The base counts of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        # a text without a repeated word has no repeated window
        "n_repeat_words": repeat_words(ids) if len(index) < len(words) else 0,
        "n_lines": len(lines),
    }


def measured(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    return extend(docs, text_col, lambda texts: list(map(measure, texts)), COUNTS, name)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def metric(m: str, rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.coalesce(F.try_divide(F.col(f"{m}.{top}").cast("double"), F.col(f"{m}.{bottom}")), F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial in n trials of probability p."""
    if k >= n:
        return 1.0
    step, total = math.log1p(-p) * n, 0.0  # log of P(X = 0)
    terms = []
    for j in range(k + 1):
        terms.append(step)
        step += math.log(n - j) - math.log(j + 1) + math.log(p) - math.log1p(-p)
    most = max(terms)
    total = math.fsum(math.exp(t - most) for t in terms)
    return min(1.0, total * math.exp(most))


def choose(good: list[int], bad: list[int], n_good: int, rate: float, level: float, penalty: float = PENALTY) -> int | None:
    """Place in the grid of the cutoff to use; ``good`` and ``bad`` are the documents rejected at each cutoff, lax to strict."""
    best, most = None, 0.0
    for i, (g, b) in enumerate(zip(good, bad)):
        # beyond the mean rate the tail is about a half or more: no level allows that
        if g > rate * n_good or binomial_tail(g, n_good, rate) > level:
            break
        if b - penalty * g > most:
            best, most = i, b - penalty * g
    return best


def single(n_good: int, risk: float, level: float) -> tuple[bool, float]:
    """Whether rules are certified one by one too, and the level of the sequence (and, together, of the rules one by one)."""
    alone = binomial_tail(0, n_good, risk / len(RULES)) <= level / 2 / len(RULES)
    return alone, level / 2 if alone else level


def cutoffs(measured_holdout: DataFrame, *, risk: float = RISK, delta: float = DELTA, penalty: float = PENALTY) -> DataFrame:
    """(stratum, <rule> double, ...): a row for each stratum, null where a rule doesn't reject. ``measured_holdout`` has (stratum, good boolean,
    <rule> double, ...), a row for each text. Per stratum only the histograms over the grids and the sequence leave the tasks."""
    importable(measured_holdout.sparkSession)
    # place of a metric: how many cutoffs of the grid it exceeds, counted from the strict end, so that cutoff i rejects places >= len - i

    def place(rule: str) -> Column:
        return F.size(F.filter(F.lit(GRIDS[rule]), lambda c: F.col(rule) > c))

    # where the sequence first rejects a text: at its place in the first rule with a cutoff it exceeds
    first, step = 0, []
    for r in RULES:
        step.append(F.when(place(r) > 0, F.lit(first + len(GRIDS[r])) - place(r)))
        first += len(GRIDS[r])
    joint = F.coalesce(*step, F.lit(first)).cast("int")
    at = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), place(r).alias("place")) for r in RULES], F.struct(F.lit("").alias("rule"), joint.alias("place"))))
    bins = measured_holdout.select("stratum", "good", at.alias("x")).groupBy("stratum", "x.rule", "x.place").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    # one row per stratum, rule and place of a fixed grid
    bins = cut(bins)
    n_strata = max(1, bins.select(F.count_distinct(F.struct("stratum")).alias("n")).first().n)
    names, grids, steps = list(RULES), GRIDS, first

    def of(pdf):
        import pandas as pd

        out = {"stratum": [pdf["stratum"].iloc[0]]}

        def counts(rule, size):
            """Good and bad texts at each place."""
            part = pdf[pdf["rule"] == rule]
            g, b = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
            g[part["place"]], b[part["place"]] = part["good"], part["bad"]
            return g, b

        g, b = counts("", steps)
        n = int(g.sum())
        alone, level = single(n, risk, delta / n_strata)
        i = choose(np.cumsum(g)[:steps].tolist(), np.cumsum(b)[:steps].tolist(), n, risk, level, penalty)
        for r in names:
            # the step's rule is at the step's place, those before at their strictest, those after don't reject
            k = None if i is None or i < 0 else min(i, len(grids[r]) - 1)
            out[f"joint_{r}"] = [None if k is None else grids[r][k]]
            i = None if i is None else i - len(grids[r])
        for r in names:
            i = None
            if alone:
                size = len(grids[r])
                # the laxest cutoff (grid place 0) is exceeded by texts that exceed all of them
                above_g, above_b = (np.cumsum(x[::-1])[:size].tolist() for x in counts(r, size))
                i = choose(above_g, above_b, n, risk / len(names), level / len(names), penalty)
            out[f"single_{r}"] = [None if i is None else grids[r][i]]
        return pd.DataFrame(out).astype({c: "float64" for c in out if c != "stratum"})

    made = [f"{kind}_{r}" for kind in ("joint", "single") for r in names]
    found = bins.groupBy("stratum").applyInPandas(of, f"stratum {dict(bins.dtypes)['stratum']}, " + ", ".join(f"{c} double" for c in made))
    # pandas has NaN for null, and it may have lost what a null stratum is
    found = cut(found.select("stratum", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in made]))
    # how good and bad texts fare under either set of cutoffs
    units = measured_holdout.join(found.select(F.col("stratum").alias("of"), *made), F.col("stratum").eqNullSafe(F.col("of")))

    def worth(kind: str) -> Column:
        hit = reduce(lambda a, r: a | F.coalesce(F.col(r) > F.col(f"{kind}_{r}"), F.lit(False)), names, F.lit(False))
        return F.sum(F.when(~hit, 0.0).when(F.col("good"), -float(penalty)).otherwise(1.0)).alias(kind)

    worths = units.groupBy("stratum").agg(worth("joint"), worth("single")).select(F.col("stratum").alias("of"), (F.col("single") > F.col("joint")).alias("better"))
    found = found.join(worths, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return found.select("stratum", *[F.when(F.col("better"), F.col(f"single_{r}")).otherwise(F.col(f"joint_{r}")).alias(r) for r in names])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", **params) -> DataFrame:
    """``cutoffs`` of the strata from labelled documents (label 1: good)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    m = measured(rows, "text", "m").select("id", "stratum", F.xxhash64("text").alias("key"), *[metric("m", r).alias(r) for r in RULES])
    units = m.join(known, "id").groupBy("stratum", "key").agg(F.max("good").alias("good"), *[F.first(r).alias(r) for r in RULES])
    return cutoffs(units, **params)


def verdict(rows: DataFrame, found: DataFrame, stratum_col: str, m: str, name: str) -> DataFrame:
    """``rows`` and a boolean ``name``: kept by base rules and cutoffs. ``found`` has a row per stratum; up to ``STRATA`` of them are broadcast, so that
    the rows stay where they are, more are joined by stratum."""
    found = cut(found)
    if found.count() <= STRATA:
        found = F.broadcast(found)
    other = found.select(F.struct("*").alias(fresh_name(rows, "__cutoffs")))
    c = other.columns[0]
    joined = rows.join(other, rows[stratum_col].eqNullSafe(other[f"{c}.stratum"]), "left")
    rejects = reduce(lambda a, r: a | F.coalesce(metric(m, r) > F.col(f"{c}.{r}"), F.lit(False)), RULES, F.lit(False))
    return joined.withColumn(name, ~(base_failed(m) | rejects)).drop(c)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **params) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    m = measured(rows, "text", "m").select("id", "stratum", "m", F.xxhash64("text").alias("key"))
    m = cut(m)  # small rows: a text is read and measured once for the holdout and the verdicts
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("quality") == 1).alias("good"))
    units = m.join(known, "id").groupBy("stratum", "key").agg(F.max("good").alias("good"), *[F.first(metric("m", r)).alias(r) for r in RULES])
    out = verdict(m, cutoffs(units, **params), "stratum", "m", "kept")
    return out.select(F.col("id").alias(id_col), "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", base_failed("m").alias("base_failed"), "kept")


def report(judged: DataFrame, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """(stratum, n_good, n_bad, good_base_failed, bad_base_failed, good_kept, bad_kept): labelled rows of ``judge``'s result, a row for each stratum."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("quality") == 1).alias("good"))
    # rows that repeat an id may differ in text or stratum: each id counts once in each of its strata, as kept if a row of it is
    strata = docs.select(id_col, F.col(stratum_col).alias("stratum")).distinct()
    ids = judged.groupBy(id_col).agg(F.min("base_failed").alias("base_failed"), F.max("kept").alias("kept"))
    rows = known.join(ids, id_col).join(strata, id_col)
    counts = {"n": F.lit(True), "base_failed": F.col("base_failed"), "kept": F.col("kept")}
    named = {"n": ("n_good", "n_bad"), "base_failed": ("good_base_failed", "bad_base_failed"), "kept": ("good_kept", "bad_kept")}
    return rows.groupBy("stratum").agg(*[F.count_if(c & (F.col("good") if i == 0 else ~F.col("good"))).alias(named[k][i]) for k, c in counts.items() for i in (0, 1)])


def keep(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", stratum_col: str = "lang", **params) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    found = cut(learn(docs, labels, text_col=text_col, stratum_col=stratum_col, **params))
    m = fresh_name(docs, "__measured")
    rows = measured(docs, text_col, m)
    kept = fresh_name(rows, "__kept")
    return verdict(rows, found, stratum_col, m, kept).filter(F.col(kept)).drop(m, kept)
