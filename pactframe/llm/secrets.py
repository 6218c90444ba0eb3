"""Secret scan: candidates by patterns, false positives removed by a random forest. Everything on rows is a SQL expression.

1. ``FIND`` splits a whole text into gaps and candidates in one pass: private key blocks, values assigned to a telling name, log-in data in URLs,
   and runs of ``RUN`` or more token characters.
2. Each candidate gets the features of ``FEATURES``: its length, how its characters change class and spread, how much of it dictionary words
   cover, path signs in it and in the path of its document, and words next to it.
3. A random forest, trained on labelled findings, gives each candidate a score; below ``cutoff`` it is a false positive. The trees are grown on the driver from the
   bounded labelled findings (at most ``sample``, those of the smallest hashes) and become nested CASE expressions.

Labelled findings are a parameter with columns (text, path, secret): a snippet whose first candidate is the finding. Without it, those of
``secret_labels`` are used, which are made from written-down forms of secrets and of look-alikes.

Defined results: null, empty and clean texts have no findings; whole texts are searched; a finding's ``start`` counts code points from 0; findings of a text don't
overlap; repeated rows have their findings each; null ids stay null; a null path is empty; a score that equals the cutoff is a secret; other columns
are ignored or kept as they are; empty tables give empty results.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactframe.llm.common import fresh_name
from pactframe.llm.secret_labels import labelled

#: Characters of a run; of context looked at on either side; labelled findings learned from at most; trees, their depth and the rows of a leaf.
RUN, AROUND, SAMPLE, TREES, DEPTH, LEAF = 16, 48, 20_000, 30, 8, 2
CUTOFF = 0.5

# Telling names, token characters, and the pattern of candidates.
NAMES = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?key|credential|bearer"
CHARS = "A-Za-z0-9_+/.-"
PEM = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\\s]*+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?"
LOGIN = "(?<=://)[^\\s/:@\"'<>]{1,64}:[^\\s/@\"'<>]{1,256}(?=@)"
ASSIGNED = f"(?i:{NAMES})[A-Za-z0-9_-]{{0,20}}+[\"']?\\s{{0,3}}(?:=>|:=|[:=])\\s{{0,3}}[\"']?[^\\s\"'<>,;]{{6,}}+"
TOKENS = f"(?<![{CHARS}])[{CHARS}]{{{RUN},}}+={{0,2}}"
FIND = f"{PEM}|{LOGIN}|{ASSIGNED}|{TOKENS}"
#: Before the value of an assignment.
HEAD = f"^(?i:{NAMES})[A-Za-z0-9_-]{{0,20}}+[\"']?\\s{{0,3}}(?:=>|:=|[:=])\\s{{0,3}}[\"']?"
KNOWN = "^(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{16}|^gh[pousr]_[A-Za-z0-9]{30,}|^github_pat_|^xox[abprs]-|^sk-[A-Za-z0-9-]{20,}|^[sr]k_(?:live|test)_|^AIza[A-Za-z0-9_-]{30,}|^glpat-|^npm_[A-Za-z0-9]{30,}|^eyJ[A-Za-z0-9_-]{10,}[.]eyJ|^-----BEGIN |^hf_[A-Za-z]{30,}|^SG[.][A-Za-z0-9_-]{16,}"
WORDS = "the and ing ion ent her ere ver ter tion that with this from have not you are was his who all one our out can has had how its may new now old see two way use some time like into than then them would about there their which when what example sample dummy test demo fake changeme placeholder password secret token your user admin name home file path data code page index image public static content main build src lib bin usr var etc com org net www http https html default value null none true false undefined replace insert here foo bar baz hello world key api access service client server config update version release install package module function class return string number"
NEAR = "pass|pwd|secret|token|api.?key|access.?key|credential|auth|bearer|private|login"
CALM = "sha|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|version|serial|isbn|order|invoice|example|sample|dummy|placeholder|fake|test|integrity|fingerprint|build|card|phone|account|number"
FEATURES = "length changes letters digits uppers hexadecimal distinct entropy dictionary vowels slashes extension test_path near_before near_after calm_before calm_after named assigned quoted known placeholder".split()


def features(value: Column, left: Column, right: Column, whole: Column, path: Column) -> list[Column]:
    """Of a candidate, as doubles in the order of ``FEATURES``."""
    n = F.greatest(F.length(value), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    chars = F.split(F.left(value, F.lit(4096)), "")
    short = F.greatest(F.least(n, F.lit(4096)), F.lit(1))
    kinds = F.array_distinct(chars)
    head = F.left(value, F.lit(4096))

    def spread(x: Column) -> Column:
        p = (short - F.length(F.replace(head, x, F.lit("")))) / short
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    lower = F.lower(value)
    words = "|".join(sorted(WORDS.split(), key=len, reverse=True))
    found = {
        "length": F.log2(n),
        "changes": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "letters": share("[A-Za-z]"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hexadecimal": F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0),
        "distinct": F.size(kinds) / short,
        "entropy": F.aggregate(kinds, F.lit(0.0), lambda acc, x: acc + spread(x)),
        "dictionary": (n - F.length(F.regexp_replace(lower, words, ""))) / n,
        "vowels": share("[aeiouAEIOU]"),
        "slashes": share("/"),
        "extension": F.when(value.rlike("[.][a-z]{2,4}$|^/|^[.]{1,2}/|^www[.]"), 1.0).otherwise(0.0),
        "test_path": F.when(F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|sample|fixture|mock|docs?/"), 1.0).otherwise(0.0),
        "near_before": F.least(F.regexp_count(F.lower(left), F.lit(NEAR)), F.lit(3)).cast("double"),
        "near_after": F.least(F.regexp_count(F.lower(right), F.lit(NEAR)), F.lit(3)).cast("double"),
        "calm_before": F.least(F.regexp_count(F.lower(left), F.lit(CALM)), F.lit(3)).cast("double"),
        "calm_after": F.least(F.regexp_count(F.lower(right), F.lit(CALM)), F.lit(3)).cast("double"),
        "named": F.when(whole.rlike(HEAD), 1.0).otherwise(0.0),
        "assigned": F.when(whole.rlike(HEAD) | left.rlike("[=:]\\s{0,3}[\"']?$"), 1.0).otherwise(0.0),
        "quoted": F.when(left.rlike("[\"'`]$") | whole.rlike("[=:]\\s{0,3}[\"']"), 1.0).otherwise(0.0),
        "known": F.when(value.rlike(KNOWN), 1.0).otherwise(0.0),
        "placeholder": F.when(lower.rlike("x{4,}|[*]{3,}|[.]{3,}|example|changeme|placeholder|your[_-]|dummy|redacted|(.)\\1{7,}|^[$%{(<]|12345678|abcdefgh"), 1.0).otherwise(0.0),
    }
    return [F.coalesce(found[x].cast("double"), F.lit(0.0)).alias(x) for x in FEATURES]


def pieces(text: Column) -> tuple[Column, Column]:
    """(gaps, candidates) of a text, as many of both: a gap stands before each candidate. What follows the last one belongs to neither."""
    pattern = f"(?s)\\G(.*?)({FIND})"
    body = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2))


def value_of(whole: Column) -> Column:
    """The candidate without the name it is assigned to."""
    return F.regexp_replace(whole, HEAD, "")


class Forest:
    """Trees as (feature, limit, low, high) or shares of secrets in leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        if not len(y) or y.min() == y.max():  # nothing to tell apart
            self.trees = [float(y.mean()) if len(y) else 0.5]
            return
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], DEPTH, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
            if not len(at):
                continue
            a, b = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(y) - at)
            gini = at * a * (1 - a) + (len(y) - at) * b * (1 - b)
            i = int(np.argmin(gini))
            if best is None or gini[i] < best[0]:
                best = (gini[i], int(f), float((v[at[i] - 1] + v[at[i]]) / 2))
        if best is None:
            return float(y.mean())
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1, rng), self._grow(x[~low], y[~low], depth - 1, rng)

    def column(self, f: Column) -> Column:
        """The score, from an array of features."""

        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(F.get(f, F.lit(node[0])) <= node[1], of(node[2])).otherwise(of(node[3]))

        total = of(self.trees[0])
        for t in self.trees[1:]:
            total = total + of(t)
        return total / len(self.trees)


def own_labels(spark: SparkSession) -> DataFrame:
    """The findings of ``secret_labels`` as a table."""
    rows = json.dumps([{"text": t, "path": p, "secret": s} for t, p, s in labelled()])
    kind = "array<struct<text:string,path:string,secret:boolean>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))


def fit(spark: SparkSession, findings: DataFrame | None = None, *, sample: int = SAMPLE) -> Forest:
    """Learn from labelled findings; those without a candidate, a text or a label don't count."""
    rows = (own_labels(spark) if findings is None else findings).filter("text is not null and secret is not null").select("text", "path", "secret").orderBy(F.xxhash64("text", "path"), "text", "path", "secret").limit(sample)
    gaps, found = pieces(F.col("text"))
    rows = rows.select("text", "path", "secret", gaps.alias("g"), found.alias("c")).filter(F.size("c") > 0)
    left, whole = F.right(F.col("g")[0], F.lit(AROUND)), F.col("c")[0]
    rows = rows.select("path", "secret", whole.alias("whole"), left.alias("left"), F.left(F.substring("text", F.length(F.col("g")[0]) + F.length(whole) + 1, F.lit(AROUND)), F.lit(AROUND)).alias("right"))
    got = rows.select(F.array(*features(value_of(F.col("whole")), F.col("left"), F.col("right"), F.col("whole"), F.col("path"))).alias("f"), F.col("secret").cast("int").alias("y")).collect()
    return Forest(np.array([r.f for r in got], float).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], int))


def candidates(docs: DataFrame, forest: Forest, *, text_col: str = "text", path_col: str | None = None, keep_cols: list[str]) -> DataFrame:
    """(keep_cols, start, length, value, score): a row for each candidate."""
    row = F.monotonically_increasing_id()
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    gaps, found = pieces(F.col(text_col))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep_cols)], path.alias("path"), F.col(text_col).alias("text"), gaps.alias("g"), found.alias("c"))
    # contexts are cut out before the arrays are taken apart, so that texts don't multiply
    used = F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate("g", F.lit(0), lambda a, x: a + F.length(x))
    after = F.concat(F.transform(F.slice("g", F.lit(2), F.size("g")), lambda x: F.left(x, F.lit(AROUND))), F.array(F.left(F.substring(F.col("text"), used + 1, F.lit(AROUND)), F.lit(AROUND))))
    rows = rows.withColumn("after", after)
    parts = F.transform("c", lambda x, i: F.struct(x.alias("whole"), F.length(F.get("g", i)).alias("gap"), F.right(F.get("g", i), F.lit(AROUND)).alias("left"), F.get("after", i).alias("right")))
    keys = [f"k{i}" for i in range(len(keep_cols))]
    rows = rows.select(*keys, "path", parts.alias("parts")).withColumn("row", row).select(*keys, "path", "row", F.posexplode_outer("parts").alias("at", "p"))
    # the outer form and this filter keep the patterns from being run a second time to find texts without candidates
    rows = rows.filter("at is not null").select(*keys, "path", "row", "at", "p.*")
    scored = rows.withColumn("value", value_of(F.col("whole"))).withColumn("f", F.array(*features(F.col("value"), F.col("left"), F.col("right"), F.col("whole"), F.col("path"))))
    scored = scored.withColumn("score", forest.column(F.col("f"))).drop("f", "left", "right", "path")
    # where a candidate ends: gaps and candidates of its row up to it; a row's candidates are part of one text
    end = F.sum(F.col("gap") + F.length("whole")).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = scored.withColumn("end", end)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep_cols)], (F.col("end") - F.length("value")).cast("long").alias("start"), F.length("value").cast("long").alias("length"), "value", "score")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, findings: DataFrame | None = None, cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """(id, start, length, kind, value, score): a row for each secret."""
    forest = fit(docs.sparkSession, findings, sample=sample)
    found = candidates(docs, forest, text_col=text_col, path_col=path_col, keep_cols=[id_col]).filter(F.col("score") >= cutoff)
    kind = F.when(F.col("value").startswith("-----BEGIN"), "private_key").when(F.col("value").rlike(KNOWN), "known_format").when(F.col("value").rlike("^[0-9A-Fa-f]+$"), "hexadecimal").otherwise("other")
    return found.select(id_col, "start", "length", kind.alias("kind"), "value", "score")


def redact(docs: DataFrame, *, text_col: str = "text", path_col: str | None = None, findings: DataFrame | None = None, cutoff: float = CUTOFF, mark: str = "[SECRET]", length_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by ``mark``; ``length_col``, where given, is the text's new length. No row is dropped or moved."""
    forest = fit(docs.sparkSession, findings, sample=sample)
    work = {k: fresh_name(docs, f"__{k}") for k in ("gaps", "found", "after")}
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    text, (gaps, found) = F.col(text_col), pieces(F.col(text_col))
    rows = docs.withColumn(work["gaps"], gaps).withColumn(work["found"], found)
    g, c = F.col(work["gaps"]), F.col(work["found"])
    used = F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(g, F.lit(0), lambda a, x: a + F.length(x))
    tail = F.substring(text, used + 1, F.length(text))
    after = F.concat(F.transform(F.slice(g, F.lit(2), F.size(g)), lambda x: F.left(x, F.lit(AROUND))), F.array(F.left(tail, F.lit(AROUND))))
    rows = rows.withColumn(work["after"], F.when(F.size(c) > 0, after))

    def one(x: Column, i: Column) -> Column:
        value = value_of(x)
        # an array of one struct, so that a value and its features are worked out once
        scores = F.transform(F.array(F.array(*features(value, F.right(F.get(g, i), F.lit(AROUND)), F.get(F.col(work["after"]), i), x, path))), forest.column)
        return F.concat(F.get(g, i), F.when(F.get(scores, F.lit(0)) >= cutoff, F.concat(F.left(x, F.length(x) - F.length(value)), F.lit(mark))).otherwise(x))

    new = F.when(F.size(c) > 0, F.concat(F.array_join(F.transform(c, one), ""), tail)).otherwise(text)
    rows = rows.withColumn(text_col, new)
    if length_col:
        rows = rows.withColumn(length_col, F.when(F.size(c) > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*docs.columns)
