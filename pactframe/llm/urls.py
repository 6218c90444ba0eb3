"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules are ``(host, path prefix, verdict)``; one fits its host and all subdomains if the path starts with its prefix, and of those that fit the longest
(host and path together, then the smaller text) wins. They are applied with built-in expressions: a look-up of the host and its parent domains.

What no rule decides is judged by boosted trees over features of the URL's text: length, depth, digit ratio, entropy, parameter
counts, hyphens, and statistics of the suffix, the first path segment and the host's words (smoothed block rates learned from the labelled URLs; of
the words the highest counts). Trees are grown on histograms of the features with second-order gains. Labelled URLs are whatever (url, blocked) rows
the caller has; the registered query takes the fixed list of ``url_labels``, never the verdicts of its rules, as those tell nothing on the URLs that
no rule decides. From the list, statistics are learned out of fold by host, so that trees see them as they are for unknown hosts. The fit runs on the driver over at most ``SAMPLE`` labelled URLs (the smallest hashes); scoring covers
every row. Statistics cover every suffix, name, whole segment and word of the labelled URLs; unknown ones get the mean. A score of exactly 1/2 blocks.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule, and is judged like any other; whole URLs count; null labels
don't count; without labels of both kinds the verdict is the kind there is, ``allow`` without any. Repeated rows give repeated rows; other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.llm import url_labels
from pactframe.llm.common import map_rows

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 4, 0.15, 32, 20, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
_LOWERED = str.maketrans(UPPER, LOWER)
STATISTICS = ("suffix", "domain", "segment", "words")
FEATURES = ("length", "host_length", "labels", "depth", "path_length", "digits", "letters", "hyphens", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "extension", "secure", "www", *STATISTICS)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        hit = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _parts(url: str | None) -> tuple[str, str, str, str, str]:
    """(host, path, query, fragment, scheme)."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", "", "", "", ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    name, slash, way = rest.partition("/")
    return name.translate(_LOWERED), slash + way, query, fragment, scheme


def keys(url: str | None) -> tuple[str, str, str]:
    """What block rates are kept for: suffix, registered name, suffix with the first segment."""
    name, way, *_ = _parts(url)
    labels = name.rsplit(".", 2)
    segment = way.split("/", 2)[1] if "/" in way else ""
    return labels[-1], ".".join(labels[-2:]), f"{labels[-1]} {segment}"


def host_words(url: str | None) -> list[str]:
    """Runs of letters in the host before its suffix."""
    return sorted(set(re.findall(r"[^\W\d_]+", _parts(url)[0].rpartition(".")[0])))


def lexical(url: str | None) -> list[float]:
    text = url or ""
    name, way, query, fragment, scheme = _parts(url)
    n = max(1, len(text))
    return [
        len(text), len(name), name.count(".") + bool(name), sum(map(bool, way.split("/"))), len(way), sum(map(str.isdigit, text)) / n, sum(map(str.isalpha, text)) / n, name.count("-"), sum(map(str.isdigit, name)),
        _entropy(text), _entropy(name), query.count("&") + bool(query), len(query), len(fragment), "." in way.rsplit("/", 1)[-1], scheme.lower() == "https", name.startswith("www."),
    ]


class Boosted:
    """Boosted trees for a binary label over binned features. A node is (feature, bin, left, right) or a value."""

    def __init__(self):
        self.tables: list[dict[str, float]] = [{} for _ in STATISTICS]
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = self.mean = 0.0

    def features(self, urls: Iterable[str | None]) -> np.ndarray:
        words = self.tables[-1]
        rows = [[*lexical(u), *(t.get(k, self.mean) for t, k in zip(self.tables, keys(u))), max((words.get(w, self.mean) for w in host_words(u)), default=self.mean)] for u in urls]
        return np.array(rows, np.float64).reshape(-1, len(FEATURES))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int64) if len(x) else np.zeros((0, len(FEATURES)), np.int64)

    def margin(self, urls: Sequence[str | None]) -> np.ndarray:
        out = np.full(len(urls), self.base)
        if self.trees:
            b = self.binned(self.features(urls))
            rows = np.arange(len(urls))
            for feature, at, value in self.trees:
                node = np.zeros(len(urls), np.int64)
                for _ in range(DEPTH):  # trees are complete; a leaf above the last level repeats below
                    node = 2 * node + 1 + (b[rows, feature[node]] > at[node])
                out += value[node]
        return out

    def learn_rates(self, urls: Sequence[str | None], y: np.ndarray) -> None:
        of = [[*([k] for k in keys(u)), host_words(u)] for u in urls]
        for i in range(len(self.tables)):  # block rates, shrunk to the mean
            n, hit = Counter(x for k in of for x in k[i]), Counter(x for k, v in zip(of, y) if v for x in k[i])
            self.tables[i] = {k: (hit[k] + 10 * self.mean) / (c + 10) for k, c in n.items()}

    def fit(self, urls: Sequence[str | None], y: np.ndarray, groups: Sequence[str] | None = None) -> Boosted:
        """With ``groups`` (a text for each URL) trees are grown on rates learned from URLs of other groups."""
        self.mean = float(y.mean()) if len(y) else 0.0
        if not 0 < self.mean < 1:
            self.base = 20.0 if self.mean else -20.0
            return self
        if groups is None:
            self.learn_rates(urls, y)
            x = self.features(urls)
        else:
            x, fold = np.zeros((len(y), len(FEATURES))), np.array([zlib.crc32(g.encode()) % FOLDS for g in groups])
            for k in range(FOLDS):
                rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                self.learn_rates([urls[i] for i in rest], y[rest])
                x[own] = self.features([urls[i] for i in own])
            self.learn_rates(urls, y)
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        b, f = self.binned(x), np.full(len(y), math.log(self.mean / (1 - self.mean)))
        self.base = float(f[0])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(b, y - p, p * (1 - p))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Add a tree; returns its values for the rows."""
        size, width = 2 ** (DEPTH + 1) - 1, BINS + 1
        feature, at, value = np.zeros(size, np.int64), np.full(size, width, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, width)
                if len(rows) >= 2 * LEAF:
                    gs, hs = g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + RIDGE)
                    for i in range(b.shape[1]):
                        col = b[rows, i]
                        gl, hl, nl = (np.cumsum(np.bincount(col, w, width))[:-1] for w in (gs, hs, None))
                        gain = gl**2 / (hl + RIDGE) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + RIDGE) - whole
                        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                        if gain.max() > best[0]:
                            best = (float(gain.max()), i, int(gain.argmax()))
                feature[k], at[k] = best[1:]
                node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2])
        for k in range(2**DEPTH - 1, size):
            rows = node == k
            value[k] = RATE * g[rows].sum() / (h[rows].sum() + RIDGE)
        self.trees.append((feature, at, value))
        return value[node]


def fit(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked", sample: int = SAMPLE) -> Boosted:
    """Learn from at most ``sample`` distinct labelled URLs; one with both labels counts as blocked."""
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    got = rows.orderBy(F.xxhash64("url"), "url").limit(sample).toArrow()
    return Boosted().fit(got.column("url").to_pylist(), np.array(got.column("y").to_pylist(), np.float64))


def built_in() -> Boosted:
    """Learned from the fixed list."""
    urls, y, groups = url_labels.labelled()
    return Boosted().fit(urls, np.array(y, np.float64), groups)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row; without ``labelled`` URLs the fixed list is learned from."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    model = built_in() if labelled is None else fit(labelled, url_col=url_col, sample=sample)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for part in parts:
            m = sent.value.margin(part["url"])
            yield part | {"score": (1 / (1 + np.exp(-np.clip(m, -30, 30)))).tolist()}

    scored = map_rows(rows, run, f"id {dict(rows.dtypes)['id']}, url string, score double")
    out = scored.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    out = out.withColumn("hit", fitting(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
